"""Operators on repeated content, next to brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np

from usageweave.llm import blocks, linking, ngram_join, substring_dedup
from usageweave.llm.components import components

from conftest import prose  # noqa: I001


def brute_repeats(texts, k):
    own = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in own for i in range(len(w) - k + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(df, k):
    rows = df.select("doc_id", "text").collect()
    want = Counter(
        (r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows], k))
    )
    options = substring_dedup.SubstringOptions(k=k)
    got = substring_dedup.repeats(df, options)
    assert Counter(tuple(r)[:1] + tuple(r)[2:5] for r in got.collect()) == want
    return got


def test_repeats_equal_brute_force(spark, odd_docs, no_docs):
    check_repeats(odd_docs, 35)
    got = check_repeats(odd_docs, 5)
    left = substring_dedup.remove_repeats(odd_docs, got, 5)
    assert left.columns == odd_docs.columns and left.count() >= odd_docs.count()
    assert substring_dedup.repeats(no_docs).count() == 0


def test_own_columns_of_any_name_come_back_from_removal(spark):
    text = prose(21, 12)
    rows = [(1, text, "s1", 7, None), (2, f"x {text} y", "s2", 8, "t"), (3, None, "s3", 9, "u")]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, stretches string, text_key long, `a.b` string"
    )
    left = substring_dedup.remove_repeats(df, substring_dedup.repeats(df, substring_dedup.SubstringOptions(k=5)), 5)
    assert left.columns == df.columns
    got = sorted(tuple(r) for r in left.collect())
    assert got == [(1, "", "s1", 7, None), (2, "x y", "s2", 8, "t"), (3, "", "s3", 9, "u")]


def test_paths_that_fingerprints_do_not_part(spark, monkeypatch):
    # With one fingerprint for all edges no branch is seen but at ends of texts.
    parts = [prose(i, 8) for i in range(6)]
    rows = [
        (i, " ".join(parts[(i * 7 + j * (1 + i % 3)) % 6] for j in range(5)))
        for i in range(24)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_repeats(df, 6)
    alone = substring_dedup._kept([b"a", b"b", b"c"], [(0, 2), (1, 3)])
    assert alone == (3, b"")


def test_windows_found_once_are_left_alone(spark):
    """Paths that only share keys, not words, are compared word by word."""
    text = prose(1, 40)
    rows = spark.createDataFrame([(1, text, 11), (2, prose(2, 40), 22)], "doc_id long, text string, text_key long")
    found = spark.createDataFrame(
        [(1, 11, 40, 35, "x", [(0, 6, 2, b"p")]), (2, 22, 40, 35, "y", [(0, 6, 2, b"q")])],
        f"doc_id long, text_key long, n_words long, n_removed long, kept_sha256 string, stretches {substring_dedup.STRETCHES}",
    )
    paths = spark.createDataFrame([(1, 11, 0, 6), (1, 22, 0, 6)], "found long, text_key long, start int, edges int")
    out = {r.doc_id: r for r in substring_dedup._compared(rows, found, paths, 35).collect()}
    assert out[1].n_removed == 0 and out[1].stretches == []
    assert out[1].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    group = list(range(len(rows)))
    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                pairs += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    lowest = {}
    for (k, _), g in zip(rows, group):
        ids = [x for x in (lowest.get(g), k) if x is not None]
        lowest[g] = min(ids) if ids else None
    return Counter((k, len(s), lowest[g]) for (k, _), s, g in zip(rows, sets, group)), pairs


def near_copies():
    base = prose(11, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 7):
            w[(i * 13 + j * 29) % len(w)] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    chain = prose(12, 100).split()
    for i in range(12):
        rows.append((100 + i, " ".join(chain[2 * i : 2 * i + 60])))
    common = prose(13, 10)
    rows += [(200 + i, common + " " + prose(300 + i, 3)) for i in range(20)]
    rows += [(300 + i, prose(14 + i % 3, 6)) for i in range(9)]
    return rows


def test_components_equal_brute_force(spark, odd_docs, no_docs):
    for percent in (85, 60):
        options = ngram_join.JoinOptions(percent=percent)
        rows = near_copies()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want, pairs = brute_components(rows, 4, percent)
        got = ngram_join.near_duplicates(df, options)
        assert Counter(tuple(r)[:3] for r in got.collect()) == want
    sets = ngram_join.shingle_sets(df, options).cache()
    members = {r.text_key: r["count"] for r in sets.groupBy("text_key").count().collect()}
    found = ngram_join.links(sets, options).collect()
    inside = sum(n * (n - 1) // 2 for n in members.values())
    assert sum(members[r.a] * members[r.b] for r in found) + inside == pairs


def test_suffix_filter_bounds_what_sets_differ_by():
    rnd = np.random.default_rng(4)
    for size, changed in ((12, 2), (300, 40), (2_000, 600), (40_000, 9_000), (200_000, 10)):
        pool = np.unique(rnd.integers(0, 1 << 56, size + changed).astype(np.uint64))
        a, b = np.sort(pool[changed:]), np.sort(pool[: len(pool) - changed // 2])
        apart = len(np.setxor1d(a, b))
        parts = ngram_join._parts(a), ngram_join._parts(b)
        assert ngram_join.differ_at_least(*parts, 10**9) <= apart
        far = ngram_join._parts(np.sort(rnd.integers(0, 1 << 56, size).astype(np.uint64)))
        # Sets that have nothing in common are told apart, however large they are.
        if size <= 40_000:
            assert ngram_join.differ_at_least(parts[0], far, 10**9) > 0.4 * size


def test_odd_texts_join(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want, _ = brute_components(rows, 4, 85)
    got = ngram_join.near_duplicates(odd_docs)
    assert Counter(tuple(r)[:3] for r in got.collect()) == want
    left = ngram_join.one_of_each(odd_docs)
    assert left.columns == odd_docs.columns
    # Empty texts stay, of linked ones the first, of the repeated row one.
    texts = Counter(r.doc_id for r in left.collect())
    assert texts[8] == 2 and texts[9] == 0 and texts[10] == 0 and texts[0] == texts[2] == 1
    assert texts[3] == 1 and texts[4] == 0 and texts[7] == 0
    assert ngram_join.near_duplicates(no_docs).count() == 0
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_window_hashes_tell_windows_apart():
    hashes, counts = blocks.word_hashes([b"a b c a b", b"", b"A B c  a\x0bb", b"ab"], lower=True)
    assert counts.tolist() == [5, 0, 5, 1]
    assert (hashes[:5] == hashes[5:10]).all() and hashes[0] == hashes[3] != hashes[10]
    for n in (1, 2, 3, 5, 35):
        words = np.arange(200, dtype=np.uint64) % 7
        keys = blocks.window_hashes(blocks.mix(words), n)
        assert len(keys) == 201 - n and len(set(keys.tolist())) == 7
    assert blocks.whole_windows(np.array([3, 0, 1, 2]), 2).tolist() == [True, True, False, False, True]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(components(df).collect())
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50}


def test_sorted_keys_are_sent_by_planes():
    """They come back as they were, and compress to less than the keys one by one."""
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 6000, dtype=np.uint64)) << np.uint64(16)
    keys = keys[keys < np.uint64(1 << 50)]
    for some in (keys, keys[:1], keys[:0]):
        sent = blocks._planes(some, 2)
        assert len(sent) == len(blocks.packed(some, 2)) == 5 * len(some)
        assert (blocks._from_planes(sent, 2) == some).all()
    assert len(zlib.compress(blocks._planes(keys, 2))) < 0.9 * len(
        zlib.compress(blocks.packed(keys, 2))
    )
    # Keys of shingles are counted by five bytes.
    counted = ngram_join._keys([prose(3, 50).encode()], 4)[0]
    assert not (counted & np.uint64(0xFFFF)).any()


def test_last_step_of_joining_equals_brute_force(spark, monkeypatch):
    """With no turns before it, it has to find every link between groups."""
    monkeypatch.setattr(linking.Grouping, "_turn", lambda self: False)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in (ngram_join.JoinOptions(), ngram_join.JoinOptions(n=5, percent=80)):
        want, _ = brute_components(rows, options.n, options.percent)
        got = ngram_join.near_duplicates(df, options).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
