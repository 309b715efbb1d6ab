"""Operators on whole documents, pages and vectors."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import connection, differences
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from usageweave.llm import hashing_ann, language_id, line_dedup, mixing, quality, url_filter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(
    "name",
    [
        "op3_ngram_join",
        "op6_url_filter",
        "op7_line_dedup",
        "op8_substring_dedup",
        "op10_quality_rules",
        "op12_minhash",
        "op13_phrases",
    ],
)
def test_query_agrees_with_sql(spark, name):
    con = connection(SMALL)
    assert differences(spark, con, SMALL, queries()[name], oracle_sql()[name]) == []


# --- mixing -----------------------------------------------------------------


def filled(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight if weight else 0 for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update((s, most * sizes[s]) for s in over)


def test_mix_meets_its_targets(spark, odd_docs, no_docs):
    taken = mixing.plan_mix(odd_docs, mixing.MixOptions(block_words=16)).taken().collect()
    assert len(taken) == odd_docs.count()
    sizes = Counter()
    for r in odd_docs.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = [*sorted(s for s in sizes if s is not None), None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    for source in order:
        rows = [r for r in taken if r.source == source]
        assert {r.source_size for r in rows} == {sizes[source]}
        assert math.isclose(rows[0].target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(sum(r.taken for r in rows) - want[source]) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in taken)
    again = mixing.plan_mix(odd_docs.repartition(5), mixing.MixOptions(block_words=16)).taken()
    assert Counter(map(tuple, taken)) == Counter(map(tuple, again.collect()))
    assert mixing.plan_mix(no_docs).taken().count() == 0
    mixed = mixing.mixed_documents(odd_docs, mixing.MixOptions(block_words=16))
    assert mixed.columns == odd_docs.columns
    read = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert read == sum(r.taken for r in taken)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_schedule_is_even_along_the_way(spark):
    rows = [(i, "abc"[i % 3], "w " * 400) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    options = mixing.MixOptions(block_words=20, chunk=64)
    slots = mixing.plan_mix(df, options).schedule.orderBy("slot").collect()
    share = Counter(r.sid for r in slots)
    for upto in range(100, len(slots), 100):
        seen = Counter(r.sid for r in slots[:upto])
        for sid, n in share.items():
            assert abs(seen[sid] - upto * n / len(slots)) < 8
    for sid in share:
        taken = [(r.epoch, r.block) for r in slots if r.sid == sid]
        assert taken == sorted(taken)


# --- language ---------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    rows = queries()["op5_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = rows.join(docs, "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert right / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    model = language_id.learn(odd_docs)
    out = language_id.identify(odd_docs, model)
    assert out.columns == [*odd_docs.columns, "lang_pred", "score"]
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
    nothing = language_id.learn(no_docs)
    assert {r.lang_pred for r in language_id.identify(odd_docs, nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def test_grams_stay_inside_words_and_texts():
    a = language_id.grams(["ab cd"], 3)[0]
    b = language_id.grams(["ab\0-- CD  "], 3)[0]
    assert sorted(a.tolist()) == sorted(b.tolist()) and len(a) == 4
    both, owner = language_id.grams(["ab", "", "cd"], 3)
    assert sorted(both.tolist()) == sorted(a.tolist()) and owner.tolist() == [0, 0, 2, 2]
    assert len(language_id.grams([""], 3)[0]) == len(language_id.grams([], 3)[0]) == 0


def test_languages_of_long_texts_and_large_alphabets_are_learned(spark):
    rnd = np.random.default_rng(5)

    def text(first, letters, n):
        # Few letters as in Latin script, or thousands that are used evenly.
        letters = rnd.integers(0, letters, n)
        ends = rnd.random(n) < 0.2
        return "".join(chr(first + c) + " " * e for c, e in zip(letters.tolist(), ends.tolist()))

    pairs = rnd.integers(0x4E00, 0x4E00 + 3000, (4000, 2)).tolist()

    def wide(n):
        own = [pairs[i] for i in rnd.integers(0, len(pairs), n)]
        return " ".join(chr(a) + chr(b) for a, b in own)

    rows = [("aa", text(0x430, 20, 500)) for _ in range(30)]
    rows += [("bb", text(0x61, 20, 21_000)) for _ in range(3)]
    rows += [("cc", wide(2000)) for _ in range(30)]
    model = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["aa", "bb", "cc"]
    texts = [text(0x430, 20, 60), text(0x61, 20, 60), *[wide(3) for _ in range(40)]]
    assert model.decide(texts)[0] == ["aa", "bb", *["cc"] * 40]


# --- pages ------------------------------------------------------------------


def test_urls(spark):
    urls = {
        "http://WWW.Example.COM/en/x?q=/a#b": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://m.example.com/enx": ("m.example.com", "/enx", "com/", "allow"),
        "ftp://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://net/fr/1://y/": ("net", "/fr/1://y/", "net/fr/", "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://casino.example.org/es/": ("casino.example.org", "/es/", None, "block"),
        "http://casinos.example.org/es/": ("casinos.example.org", "/es/", None, "allow"),
        "no scheme /en/": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(u, "x", "y") for u in [*urls, "://", None]]
    df = spark.createDataFrame(rows, "url string, rule string, token string")
    out = url_filter.judge_urls(df)
    assert out.columns == ["url", "rule", "token", "url_filter"]
    got = out.select("url", "url_filter.*").collect()
    assert len(got) == len(rows)
    for r in got:
        site = r.rule if r["rank"] == 1 else None
        assert (r.host, r.path, site, r.verdict) == urls[r.url], r
    always = url_filter.Rule("any", "block", "^$")
    out = url_filter.judge_urls(df, (always,)).where("url = ''").first()
    assert out.url_filter.verdict == "block"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_lines_that_most_pages_of_a_site_have(spark, odd_docs, no_docs):
    rows = [(i, "s" if i < 30 else None, f"menu\n\nonly {i}\nmenu" if i % 3 else f"only {i}") for i in range(40)]
    rows += [(50, "t", "menu"), (51, "t", "menu"), (52, "s", None), (53, "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lines = line_dedup.text_lines(F.col("text"))
    out = line_dedup.drop_boilerplate(df, F.col("source"), lines, line_dedup.LineOptions(0.5, 10))
    got = {r.doc_id: r.line_dedup for r in out.collect()}
    assert got[1].kept == ["", "only 1"] and got[1].n_dropped == 2
    assert got[31].kept == ["", "only 31"] and got[0].kept == ["only 0"]
    assert got[50].kept == ["menu"] and got[52].kept == [] and got[53].kept == [""]
    out = line_dedup.drop_boilerplate(odd_docs, F.col("source"), lines)
    assert out.columns == [*odd_docs.columns, "line_dedup"] and out.count() == odd_docs.count()
    assert line_dedup.drop_boilerplate(no_docs, F.col("source"), lines).count() == 0


# --- quality ----------------------------------------------------------------


def brute_counts(text):
    own = WORD.findall(text or "")
    windows = Counter(zip(own, own[1:], own[2:]))
    covered = {
        i + j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in range(3)
    }
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, own))
    return len(own), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, odd_docs, no_docs):
    out = quality.judge(odd_docs)
    assert out.columns == [*odd_docs.columns, "quality"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        q = r.quality
        counts = brute_counts(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == counts
        assert q.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (q.base_failed and q.kept)
    assert quality.judge(no_docs).count() == 0
    kept = quality.judge(odd_docs).where("quality.kept").count()
    assert kept == sum(r.quality.kept for r in rows)


def test_distance_is_jensen_shannons(spark):
    pairs = [([3, 1], [1, 3]), ([1, 0], [0, 1]), ([2, 2], [7, 7]), ([0, 0], [1, 1])]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r.d for r in df.select(quality.distance(F.col("a"), F.col("b")).alias("d")).collect()]
    p = np.array([0.75, 0.25])
    m = np.array([0.5, 0.5])
    assert math.isclose(got[0], math.sqrt(float((p * np.log2(p / m)).sum())))
    assert math.isclose(got[1], 1) and math.isclose(got[2], 0, abs_tol=1e-7) and got[3] is None


def test_odd_documents_of_a_language_go(spark):
    clean = "the cat and the dog of an old man in a big red house by the sea at dusk. "
    rows = [(i, "en", clean * 4 + f"number {i} of us. " * 2) for i in range(60)]
    rows.append((100, "en", " ".join(f"zzzzz{i}###" for i in range(80))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    options = quality.QualityOptions(max_repeat_percent=100)
    kept = {r.doc_id for r in quality.judge(docs, options=options).where("quality.kept").collect()}
    assert kept == set(range(60))


def test_copies_of_an_odd_text_do_not_become_the_reference(spark):
    clean = "the cat and the dog of an old man in a big red house by the sea at dusk. "
    good = [(i, "en", clean * 4 + f"number {i} of us. " * 2) for i in range(60)]
    odd = " ".join(f"zzzzz{i}### QQ" for i in range(400))
    options = quality.QualityOptions(max_repeat_percent=100)
    # Exact copies, near copies, and texts that fail the base rules but are many.
    for other in ([odd] * 30, [f"{odd} xx{i}" for i in range(30)], ["## 1" * 5] * 200):
        rows = good + [(100 + i, "en", t) for i, t in enumerate(other)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        judged = quality.judge(docs, options=options).where("quality.kept").collect()
        assert {r.doc_id for r in judged} == set(range(60))


def test_copied_junk_leaves_the_verdicts_of_the_query_alone(spark, tmp_path):
    """Copies of one rejected text as a third of all rows: every labelled-good document that
    passes the base rules stays, and no copy does.
    """
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = docs.join(quality.judge(docs, columns=["doc_id"]), "doc_id")
    junk = judged.where("NOT quality.kept AND NOT quality.base_failed AND lang = 'en'").first()
    assert junk
    copies = spark.range(500).select(
        (F.col("id") + 10**6).alias("doc_id"), F.lit(junk.text).alias("text"), F.lit("en").alias("lang")
    )
    rows = docs.select("doc_id", "text", "lang").unionByName(copies)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op10_quality_rules"](spark, str(tmp_path)).where("NOT base_failed")
    got = {r.doc_id: r.kept for r in got.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len([d for d in got if d in good]) > 100
    assert all(kept for d, kept in got.items() if d in good)
    assert not any(kept for d, kept in got.items() if d >= 10**6)


# --- vectors ----------------------------------------------------------------


def test_recall_of_neighbours(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op9_hashing_ann"](spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    hits = wanted = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        far[i] = np.inf
        best = ids[np.lexsort((ids, far))[:10]]
        mine = sorted((r for r in got if r.query_id == ids[i]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len(set(best.tolist()) & {r.vec_id for r in mine})
        wanted += 10
    assert hits / wanted >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(14)]
    rows += [(20, [0.0, 0.0]), (21, None), (22, [nan, 1.0]), (23, [inf, 1.0]), (24, [None, 1.0])]
    rows += [(25, [4.0, 6.0]), (26, []), (27, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (25, [4.0, 6.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    asked = F.col("vec_id").isin(0, 13, 20, 22, 25)
    got = {}
    for r in hashing_ann.neighbours(df, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 13, 25}
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[13] == [(i, 0.0) for i in range(10)]
    assert got[25] == [(i, 5.0) for i in range(10)]
    few = df.where("vec_id IN (0, 1, 25)")
    rows = hashing_ann.neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(1, 0.0), (25, 5.0)]
    assert hashing_ann.neighbours(df.limit(0), asked).count() == 0


def test_repeated_rows_take_no_places_of_neighbours(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.standard_normal((60, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    equal = [(100 + i, [9.0] * 8) for i in range(12)]
    once = spark.createDataFrame(rows + equal, "vec_id long, embedding array<double>")
    often = spark.createDataFrame(
        2 * rows + 11 * equal[:1] + 12 * equal, "vec_id long, embedding array<double>"
    )
    asked = F.col("vec_id").isin(0, 7, 100, 111)
    for options in (hashing_ann.AnnOptions(), hashing_ann.AnnOptions(shard_rows=16)):
        want = hashing_ann.neighbours(once, asked, options).collect()
        got = hashing_ann.neighbours(often, asked, options).collect()
        assert Counter(r.query_id for r in got) == {0: 10, 7: 10, 100: 10, 111: 10}
        for query in (100, 111):
            ids = {r.vec_id for r in got if r.query_id == query}
            assert ids == set([i for i in range(100, 112) if i != query][:10])
        if options.shard_rows > 100:
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_an_id_with_several_vectors_leaves_places_to_others(spark):
    rows = [(0, [0.5, 0.0])] + [(1, [0.5 + math.cos(t), math.sin(t)]) for t in range(30)]
    rows += [(i, [0.5, 1.5 + i]) for i in range(2, 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hashing_ann.neighbours(df, F.col("vec_id") == 0).collect()
    assert len(got) == 10 and len({(r.vec_id, r.score) for r in got}) == 10


def test_search_of_a_shard_equals_the_plain_way_in_few_steps():
    """Equal to distances to all entries within the radius, ties, large and small numbers
    included; a query takes far less time than lists of single values did.
    """
    import time

    rnd = np.random.default_rng(11)
    near = rnd.standard_normal((8192, 64))
    near[100:130] = near[7]
    tiny = 1e8 + 1e-6 * rnd.standard_normal((300, 64))
    for vectors in (near, 1e200 * near[:300], tiny, rnd.integers(0, 2, (500, 20)).astype(float)):
        with np.errstate(over="ignore", invalid="ignore"):
            codes = hashing_ann.learn_codes(vectors[:256] / np.abs(vectors).max(), hashing_ann.AnnOptions(rounds=3))
            shard = hashing_ann.Shard(codes, vectors)
            queries = vectors[:40]
            own, products = codes.encode(queries), queries @ vectors.T
            began = time.process_time()
            got = [shard.nearest(q, c, 11, p) for q, c, p in zip(queries, own, products)]
            took = time.process_time() - began
            every = codes.encode(vectors)
            for q, c, (at, far) in zip(queries, own, got):
                apart = hashing_ann._ONES[every ^ c].sum(1)
                radius = codes.radius
                while (apart <= radius).sum() < 11:
                    radius += codes.substrings
                (within,) = np.nonzero(apart <= radius)
                want = np.sqrt(((vectors[within] - q) ** 2).sum(1))
                keep = want <= np.sort(want)[10]
                order = np.argsort(want[keep], kind="stable")
                assert at.tolist() == within[keep][order].tolist()
                assert far.tolist() == want[keep][order].tolist()
            assert took < 40 * 0.015
