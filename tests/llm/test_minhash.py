"""Near duplicates by sketches, next to brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from usageweave.llm import blocks, linking, minhash
from usageweave.llm.shared import stored

from conftest import prose  # noqa: I001
from test_repeats import brute_components, near_copies, shingle_set


def family(n, words=300, edits=3, seed=5):
    """``n`` copies of one text with ``edits`` changed words each."""
    rnd = random.Random(seed)
    base = prose(seed, words).split()
    for i in range(n):
        w = list(base)
        for j in range(edits):
            w[rnd.randrange(words)] = f"new{i}x{j}"
        yield (i, " ".join(w))


def test_every_coordinate_fills():
    rnd = np.random.default_rng(1)
    sizes = [1, 2, 5, 60, 128, 3000]
    keys = rnd.integers(0, 1 << 56, sum(sizes)).astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows = minhash.sketch(keys, owner, len(sizes) + 1, 128)
    assert (rows[:-1] != minhash._EMPTY).all() and (rows[-1] == minhash._EMPTY).all()
    # Each text alone, in another order and with repeats, has the same sketch.
    for i in range(len(sizes)):
        own = np.tile(keys[owner == i][::-1], 2)
        assert (minhash.sketch(own, np.zeros(len(own), int), 1, 128)[0] == rows[i]).all()


def test_agreement_follows_similarity():
    rnd = np.random.default_rng(2)
    for size, similarity in ((40, 0.5), (300, 0.8), (2000, 0.25)):
        shared = round(2 * size * similarity / (1 + similarity))
        off = []
        for _ in range(60):
            pool = rnd.integers(0, 1 << 56, 2 * size - shared).astype(np.uint64)
            sets = pool[:size], pool[size - shared :]
            owner = np.repeat([0, 1], [size, size])
            a, b = minhash.sketch(np.concatenate(sets), owner, 2, 128)
            off.append((a == b).mean() - shared / (2 * size - shared))
        assert abs(np.mean(off)) < 0.02
        assert np.std(off) < 1.3 * (similarity * (1 - similarity) / 128) ** 0.5


def check(df, options=minhash.MinhashOptions()):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want, _ = brute_components(rows, options.n, options.percent)
    got = minhash.near_duplicates(df, options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_equal_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df)
    check(df, minhash.MinhashOptions(n=3, percent=90, block_bytes=2_000, bins=128, band=4, agree=75))


def test_odd_texts(odd_docs, no_docs):
    check(odd_docs)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_only_rows_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (None, "")], "doc_id long, text string")
    got = {tuple(r)[:4] for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)}


def test_comparisons_of_a_family_grow_with_its_members(spark):
    """Four times the members make some four times the pairs, not sixteen."""
    compared = {}
    for n in (300, 1200):
        df = spark.createDataFrame(list(family(n)), "doc_id long, text string").repartition(4)
        signed = stored(minhash.signatures(df), "signed")
        found = minhash.grouping(df, signed)
        groups = {r.component for r in found.run().collect()}
        assert len(groups) <= 8
        compared[n] = found.compared
    assert compared[1200] < 8 * compared[300] and compared[1200] < 20 * 1200


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, prose(i, 30)) for i in range(100)] + [(500 + i, prose(3, 30)) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_shingles_are_those_of_brute_force():
    texts = [prose(i, n).encode() for i, n in enumerate((0, 1, 3, 4, 5, 90))]
    keys, owner = blocks.shingles(texts, 4)
    got = [len(set(keys[owner == i].tolist())) for i in range(len(texts))]
    assert got == [len(shingle_set(t.decode(), 4)) for t in texts]


def spread(n, words=120, seed=7):
    """``n`` copies of one text with up to a quarter of its words changed: most don't link."""
    rnd = random.Random(seed)
    base = prose(seed, words).split()
    for i in range(n):
        w = list(base)
        for j in range(rnd.randrange(2, 9)):
            w[rnd.randrange(words)] = f"new{rnd.randrange(3 * n)}" if i % 4 else f"shared{j % 2}"
        yield (i, " ".join(w))


def test_what_turns_leave_equals_brute_force(spark, monkeypatch):
    """The last step alone, and after the turns, on near copies some of which link."""
    rows = [*spread(150), *((1000 + i, t) for i, t in spread(40, 60, 8)), *near_copies()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df)
    monkeypatch.setattr(linking.Grouping, "_turn", lambda self: False)
    check(df)


def test_comparisons_of_copies_too_far_apart_to_link_grow_with_their_number(spark):
    compared = {}
    for n in (200, 800):
        rnd, base = random.Random(3), prose(9, 150).split()
        rows = []
        for i in range(n):
            w = list(base)
            for j, at in enumerate(rnd.sample(range(150), 8)):
                w[at] = f"new{i}x{j}"
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        found = minhash.grouping(df, stored(minhash.signatures(df), "signed"))
        found.run()
        compared[n] = found.compared
    assert compared[800] < 10 * compared[200] and compared[800] < 10 * 800
