"""Phrases next to brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from usageweave.llm import collocations
from usageweave.llm.collocations import PhraseOptions


def brute_phrases(rows, options):
    """The phrases of (lang, text) rows, from all contiguous runs of words."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, options.longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= options.least}
        inside = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    q = p[i : i + size]
                    inside[q] = max(inside[q], a)
        best = []
        for p, a in candidates.items():
            if 100 * inside[p] >= options.inside_percent * a:
                continue
            score, k = min(
                (2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))
            )
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[: options.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def check(df, options):
    rows = [tuple(r) for r in df.select("lang", "text").collect()]
    got = collocations.phrases(df, options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, options))
    return rows


def test_odd_rows_equal_brute_force(spark, odd_docs, no_docs):
    check(odd_docs, PhraseOptions(least=2))
    check(odd_docs, PhraseOptions(least=2, longest=3, top=7, block_bytes=500))
    assert collocations.phrases(no_docs).collect() == []


def test_texts_without_words(spark):
    df = spark.createDataFrame([("en", None), (None, " .,; "), ("de", "")], "lang string, text string")
    assert collocations.phrases(df, PhraseOptions(least=1)).collect() == []


def test_pieces_cases_and_full_filters_equal_brute_force(spark):
    rnd = random.Random(5)
    words = ["New", "york", "été", "a", "B", "x y", "..", "q\x0b", "1,000", "the\tend", "İ"]
    rows = [
        (rnd.choice(["en", "und", None, ""]), " ".join(rnd.choices(words, k=rnd.randrange(40))))
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    check(df, PhraseOptions(least=6))
    # A filter of the least size lets almost everything through; the rest is as before.
    check(df, PhraseOptions(least=6, filter_bits=8, common_share=1.0, word_segments=1))


def test_frequent_neighbours_of_a_third_of_all_words(spark):
    rows = [("en", "of the " * 200)] * 60 + [("en", f"w{i % 40} of the house") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    check(df, PhraseOptions())


def test_products_beyond_64_bits(spark):
    a = 6 * 10**15
    counts = spark.createDataFrame(
        [("en", "", 0, 9 * 10**17), ("en", "x", 1, a + 1), ("en", "y", 1, a), ("en", "x y", 2, a)],
        "lang string, phrase string, size int, f long",
    )
    (row,) = collocations.scored(counts).collect()
    assert row.score == 2_000_000 * a // (2 * a + 1)


def test_same_word_of_two_languages_is_counted_apart(spark):
    rows = [("en", "in vitro")] * 30 + [("la", "in vitro")] * 29 + [("la", "in")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.phrases(df).select("lang", "phrase", "l", "r", F.col("n")).collect()
    assert [tuple(r) for r in got] == [("en", "in vitro", 30, 30, 60)]
