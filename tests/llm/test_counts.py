"""Counts of texts that are kept for each different word."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from usageweave.llm import quality

TEXTS = [
    None,
    "",
    " \n\t ",
    "a A b a İ i̇ abcde ab",
    "AÉ𝐀 9٣.,;:!?'\"()[]{}-#*$%&|<>\\^_\t\n\x0b\x0c\r \x1c\x85　Ǆǅǆ ÀÀ 中文 中文",
]


def random_text(rnd: random.Random) -> str:
    pool = "aaBB1 2٣\n\t\x0b\x0c\r\x1c\x85.-]['\"\\^|#É𝐀中"
    return "".join(rnd.choice(pool) for _ in range(rnd.randrange(60)))


def test_short_words_and_classes_are_counted_once_each(spark):
    rnd = random.Random(3)
    texts = TEXTS + [random_text(rnd) for _ in range(300)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    rows = quality.features(docs, ["text"]).select("_row.text", "_quality.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r.text or ""
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        short = Counter(w for w in words if len(w) <= 4)
        ends = r.starts[1:]
        assert dict(zip(r.short, (b - a for a, b in zip(r.starts, ends)))) == dict(short), text
        assert len(r.short) == len(short) == len(ends)
        kinds = [unicodedata.category(c) for c in text]
        classes = [
            kinds.count("Lu"),
            kinds.count("Nd"),
            len(re.findall(r"[\x20\x09-\x0D]", text)),
            len(re.findall(r"[.,;:!?'\"()\[\]{}\-]", text)),
            len(re.findall(quality.SYMBOLS, text)),
        ]
        assert r.classes == [*classes, len(text) - sum(classes)], text
        assert r.word_chars == len(text) - classes[2]


def test_held_words_are_looked_up(spark):
    docs = spark.createDataFrame([("en", t) for t in TEXTS], "lang string, text string")
    listed = F.array(*[F.lit(w) for w in ("a", "ab", "none", "中文")])
    found = quality.features(docs, ["text"]).select(
        "_row.text", quality._held(F.col("_quality"), listed).alias("held")
    )
    held = {r.text: r.held for r in found.collect()}
    assert held[TEXTS[3]] == [3, 1, 0, 0]
    assert held[TEXTS[4]] == [0, 0, 0, 2]
    assert held[None] == held[""] == held[TEXTS[2]] == [0, 0, 0, 0]
