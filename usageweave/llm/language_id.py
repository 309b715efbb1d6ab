"""Language ID by language-bitmask n-gram filters.

One Bloom filter serves all languages: it is cut into bits of languages, so each of its
slots holds a mask with one bit for every language that set it. An n-gram's masks at its
slots, ANDed, give all languages that have the n-gram, in one look-up. A text adds up, for
each language, how many of its n-grams carry the language's bit; what the filter's false
positives add on average is taken off, and the largest share decides.

The filter is learned from a bounded sample of labelled texts (``sample_per_language`` for
each language, by hash order) and has a fixed size, so it can be broadcast. All texts are
scored whole, each in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from usageweave.llm.shared import stored

UNDECIDED = "und"


@dataclass(frozen=True)
class LanguageOptions:
    #: Characters in an n-gram; words are padded by one space on each side.
    n: int = 3
    #: Labelled texts the filter is learned from, for each language at most.
    sample_per_language: int = 400
    #: Longer texts (in characters) are in the sample only if there are not enough others,
    #: and then by so many leading characters.
    sample_chars: int = 20_000
    #: An n-gram belongs to a language from this share of all its n-grams on, or from a
    #: smaller one that makes a language's n-grams so large a part of its text.
    least_share: float = 1e-4
    least_cover: float = 0.9
    #: Slots of the filter (a power of two), doubled while a language would set more than
    #: half of them, up to a bound; and hash functions.
    slots: int = 1 << 16
    most_slots: int = 1 << 22
    hashes: int = 3
    #: Characters scored at a time.
    block_chars: int = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the text each is from.

    Texts are lower-cased, all but letters counts as space, runs of which are one. A
    gram of spaces alone can't occur.
    """
    joined = " \0 ".join(t.replace("\0", " ") for t in texts).lower()
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), "<u4")
    owner = np.cumsum(codes == 0)
    letter = _letters()[codes]
    # Of each run of other characters the first in its text stays, as a space.
    keep = letter | np.concatenate(([True], letter[:-1] | (codes[:-1] == 0)))
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    owner, letter = owner[keep], letter[keep]
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(codes) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + m]) * _MIX
        h ^= h >> np.uint64(29)
    # A gram belongs to a word: a space may only be its first or last character.
    fits = np.ones(m, bool)
    for k in range(1, n - 1):
        fits &= letter[k : k + m]
    if n <= 2:
        fits = letter[:m] | letter[n - 1 :]
    fits &= owner[:m] == owner[n - 1 :]
    return h[fits], owner[:m][fits]


@dataclass
class Filter:
    """``masks``: for each slot one bit for every language, in words of 64."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    options: LanguageOptions

    def _slots(self, h: np.ndarray, k: int) -> np.ndarray:
        x = h * np.uint64(2 * k + 1) + np.uint64(k)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(40)) & np.uint64(self.options.slots - 1)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Masks of the languages that have each n-gram."""
        found = self.masks[self._slots(h, 0)]
        for k in range(1, self.options.hashes):
            found &= self.masks[self._slots(h, k)]
        return found

    @classmethod
    def learn(cls, samples: dict[str, list[str]], options: LanguageOptions) -> Filter:
        languages = sorted(samples)
        n_words = max(1, -(-len(languages) // 64))
        owned = [cls._own(samples[lang], options) for lang in languages]
        slots, most = options.slots, max(map(len, owned), default=0) * options.hashes
        while slots * np.log(2) < most and slots < options.most_slots:
            slots *= 2
        options = replace(options, slots=slots)
        made = cls(
            languages, np.zeros((options.slots, n_words), np.uint64), np.zeros(0), options
        )
        for i, own in enumerate(owned):
            bit = np.uint64(1) << np.uint64(i % 64)
            for k in range(options.hashes):
                made.masks[made._slots(own, k), i // 64] |= bit
        filled = np.array(
            [
                ((made.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
                for i in range(len(languages))
            ]
        )
        made.chance = filled**options.hashes
        return made

    @staticmethod
    def _own(texts: list[str], options: LanguageOptions) -> np.ndarray:
        """The n-grams that belong to a language, by its sample."""
        parts = [np.unique(grams([t], options.n)[0], return_counts=True) for t in texts]
        if not parts:
            return np.zeros(0, np.uint64)
        hashes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(hashes))
        if not len(counts):
            return hashes
        falling = np.sort(counts)[::-1]
        cover = np.cumsum(falling)
        least = falling[np.searchsorted(cover, options.least_cover * cover[-1])]
        usual = max(2.0, options.least_share * counts.sum())
        return hashes[counts >= min(usual, least)]

    def shares(self, texts: list[str]) -> np.ndarray:
        """For each text and language, the share of n-grams the language has, corrected
        for false positives; NaN rows for texts without letters.
        """
        h, owner = grams(texts, self.options.n)
        found = self.look_up(h)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bits = (found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(owner, bits, len(texts))
            with np.errstate(invalid="ignore", divide="ignore"):
                share = (hits / total - self.chance[i]) / max(1e-9, 1 - self.chance[i])
            out[:, i] = np.clip(share, 0, 1)
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: its share less the next one's, plus 1, halved."""
        shares = self.shares([t or "" for t in texts])
        langs, scores = [], []
        for text, row in zip(texts, shares):
            if not text or not self.languages or np.isnan(row).any():
                langs.append(UNDECIDED)
                scores.append(0.0)
                continue
            best = int(np.argmax(row))
            rest = np.delete(row, best)
            margin = row[best] - (rest.max() if len(rest) else 0.0)
            langs.append(self.languages[best])
            scores.append(float((1 + margin) / 2))
        return langs, scores


def learn(labelled: DataFrame, options: LanguageOptions = LanguageOptions()) -> Filter:
    """The filter of the languages in ``labelled`` (lang, text); null labels are left out.

    The sample is the ``sample_per_language`` texts of each language that come first by a
    hash of the text, so it is the same in every run; those of up to ``sample_chars`` come
    before longer ones. Without labels nothing is learned and every text is undecided.
    """
    place = F.struct(
        (F.length("text") > options.sample_chars).alias("long"), F.xxhash64("text").alias("hash")
    )
    first = Window.partitionBy("lang").orderBy("place", "text")
    # The cut is made on digests; only the texts that are in the sample are moved.
    keys = (
        labelled.where("lang IS NOT NULL AND text IS NOT NULL")
        .select("lang", place.alias("place"), F.md5("text").alias("text"))
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= options.sample_per_language)
        .select("lang", "place")
        .distinct()
    )
    keys = stored(keys, "language-sample")
    text = F.substring("text", 1, options.sample_chars).alias("text")
    texts = labelled.select("lang", text, place.alias("place")).join(keys, ["lang", "place"])
    nth = F.row_number().over(first)
    texts = texts.withColumn("nth", nth).where(F.col("nth") <= options.sample_per_language)
    samples: dict[str, list[str]] = {}
    for row in texts.select("lang", "text").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return Filter.learn(samples, options)


def identify(docs: DataFrame, model: Filter, column: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; any other text gets
    the learned language with the largest share, on ties the first by name. Each row is
    judged by its text alone; own columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(column).to_pylist()
            langs: list[str] = []
            scores: list[float] = []
            start = chars = 0
            for end, text in enumerate(texts, 1):
                chars += len(text or "")
                if chars >= model.options.block_chars or end == len(texts):
                    got = model.decide(texts[start:end])
                    langs += got[0]
                    scores += got[1]
                    start, chars = end, 0
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=[*kept, "lang_pred", "score"],
            )

    fields = [docs.schema[c] for c in kept]
    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType([*fields, *more]))
