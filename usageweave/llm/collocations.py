"""Phrase collocations by stripes.

Each prefix of words keys a stripe: an associative counter of the words that come next.
A task makes the stripes of a block of text, which is the map-side sum; stripes of one
prefix are merged by adding them element by element. All counts come out of this one
structure: the entry ``next`` of the stripe of ``prefix`` is how often ``prefix next``
occurs, the stripe of the empty prefix holds the totals of the words (and, as entry "",
that of the language), and the largest entry of a stripe is the most frequent extension.

Phrases that occur often enough consist of shorter ones that do, so stripes are made for
one length after the other and only where both shorter phrases are frequent. Tasks know
these from a bit filter of bounded size: a false positive costs a count that is thrown
away later, and no frequent phrase is missed. The stripes of very common prefixes (there can
only be a few) are cut into segments by the next word, so that many tasks merge them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usageweave.llm.blocks import mix, word_hashes
from usageweave.llm.shared import bit_filter, in_filter, stored

_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class PhraseOptions:
    #: Fewest occurrences of a candidate.
    least: int = 30
    #: Words in the longest candidates.
    longest: int = 4
    #: A candidate goes if a longer one around it has this percentage of its occurrences.
    inside_percent: int = 80
    #: Phrases reported for each language.
    top: int = 2000
    #: Bytes of text whose stripes are made at once.
    block_bytes: int = 6_000_000
    #: Most bits of a filter (32 MB); a fuller filter lets more through, never less.
    filter_bits: int = 1 << 28
    #: Segments of the stripe of a common prefix, and of that of the empty one.
    segments: int = 256
    word_segments: int = 4096
    #: A prefix is common with this share of all words; so there are 4096 at most.
    common_share: float = 1 / 4096


@dataclass
class _Block:
    """Words of a block: ``ids`` of (language, word) in order, and their pieces."""

    ids: np.ndarray
    pieces: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    words: pa.Array
    word_of: np.ndarray
    hashes: np.ndarray


def _language_hash(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _read(langs: list[str], texts: list[bytes]) -> _Block:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    cut = _CUT[data]
    inside = ~(cut | _GAP[data])
    at = np.flatnonzero(inside)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    kept = _LOWER[data[at]]
    starts = at[first]
    offsets = np.append(first, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]
    ).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    names, lang_no = np.unique(np.array(langs, object), return_inverse=True)
    lang_at = np.repeat(lang_no, per_text)
    dictionary = words.dictionary.cast(pa.binary())
    codes = words.indices.to_numpy().astype(np.int64)
    size = max(1, len(dictionary))
    known, ids = np.unique(lang_at * size + codes, return_inverse=True)
    lang_of, word_of = known // size, known % size
    own = word_hashes([b"\n".join(dictionary.to_pylist())])[0]
    salts = np.array([_language_hash(n) for n in names], np.uint64)
    hashes = mix(own[word_of] ^ salts[lang_of]) if len(known) else own
    pieces = np.searchsorted(np.flatnonzero(cut), starts)
    return _Block(ids, pieces, list(names), lang_of, dictionary.view(pa.string()), word_of, hashes)


def _extended(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all their words but the last, and of this one."""
    return mix(before * _STEP + after)


@dataclass
class _Known:
    """What tasks know of the frequent phrases of one word less: a bit filter of all of
    them, and the hashes of the common ones.
    """

    bits: bytes
    common: np.ndarray


def _frequent_places(block: _Block, size: int, known: _Known | None):
    """Where a phrase of ``size`` words begins whose two shorter phrases may be frequent,
    and whether its prefix is common.
    """
    n = len(block.ids) - size + 1
    if n <= 0 or size == 1:
        return np.arange(max(n, 0)), np.ones(max(n, 0), bool)
    hashes = shorter = block.hashes[block.ids]
    for j in range(1, size - 1):
        shorter = _extended(shorter[:-1], hashes[j:])
    may_be = in_filter(np.frombuffer(known.bits, np.uint8), shorter)
    whole = block.pieces[:n] == block.pieces[size - 1 :]
    at = np.flatnonzero(whole & may_be[:n] & may_be[1 : n + 1])
    return at, np.isin(shorter[at], known.common)


STRIPES = "lang string, prefix string, segment int, next string, n array<int>"
_ARROW = pa.schema(
    [
        ("lang", pa.string()),
        ("prefix", pa.string()),
        ("segment", pa.int32()),
        ("next", pa.string()),
        ("n", pa.list_(pa.int32())),
    ]
)


def _stripes(
    block: _Block, size: int, known: _Known | None, options: PhraseOptions
) -> pa.RecordBatch:
    """The stripes of all prefixes of ``size - 1`` words of a block."""
    at, common = _frequent_places(block, size, known)
    prefix = np.zeros(len(at), np.int64)
    vocabulary = len(block.word_of)
    for j in range(size - 1):
        joint = prefix * vocabulary + block.ids[at + j]
        prefix = np.unique(joint, return_inverse=True)[1]
    if size == 1:
        prefix = block.lang_of[block.ids[at]]
    _, shown, n = np.unique(
        prefix * vocabulary + block.ids[at + size - 1], return_index=True, return_counts=True
    )
    prefix, place = prefix[shown], at[shown]
    last = block.ids[place + size - 1]
    parts = options.word_segments if size == 1 else options.segments
    segment = (mix(block.hashes[last]) % np.uint64(parts)).astype(np.int64)
    segment[~common[shown]] = 0
    order = np.lexsort((segment, prefix))
    prefix, place, last, segment, n = (x[order] for x in (prefix, place, last, segment, n))
    new = np.ones(len(place), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])
    begins = np.flatnonzero(new)
    words = [
        block.words.take(pa.array(block.word_of[block.ids[place[begins] + j]]))
        for j in range(size - 1)
    ]
    empty = pa.array([""] * len(begins), pa.string())
    langs = pa.array(block.langs, pa.string())
    columns = [
        langs.take(pa.array(block.lang_of[last[begins]], pa.int64())),
        pc.binary_join_element_wise(*words, " ") if words else empty,
        pa.array(segment[begins], pa.int32()),
        pc.binary_join(_lists(begins, block.words.take(pa.array(block.word_of[last]))), " "),
        _lists(begins, pa.array(n, pa.int32())),
    ]
    out = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
    if size > 1:
        return out
    totals = np.bincount(block.lang_of[block.ids], minlength=len(block.langs)).tolist()
    rows = [
        {"lang": lang, "prefix": "", "segment": 0, "next": "", "n": [total]}
        for lang, total in zip(block.langs, totals)
        if total
    ]
    own = pa.RecordBatch.from_pylist(rows, _ARROW)
    return pa.Table.from_batches([out, own]).combine_chunks().to_batches()[0] if rows else out


def _lists(begins: np.ndarray, values: pa.Array) -> pa.Array:
    offsets = np.append(begins, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def stripes(docs: DataFrame, size: int, known, options: PhraseOptions) -> DataFrame:
    """The stripes (lang, prefix, segment, next, n) of all prefixes of ``size - 1`` words
    of each block of ``docs`` (lang, text): next words joined by spaces, and their counts.
    ``known``: what is broadcast of the frequent phrases of ``size - 1`` words; none for words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = known.value if known else None
        langs, texts, held = [], [], 0

        def done():
            return _stripes(_read(langs, texts), size, shorter, options)

        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            for lang, t in zip(batch.column("lang").to_pylist(), text):
                langs.append(lang)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= options.block_bytes:
                    yield done()
                    langs, texts, held = [], [], 0
        if texts:
            yield done()

    return docs.select("lang", "text").mapInArrow(run, STRIPES)


def merged(rows: DataFrame) -> DataFrame:
    """Stripes added up element by element: (lang, prefix, next, f)."""
    dealt = rows.repartition("lang", "prefix", "segment")
    zipped = F.arrays_zip(F.split("next", " ").alias("next"), "n")
    entries = dealt.select("lang", "prefix", "segment", F.inline(zipped))
    return (
        entries.groupBy("lang", "prefix", "segment", "next")
        .agg(F.sum("n").alias("f"))
        .drop("segment")
    )


def _hashed(phrases: DataFrame, size: int) -> DataFrame:
    """(hash, f) of phrases (lang, phrase, f) of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = b"\n".join(batch.column("phrase").cast(pa.binary()).to_pylist())
            own = word_hashes([text])[0].reshape(-1, size)
            langs = batch.column("lang").to_pylist()
            salts = np.array([_language_hash(n) for n in langs], np.uint64)
            own = mix(own ^ salts[:, None])
            hashes = own[:, 0]
            for j in range(1, size):
                hashes = _extended(hashes, own[:, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), batch.column("f")], ["hash", "f"]
            )

    return phrases.select("lang", "phrase", "f").mapInArrow(run, "hash long, f long")


def _known(phrases: DataFrame, size: int, n_words: int, options: PhraseOptions):
    """What to broadcast of frequent phrases: the filter has 16 bits for each if its bound
    allows, and is built by Spark's bitmap aggregate, a row for each chunk.
    """
    spark = phrases.sparkSession
    hashed = stored(_hashed(phrases, size), "phrases-hashed")
    common = hashed.where(F.col("f") >= F.lit(max(1.0, n_words * options.common_share)))
    bits = bit_filter(hashed, phrases.count(), options.filter_bits)
    found = np.array([r["hash"] for r in common.select("hash").collect()], np.int64)
    return spark.sparkContext.broadcast(_Known(bits, found.view(np.uint64)))


def frequent(docs: DataFrame, options: PhraseOptions = PhraseOptions()) -> DataFrame:
    """(lang, phrase, size, f): every phrase of up to ``longest`` words that occurs at least
    ``least`` times in its language, and with phrase "" and size 0 each language's number
    of words.
    """
    lang, text = F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))
    docs = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"))
    found, known, n_words = None, None, 0
    for size in range(1, options.longest + 1):
        counts = merged(stripes(docs, size, known, options)).where(
            (F.col("f") >= options.least) | (F.col("next") == "")
        )
        joined = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), "next")
        words = F.when(F.col("next") == "", 0).otherwise(size)
        level = stored(
            counts.select("lang", joined.alias("phrase"), words.alias("size"), "f"),
            f"phrases-{size}",
        )
        found = level if found is None else found.unionByName(level)
        if size == 1:
            n_words = level.where("size = 0").agg(F.sum("f")).first()[0] or 0
        if size < options.longest:
            known = _known(level.where("size > 0"), size, n_words, options)
    return found


def _words(start: str, n: str):
    return F.array_join(F.expr(f"slice(split(phrase, ' '), {start}, {n})"), " ")


def scored(counts: DataFrame, options: PhraseOptions = PhraseOptions()) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the candidates among :func:`frequent` phrases
    that no longer candidate takes the place of, by their lowest-scoring cut.
    """
    big = "decimal(20,0)"
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    # What holds a candidate and is longer by several words holds one longer by one word,
    # which occurs as often at least.
    shorter = F.array(*[_words(i, "size - 1") for i in "12"])
    longer = (
        counts.where("size >= 3")
        .select("lang", "f", F.explode(shorter).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longest"))
    )
    share = f"CAST(100 AS {big}) * longest >= CAST({options.inside_percent} AS {big}) * a"
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        f"longest IS NULL OR NOT ({share})"
    )
    cuts = kept.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        _words("1", "k").alias("left"),
        _words("k + 1", "size - k").alias("right"),
    )
    parts = counts.where("size >= 1")
    lefts = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr(f"(CAST(2000000 AS {big}) * CAST(a AS {big})) div CAST(l + r AS {big})")
    lowest = (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return lowest.join(totals, "lang").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def phrases(docs: DataFrame, options: PhraseOptions = PhraseOptions()) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase,
    a, l, r, n, score, best first; ties go to the more frequent, then to the smaller phrase.

    A null language is "und"; null and empty texts have no words; repeated rows count as
    often as they stand there; a very long text is a block of its own, whole. An empty
    table gives no rows. Other columns of ``docs`` are not looked at.
    """
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = scored(frequent(docs, options), options)
    # First within parts of a language: no task orders all its candidates.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    parts = rows.withColumn("part", part)
    nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    parts = parts.withColumn("rank", nth).where(F.col("rank") <= options.top)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    ranked = parts.withColumn("rank", nth).where(F.col("rank") <= options.top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
