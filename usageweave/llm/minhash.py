"""Near-duplicate documents by fast similarity sketching.

A sketch has ``bins`` coordinates. In each round every shingle of a text is hashed to one
bin and a value, and bins that earlier rounds left empty take the least value thrown into
them. After as many rounds as there are bins, the rounds left serve one bin each, so that
every coordinate fills, whatever the size of the set; a text of many shingles is done in a
round or two. Two sketches agree in a coordinate with a chance of their Jaccard
similarity, and the share of agreeing coordinates is concentrated as for independent ones.

Coordinates are cut into bands; texts that agree in a whole band are candidates. Of these,
pairs whose sketches agree in too few coordinates are ruled out by the bound, and all
others are confirmed on their full sets of shingles. With 60 bands of 7 coordinates a
pair of similarity 0.8 shares no band with a chance of 7 in 10^7, and agrees in fewer than
287 of 420 coordinates with one of 2 in 10^7; a pair that has a passage in common, of
similarity 0.25, is a candidate with one of 1 in 270.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave.llm.blocks import KEY_BITS, mix, packed, set_marks, shingles, unpacked
from usageweave.llm.linking import Grouping, beside, several, smallest_ids
from usageweave.llm.shared import bit_filter, in_filter, stored

_EMPTY = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class MinhashOptions:
    #: Words in a shingle; texts with fewer words are one shingle as a whole.
    n: int = 4
    #: Least similarity in percent.
    percent: int = 80
    #: Coordinates of a sketch, and of a band.
    bins: int = 420
    band: int = 7
    #: Fewest coordinates in which the sketches of similar texts agree.
    agree: int = 287
    #: Bytes of text that are sketched at once.
    block_bytes: int = 8_000_000
    #: Most bits of the filter of texts whose sets are needed (32 MB).
    filter_bits: int = 1 << 28


def sketch(keys: np.ndarray, owner: np.ndarray, n_texts: int, bins: int) -> np.ndarray:
    """A row of ``bins`` values for each text; texts without keys keep the empty value.

    ``keys`` are hashes of shingles, ``owner`` the text of each; repeats change nothing.
    """
    out = np.full(n_texts * bins, _EMPTY, np.uint64)
    rows, live = out.reshape(n_texts, bins), np.unique(owner)
    for turn in range(2 * bins):
        if not len(live):
            break
        step = (turn + 1) * 0x9E3779B97F4A7C15 % 2**64
        hashes = mix(mix(keys + np.uint64(step)))
        into = hashes % np.uint64(bins) if turn < bins else np.uint64(turn - bins)
        place = owner * bins + np.asarray(into).astype(np.int64)
        open_ = out[place] == _EMPTY
        np.minimum.at(out, place[open_], hashes[open_] // np.uint64(bins))
        live = live[(rows[live] == _EMPTY).any(axis=1)]
        still = np.zeros(n_texts, bool)
        still[live] = True
        keys, owner = keys[still[owner]], owner[still[owner]]
    return rows


def _bands(values: np.ndarray, band: int) -> np.ndarray:
    """A hash of each band of each row of a sketch; bands of different place differ."""
    parts = values.reshape(len(values), -1, band)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for i in range(band):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, i])
    return out.view(np.int64)


def _distinct(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, whose they are, and how many each has."""
    keys, owner = shingles(texts, n)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
        keys, owner = keys[new], owner[new]
    return keys, owner, np.bincount(owner, minlength=len(texts))


def _in_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches in tables that end with the row that completes ``size`` bytes of text."""
    held, rows = 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        total = held + np.cumsum(lengths)
        at = 0
        for cut in np.flatnonzero(np.diff(total // size, prepend=0)) + 1:
            yield pa.Table.from_batches([*rows, batch.slice(at, cut - at)])
            rows, at = [], cut
        if at < batch.num_rows:
            rows.append(batch.slice(at))
        held = int(total[-1]) % size
    if rows:
        yield pa.Table.from_batches(rows)


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]


SIGNATURE = "n_shingles long, node binary, bands array<long>"


def signatures(docs: DataFrame, options: MinhashOptions = MinhashOptions()) -> DataFrame:
    """doc_id, text_hash, the size of each text's set, ``node`` (equal for equal sets), and a
    hash of each band of its sketch. A text without words has null for the last two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_blocks(batches, options.block_bytes):
            keys, owner, sizes = _distinct(_texts(table), options.n)
            values = sketch(keys, owner, len(sizes), options.bins)
            some = sizes > 0
            bands = _bands(values, options.band)
            columns = {
                "doc_id": table.column("doc_id"),
                "text_hash": table.column("text_hash"),
                "n_shingles": pa.array(sizes, pa.int64()),
                "node": pa.array(
                    [m if s else None for m, s in zip(set_marks(keys, sizes), some)], pa.binary()
                ),
                "bands": pa.array(
                    [b if s else None for b, s in zip(bands, some)], pa.list_(pa.int64())
                ),
            }
            yield from pa.table(columns).to_batches()

    rows = _rows(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, text_hash long, {SIGNATURE}")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _sets(docs: DataFrame, shown: DataFrame, options: MinhashOptions) -> DataFrame:
    """(node, sketch, keys): a byte of each coordinate of the sketch, and all shingles, of the
    classes ``shown`` (node, doc_id, text_hash) by one of their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_blocks(batches, options.block_bytes):
            keys, owner, sizes = _distinct(_texts(table), options.n)
            values = sketch(keys, owner, len(sizes), options.bins)
            narrow = (mix(values) & np.uint64(255)).astype(np.uint8)
            data, ends = packed(keys), np.cumsum(sizes) * (KEY_BITS // 8)
            own = [data[b:e] for b, e in zip(np.append(0, ends[:-1]), ends)]
            columns = {
                "node": table.column("node"),
                "sketch": pa.array([v.tobytes() for v in narrow], pa.binary()),
                "keys": pa.array(own, pa.binary()),
            }
            yield from pa.table(columns).to_batches()

    of = shown.select("node", F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"))
    # Texts that can't be among them are left out before any are dealt out.
    hashes = shown.select(F.col("text_hash").alias("hash"))
    bits = bit_filter(hashes, shown.count(), options.filter_bits)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            place = batch.column("text_hash").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_filter(known, place)))

    rows = _rows(docs)
    rows = rows.mapInArrow(maybe, rows.schema)
    texts = rows.join(of, F.expr("doc_id <=> of_doc AND text_hash = of_text"))
    sets = texts.select("node", "text").mapInArrow(run, "node binary, sketch binary, keys binary")
    # The row that shows a class may stand there several times.
    return sets.dropDuplicates(["node"])


def _agreeing(least: int):
    """Pairs whose sketches agree in ``least`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
                for c in ("a_sketch", "b_sketch")
            )
            same = (a == b).reshape(batch.num_rows, -1).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return run


def _confirmed(percent: int):
    """Pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column("a_keys"), batch.column("b_keys")):
                a, b = unpacked(a.as_py()), unpacked(b.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return run


def grouping(
    docs: DataFrame, signed: DataFrame, options: MinhashOptions = MinhashOptions()
) -> Grouping:
    """The classes of equal sets among ``signed`` (:func:`signatures` of ``docs``, stored),
    ready to be grouped by the bands they share.
    """
    size = F.col("n_shingles").alias("size")
    one = F.first(F.struct(size, "bands", "doc_id", "text_hash"))
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(one.alias("one"))
    classes = stored(classes.select("node", "one.*"), "minhash-classes")
    banded = classes.select("node", "size", F.explode("bands").alias("key"))
    postings = stored(several(banded), "minhash-postings")
    shown = classes.join(postings.select("node").distinct(), "node", "left_semi")
    shown = stored(shown.select("node", "doc_id", "text_hash"), "minhash-shown")
    sets = stored(_sets(docs, shown, options), "minhash-sets")

    def compare(pairs: DataFrame, most_unlike: bool) -> DataFrame:
        if most_unlike:
            near = beside(pairs, sets, "sketch").mapInArrow(
                _agreeing(options.agree), "a binary, b binary"
            )
            pairs = stored(near, "minhash-near")
        held = beside(pairs, sets, "keys")
        found = held.mapInArrow(_confirmed(options.percent), "a binary, b binary")
        return stored(found, "minhash-links")

    t = options.percent
    return Grouping(
        postings,
        compare,
        sets.selectExpr(
            "node", f"octet_length(keys) div {KEY_BITS // 8} AS size", "0L AS alone", "keys"
        ),
        t,
        near=f"100 * x.size >= {t} * y.size AND 100 * y.size >= {t} * x.size",
    )


def near_duplicates(docs: DataFrame, options: MinhashOptions = MinhashOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of ``docs`` (doc_id,
    text); text_hash tells rows of one id apart.

    component_id is the smallest doc_id that a chain of links reaches, and kept says
    whether that is the row's own. Null and empty texts have no shingles, link with nothing
    and are kept; repeated rows link with each other and are all kept or not. Null ids
    don't count as smallest; a component of null ids alone has a null id and is kept. Very
    long texts are sketched whole. An empty table gives an empty one; other columns are left
    behind.
    """
    signed = stored(signatures(docs, options), "minhash-signatures")
    labels = grouping(docs, signed, options).run()
    ids = smallest_ids(signed.where("node IS NOT NULL"), labels)
    joined = signed.where("node IS NOT NULL").join(ids, "node")
    alone = signed.where("node IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash"]
    rows = joined.select(*columns).unionByName(alone.select(*columns))
    kept = F.expr("doc_id <=> component_id")
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")
