"""N-gram Jaccard join by rare-first prefix filtering.

Every text is the set of its ``n``-word shingles, as 56-bit hashes. All sets are ordered
alike: shingles by how often they occur in all texts, rarest first. Two sets that are
similar enough share one of the first ``size - ceil(t * size) + 1`` shingles of each, so
only these are joined; shingles that occur once can't join, and most texts have nothing
else in front. Lengths and the places of the first common shingle rule out pairs, and then the suffix
filter does: the sets are split at the same places of the hash range, into halves, their
halves and so on, and what the parts differ by in size is the least that the sets differ by.
Parts are so small that texts of any length are told apart. The sets themselves are compared
once for each pair that is left.

Texts with equal sets are one class and are joined as one. Of the classes that share a
shingle not all pairs are looked at, but for those that :mod:`linking` can't put into one
group by others, so a large family of near copies costs a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usageweave.llm.blocks import (
    KEY_BITS,
    count_keys,
    in_blocks,
    packed,
    set_marks,
    shingles,
    unpacked,
    with_totals,
)
from usageweave.llm.linking import Grouping, beside, several, smallest_ids
from usageweave.llm.shared import stored

#: Lowest bytes of keys that are not needed to count them: 40 bits tell 10 billion shingles
#: apart but for one in a hundred, which then counts as one that others have, too.
UNCOUNTED = 2
#: Parts of the hash range at the first split, and the most there are.
FIRST_PARTS, MOST_PARTS = 16, 1 << 16


@dataclass(frozen=True)
class JoinOptions:
    #: Words in a shingle; texts with fewer words are one shingle as a whole.
    n: int = 4
    #: Least similarity in percent.
    percent: int = 85


def _keys(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = shingles(texts, n)[0]
    shift = np.uint64(8 * UNCOUNTED)
    return keys >> shift << shift, np.ones((1, len(keys)), np.uint8)


SETS = (
    "text_key binary, size long, rare int, prefix array<long>, parts binary, shared binary"
)


def _parts(keys: np.ndarray) -> bytes:
    """How many of the keys are in each part of their range, some two in a part."""
    bits = int(np.clip(len(keys) // 2, FIRST_PARTS, MOST_PARTS)).bit_length()
    n = min(1 << bits, MOST_PARTS)
    at = (keys >> np.uint64(KEY_BITS - n.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n), 255).astype(np.uint8).tobytes()


def _folded(parts: np.ndarray, n: int) -> np.ndarray:
    """Counts in ``n`` larger parts; 255 stands for as many or more."""
    return np.minimum(parts.reshape(n, -1).sum(axis=1, dtype=np.int64), 255)


def differ_at_least(a: bytes, b: bytes, enough: int) -> int:
    """Fewest keys in one of two sets only, by their parts: of a few parts first, then of
    more, until there are ``enough``.
    """
    a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
    finest, n = min(len(a), len(b)), FIRST_PARTS
    while True:
        least = int(np.abs(_folded(a, n) - _folded(b, n)).sum())
        if least >= enough or n == finest:
            return least
        n = min(8 * n, finest)


def _sets(options: JoinOptions):
    """The work on a block: each text's set; what is joined only where it can join."""

    def work(rows, texts, keys, totals):
        keys, owner = shingles(texts, options.n)
        n_texts = len(texts)
        # Distinct shingles of each text, rarest first and then by hash.
        order = np.lexsort((keys, totals[0], owner))
        keys, counts, owner = keys[order], totals[0][order], owner[order]
        if len(keys):
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
            keys, counts, owner = keys[new], counts[new], owner[new]
        sizes = np.bincount(owner, minlength=n_texts)
        ends = np.cumsum(sizes)
        rare = np.bincount(owner[counts == 1], minlength=n_texts)
        reach = sizes - -(-options.percent * sizes // 100) + 1
        prefix, parts, shared = [], [], []
        for i in range(n_texts):
            start = ends[i] - sizes[i]
            if sizes[i] and rare[i] < reach[i]:
                own = keys[start + rare[i] : ends[i]]
                prefix.append(own[: reach[i] - rare[i]].astype(np.int64))
                own = np.sort(own)
                parts.append(_parts(own))
                shared.append(packed(own))
            else:
                prefix.append(None)
                parts.append(None)
                shared.append(None)
        columns = {
            "doc_id": rows.column("doc_id"),
            "text_hash": rows.column("text_hash"),
            "text_key": pa.array(set_marks(keys, sizes), pa.binary()),
            "size": pa.array(sizes, pa.int64()),
            "rare": pa.array(rare, pa.int32()),
            "prefix": pa.array(prefix, pa.list_(pa.int64())),
            "parts": pa.array(parts, pa.binary()),
            "shared": pa.array(shared, pa.binary()),
        }
        return pa.table(columns)

    return work


def shingle_sets(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """doc_id, text_hash, text_key (equal for equal sets), size, and for texts that may
    join: how many shingles are theirs alone, the prefix without these, and of all shingles
    that others have, too, the number in each part of the range and the shingles themselves.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    blocks, groups = in_blocks(rows, ["doc_id"])

    def keys_of(texts: list[bytes]):
        return _keys(texts, options.n)

    totals = count_keys(blocks, groups, keys_of, UNCOUNTED)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return with_totals(
        blocks, totals, groups, keys_of, _sets(options), f"doc_id {id_type}, text_hash long, {SETS}"
    )


def _least(percent: int) -> str:
    """Fewest common shingles of sets of sizes x.size and y.size that are similar enough."""
    return f"(({percent} * (x.size + y.size) + {99 + percent}) div {100 + percent})"


class _Join:
    """Classes of equal sets and their prefixes by shingle."""

    def __init__(self, sets: DataFrame, options: JoinOptions) -> None:
        self.options = options
        one = F.first(F.struct("size", "rare", "prefix", "parts", "shared"))
        classes = (
            sets.where("shared IS NOT NULL")
            .groupBy(F.col("text_key").alias("node"))
            .agg(one.alias("set"))
            .select("node", "set.*")
        )
        self.classes = stored(classes, "join-classes")
        each = self.classes.select("node", "size", "rare", F.posexplode("prefix").alias("at", "key"))
        each = each.select("key", "node", "size", (F.col("rare") + F.col("at")).alias("place"))
        self.postings = stored(several(each), "join-postings")
        #: Whether ``x`` and ``y``, which share a shingle, may be similar by their sizes and by
        #: what is left behind the shingle's places. Behind their first common shingle that
        #: bounds all they share; by a later one a pair may be passed over.
        t = options.percent
        self.near = (
            f"100 * y.size >= {t} * x.size AND 100 * x.size >= {t} * y.size"
            f" AND least(x.size - x.place, y.size - y.place) >= {_least(t)}"
        )
        self.first = "array_intersect(x.prefix, y.prefix)[0] = x.key"

    def grouping(self) -> Grouping:
        sets = self.classes.selectExpr("node", "size", "CAST(rare AS LONG) AS alone", "shared AS keys")
        return Grouping(self.postings, self.compare, sets, self.options.percent, self.near)

    def every_pair(self) -> DataFrame:
        p = self.postings.join(self.classes.select("node", "prefix"), "node")
        near = f"x.key = y.key AND x.node < y.node AND {self.near} AND {self.first}"
        pairs = p.alias("x").join(p.alias("y"), F.expr(near))
        return pairs.selectExpr("x.node AS a", "y.node AS b")

    def compare(self, pairs: DataFrame, most_unlike: bool) -> DataFrame:
        """Links among ``pairs``: those whose sets are similar enough. The suffix filter comes
        first if ``most_unlike``, else it would leave most pairs.
        """
        least = _least(self.options.percent).replace("x.", "a_").replace("y.", "b_")
        numbers = beside(pairs, self.classes, "size", "rare", "parts").selectExpr(
            "a",
            "b",
            f"{least} AS least",
            "a_size + b_size - a_rare - b_rare AS both",
            "a_parts",
            "b_parts",
        )
        if most_unlike:
            near = numbers.mapInArrow(_suffix_filter, "a binary, b binary, least long")
            near = stored(near, "join-near")
            held = beside(near, self.classes, "shared")
        else:
            held = beside(pairs, self.classes, "size", "shared").withColumn("least", F.expr(least))
        held = held.select(
            "a", "b", "least", F.col("a_shared").alias("a_set"), F.col("b_shared").alias("b_set")
        )
        return stored(held.mapInArrow(_verified, "a binary, b binary, common long"), "join-links")


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that have ``least`` common shingles by the sizes of their parts: of the ``both``
    shingles that others share, what is in one set only is not common.
    """
    for batch in batches:
        columns = [batch.column(c) for c in ("a_parts", "b_parts")]
        numbers = [batch.column(c).to_pylist() for c in ("both", "least")]
        near = []
        for a, b, both, least in zip(*columns, *numbers):
            most = both - 2 * least
            near.append(most >= 0 and differ_at_least(a.as_py(), b.as_py(), most + 1) <= most)
        yield batch.select(["a", "b", "least"]).filter(pa.array(near, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [
            len(np.intersect1d(unpacked(a.as_py()), unpacked(b.as_py()), assume_unique=True))
            for a, b in zip(batch.column("a_set"), batch.column("b_set"))
        ]
        common = pa.array(common, pa.int64())
        out = batch.select(["a", "b"]).append_column("common", common)
        yield out.filter(pc.greater_equal(common, batch.column("least")))


def links(sets: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(a, b, common): every pair of classes (by ``text_key``) of :func:`shingle_sets` that
    is similar enough, with the number of common shingles.
    """
    join = _Join(sets, options)
    return join.compare(join.every_pair(), True)


def near_duplicates(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component) for each row of ``docs``
    (doc_id, text); text_hash tells rows of one id apart, and component is null for texts
    that can link with nothing.

    component_id is the smallest doc_id that a chain of links reaches. Null and empty
    texts have no shingles and link with nothing; repeated rows link with each other.
    Null ids don't count as smallest; a component of null ids alone has a null id. An
    empty table gives an empty one; other columns are left behind.
    """
    sets = stored(shingle_sets(docs, options), "join-sets")
    labels = _Join(sets.where("size > 0"), options).grouping().run()
    joining = sets.where("size > 0 AND shared IS NOT NULL").select(
        "doc_id", "text_hash", "size", F.col("text_key").alias("node")
    )
    members = joining.join(smallest_ids(joining, labels), "node").withColumn(
        "component", F.coalesce("component", "node")
    )
    alone = sets.where("size = 0 OR shared IS NULL").withColumns(
        {"component_id": F.col("doc_id"), "component": F.lit(None).cast("binary")}
    )
    columns = ["doc_id", F.col("size").alias("n_shingles"), "component_id", "text_hash", "component"]
    return alone.select(*columns).unionByName(members.select(*columns))


def one_of_each(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """``docs`` with one row left of each component: that of the smallest doc_id, and of
    several rows with this id, that with the smallest hash of its text. Texts without
    words stay. All columns of ``docs`` come back, whatever their names.
    """
    found = near_duplicates(docs.select("doc_id", "text"), options).where("component IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = found.groupBy("component").agg(F.min(place).alias("best"))
    marked = (
        found.join(best, "component")
        .select(
            F.col("doc_id").alias("of_doc"),
            F.col("text_hash").alias("of_text"),
            (place == F.col("best")).alias("stays"),
        )
        .groupBy("of_doc", "of_text")
        .agg(F.max("stays").alias("stays"))
    )
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    text = F.xxhash64(F.col("text").cast("string"))
    df = docs.select(row, F.col("doc_id").alias("_doc"), text.alias("_text"))
    df = df.join(marked, F.expr("_doc <=> of_doc AND _text = of_text"), "left")
    # The same row again is one more member of its component.
    nth = F.row_number().over(Window.partitionBy("_doc", "_text").orderBy("_text"))
    df = df.withColumn("_nth", nth).where("stays IS NULL OR (stays AND _nth = 1)")
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
