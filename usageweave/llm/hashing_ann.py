"""Approximate nearest neighbours by multi-index hashing.

Vectors are centred, rotated onto their principal axes and on to where the signs of the
coordinates lose least (iterative quantisation), and become binary codes. A code is cut
into substrings, each of which is indexed. If two codes differ in at most r bits, some
substring of the m differs in at most r // m; probing all values of each substring within
that many bits retrieves every code within r, and these are ranked by their vectors.

Rotation and radius are learned from a bounded sample (``sample`` vectors by hash order):
the radius is that within which the wanted share of the sample's own nearest neighbours
lie. Every row is indexed. The index is dealt out in shards, each probed by all queries,
which are the stated set; a shard returns a query's nearest k, so what is shuffled and
merged is k rows for each query and shard. Equal vectors are one entry of the index with
as many ids as a query can want.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageweave.llm.shared import stored


@dataclass(frozen=True)
class AnnOptions:
    k: int = 10
    #: Vectors the rotation and the radius are learned from, and rounds of learning.
    sample: int = 4096
    rounds: int = 30
    #: Bits of a substring; a code has as many bits as a vector has components.
    substring: int = 16
    #: Share of the sample's nearest neighbours that the radius must reach.
    reach: float = 0.98
    #: Index entries in a shard, and queries probed at a time.
    shard_rows: int = 8192
    query_rows: int = 2048
    seed: int = 7


@dataclass
class Codes:
    """What turns vectors into codes, and how far around a query's code to look."""

    centre: np.ndarray
    axes: np.ndarray
    radius: int
    substring: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    @property
    def substrings(self) -> int:
        return -(-self.bits // self.substring)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector its code's substrings as numbers."""
        signs = (vectors - self.centre) @ self.axes > 0
        pad = self.substrings * self.substring - self.bits
        signs = np.pad(signs, ((0, 0), (0, pad)))
        parts = signs.reshape(len(vectors), self.substrings, self.substring)
        return parts @ (1 << np.arange(self.substring))


#: Queries whose products with a shard's vectors are made at once.
_AT_ONCE = 64
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def learn_codes(vectors: np.ndarray, options: AnnOptions) -> Codes:
    """Codes learned from a sample of vectors."""
    centre = vectors.mean(0)
    centred = vectors - centre
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    rotation = np.linalg.qr(
        np.random.default_rng(options.seed).standard_normal((axes.shape[1],) * 2)
    )[0]
    projected = centred @ axes
    for _ in range(options.rounds):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    codes = Codes(centre, axes @ rotation, 0, options.substring)
    own, probes = codes.encode(vectors), min(len(vectors), 256)
    distances = []
    for i in range(probes):
        far = ((vectors - vectors[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: options.k]
        distances += _ONES[own[near] ^ own[i]].sum(1)[np.isfinite(far[near])].tolist()
    if distances:
        codes.radius = int(np.quantile(distances, options.reach, method="higher"))
    return codes


class Shard:
    """Index entries with, for each substring, the entries by its value."""

    def __init__(self, codes: Codes, vectors: np.ndarray) -> None:
        self.codes, self.vectors = codes, vectors
        # A row for each substring, so that a query goes along all entries' values.
        self.own = np.ascontiguousarray(codes.encode(vectors).T.astype(np.uint32))
        with np.errstate(over="ignore"):
            self.squares = (vectors**2).sum(1)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every entry whose code differs in at most ``radius`` bits.

        By the pigeonhole these have a substring that differs in its share of the bits at
        most. All values of a substring that occur are looked at, in one pass over entries:
        where most of them are in reach, that takes less than their lists one by one.
        """
        share = radius // self.codes.substrings
        bits = [_ONES[own ^ part] for own, part in zip(self.own, code.astype(np.uint32))]
        found = bits[0] <= share
        total = bits[0].astype(np.uint16)
        for other in bits[1:]:
            found |= other <= share
            total += other
        return np.flatnonzero(found & (total <= radius))

    def _nearest_few(
        self, at: np.ndarray, query: np.ndarray, products: np.ndarray, n: int
    ) -> np.ndarray:
        """Of the entries ``at`` those that may be among the ``n`` nearest: distances by
        products are off by rounding, so what is nearer than the n-th and twice the error
        stays. All stay where numbers are too large for that.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            own = query @ query
            far = self.squares[at] + own - 2 * products[at]
            error = 8 * (len(query) + 4) * np.finfo(float).eps * (self.squares[at].max() + own)
            few = far <= np.partition(far, n - 1)[n - 1] + 2 * error
            return at[few] if np.isfinite(far).all() and np.isfinite(error) else at

    def nearest(
        self, query: np.ndarray, code: np.ndarray, n: int, products: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Up to ``n`` entries within the radius, nearest first, with their distances. A
        shard with fewer entries within it widens the radius until it has ``n``.
        ``products`` are those of the query with all vectors of the shard.
        """
        radius, count = self.codes.radius, len(self.vectors)
        at = self.within(code, radius)
        while len(at) < min(n, count):
            radius += self.codes.substrings
            at = self.within(code, radius)
        if len(at) > n:
            at = self._nearest_few(at, query, products, n)
        far = np.sqrt(((self.vectors[at] - query) ** 2).sum(1))
        if len(at) > n:
            # All that tie with the n-th stay; ids decide between them later.
            at, far = at[keep := far <= np.partition(far, n - 1)[n - 1]], far[keep]
        order = np.argsort(far, kind="stable")
        return at[order], far[order]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all 0."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(
        (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _sample(vectors: DataFrame, options: AnnOptions) -> np.ndarray:
    rows = (
        vectors.select("vector", F.xxhash64("vector").alias("place"))
        .orderBy("place")
        .limit(options.sample)
        .select("vector")
        .toArrow()
    )
    return _matrix(rows.column("vector")) if rows.num_rows else np.zeros((0, 1))


def neighbours(
    vectors: DataFrame, is_query: Column, options: AnnOptions = AnnOptions()
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row of ``vectors``
    (vec_id, embedding) with ``is_query``, by Euclidean distance in double precision.

    Nearest first, on ties the smaller vec_id; a query's own row is no candidate, other
    rows with the same vector are. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those whose length is not the commonest one (of equally
    common lengths, the longest). Rows with a null vec_id are not candidates or queries.
    With no more than k candidates all are found. An empty table gives an empty one; other
    columns are left behind. Repeated rows (same vec_id and vector) are one candidate and
    one query; an id with several vectors is a candidate and a query with each of them, and
    of its rows for one query those of equal score are one.
    """
    k = options.k
    rows = vectors.where("vec_id IS NOT NULL").where(usable(F.col("embedding")))
    rows = rows.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    lengths = rows.groupBy(F.size("vector").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 0
    rows = rows.where(F.size("vector") == length).withColumn("same", F.md5(F.to_json("vector")))
    candidates = rows.select("same", "vec_id").distinct()
    # The ids a query can want of equal vectors: k besides its own, the smallest.
    nth = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    ids = candidates.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    ids = ids.groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(
        rows.groupBy("same").agg(F.first("vector").alias("vector")).join(ids, "same"),
        "ann-entries",
    )
    codes = learn_codes(_sample(entries, options), options) if length else None
    count = entries.count()
    shards = max(1, -(-count // options.shard_rows))
    queries = stored(
        rows.where("is_query")
        .groupBy(F.col("vec_id").alias("query_id"), "same")
        .agg(F.first("vector").alias("vector"))
        .drop("same")
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20))),
        "ann-queries",
    )
    parts = max(1, -(-queries.count() // options.query_rows))
    asked = queries.select(
        "query_id",
        "vector",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod("part", F.lit(parts)).alias("part"),
    )
    dealt = entries.select(
        "ids",
        "vector",
        F.pmod(F.xxhash64("same"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    ).withColumn("part", F.col("part").cast("long"))
    asked = asked.withColumn("part", F.col("part").cast("long"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            shard = Shard(codes, _matrix(right.column("vector")))
            ids = right.column("ids").to_pylist()
            asking = _matrix(left.column("vector"))
            own, asked_ids = codes.encode(asking), left.column("query_id").to_pylist()
            for i, (query, vector, code) in enumerate(zip(asked_ids, asking, own)):
                if i % _AT_ONCE == 0:
                    with np.errstate(over="ignore", invalid="ignore"):
                        products = asking[i : i + _AT_ONCE] @ shard.vectors.T
                # One more entry, as the query's own may be among them.
                n = k + 1
                while True:
                    at, far = shard.nearest(vector, code, n, products[i % _AT_ONCE])
                    pairs = zip(at.tolist(), far.tolist())
                    near = {(d, i) for a, d in pairs for i in ids[a] if i != query}
                    # Fewer only if an id has several vectors: more entries are needed.
                    if len(near) >= k or n >= len(ids):
                        break
                    n *= 2
                out += [(query, i, d) for d, i in sorted(near)[:k]]
        columns = list(zip(*out)) if out else ((), (), ())
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    found = (
        asked.groupBy("shard", "part")
        .cogroup(dealt.groupBy("shard", "part"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
