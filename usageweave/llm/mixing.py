"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream: its documents in hash order, cut into blocks of equally many
words (the last one may be shorter), read again from the start when it ends. Slot ``i`` of
the schedule maps the point ``frac(i * golden ratio)`` through the cumulative weights of
the sources to one of them; its slots are ranked, and the k-th takes the source's k-th
block. So the mix is even over any stretch of the schedule, and what a source gives is its
target to the word. Closing slots at the end serve sources whose points fell short by the
discrepancy, which grows with the logarithm of the number of slots.

Ranks and word offsets are sums in two steps, over chunks and within chunks, so no source
is ever ordered in one task. Only tables with one row for each source, or for each source
and chunk, pass through a single task or a broadcast, the latter chosen by Spark by size.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usageweave.llm.shared import WORD, count_of, stored, words

getcontext().prec = 50
_GOLDEN = (Decimal(5).sqrt() - 1) / 2
_STEP = 2**20
#: Fractions of one step and of 2**20 steps; in two parts the points stay exact to 1e-9.
_ONE, _MANY = float(_GOLDEN), float(_GOLDEN * _STEP % 1)


@dataclass(frozen=True)
class MixOptions:
    #: Weights of the sources in code point order, null last, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    #: A source gives at most so many times its words.
    most_repeats: int = 3
    block_words: int = 256
    #: Slots, and documents, that one window of the ranking orders.
    chunk: int = 65_536
    seed: int = 42


@dataclass(frozen=True)
class Mix:
    """``documents``: row, doc_id, source, size, sid, begin (its first word's place in
    its source's stream). ``sources``: sid, source, source_size, target, and how it is
    cut. ``schedule``: slot, sid, epoch, block, begin, n_words, in the order of slots.
    """

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    options: MixOptions

    def pieces(self) -> DataFrame:
        """(row, epoch, slot, from_word, n_words): what each slot takes of a document."""
        d = self.documents.where("size > 0").selectExpr(
            "row", "sid", "size", "begin AS doc_begin",
            f"explode(sequence(begin div {self.options.block_words},"
            f" (begin + size - 1) div {self.options.block_words})) AS block",
        )
        s = self.schedule.selectExpr("slot", "sid", "epoch", "block", "begin", "n_words AS taken")
        start = F.greatest("doc_begin", "begin")
        end = F.least(F.expr("doc_begin + size"), F.expr("begin + taken"))
        return (
            d.join(s, ["sid", "block"])
            .select(
                "row", "epoch", "slot",
                (start - F.col("doc_begin")).alias("from_word"),
                (end - start).alias("n_words"),
            )
            .where("n_words > 0")
        )

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken: one row for each document."""
        sums = self.pieces().groupBy("row").agg(F.sum("n_words").alias("taken"))
        return (
            self.documents.join(sums, "row", "left")
            .join(self.sources.select("sid", "source_size", "target"), "sid")
            .select(
                "doc_id", "source", "size", "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            )
        )


def targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size).

    All words are shared by weight; a source's share stops at ``most_repeats`` times its
    words and the excess goes to the others. Sorted by how much weight their limit bears,
    the sources that stop are the first ones, so the common level of the rest follows
    from running sums. The table has one row for each source.
    """
    n = len(options.weights)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy("bound", "sid").rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in options.weights]),
        (F.col("sid") % n + 1).cast("int"),
    )
    df = df.withColumn("weight", weight).withColumn(
        "most", (options.most_repeats * F.col("source_size")).cast("double")
    )
    df = df.withColumn("bound", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(whole) - F.coalesce(
        F.sum("most").over(by_bound), F.lit(0.0)
    )
    weights = F.sum("weight").over(whole) - F.coalesce(
        F.sum("weight").over(by_bound), F.lit(0.0)
    )
    df = df.withColumn("level", left / weights)
    level = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "sid", "level")))
    df = df.withColumn("level", level.over(whole)["level"])
    target = F.least("most", F.col("level") * F.col("weight"))
    return df.select("sid", "source", "source_size", target.alias("target"))


def _running(df: DataFrame, keys: list[str], part: str, order: list, amount: str, to: str):
    """``df`` with ``to``: the sum of ``amount`` over the rows of the same ``keys`` in
    earlier parts, or in the same part and earlier in ``order``.
    """
    parts = df.groupBy(*keys, part).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    within = (
        Window.partitionBy(*keys, part)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = df.join(parts, [*keys, part])
    return joined.withColumn(to, F.col("_before") + F.col("_within")).drop("_before", "_within")


def _numbered(docs: DataFrame, options: MixOptions, keep: list[str]) -> DataFrame:
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            *keep,
            count_of(F.col("text"), WORD).alias("size"),
            F.xxhash64(F.lit(options.seed), "doc_id", "text").alias("place"),
        ),
        "mix-documents",
    )


def _slots(sources: DataFrame, options: MixOptions) -> DataFrame:
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0
    parts = max(1, min(100_000, -(-n_slots // 500_000)))
    # Cumulative weights, and a grid of cells that leads a point to the few near it.
    cells = 4 * sources.count() + 1
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    marks = stored(
        sources.where("slots > 0").select(
            "sid", "slots",
            (F.coalesce(F.sum("slots").over(upto), F.lit(0)) / n_slots).alias("low"),
        ).withColumn("high", F.col("low") + F.col("slots") / F.lit(n_slots))
        .withColumn(
            "cell",
            F.explode(
                F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))
            ),
        ),
        "mix-weights",
    )
    i = F.col("slot")
    point = F.expr(f"slot div {_STEP}") * _MANY % 1 + i % _STEP * _ONE
    slots = (
        spark.range(0, n_slots, 1, parts)
        .withColumnRenamed("id", "slot")
        .withColumn("point", point % 1)
        .withColumn("cell", F.floor(F.col("point") * cells))
        .join(marks, "cell")
        .where("point >= low AND point < high")
        .select("slot", "sid", F.lit(1).alias("one"))
    )
    slots = slots.withColumn("chunk", F.expr(f"slot div {options.chunk}"))
    ranked = _running(slots, ["sid"], "chunk", ["slot"], "one", "k").select("slot", "sid", "k")
    have = ranked.groupBy("sid").agg((F.max("k") + 1).alias("have"))
    closing = (
        sources.join(have, "sid", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .where("have < slots")
        .select("sid", F.explode(F.expr("sequence(have, slots - 1)")).alias("k"))
        .select((F.lit(n_slots) + F.col("k")).alias("slot"), "sid", "k")
    )
    return ranked.unionByName(closing)


def plan_mix(
    docs: DataFrame, options: MixOptions = MixOptions(), keep: tuple[str, ...] = ()
) -> Mix:
    """The mix of ``docs`` (doc_id, source, text); ``keep`` names columns to carry along.

    A document's size is its number of words; null and empty texts have none, count as
    documents and are never taken. Null is a source of its own. Repeated rows are
    documents of their own. Without documents all tables are empty. The order within a
    source depends on doc_id and text alone, so reruns agree.
    """
    carried = list(dict.fromkeys(["doc_id", "source", *keep]))
    numbered = _numbered(docs, options, carried)
    narrow = numbered.select("row", "doc_id", "source", "size", "place")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    block = options.block_words
    sources = targets(sizes, options).withColumn("words", F.floor("target"))
    sources = sources.withColumns(
        {
            "blocks": F.expr(f"CAST(ceil(source_size / {block}) AS BIGINT)"),
            "epochs": F.expr("CASE WHEN words > 0 THEN words div source_size ELSE 0 END"),
        }
    )
    rest = f"CAST(ceil((words - epochs * source_size) / {block}) AS BIGINT)"
    sources = stored(sources.withColumn("slots", F.expr(f"epochs * blocks + {rest}")), "mix-sources")
    n_docs = narrow.count()
    buckets = max(1, -(-n_docs // options.chunk))
    named = sources.select("sid", F.col("source").alias("of_source"))
    placed = narrow.join(named, F.expr("source <=> of_source")).withColumn(
        "bucket", F.pmod("place", F.lit(buckets))
    )
    order = ["place", "doc_id", "size", "row"]
    placed = _running(placed, ["sid"], "bucket", order, "size", "begin")
    columns = ["row", "doc_id", "source", "size", "sid", "begin"]
    documents = numbered.select(
        "row", *[c for c in carried if c not in ("doc_id", "source")]
    ).join(placed.select(*columns), "row") if keep else placed.select(*columns)

    begin, full = f"block * {block}", "epoch * source_size"
    slots = _slots(sources.select("sid", "slots"), options).join(
        sources.select("sid", "source_size", "words", "blocks"), "sid"
    )
    slots = slots.selectExpr("*", "k div blocks AS epoch", "k % blocks AS block")
    schedule = slots.selectExpr(
        "slot", "sid", "epoch", "block", f"{begin} AS begin",
        f"least({block}, source_size - {begin}, words - {full} - {begin}) AS n_words",
    ).where("n_words > 0")
    return Mix(documents, sources, schedule, options)


def mixed_documents(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """``docs`` as the mix takes them: one row for each reading of a document.

    A document that is read in part keeps its leading words, joined by single spaces,
    and its ``n_chars`` is counted anew. All columns of ``docs`` come back, whatever
    their names; documents that are not taken go.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    carried = docs.select("doc_id", "source", "text", row)
    mix = plan_mix(carried, options, keep=("_row",))
    reads = mix.pieces().groupBy("row", "epoch").agg(F.sum("n_words").alias("read_words"))
    df = mix.documents.select("row", "_row", "size").join(reads, "row")
    text = F.when(F.col("read_words") == F.col("size"), F.col("_row.text")).otherwise(
        F.array_join(
            F.slice(words(F.col("_row.text")), F.lit(1), F.col("read_words").cast("int")), " "
        )
    )
    df = df.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.length("_text")}
    types = dict(docs.dtypes)
    return df.select(
        *[
            changed.get(c, F.col("_row")[c]).cast(types[c]).alias(c)
            for c in docs.columns
        ]
    )
