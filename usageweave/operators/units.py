"""Unit-wise scans that also hold when one unit is far too big for a task.

A *unit* is one device log.  Most units are small: they are hash-partitioned
by unit and every scan is an ordinary window.  A unit with very many rows is
*hot*; hot units are range-partitioned by (unit, time) into slices, scans run
inside each slice, and what has to cross slice borders travels in a table with
one row per (unit, slice).

``Lane`` tells an operator which of the two applies, so operators are written
once on top of the scans below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions.values import same_app
from usageweave.operators.storage import materialise

# Tables with a row per hot unit or slice pass through the driver, as broadcasts, up to this
# many rows; larger ones are joined by shuffles.
BROADCAST_ROWS = 20_000
# Hot rows are dealt into one range for each shuffle partition, or more of this many rows;
# a range has as many slices as it needs.
RANGE_ROWS = 1_000_000
# Options that would make more hot units or slices than this are refused.
MAX_HOT_UNITS = 20_000_000
MAX_SLICES = 20_000_000


@dataclass(frozen=True)
class Lane:
    """How the units of a DataFrame are laid out; ``slices=0``: one task each.

    ``slices`` of ``slice_rows`` rows lie in ``ranges`` range partitions (0: one slice each).
    With ``small``, tables with a row per hot unit or slice are broadcast.
    """

    unit: str
    slices: int = 0
    partitions: int = 0
    slice_rows: int = 0
    ranges: int = 0
    small: bool = True

    @property
    def sliced(self) -> bool:
        return self.slices > 0

    @property
    def keys(self) -> list[str]:
        return [self.unit, C.SLICE] if self.sliced else [self.unit]

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the plan of a sliced lane, whose scans read their input twice."""
        return materialise(df, name) if self.sliced else df

    def attach(self, df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
        """Join a table with a row per hot unit or slice."""
        return df.join(F.broadcast(table) if self.small else table, on, how)

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(C.SLICE)


def split_lanes(df: DataFrame, options: StudyOptions) -> list[tuple[DataFrame, Lane]]:
    """Separate hot units from the rest after counting rows per unit."""
    unit = options.unit
    df = df.withColumn(unit, F.coalesce(F.col(unit), F.lit("")))
    sizes = df.groupBy(unit).agg(F.count(F.lit(1)).alias("unit_rows"))
    plain = Lane(unit, partitions=options.unit_partitions)
    hot = sizes.filter(F.col("unit_rows") > options.hot_unit_rows)
    hot_units, hot_rows = hot.agg(F.count(F.lit(1)), F.sum("unit_rows")).first()
    if not hot_units:
        return [(df, plain)]
    hot = materialise(hot, "hot-units")
    slices = -(-hot_rows // options.slice_rows)
    if hot_units > MAX_HOT_UNITS or slices > MAX_SLICES:
        raise ValueError(
            f"{hot_units} hot units in {slices} slices: raise hot_unit_rows or slice_rows"
            f" until there are at most {MAX_HOT_UNITS} and {MAX_SLICES}"
        )
    slices = max(2, slices)
    dealt = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(dealt, -(-hot_rows // RANGE_ROWS))
    small = hot_units + slices <= BROADCAST_ROWS
    lane = Lane(unit, slices, 0, options.slice_rows, 0 if slices <= ranges else ranges, small)
    names = hot.select(unit)
    return [
        (lane.attach(df, names, [unit], "left_anti"), plain),
        (lane.attach(df, names, [unit], "left_semi"), lane),
    ]


def by_unit(
    df: DataFrame, step: Callable[[DataFrame, Lane], DataFrame], options: StudyOptions
) -> DataFrame:
    """Run ``step`` on the plain and on the hot units and put both together."""
    parts = [
        lane.finish(step(part, lane)) for part, lane in split_lanes(df, options)
    ]
    return reduce(DataFrame.unionByName, parts)


def lookup_join(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "left"
) -> DataFrame:
    """Join a dimension that is stored first, so that its size in bytes is known.

    Spark broadcasts it up to ``spark.sql.autoBroadcastJoinThreshold``; beyond
    that it shuffles, and adaptive skew handling splits hot keys.
    """
    return df.join(materialise(table, "lookup"), on, how)


def whole_unit(df: DataFrame, lane: Lane, values: dict[str, Column]) -> DataFrame:
    """Attach per-unit aggregates of ``values`` (aggregate expressions)."""
    if not lane.sliced:
        window = Window.partitionBy(lane.unit)
        return df.withColumns({n: e.over(window) for n, e in values.items()})
    stats = df.groupBy(lane.unit).agg(*[e.alias(n) for n, e in values.items()])
    return lane.attach(df, stats, [lane.unit])


def _before(keys: Iterable[str], order: Column | str):
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def nearest(
    df: DataFrame,
    lane: Lane,
    *,
    earlier: dict[str, Column] | None = None,
    later: dict[str, Column] | None = None,
    by: Iterable[str] = (),
) -> DataFrame:
    """Value of the nearest strictly earlier / later row where it is not null.

    ``by`` narrows the search to rows that agree on more columns.
    """
    earlier, later, by = earlier or {}, later or {}, list(by)
    directions = [(earlier, F.asc(C.SEQ)), (later, F.desc(C.SEQ))]
    values = {**earlier, **later}
    local = {
        name: F.last(expr, ignorenulls=True).over(_before([*lane.keys, *by], order))
        for exprs, order in directions
        for name, expr in exprs.items()
    }
    if not lane.sliced:
        return df.withColumns(local)

    def edge(name: str, expr: Column) -> Column:
        pick = F.max_by if name in earlier else F.min_by
        return pick(expr, F.when(expr.isNotNull(), F.col(C.SEQ))).alias(name)

    edges = df.groupBy(*lane.keys, *by).agg(*[edge(n, e) for n, e in values.items()])
    slice_order = [(earlier, F.asc(C.SLICE)), (later, F.desc(C.SLICE))]
    carry = edges.select(
        *lane.keys,
        *by,
        *[
            F.last(n, ignorenulls=True)
            .over(_before([lane.unit, *by], order))
            .alias(f"carry_{n}")
            for exprs, order in slice_order
            for n in exprs
        ],
    )
    df = df.withColumns(local)
    if by:
        joined = df.join(carry, [*lane.keys, *by], "left")
    else:
        joined = lane.attach(df, carry, lane.keys)
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.col(f"carry_{n}")) for n in values}
    ).drop(*[f"carry_{n}" for n in values])


def next_of_other_app(
    df: DataFrame,
    lane: Lane,
    name: str,
    matches: Column,
    app: str,
    value: Column,
) -> DataFrame:
    """``value`` of the first later matching row that belongs to another app.

    The first later match is known from one backward scan.  If it belongs to
    the row's own app, so do all matches up to the first one that is followed
    by a match of a different app; that following match is the answer.
    """
    before = _before(lane.keys, F.desc(C.SEQ))
    nxt, turn = f"_{name}_next", f"_{name}_turn"
    this = F.struct(F.col(app).alias("app"), value.alias("value"))
    df = df.withColumn(nxt, F.last(F.when(matches, this), True).over(before))
    turns = (
        matches & F.col(nxt).isNotNull() & ~same_app(F.col(app), F.col(f"{nxt}.app"))
    )
    turned = F.when(turns, F.col(f"{nxt}.value"))
    df = df.withColumn(turn, F.last(turned, True).over(before))

    def pick(found: Column, other: Column, beyond: Column) -> Column:
        own = same_app(found["app"], F.col(app))
        return (
            F.when(found.isNull(), beyond)
            .when(~own, found["value"])
            .otherwise(F.coalesce(other, beyond))
        )

    nothing = F.lit(None)
    if not lane.sliced:
        df = df.withColumn(name, pick(F.col(nxt), F.col(turn), nothing))
        return df.drop(nxt, turn)

    # First match and first turn of each slice, then the same scan over slices.
    slices = df.groupBy(*lane.keys).agg(
        F.min_by(this, F.when(matches, F.col(C.SEQ))).alias("first"),
        F.min_by(turned, F.when(turns, F.col(C.SEQ))).alias("turn"),
    )
    slices_before = _before([lane.unit], F.desc(C.SLICE))
    slices = slices.withColumn("next", F.last("first", True).over(slices_before))
    crosses = (
        F.col("first").isNotNull()
        & F.col("next").isNotNull()
        & ~same_app(F.col("first.app"), F.col("next.app"))
    )
    # A slice without a turn inside may still turn towards the next match.
    leaves = F.coalesce(F.col("turn"), F.when(crosses, F.col("next.value")))
    carry = slices.select(
        *lane.keys,
        F.col("next").alias("_next"),
        F.last(leaves, True).over(slices_before).alias("_turn"),
    )
    df = lane.attach(df, carry, lane.keys)
    after = pick(F.col("_next"), F.col("_turn"), nothing)
    df = df.withColumn(name, pick(F.col(nxt), F.col(turn), after))
    return df.drop(nxt, turn, "_next", "_turn")
