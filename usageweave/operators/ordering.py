"""Order of events inside a unit: ties, sequence numbers and data gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions.values import event_priority
from usageweave.operators.storage import materialise
from usageweave.operators.units import Lane

_LAST = 2**63 - 1  # sort position of rows without a timestamp
_KEY, _PRIORITY = "_time_key", "_priority"


def _gap_hours(previous: Column) -> Column:
    hours = (F.col(C.EVENT_US) - previous) / F.lit(1e6) / F.lit(3600.0)
    return F.when(F.col(C.SEQ) == 1, F.lit(0.0)).otherwise(F.round(hours, 2))


def _moved(in_tie: Column, later_ties: Column) -> Column:
    """Ties step back one microsecond per row, counted from the last one."""
    return F.col(C.RAW_US) - F.when(in_tie, later_ties + 1).otherwise(0)


def order_log(df: DataFrame, lane: Lane, options: StudyOptions) -> DataFrame:
    """Add ``seq``, ``raw_us``, ``event_us`` and ``data_time_gap_hours``.

    Rows of a unit are ordered by time.  Rows that share a timestamp are put
    in the order unknown, stop, other, resumed (later file rows first) and get
    distinct times; ``raw_us`` keeps the time they were recorded with.  Needs
    ``event_timestamp`` (an instant) and ``file_order``.
    """
    stops = {*options.same_app_stops, *options.other_app_stops}
    fix_ties = options.correct_duplicate_timestamps
    time = F.unix_micros("event_timestamp")
    df = df.withColumns(
        {
            C.RAW_US: time,
            _KEY: F.coalesce(time, F.lit(_LAST)),
            _PRIORITY: event_priority(F.col("interaction_type"), stops),
        }
    )
    if fix_ties:
        within = [F.desc(_PRIORITY), F.desc("file_order")]
    else:
        within = [F.asc("file_order")]
    arrange = _arrange_slices if lane.sliced else _arrange_units
    df = arrange(df, lane, within, fix_ties).drop(_KEY, _PRIORITY)
    df = df.withColumn("event_timestamp", F.timestamp_micros(C.EVENT_US))
    return lane.settle(df, "ordered")


def _arrange_units(
    df: DataFrame, lane: Lane, within: list[Column], fix_ties: bool
) -> DataFrame:
    # The unit-wide window comes first: its exchange and sort serve the others.
    unit = Window.partitionBy(lane.unit).orderBy(F.asc(_KEY), *within)
    df = df.withColumn(C.SEQ, F.row_number().over(unit).cast("long"))
    if fix_ties:
        tie = Window.partitionBy(lane.unit, _KEY)
        df = df.withColumns(
            {"_tie_first": F.min(C.SEQ).over(tie), "_tie_last": F.max(C.SEQ).over(tie)}
        )
        tied = F.col("_tie_last") > F.col("_tie_first")
        later = F.col("_tie_last") - F.col(C.SEQ)
        df = df.withColumn(C.EVENT_US, _moved(tied, later))
        df = df.drop("_tie_first", "_tie_last")
    else:
        df = df.withColumn(C.EVENT_US, F.col(C.RAW_US))
    df = df.withColumn("_previous", F.lag(C.EVENT_US).over(unit))
    gap = _gap_hours(F.col("_previous"))
    return df.withColumn("data_time_gap_hours", gap).drop("_previous")


def _slice_number(lane: Lane) -> Column:
    """Numbers slices in the order of rows that are sorted in range partitions."""
    if not lane.ranges:
        return F.spark_partition_id()
    # The number of the partition in the upper bits, that of the row in the lower 33.
    number = F.monotonically_increasing_id()
    row = number.bitwiseAND((1 << 33) - 1)
    return number - row + F.floor(row / lane.slice_rows)


def _arrange_slices(
    df: DataFrame, lane: Lane, within: list[Column], fix_ties: bool
) -> DataFrame:
    order = [F.asc(_KEY), *within]
    df = (
        df.repartitionByRange(lane.ranges or lane.slices, F.asc(lane.unit), *order)
        .sortWithinPartitions(F.asc(lane.unit), *order)
        .withColumn(C.SLICE, _slice_number(lane))
    )
    df = materialise(df, "slices")
    edges = _slice_edges(df, lane, fix_ties)
    row = Window.partitionBy(*lane.keys).orderBy(*order)
    tie = Window.partitionBy(*lane.keys, _KEY)
    df = df.withColumn("_row", F.row_number().over(row).cast("long"))
    df = df.withColumns(
        {"_tie_first": F.min("_row").over(tie), "_tie_last": F.max("_row").over(tie)}
    )
    df = lane.attach(df, edges, lane.keys)
    later = (
        F.col("_tie_last")
        - F.col("_row")
        + F.when(F.col(_KEY) == F.col("_last_key"), F.col("_later")).otherwise(0)
    )
    # A tie is a group of more than one row here, or one that goes on in the
    # slice before or after.
    tied = (
        (F.col("_tie_last") > F.col("_tie_first"))
        | (later > 0)
        | F.coalesce(F.col(_KEY) == F.col("_before_key"), F.lit(False))
    )
    moved = _moved(tied, later) if fix_ties else F.col(C.RAW_US)
    df = df.withColumns(
        {C.EVENT_US: moved, C.SEQ: F.col("_row") + F.col("_rows_before")}
    )
    previous = F.when(F.col("_row") == 1, F.col("_before_us")).otherwise(
        F.lag(C.EVENT_US).over(row)
    )
    df = df.withColumn("_previous", previous)
    gap = _gap_hours(F.col("_previous"))
    df = df.withColumn("data_time_gap_hours", gap)
    helpers = ["_tie_first", "_tie_last", "_row", "_previous", *edges.columns]
    return df.drop(*[c for c in helpers if c not in lane.keys])


def _slice_edges(df: DataFrame, lane: Lane, fix_ties: bool) -> DataFrame:
    """What rows need to know about the slices around theirs.

    One row per (unit, slice): rows in earlier slices, the last time key of
    the slice and how many rows of later slices share it, the last time key
    before the slice, and the (moved) time of the row just before it.
    """
    per_key = df.groupBy(*lane.keys, _KEY).agg(F.count(F.lit(1)).alias("n"))
    per_slice = per_key.groupBy(*lane.keys).agg(
        F.sum("n").alias("rows"),
        F.min(F.struct(_KEY, "n")).alias("first"),
        F.max(F.struct(_KEY, "n")).alias("last"),
    )
    ordered = Window.partitionBy(lane.unit).orderBy(C.SLICE)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumns(
        {
            "_rows_before": F.coalesce(F.sum("rows").over(earlier), F.lit(0)),
            "_last_key": F.col(f"last.{_KEY}"),
            "_before_key": F.lag(f"last.{_KEY}").over(ordered),
        }
    )
    # Later slices that begin with the last key of this one add to its ties.
    begins = per_slice.select(
        *lane.keys, F.col(f"first.{_KEY}").alias("key"), F.col("first.n").alias("n")
    )
    ends = per_slice.filter(F.col(f"first.{_KEY}") != F.col("_last_key")).select(
        *lane.keys, F.col("_last_key").alias("key"), F.lit(0).alias("n")
    )
    following = (
        Window.partitionBy(lane.unit, "key")
        .orderBy(F.desc(C.SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ties = begins.unionByName(ends).select(
        *lane.keys,
        F.col("key").alias("_last_key"),
        F.coalesce(F.sum("n").over(following), F.lit(0)).alias("_later"),
    )
    per_slice = per_slice.join(ties, [*lane.keys, "_last_key"], "left")
    tied = (
        (F.col("_later") > 0)
        | (F.col("last.n") > 1)
        | F.coalesce(F.col("_last_key") == F.col("_before_key"), F.lit(False))
    )
    step = F.when(tied, F.col("_later") + 1).otherwise(0) if fix_ties else F.lit(0)
    last_us = F.when(F.col("_last_key") != _LAST, F.col("_last_key") - step)
    return per_slice.withColumn("_last_us", last_us).select(
        *lane.keys,
        "_rows_before",
        "_last_key",
        "_later",
        "_before_key",
        F.lag("_last_us").over(ordered).alias("_before_us"),
    )
