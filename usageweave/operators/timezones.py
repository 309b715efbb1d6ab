"""Time-zone discovery and the four ways to treat mixed zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usageweave.config import StudyOptions, TimezoneMode
from usageweave.functions.times import is_zone, text_offset_zone, usable_zone
from usageweave.operators.units import Lane


def _named(zone: Column) -> Column:
    return F.when(~zone.isin("", "None"), zone)


def discover_timezones(df: DataFrame) -> DataFrame:
    """Sorted distinct zone names, without missing ones."""
    zone = _named(F.col("timezone")).alias("timezone")
    return df.select(zone).filter("timezone IS NOT NULL").distinct().orderBy("timezone")


def detect_timezones(df: DataFrame, text: str = "event_timestamp") -> DataFrame:
    """Zone names of the column together with offsets of the timestamp texts."""
    pairs = df.select(
        F.explode(
            F.array(_named(F.col("timezone")), text_offset_zone(F.col(text)))
        ).alias("timezone")
    )
    return pairs.filter("timezone IS NOT NULL").distinct().orderBy("timezone")


def _choice(text: str | None) -> Column:
    """What a row says about its zone: the name, else the text's offset.

    Levels make names beat offsets; offsets only count in units without names.
    """
    def choice(level: int, zone: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), zone.alias("zone"))

    zone = F.col("timezone")
    chosen = F.when(zone.isNotNull(), choice(0, zone))
    if text:
        offset = text_offset_zone(F.col(text))
        chosen = chosen.when(offset.isNotNull(), choice(1, offset))
    return chosen.otherwise(choice(2, F.lit("UTC")))


def _rank() -> Column:
    """Sort key of a counted choice: most frequent first, then first seen.

    Equally frequent offsets go by name.
    """
    choice = F.col("_choice")
    by_name = F.when(choice["level"] == 1, choice["zone"])
    return F.struct(choice["level"], -F.col("_n"), by_name, F.col("_first"))


def primary_timezone(
    df: DataFrame, unit: str, text: str | None = "event_timestamp"
) -> DataFrame:
    """Most frequent zone per unit, ties going to the one seen first.

    A unit without any zone name uses the offsets in its timestamp texts, and
    UTC when there are none either.
    """
    counted = df.groupBy(unit, _choice(text).alias("_choice")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("file_order").alias("_first")
    )
    zone = F.min_by("_choice.zone", _rank()).alias("primary_timezone")
    return counted.groupBy(unit).agg(zone)


def attach_primary_timezone(df: DataFrame, lane: Lane, text: str | None) -> DataFrame:
    """``primary_timezone`` of the unit on every row.

    Plain units count in windows on the exchange the later steps use anyway;
    hot units are aggregated before anything is shuffled.
    """
    if lane.sliced:
        return lane.attach(df, primary_timezone(df, lane.unit, text), [lane.unit])
    unit = Window.partitionBy(lane.unit)
    same = Window.partitionBy(lane.unit, "_choice")
    return (
        df.withColumn("_choice", _choice(text))
        # Asked for by unit here, so that no other exchange is needed.
        .repartition(*([lane.partitions] if lane.partitions else []), F.col(lane.unit))
        .withColumns(
            {
                "_n": F.count(F.lit(1)).over(same),
                "_first": F.min("file_order").over(same),
            }
        )
        .withColumn("primary_timezone", F.min_by("_choice.zone", _rank()).over(unit))
        .drop("_choice", "_n", "_first")
    )


def apply_timezone_mode(
    df: DataFrame, lane: Lane, options: StudyOptions, text: str | None = None
) -> DataFrame:
    """Filter rows by zone if asked to, and set ``timezone`` to the target.

    Instants stay as they are: local times follow from the ``timezone``
    column.  ``zone_error`` marks rows whose target zone does not exist.
    """
    mode = options.timezone_mode
    if mode in (TimezoneMode.KEEP_SELECTED, TimezoneMode.CONVERT_TO_SELECTED):
        if options.selected_timezone is None:
            raise ValueError(f"{mode.name} needs a selected_timezone")
        if not is_zone(options.selected_timezone):
            raise ValueError(f"unknown time zone {options.selected_timezone}")
        target = F.lit(options.selected_timezone)
        if mode is TimezoneMode.KEEP_SELECTED:
            df = df.filter(F.col("timezone") == target)
        return df.withColumns({"timezone": target, "zone_error": F.lit(False)})
    df = attach_primary_timezone(df, lane, text)
    primary = F.col("primary_timezone")
    if mode is TimezoneMode.KEEP_PRIMARY:
        df = df.filter(F.col("timezone") == primary)
    usable = usable_zone("primary_timezone")
    # Rows with an unusable target keep the zone they came with.
    zone = F.coalesce(usable, F.col("timezone"))
    return df.withColumns({"timezone": zone, "zone_error": usable.isNull()}).drop(
        "primary_timezone"
    )


def bad_zone_rows(
    df: DataFrame, lane: Lane, options: StudyOptions, text: str | None = None
) -> DataFrame:
    """The rows of :func:`apply_timezone_mode` whose target zone does not exist, without
    ``zone_error``. The primary zones are aggregates here, so of ``df`` only rows of units
    without a usable one are joined with anything.
    """
    mode = options.timezone_mode
    if mode in (TimezoneMode.KEEP_SELECTED, TimezoneMode.CONVERT_TO_SELECTED):
        zoned = apply_timezone_mode(df, lane, options, text)
        return zoned.filter("zone_error").drop("zone_error")
    primary = primary_timezone(df, lane.unit, text)
    bad = primary.filter(usable_zone("primary_timezone").isNull())
    rows = df.join(bad, lane.unit)
    if mode is TimezoneMode.KEEP_PRIMARY:
        rows = rows.filter(F.col("timezone") == F.col("primary_timezone"))
    return rows.drop("primary_timezone")
