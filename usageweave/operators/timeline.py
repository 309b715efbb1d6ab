"""Tables behind the daily usage plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions.times import clock_hours, ntz_micros
from usageweave.functions.values import category_colour

KIND = "interaction_type"


def select_plot_usage(df: DataFrame, options: StudyOptions) -> DataFrame:
    """Usage rows to draw, as chosen by the options."""
    kinds = [C.APP_USAGE]
    if options.plot_filtered_usage:
        kinds.append(C.FILTERED_APP_USAGE)
    df = df.filter(F.col(KIND).isin(*kinds))
    if options.plot_target_child_only:
        df = df.filter(F.col("username") == C.TARGET_CHILD)
    return df


def date_bounds(df: DataFrame, unit: str) -> DataFrame:
    """First and last ``date`` of each unit."""
    return df.groupBy(unit).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def date_spine(df: DataFrame, unit: str) -> DataFrame:
    """Every date from the first to the last one of each unit."""
    bounds = date_bounds(df, unit).filter("first_date IS NOT NULL")
    return bounds.select(
        unit, F.explode(F.sequence("first_date", "last_date")).alias("date")
    )


def daily_usage_segments(df: DataFrame, bounds: DataFrame, unit: str) -> DataFrame:
    """Split usages at midnight into bars of (date, left hour, width).

    ``start_local`` / ``stop_local`` are wall-clock times of whole seconds.
    Days after the unit's last date are left out.
    """
    start, stop = F.col("start_local"), F.col("stop_local")
    df = df.filter(F.to_date(start) <= F.to_date(stop))
    df = df.join(bounds.select(unit, "last_date"), [unit], "left")
    last_day = F.least(F.to_date(stop), F.col("last_date"))
    df = df.filter(F.to_date(start) <= last_day).withColumn(
        "segment_date", F.explode(F.sequence(F.to_date(start), last_day))
    )
    seconds = (ntz_micros(stop) - ntz_micros(start)) / F.lit(1e6)
    first = F.col("segment_date") == F.to_date(start)
    final = F.col("segment_date") == F.to_date(stop)
    left = F.when(first, clock_hours(start)).otherwise(F.lit(0.0))
    width = (
        F.when(first, F.least(24 - clock_hours(start), seconds / 3600))
        .when(final, clock_hours(stop))
        .otherwise(F.lit(24.0))
    )
    category = F.coalesce("broad_app_category", F.lit(C.UNCATEGORISED))
    return df.withColumns(
        {
            "left_hours": left,
            "width_hours": width,
            "broad_app_category": category,
            "colour": category_colour(category),
        }
    ).drop("last_date")


def event_markers(df: DataFrame) -> DataFrame:
    """Hour of day of shutdowns, startups and missing ends (``event_local``)."""
    kinds = list(C.MARKER_COLOURS)
    colour: Column | None = None
    for kind, name in C.MARKER_COLOURS.items():
        match = F.col(KIND) == kind
        colour = F.when(match, name) if colour is None else colour.when(match, name)
    return df.filter(F.col(KIND).isin(*kinds)).withColumns(
        {"event_hours": clock_hours(F.col("event_local")), "colour": colour}
    )


def gap_segments(df: DataFrame, bounds: DataFrame, unit: str) -> DataFrame:
    """Bars for data gaps, going back in time from the row after each gap.

    The row's own day is covered up to its event time, full days before it
    follow, and what is left ends the earliest day.  Days before the unit's
    first date are left out.
    """
    df = df.filter(F.col("data_time_gap_hours") > 0)
    df = df.join(bounds.select(unit, "first_date"), [unit], "left")
    hours = clock_hours(F.col("event_local"))
    before = F.col("data_time_gap_hours") - F.col("_hours")
    df = df.withColumn("_hours", hours).withColumns(
        {
            "_full": F.when(before > 0, F.floor(before / 24).cast("int")).otherwise(0),
            "_rest": F.when(before > 0, before % 24).otherwise(F.lit(0.0)),
        }
    )
    reach = F.date_sub("date", F.col("_full") + F.when(F.col("_rest") > 0, 1).otherwise(0))
    earliest = F.greatest(reach, F.col("first_date"))
    days = F.sequence(F.lit(0), F.datediff(F.col("date"), earliest))
    df = df.withColumn("_offset", F.explode(days))
    own = F.col("_offset") == 0
    full = F.col("_offset") <= F.col("_full")
    width = F.when(own, F.col("_hours")).when(full, F.lit(24.0)).otherwise(F.col("_rest"))
    left = F.when(own | full, F.lit(0.0)).otherwise(24 - F.col("_rest"))
    return df.withColumns(
        {
            "segment_date": F.date_sub("date", F.col("_offset")),
            "left_hours": left,
            "width_hours": width,
            "colour": F.lit(C.GAP_COLOUR),
        }
    ).drop("_hours", "_full", "_rest", "_offset", "first_date")
