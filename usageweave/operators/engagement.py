"""Engagement details of usage rows and data-quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions.values import same_app, usage_flags
from usageweave.operators.units import Lane, nearest

APP = "app_package_name"
KIND = "interaction_type"
# Any usage also counts filtered apps, valid usage does not.
USAGE_TYPES = {
    "any": (C.APP_USAGE, C.FILTERED_APP_USAGE),
    "valid": (C.APP_USAGE,),
}


def _is_usage(scope: str) -> Column:
    return F.coalesce(F.col(KIND).isin(*USAGE_TYPES[scope]), F.lit(False))


def previous_usage(df: DataFrame, lane: Lane) -> DataFrame:
    """``_{scope}_seen`` and ``_{scope}_prev`` (app, stop) of the usage before."""
    earlier = {}
    last = F.struct(
        F.col(APP).alias("app"), F.unix_micros("stop_timestamp").alias("stop")
    )
    for scope in USAGE_TYPES:
        usage = _is_usage(scope)
        earlier[f"_{scope}_seen"] = F.when(usage, F.lit(True))
        ended = usage & F.col("stop_timestamp").isNotNull()
        earlier[f"_{scope}_prev"] = F.when(ended, last)
    return nearest(df, lane, earlier=earlier)


def usage_details(df: DataFrame, lane: Lane, options: StudyOptions) -> DataFrame:
    """New-engagement, app-switch and time-gap columns for both scopes.

    The first usage of a unit is a new engagement in its own scope only, and
    so is the first valid usage, whatever came before it.
    """
    n = options.custom_engagement_seconds
    df = previous_usage(df, lane)
    usage, valid = _is_usage("any"), _is_usage("valid")
    first = usage & F.col("_any_seen").isNull()
    first_valid = valid & F.col("_valid_seen").isNull()
    compared = usage & ~first & ~first_valid
    opens = {"any": first & ~valid, "valid": first_valid}
    details = {}
    for scope, member in (("valid", valid), ("any", usage)):
        prev = F.col(f"_{scope}_prev")
        start = F.unix_micros("start_timestamp")
        seconds = F.when(compared & prev.isNotNull(), start - prev["stop"]) / F.lit(1e6)

        def flag(condition: Column) -> Column:
            return F.when(
                member, F.coalesce((opens[scope] | condition).cast("int"), F.lit(0))
            )

        switched = seconds.isNotNull() & ~same_app(F.col(APP), prev["app"])
        hours = F.coalesce(F.floor(seconds / 3600).cast("double"), F.lit(0.0))
        new = f"{scope}_app_new_engage"
        details |= {
            f"{new}_30s": flag(F.coalesce(seconds > 30, F.lit(False))),
            f"{new}_custom_{n}s": flag(F.coalesce(seconds > n, F.lit(False))),
            f"{scope}_app_switched_app": F.when(member, switched.cast("int")),
            f"{scope}_app_usage_time_gap_hours": F.when(member, hours),
        }
    helpers = [f"_{s}_{c}" for s in USAGE_TYPES for c in ("seen", "prev")]
    return df.withColumns(details).drop(*helpers)


def add_usage_flags(df: DataFrame, options: StudyOptions) -> DataFrame:
    flags = usage_flags(
        F.col("data_time_gap_hours"),
        F.col("duration_minutes"),
        options.gap_thresholds_hours,
        options.usage_thresholds_hours,
    )
    return df.withColumn("any_app_usage_flags", flags)
