"""From resume events to usage sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.operators.units import Lane, nearest, next_of_other_app

APP = "app_package_name"
KIND = "interaction_type"


@dataclass(frozen=True)
class Rules:
    """One of the two session kinds and what ends it."""

    prefix: str
    resumed: str
    paused: str
    stopped: str
    usage: str
    same_types: tuple[str, ...]
    other_types: tuple[str, ...]
    fallback_limited: bool
    start_when_missing: bool


def valid_rules(options: StudyOptions) -> Rules:
    return Rules(
        "valid",
        C.ACTIVITY_RESUMED,
        C.ACTIVITY_PAUSED,
        C.ACTIVITY_STOPPED,
        C.APP_USAGE,
        options.same_app_stops,
        options.other_app_stops,
        fallback_limited=False,
        start_when_missing=False,
    )


def filtered_rules(options: StudyOptions) -> Rules:
    return Rules(
        "filtered",
        C.FILTERED_APP_RESUMED,
        C.FILTERED_APP_PAUSED,
        C.FILTERED_APP_STOPPED,
        C.FILTERED_APP_USAGE,
        options.filtered_same_app_stops,
        options.filtered_other_app_stops,
        fallback_limited=True,
        start_when_missing=True,
    )


def _times() -> Column:
    return F.struct(F.col(C.RAW_US).alias("raw"), F.col(C.EVENT_US).alias("moved"))


def same_app_stops(df: DataFrame, lane: Lane, *rules: Rules) -> DataFrame:
    """``*_same`` and ``*_stopped``: nearest later stops of the row's own app."""
    later = {}
    for r in rules:
        same = F.col(KIND).isin(*r.same_types) if r.same_types else F.lit(False)
        own = F.col(APP).isNotNull() & F.col(C.EVENT_US).isNotNull()
        later[f"{r.prefix}_same"] = F.when(own & same, _times())
        stopped = own & (F.col(KIND) == r.stopped)
        later[f"{r.prefix}_stopped"] = F.when(stopped, F.col(C.EVENT_US))
    return nearest(df, lane, later=later, by=[APP])


def other_app_stop(df: DataFrame, lane: Lane, rules: Rules) -> DataFrame:
    """``*_other``: nearest later stop caused by another app or the device."""
    matches = F.coalesce(
        F.col(KIND).isin(*rules.other_types) if rules.other_types else F.lit(False),
        F.lit(False),
    )
    return next_of_other_app(df, lane, f"{rules.prefix}_other", matches, APP, _times())


def resolve_stop(rules: Rules) -> Column:
    """Stop time (microseconds) of a resumed row, null when it is missing.

    The earlier of same-app and other-app stop counts if both exist and it is
    less than twelve hours away.  Otherwise the app's next "stopped" event
    does: within twelve hours if both exist (for filtered apps: always).
    """
    same, other, fallback = (
        F.col(f"{rules.prefix}_{n}") for n in ("same", "other", "stopped")
    )
    start = F.col(C.EVENT_US)
    short_fallback = F.when(fallback - start < C.LONG_USAGE_MICROS, fallback)
    first = F.when(same["raw"] <= other["raw"], same["moved"]).otherwise(other["moved"])
    both = same["moved"].isNotNull() & other["moved"].isNotNull()
    near = first - start < C.LONG_USAGE_MICROS
    single = short_fallback if rules.fallback_limited else fallback
    return F.when(
        start.isNotNull(),
        F.when(both & near, first).when(both, short_fallback).otherwise(single),
    )


def _close(df: DataFrame, lane: Lane, rules: Rules) -> DataFrame:
    """Resolve one kind of session; expects its same-app stops to be there."""
    for name in ("start_timestamp", "stop_timestamp"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("timestamp"))
    df = other_app_stop(df, lane, rules)
    # Paused rows have done their part as stops.
    df = df.filter(F.coalesce(F.col(KIND) != rules.paused, F.lit(True)))
    df = df.withColumn("_stop", resolve_stop(rules))
    resumed = F.col(KIND) == rules.resumed
    ended = F.col("_stop").isNotNull()
    starts = resumed if rules.start_when_missing else resumed & ended
    start = F.when(starts, F.timestamp_micros(C.EVENT_US))
    df = df.withColumns(
        {
            "start_timestamp": start.otherwise(F.col("start_timestamp")),
            "stop_timestamp": F.when(resumed, F.timestamp_micros("_stop")).otherwise(
                F.col("stop_timestamp")
            ),
            KIND: F.when(resumed & ended, rules.usage)
            .when(resumed, C.END_OF_USAGE_MISSING)
            .otherwise(F.col(KIND)),
        }
    )
    helpers = [f"{rules.prefix}_{n}" for n in ("same", "other", "stopped")]
    return lane.settle(df.drop("_stop", *helpers), f"{rules.prefix}-sessions")


def filtered_sessions(df: DataFrame, lane: Lane, options: StudyOptions) -> DataFrame:
    """Sessions of filtered apps: ``Filtered App Usage`` or a missing end."""
    rules = filtered_rules(options)
    return _close(same_app_stops(df, lane, rules), lane, rules)


def valid_sessions(df: DataFrame, lane: Lane, options: StudyOptions) -> DataFrame:
    """Sessions of counted apps: ``App Usage`` or a missing end."""
    rules = valid_rules(options)
    return _close(same_app_stops(df, lane, rules), lane, rules)


def sessions(df: DataFrame, lane: Lane, options: StudyOptions) -> DataFrame:
    """Filtered sessions, then valid ones, then durations.

    The same-app stops of both kinds come from one scan: no type that can end
    a valid session in its own app is changed by the filtered step.
    """
    rules = [valid_rules(options)]
    if options.use_filter_list:
        rules.insert(0, filtered_rules(options))
    df = lane.settle(same_app_stops(df, lane, *rules), "same-app-stops")
    for r in rules:
        df = _close(df, lane, r)
    return durations(df, options)


def durations(df: DataFrame, options: StudyOptions) -> DataFrame:
    """Seconds and minutes of App Usage rows; too short ones become null."""
    micros = F.unix_micros("stop_timestamp") - F.unix_micros("start_timestamp")
    seconds = micros / F.lit(1e6)
    counted = (F.col(KIND) == C.APP_USAGE) & (seconds >= options.minimum_usage_seconds)
    return df.withColumn("duration_seconds", F.when(counted, seconds)).withColumn(
        "duration_minutes", F.col("duration_seconds") / 60
    )
