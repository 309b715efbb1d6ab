"""Row-level steps and per-unit device columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions import times, values
from usageweave.operators.units import Lane, whole_unit


def rename_interaction_types(df: DataFrame) -> DataFrame:
    kind = values.canonical_type(F.col("interaction_type"))
    return df.withColumn("interaction_type", kind)


def normalise_usernames(df: DataFrame) -> DataFrame:
    name = F.col("username")
    fixed = F.when(name == "Target child", F.lit(C.TARGET_CHILD)).otherwise(name)
    return df.withColumn("username", fixed)


def target_child_only(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("username").contains(C.TARGET_CHILD.lower()))


def fix_timestamps(df: DataFrame) -> DataFrame:
    """Text timestamps to instants; ``ts_error`` marks text that cannot be read."""
    text = F.col("event_timestamp")
    df = df.withColumn("_instant", times.read_timestamp(text))
    unread = text.isNotNull() & F.col("_instant").isNull()
    columns = {"ts_error": unread, "event_timestamp": F.col("_instant")}
    return df.withColumns(columns).drop("_instant")


def remove_types(df: DataFrame, options: StudyOptions) -> DataFrame:
    """Drop rows of the selected types unless they follow a gap in the data."""
    if not options.removed_types:
        return df
    removed = F.coalesce(
        F.col("interaction_type").isin(*options.removed_types), F.lit(False)
    )
    after_gap = F.coalesce(F.col("data_time_gap_hours") > 0, F.lit(False))
    return df.filter(~removed | after_gap)


def device_model(df: DataFrame, lane: Lane) -> DataFrame:
    """``possible_device_model`` from the packages seen in the unit."""
    seen = F.max(values.is_tablet_package(F.col("app_package_name")))
    df = whole_unit(df, lane, {"_tablet": seen})
    model = F.when(F.col("_tablet"), C.TABLET_MODEL).otherwise(C.PHONE_MODEL)
    return df.withColumn("possible_device_model", model).drop("_tablet")


def calendar_columns(df: DataFrame) -> DataFrame:
    """Calendar columns of the event's local time in its ``timezone``."""
    local = times.wall_clock(F.col(C.EVENT_US), F.col("timezone"))
    df = df.withColumn("_local", local)
    return df.withColumns(times.calendar(F.col("_local"))).drop("_local")


def admin_columns(df: DataFrame, run_time: datetime, version: str) -> DataFrame:
    return df.withColumns(
        {
            "preprocessor_version": F.lit(version),
            "datetime_of_preprocessing": F.lit(run_time.strftime("%m-%d-%Y %H:%M:%S")),
        }
    )


def format_timestamps(df: DataFrame) -> DataFrame:
    """Start and stop as local text, the event time as text with its offset."""
    names = ["event_timestamp", "start_timestamp", "stop_timestamp"]
    # Converting to a zone is dear: once per column, before any formatting.
    local = {
        f"_{n}": times.wall_clock(F.unix_micros(n), F.col("timezone")) for n in names
    }
    text = {n: F.date_format(f"_{n}", C.DATETIME_FORMAT) for n in names[1:]}
    micros = F.unix_micros("event_timestamp")
    text["event_timestamp"] = times.local_text(F.col("_event_timestamp"), micros)
    return df.withColumns(local).withColumns(text).drop(*local)


def output_columns(custom_seconds: int) -> list[str]:
    """Names of the finished table, in order."""
    n = custom_seconds
    return [
        "study_id", "participant_id", "possible_device_model", "username",
        "event_timestamp", "date", "timezone",
        "app_package_name", "application_label", "broad_app_category",
        "genreId_scraped", "interaction_type",
        "start_timestamp", "stop_timestamp", "duration_seconds",
        "duration_minutes", "any_app_usage_flags", "data_time_gap_hours",
        "day", "weekdayMF", "weekdayMTh", "weekdaySuTh", "hour", "quarter",
        "valid_app_new_engage_30s", f"valid_app_new_engage_custom_{n}s",
        "valid_app_switched_app", "valid_app_usage_time_gap_hours",
        "any_app_new_engage_30s", f"any_app_new_engage_custom_{n}s",
        "any_app_switched_app", "any_app_usage_time_gap_hours",
        "preprocessor_version", "datetime_of_preprocessing",
    ]


def project_output(df: DataFrame, options: StudyOptions, *extra: str) -> DataFrame:
    """The finished columns that exist, after any ``extra`` key columns."""
    present = set(df.columns)
    names = output_columns(options.custom_engagement_seconds)
    keys = [c for c in extra if c not in names]
    return df.select(*keys, *[c for c in names if c in present])
