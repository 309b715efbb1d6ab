"""Raw logs and finished tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.operators.timezones import discover_timezones
from usageweave.sources.files import FILE, MALFORMED, ORDER, check_files, read_tables

RAW_COLUMNS = (
    "study_id",
    "participant_id",
    "username",
    "app_package_name",
    "application_label",
    "interaction_type",
    "event_timestamp",
    "timezone",
)
REQUIRED = ("interaction_type", "event_timestamp")


def scan_raw(
    spark: SparkSession,
    folder: str,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    multiline: bool = False,
    since: datetime | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Raw logs with every expected column; absent ones are null.

    Files without the columns of :data:`REQUIRED` yield no rows: they have no
    header, or are not logs.  ``check_logs`` names them for the report. Rows with more
    cells than names have their text in ``malformed`` and no values; ``preprocess`` puts
    them into quarantine.
    """
    df = read_tables(
        spark,
        folder,
        pattern,
        ignore,
        multiline,
        REQUIRED,
        reserved=(*RAW_COLUMNS, FILE, ORDER, MALFORMED),
        mark_malformed=True,
        may_be_empty=True,
        since=since,
        headers=headers,
    )
    absent = [c for c in RAW_COLUMNS if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent})


def check_logs(
    spark: SparkSession,
    folder: str,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    since: datetime | None = None,
    listed: DataFrame | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Every raw log of a folder, and the ``problem`` that keeps it from being read."""
    return check_files(spark, folder, REQUIRED, pattern, ignore, since, listed, headers)


def folder_timezones(
    spark: SparkSession, folder: str, pattern: str = C.RAW_FILE_PATTERN
) -> DataFrame:
    """Zones named anywhere in a folder of raw logs."""
    return discover_timezones(scan_raw(spark, folder, pattern))


def scan_preprocessed(spark: SparkSession, folder: str) -> DataFrame:
    """Finished CSV tables; files without start and stop columns are skipped.

    Start and stop become wall-clock times ``start_local`` / ``stop_local`` and
    the event time ``event_local``; a missing date is the start date.
    """
    times = ("start_timestamp", "stop_timestamp")
    df = read_tables(spark, folder, r"\.csv$", (), required=times, reserved=(FILE, ORDER))
    # The folder that the writer made for a unit is the unit, in all its files.
    unit = F.regexp_extract(FILE, r"^.*/output_name=[^/]+", 0)
    order = F.struct(F.col(FILE).alias("file"), f"{ORDER}.*")
    df = df.withColumns({ORDER: order, FILE: F.when(unit != "", unit).otherwise(F.col(FILE))})
    return finished_types(df)


def finished_types(df: DataFrame) -> DataFrame:
    """Typed columns of a finished table, from CSV or Parquet."""

    def local(name: str):
        return F.try_to_timestamp(name, F.lit(C.DATETIME_FORMAT)).cast("timestamp_ntz")

    numeric = {
        n: F.col(n).cast("double")
        for n in ("duration_seconds", "duration_minutes", "data_time_gap_hours")
        if n in df.columns
    }
    df = df.withColumns(
        {"start_local": local("start_timestamp"), "stop_local": local("stop_timestamp")}
    ).withColumns(numeric)
    start_date = F.to_date("start_local")
    date = F.coalesce(F.to_date("date"), start_date) if "date" in df.columns else start_date
    df = df.withColumn("date", date)
    if "event_timestamp" in df.columns:
        # What is left is local time, with or without a fraction of a second.
        clock = F.regexp_replace("event_timestamp", r"\s*(?:Z|[+-]\d{2}:\d{2})$", "")
        df = df.withColumn(
            "event_local", F.try_to_timestamp(clock).cast("timestamp_ntz")
        )
    return df
