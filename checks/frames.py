"""Logs and dimensions derived from the given tables.

The column texts are shared with the checking SQL, which runs them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave import StudyOptions, TimezoneMode
from usageweave.operators import columns as cols
from usageweave.operators.ordering import order_log
from usageweave.operators.units import by_unit
from usageweave.sources.dimensions import app_filters, codebook

UNIT = "participant_id"
K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
TIMES = {
    "plain": "ts",
    "ties": "date_trunc('hour', ts)",
    "dense": "date_trunc('month', ts) + INTERVAL '1' SECOND * event_id",
}
LOG_COLUMNS = {
    "file_order": "event_id",
    "participant_id": "concat('P', CAST(user_id AS STRING))",
    "study_id": "'S1'",
    "username": (
        "CASE WHEN user_id % 5 = 0 AND k % 2 = 0 THEN 'Target child' "
        "WHEN user_id % 5 = 0 THEN 'Other' ELSE 'Target Child' END"
    ),
    "interaction_type": (
        "CASE event_type WHEN 'view' THEN 'Unknown importance: 1' "
        "WHEN 'click' THEN 'Unknown importance: 2' "
        "WHEN 'purchase' THEN 'Unknown importance: 23' "
        "WHEN 'error' THEN 'Unknown importance: 16' "
        "ELSE CASE k % 4 WHEN 0 THEN 'Unknown importance: 26' "
        "WHEN 1 THEN 'Unknown importance: 27' WHEN 2 THEN 'Move to Foreground' "
        "ELSE 'Mystery Event' END END"
    ),
    "app_package_name": (
        "CASE WHEN k = 77 THEN 'com.amazon.imp' WHEN k = 78 THEN NULL "
        "ELSE concat('com.app.', CAST(k % 4 AS STRING)) END"
    ),
    "application_label": (
        "CASE WHEN k = 77 THEN 'Amazon Impulse' "
        "ELSE concat('App ', CAST(k % 4 AS STRING)) END"
    ),
    "timezone": (
        "CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 >= 7 THEN 'UTC' "
        "WHEN user_id % 2 = 0 THEN 'America/Chicago' ELSE 'America/New_York' END"
    ),
}
# Raw texts in every spelling the timestamp fixer knows, good and bad.
SPELLINGS = {
    0: ("yyyy-MM-dd'T'HH:mm:ss", "Z"),
    1: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z"),
    2: ("yyyy-MM-dd'T'HH:mm:ss", "-05:00"),
    3: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "+02:00"),
    4: ("yyyy-MM-dd HH:mm:ss", ""),
    5: ("yyyy-MM-dd HH:mm:ss.SSSSSS", ""),
}
PACKAGE_OF_PART = (
    "CASE WHEN p_size = 50 THEN NULL WHEN p_size % 9 = 3 THEN "
    "concat('com.rare.', CAST(p_partkey AS STRING)) ELSE "
    "concat('com.app.', CAST(p_size % 9 AS STRING)) END"
)
CATEGORY_OF_PART = (
    "CASE p_partkey % 6 WHEN 0 THEN 'Games' WHEN 1 THEN 'Education' "
    "WHEN 2 THEN 'Video Players (e.g. YouTube)' WHEN 3 THEN NULL "
    "WHEN 4 THEN 'Photography' ELSE 'Made Up' END"
)
CODEBOOK_COLUMNS = {
    "row_no": "p_partkey",
    "app_package_name": PACKAGE_OF_PART,
    "broad_app_category": CATEGORY_OF_PART,
    "genreId": "p_brand",
}
FILTER_COLUMNS = {
    "row_no": "p_partkey",
    "package_name": (
        "CASE p_size % 5 WHEN 0 THEN ' com.app.0 ' WHEN 1 THEN 'com.app.1' "
        "WHEN 2 THEN 'com.app.2' WHEN 3 THEN '  ' "
        "ELSE concat('com.more.', p_brand) END"
    ),
    "app_label": (
        "CASE p_size % 5 WHEN 0 THEN ' App 0 , Alias 0' WHEN 1 THEN 'Wrong Label' "
        "WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'App 2' ELSE 'Old Label' END "
        "ELSE p_name END"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(mapping: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in mapping.items()]


def log(spark: SparkSession, folder: str, time: str = "plain") -> DataFrame:
    """Raw log with instants for ``event_timestamp``."""
    events = table(spark, folder, "events").selectExpr("*", f"{K} AS k")
    df = events.selectExpr(*columns(LOG_COLUMNS), f"{TIMES[time]} AS event_timestamp")
    return df.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))


def text_log(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log with ``event_timestamp`` as text (UTC, microseconds)."""
    text = F.concat(F.col("event_timestamp").cast("string"), F.lit("Z"))
    return log(spark, folder).withColumn("event_timestamp", text)


def spelled_log(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log whose timestamp texts come in every spelling."""
    df = log(spark, folder)
    text = F.lit(None).cast("string")
    for n, (pattern, tail) in SPELLINGS.items():
        spelled = F.concat(F.date_format("event_timestamp", pattern), F.lit(tail))
        text = F.when(F.col("file_order") % 7 == n, spelled).otherwise(text)
    return df.withColumn("event_timestamp", text)


def codebook_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(*columns(CODEBOOK_COLUMNS))


def filter_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").selectExpr(*columns(FILTER_COLUMNS))
    return rows.select("package_name", "app_label", "row_no")


def filters(spark: SparkSession, folder: str) -> DataFrame:
    return app_filters(filter_rows(spark, folder), "row_no")


def first_codebook(spark: SparkSession, folder: str) -> DataFrame:
    return codebook(codebook_rows(spark, folder), "row_no")


def options(**more) -> StudyOptions:
    return StudyOptions(
        **{
            "unit": UNIT,
            "timezone_mode": TimezoneMode.CONVERT_TO_PRIMARY,
            **more,
        }
    )


def minimal(**more) -> StudyOptions:
    return StudyOptions.minimal(unit=UNIT, **more)


# Small enough that nearly every device log of the test tables is sliced.
HOT = {"hot_unit_rows": 60, "slice_rows": 250}


def ordered(
    spark: SparkSession, folder: str, opts: StudyOptions, step, time: str = "plain"
) -> DataFrame:
    """Renamed and ordered log, then ``step(df, lane)``, over all units."""
    renamed = cols.rename_interaction_types(log(spark, folder, time))
    return by_unit(renamed, lambda df, ln: step(order_log(df, ln, opts), ln), opts)


def micros(name: str):
    return F.unix_micros(name)
