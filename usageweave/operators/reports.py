"""Counts about types, units and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C


def unknown_interaction_counts(df: DataFrame) -> DataFrame:
    """Rows per type that no raw spelling maps to (after renaming)."""
    unknown = df.filter(~F.col("interaction_type").isin(*C.MAPPED_TYPES))
    return unknown.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("rows"))


def disordered_count(df: DataFrame, unit: str) -> DataFrame:
    """Rows per unit whose start is later than their stop."""
    disordered = F.col("start_timestamp") > F.col("stop_timestamp")
    return df.groupBy(unit).agg(F.count_if(disordered).alias("disordered"))


def assert_ordered(df: DataFrame) -> DataFrame:
    """Fail the job on the first row whose start is later than its stop."""
    message = "start timestamp later than stop timestamp"
    disordered = F.col("start_timestamp") > F.col("stop_timestamp")
    checked = F.when(disordered, F.raise_error(F.lit(message)).cast("timestamp"))
    return df.withColumn(
        "start_timestamp", F.coalesce(checked, F.col("start_timestamp"))
    )


def unit_participant(df: DataFrame, unit: str) -> DataFrame:
    """Participant of each unit: the first one given in file order."""
    present = F.when(F.col("participant_id").isNotNull(), F.col("file_order"))
    return df.groupBy(unit).agg(
        F.min_by("participant_id", present).alias("participant_id")
    )


def unit_kinds(labelled: DataFrame, unit: str) -> DataFrame:
    """Whether each unit has valid and filtered app events to make sessions of."""
    kind = F.col("interaction_type")
    active = (C.ACTIVITY_RESUMED, C.ACTIVITY_PAUSED)
    filtered = (C.FILTERED_APP_RESUMED, C.FILTERED_APP_PAUSED)
    return labelled.groupBy(unit).agg(
        F.coalesce(F.bool_or(kind.isin(*active)), F.lit(False)).alias("has_valid"),
        F.coalesce(F.bool_or(kind.isin(*filtered)), F.lit(False)).alias("has_filtered"),
    )


def unit_report(
    raw: DataFrame, seen: DataFrame, finished: DataFrame, unit: str, quarantine: DataFrame
) -> DataFrame:
    """One row per unit with counts and a status.

    ``raw`` are the rows read (``ts_error`` marks unreadable times, and a text in
    ``malformed`` rows that have no values), ``seen`` what :func:`unit_kinds` says of
    those that go into sessionising, ``finished`` the result, and ``quarantine`` the
    rows that are in no result.
    """
    one = F.lit(1)
    kind = F.col("interaction_type")
    ragged = F.col("malformed").isNotNull() if "malformed" in raw.columns else F.lit(False)
    read = raw.groupBy(unit).agg(
        F.count(one).alias("rows_in"),
        F.count_if(ragged).alias("ragged"),
        F.count_if(F.col("ts_error") & ~ragged).alias("unreadable_times"),
        F.count_if(F.col("event_timestamp").isNotNull() & ~F.col("ts_error")).alias("timed"),
    )
    rejected = quarantine.filter(~F.col("ts_error")).groupBy(unit).agg(
        F.count(one).alias("unusable_zones")
    )
    kept = finished.groupBy(unit).agg(
        F.count(one).alias("rows_kept"),
        F.count_if(kind == C.END_OF_USAGE_MISSING).alias("missing_ends"),
        F.count_if(F.col("start_timestamp") > F.col("stop_timestamp")).alias(
            "disordered"
        ),
    )
    # Per-unit aggregates: what is joined has one row per unit.
    joined = read.join(seen, unit, "left").join(kept, unit, "left")
    joined = joined.join(rejected, unit, "left")
    joined = joined.na.fill(0, ["rows_kept", "missing_ends", "disordered", "unusable_zones"])
    joined = joined.na.fill(False, ["has_valid", "has_filtered"])
    problem = (
        F.when(F.col("rows_in") == 0, "Empty file")
        .when(F.col("ragged") == F.col("rows_in"), "Malformed rows")
        .when(F.col("timed") == 0, "No readable event timestamp")
        .when(F.col("unusable_zones") > 0, "No usable primary time zone")
        .when(F.col("disordered") > 0, "Start timestamp later than stop timestamp")
    )
    message = F.coalesce(
        problem, F.when(~F.col("has_valid"), "No valid app usage data found")
    )
    status = (
        F.when(problem.isNotNull(), "error")
        .when(~F.col("has_valid"), "empty")
        .otherwise("processed")
    )
    return joined.withColumns({"status": status, "message": message}).drop("timed", "ragged")


def with_empty_units(report: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """Add files that yielded no row as error units, with their ``problem`` if they have
    one in ``units``.
    """
    known = F.col("problem") if "problem" in units.columns else F.lit(None)
    reason = F.coalesce(F.max(known.cast("string")), F.lit("Empty file")).alias("message")
    absent = units.groupBy(unit).agg(reason).join(report.select(unit), unit, "left_anti")
    return report.unionByName(
        absent.withColumns(
            {
                "rows_in": F.lit(0).cast("long"),
                "status": F.lit("error"),
            }
        ),
        allowMissingColumns=True,
    )


def run_summary(report: DataFrame) -> DataFrame:
    """Totals of a run in one row; the success rate is 0 without units."""
    total = F.count(F.lit(1))

    def having(status: str):
        return F.count_if(F.col("status") == status)

    rate = F.when(total > 0, having("processed") / total * 100).otherwise(F.lit(0.0))
    return report.agg(
        total.alias("total_units"),
        having("processed").alias("processed_units"),
        having("empty").alias("empty_units"),
        having("error").alias("failed_units"),
        rate.alias("success_percent"),
    )
