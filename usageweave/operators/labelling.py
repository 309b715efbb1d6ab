"""Labelling of apps that should not count as usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.functions.values import literal_map, quoted, stripped
from usageweave.operators.units import lookup_join

PACKAGE = "app_package_name"


def should_filter_app(label: Column, expected: Column) -> Column:
    """The label is one of the expected ones; a missing label never is."""
    return F.coalesce(F.array_contains(expected, label), F.lit(False))


def mark_listed(df: DataFrame, filters: DataFrame) -> DataFrame:
    """``listed``: the app is in the filter list and has an expected label.

    ``filters`` has one row per package: ``app_package_name, labels``.
    """
    df = lookup_join(df, filters.select(PACKAGE, "labels"), [PACKAGE])
    listed = should_filter_app(F.col("application_label"), F.col("labels"))
    return df.withColumn("listed", listed).drop("labels")


def relabel_listed(df: DataFrame) -> DataFrame:
    """Turn the activity types of listed apps into their filtered twins."""
    kind = F.col("interaction_type")
    twin = literal_map(C.FILTERED_TWIN)[kind]
    relabelled = F.when(F.col("listed"), F.coalesce(twin, kind)).otherwise(kind)
    return df.withColumn("interaction_type", relabelled).drop("listed")


def label_filtered_apps(df: DataFrame, filters: DataFrame) -> DataFrame:
    """Filtered twins for the activity types of listed apps."""
    return relabel_listed(mark_listed(df, filters))


def unexpected_labels(df: DataFrame, filters: DataFrame) -> DataFrame:
    """Distinct (package, expected labels, found label) that do not agree."""
    # Distinct first: the join then only sees one row per package and label.
    pairs = df.select(PACKAGE, "application_label").distinct()
    joined = lookup_join(pairs, filters.select(PACKAGE, "labels"), [PACKAGE], "inner")
    mismatch = ~should_filter_app(F.col("application_label"), F.col("labels"))
    return joined.filter(mismatch).select(
        PACKAGE,
        F.col("labels").alias("expected_labels"),
        F.col("application_label").alias("found_label"),
    )


def label_messages(mismatches: DataFrame) -> DataFrame:
    """One ``message`` line per mismatch."""
    expected = F.array_join(F.transform("expected_labels", quoted), ", ")
    found = F.coalesce("found_label", F.lit("nan"))
    message = F.concat(
        F.col(PACKAGE),
        F.lit(": expected any of '["),
        expected,
        F.lit("]', found '"),
        found,
        F.lit("'"),
    )
    return mismatches.select(message.alias("message")).distinct()


def merge_unexpected_labels(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Sorted distinct union of old and new message lines."""
    old = existing.select(stripped(F.col("message")).alias("message"))
    return old.union(new.select("message")).distinct().orderBy("message")
