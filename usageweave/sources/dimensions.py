"""App filter list and app codebook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave.functions.values import label_list, stripped
from usageweave.operators.enrich import dedupe_keep
from usageweave.sources.files import ORDER, read_tables

PACKAGE = "app_package_name"
ANY_FILE = r".*"


def app_filters(df: DataFrame, order: str) -> DataFrame:
    """Filter list from a table whose first two columns are package and labels.

    Entries are trimmed, blank packages are dropped and the last row of a
    package wins.  Returns ``app_package_name, labels``.
    """
    names = [c for c in df.columns if c != order]
    if len(names) < 2:
        raise ValueError("a filter list needs a package and a label column")
    package, label = (stripped(F.col(f"`{c}`").cast("string")) for c in names[:2])
    rows = df.select(
        package.alias(PACKAGE), F.coalesce(label, F.lit("nan")).alias("label"), order
    ).filter((F.col(PACKAGE) != "") & (F.lower(PACKAGE) != "nan"))
    last = dedupe_keep(rows, PACKAGE, order, "last")
    return last.select(PACKAGE, label_list(F.col("label")).alias("labels"))


def codebook(df: DataFrame, order: str) -> DataFrame:
    """Codebook with the first row of every package."""
    if PACKAGE not in df.columns:
        raise ValueError(f"a codebook needs a column {PACKAGE}")
    return dedupe_keep(df, PACKAGE, order, "first").drop(order)


def scan_app_filters(spark: SparkSession, path: str) -> DataFrame:
    df = read_tables(spark, path, ANY_FILE, ()).drop("source_file")
    return app_filters(df, ORDER)


def scan_codebook(spark: SparkSession, path: str) -> DataFrame:
    df = read_tables(spark, path, ANY_FILE, ()).drop("source_file")
    return codebook(df, ORDER)
