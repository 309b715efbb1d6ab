"""App codebook: deduplication, lookup and category counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.operators.units import lookup_join

PACKAGE = "app_package_name"


def dedupe_keep(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """First or last row per key in ``order``.

    An aggregate, not a window: a key with very many rows is reduced before
    the shuffle.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c != key]
    row = pick(F.struct(*rest), order).alias("row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"row.{c}") for c in rest])


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key (missing keys included) occurs more than once."""
    repeated = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter("occurrences > 1")
        .select(F.coalesce(key, F.lit("")).alias("_key"),
                F.col(key).isNull().alias("_missing"), "occurrences")
    )
    keyed = df.withColumns(
        {"_key": F.coalesce(key, F.lit("")), "_missing": F.col(key).isNull()}
    )
    found = lookup_join(keyed, repeated, ["_key", "_missing"], "inner")
    return found.drop("_key", "_missing")


def enrich_codebook(
    df: DataFrame,
    codebook: DataFrame | None,
    genre_name: str = "genreId_scraped",
    missing: str = C.UNKNOWN,
) -> DataFrame:
    """Add ``broad_app_category`` and the genre; a miss is ``missing``.

    ``codebook`` has one row per package.  Without a codebook, or without the
    column in it, every row is a miss.
    """
    df = df.drop("broad_app_category", genre_name)
    unknown = F.lit(missing)
    wanted = {"broad_app_category": "broad_app_category", "genreId": genre_name}
    if codebook is None:
        return df.withColumns(dict.fromkeys(wanted.values(), unknown))
    present = [c for c in wanted if c in codebook.columns]
    table = codebook.select(PACKAGE, *[F.col(c).alias(wanted[c]) for c in present])
    df = lookup_join(df, table, [PACKAGE])
    filled = {n: F.coalesce(F.col(n), unknown) for c, n in wanted.items() if c in present}
    absent = {n: unknown for c, n in wanted.items() if c not in present}
    return df.withColumns({**filled, **absent})


def map_categories(df: DataFrame, codebook: DataFrame) -> DataFrame:
    """Category and genre for finished tables; the codebook needs all columns."""
    missing = {PACKAGE, "genreId", "broad_app_category"} - set(codebook.columns)
    if missing:
        raise ValueError(f"codebook lacks {sorted(missing)}")
    if PACKAGE not in df.columns:
        raise ValueError(f"column {PACKAGE} not found")
    return enrich_codebook(df, codebook, genre_name="genreId")


def category_distribution(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent categories (ties by name)."""
    counts = df.groupBy("broad_app_category").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "broad_app_category").limit(top)
