"""Writing finished tables and reports."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.functions.values import quoted, stripped
from usageweave.operators.enrich import dedupe_keep, duplicate_rows
from usageweave.operators.labelling import merge_unexpected_labels
from usageweave.operators.storage import materialise
from usageweave.sources.files import FILE, ORDER, read_tables


#: Folders one write makes. Spark gathers the names of all of them in the driver.
FOLDERS_AT_ONCE = 100_000
#: Beside each file on a local disk Hadoop writes one with checksums, and without its native
#: library it starts a process for the mode of either: of small files that is most of the time.
#: Other file systems are as they are.
_NO_CHECKSUM_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def write_folders(
    df: DataFrame,
    path: str,
    key: str,
    file_format: str,
    mode: str = "error",
    n_folders: int | None = None,
    **settings: object,
) -> None:
    """``df`` in one folder for each value of ``key`` below ``path``, its rows dealt out and
    in order as they are. Many folders are written in several turns. With the ``mode``
    overwrite, folders of other values stay as they are.
    """
    if n_folders is None:
        n_folders = df.select(key).distinct().count()
    turns = max(1, ceil(n_folders / FOLDERS_AT_ONCE))
    if mode == "overwrite":  # only what is written
        settings["partitionOverwriteMode"] = "dynamic"
    for turn in range(turns):
        of_turn = F.pmod(F.xxhash64(key), F.lit(turns)) == turn
        part = df if turns == 1 else df.where(of_turn)
        writer = part.write.partitionBy(key).format(file_format)
        writer = writer.mode("append" if turn and mode != "overwrite" else mode)
        writer.options(**_NO_CHECKSUM_FILES, **settings).save(path)


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def output_name(unit: Column, is_file: bool = True) -> Column:
    """Name of a unit's result: stem without ``Raw ``, plus the suffix.

    Units that are no files keep their whole name; a slash in it would begin a
    folder of its own and becomes an underscore.
    """
    stem = file_stem(unit) if is_file else F.replace(unit, F.lit("/"), F.lit("_"))
    return F.concat(F.replace(stem, F.lit("Raw "), F.lit("")), F.lit(C.OUTPUT_SUFFIX))


def unique_names(units: DataFrame, name: Column, taken: DataFrame | None = None) -> DataFrame:
    """(unit, output_name) for each of ``units`` (unit): its ``name``; those whose names
    would be the same, or are ``taken`` (output_name) already, get a digest of 16 digits of
    the unit behind them. A null unit is one of its own.
    """
    unit = F.col("unit")
    name = F.coalesce(name, F.lit("no unit"))
    names = units.select("unit").distinct().withColumn("output_name", name)
    every = names.select("output_name")
    every = every if taken is None else every.unionByName(taken)
    several = every.groupBy("output_name").count().where("count > 1").drop("count")
    several = several.withColumn("several", F.lit(True))
    told = F.concat(F.isnull(unit).cast("string"), F.coalesce(unit, F.lit("")))
    digest = F.concat(F.col("output_name"), F.lit(" "), F.substring(F.md5(told), 1, 16))
    shown = F.when(F.col("several"), digest).otherwise(F.col("output_name"))
    return names.join(several, "output_name", "left").select("unit", shown.alias("output_name"))


def output_names(df: DataFrame, unit: str) -> DataFrame:
    """(unit, output_name) with the names of the units' results."""
    units = df.select(F.col(unit).cast("string").alias("unit"))
    return unique_names(units, output_name(F.col("unit"), unit == FILE))


def flags_text(flags: Column) -> Column:
    """Flag list as bracketed, quoted text, for CSV."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(flags, quoted), ", "), F.lit("]")
    )


def _write_units(
    df: DataFrame, key: str, names: DataFrame, path: str, order: str, file_format: str, mode: str
) -> None:
    """``df`` in one folder per unit (in column ``key``) below ``path``, with the names
    that ``names`` (unit, output_name) gives, rows in order of ``order``. Keys of another
    name than ``unit`` are not written.

    Rows are dealt out by ranges of (name, order): a task writes few folders, and a large
    unit is written by several. ``df`` should be stored, as ranges are sampled from it.
    """
    flags = "any_app_usage_flags"
    if file_format == "csv" and dict(df.dtypes).get(flags) == "array<string>":
        df = df.withColumn(flags, flags_text(F.col(flags)))
    of = names.select(F.col("unit").alias("_of"), "output_name")
    df = df.join(of, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")
    df = df if key == "unit" else df.drop(key)
    df = df.repartitionByRange("output_name", order)
    df = df.sortWithinPartitions("output_name", order).drop(order)
    header = {"header": True} if file_format == "csv" else {}
    write_folders(df, path, "output_name", file_format, mode, names.count(), **header)


def write_preprocessed(
    df: DataFrame,
    path: str,
    unit: str,
    file_format: str = "parquet",
    names: DataFrame | None = None,
    mode: str = "error",
) -> None:
    """One folder per unit below ``path``, with the unit in a column ``unit``.

    Rows are dealt out by ranges of (unit, seq), so a unit has one file, or
    several whose names are in the order of its rows if it is large or lies on
    the border of a range.  The ``seq`` column is not written itself. ``names``
    (unit, output_name) are worked out if they are not given. With the ``mode``
    overwrite, units that are not in ``df`` stay as they are.
    """
    if C.SEQ not in df.columns:
        raise ValueError("rows need their number in the unit: finished_table(keep_seq=True)")
    df = materialise(df.withColumnRenamed(unit, "unit"), "unit-rows")
    if names is None:
        names = unique_names(df, output_name(F.col("unit"), unit == FILE))
    _write_units(df, "unit", names, path, C.SEQ, file_format, mode)


def delete_units(names: DataFrame, path: str) -> None:
    """Delete the folders below ``path`` that the writer made for ``names`` (output_name)."""
    spark = names.sparkSession
    jvm = spark._jvm
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark._jsc.hadoopConfiguration()
    )
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in names.select("output_name").distinct().toLocalIterator():
        name = escape(row["output_name"])
        system.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/output_name={name}"), True)


def write_categorised(df: DataFrame, path: str, unit: str = FILE, order: str = ORDER) -> None:
    """Category mapper output, one folder per file, ``{stem}_with_categories``.

    Rows are in the order they were recorded in, if ``df`` has that column, and tell their
    unit in a column ``unit``: that of the table they were read from, or their file. Files
    with the same stem get folders of their own.
    """
    if order not in df.columns:
        df = df.withColumn(order, F.monotonically_increasing_id())
    if "unit" not in df.columns:
        df, unit = df.withColumnRenamed(unit, "unit"), "unit"
    df = materialise(df, "categorised-rows")
    # A folder that the writer made has no extension to remove.
    folder = F.regexp_extract("unit", r"output_name=([^/]+)$", 1)
    stem = F.when(folder != "", folder).otherwise(file_stem(F.col("unit")))
    units = df.select(F.col(unit).alias("unit"))
    names = unique_names(units, F.concat(stem, F.lit("_with_categories")))
    _write_units(df, unit, names, path, order, "csv", "error")


def update_label_log(new: DataFrame, existing: DataFrame, path: str) -> bool:
    """Write the merged message log if ``new`` holds a line not yet known."""
    known = existing.select(stripped(F.col("message")).alias("message"))
    if new.select("message").join(known, "message", "left_anti").isEmpty():
        return False
    merge_unexpected_labels(new, existing).write.text(path)
    return True


def dedupe_codebook_job(
    spark: SparkSession,
    path: str,
    out: str,
    keep: str = "first",
    report: str | None = None,
) -> bool:
    """Write a codebook without duplicates, and the duplicates if asked to.

    Writes nothing when there are no duplicates.
    """
    key = "app_package_name"
    rows = read_tables(spark, path, r".*", ()).drop("source_file")
    if key not in rows.columns:
        raise ValueError(f"a codebook needs a column {key}")
    duplicates = duplicate_rows(rows, key)
    if duplicates.isEmpty():
        return False
    if report:
        dropped = duplicates.drop(ORDER, "occurrences")
        dropped.write.option("header", True).csv(report)
    clean = dedupe_keep(rows, key, ORDER, keep).select(*rows.columns).orderBy(ORDER)
    clean.drop(ORDER).write.option("header", True).csv(out)
    return True
