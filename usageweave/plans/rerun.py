"""Preprocessing a folder again where its files have changed.

Every unit needs its whole history, so a changed file is run again as a whole; files that
are as they were are neither parsed nor written. A manifest beside the results has the
length and time of every file, and the options and dimensions it was run with.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave import __version__
from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.operators.storage import materialise
from usageweave.plans.preprocess import Result, finished_table, preprocess
from usageweave.sources import files, logs, sinks
from usageweave.sources.files import FILE

MANIFEST = "_units"
_STATE = "run long, unit string, output_name string, length long, modified timestamp, settings string"


@dataclass(frozen=True)
class Rerun:
    """``changed`` and ``removed`` (unit, output_name) are the files that were run again or
    are new, and those that are gone; ``result`` is None if there was nothing to run.
    """

    result: Result | None
    changed: DataFrame
    removed: DataFrame


def _state(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the last run; empty before the first."""
    try:
        runs = spark.read.schema(_STATE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)
    last = runs.agg(F.max("run")).first()[0]
    return materialise(runs.filter(F.col("run") == last), "units-before")


def _settings(options: StudyOptions, *dimensions: DataFrame | None) -> str:
    """A digest of what results depend on besides the logs."""
    parts = [__version__, repr(options)]
    for table in dimensions:
        if table is not None:
            rows = F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)"))
            parts.append(str([sorted(table.columns), table.agg(rows, F.count("*")).first()]))
    return sha256("\n".join(parts).encode()).hexdigest()


def _named(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` (unit, ...) with names: known units keep theirs; new ones whose name would be
    that of another unit get a digest behind it.
    """
    fresh = files.join(known.select("unit"), "unit", "left_anti").select("unit")
    base = sinks.output_name(F.col("unit"))
    names = sinks.unique_names(fresh, base, taken=known.select("output_name"))
    names = names.unionByName(known.select("unit", "output_name"))
    return files.join(names, "unit")


def preprocess_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    options: StudyOptions,
    filters: DataFrame | None = None,
    codebook: DataFrame | None = None,
    run_time: datetime | None = None,
    file_format: str = "parquet",
    multiline: bool = False,
) -> Rerun:
    """Preprocess the raw logs of ``folder`` into one folder per file below ``out``.

    Called again, it runs the files that are new or whose length or time has changed, all of
    them if options or dimensions have; results of files that are gone or have no rows any
    more go. Afterwards ``out`` holds what a first run over the folder as it is would write
    (of files with equal stems the one that came first may keep the shorter name).
    The manifest is written last: a run that was broken off is made up for by the next.
    """
    if options.unit != FILE:
        raise ValueError(f"files are run again, so the unit has to be {FILE}")
    state = f"{out.rstrip('/')}/{MANIFEST}"
    known = _state(spark, state)
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    settings = F.lit(_settings(options, filters, codebook))
    listed = materialise(files.list_files(spark, folder, times=True), "listed")
    listed = listed.withColumnRenamed(FILE, "unit")
    current = materialise(_named(listed.withColumn("settings", settings), known), "units-now")
    same = ["unit", "length", "modified", "settings"]
    changed = materialise(current.join(known.select(same), same, "left_anti"), "units-changed")
    removed = known.join(current, "unit", "left_anti").select("unit", "output_name")
    removed = materialise(removed, "units-removed")
    since = changed.agg(F.min("modified")).first()[0]
    result, stale = None, removed
    if since is not None:
        again = changed.select(F.col("unit").alias(FILE))
        # Older files are not even listed for the scan; headers are read once.
        headers = materialise(files.header_catalogue(spark, folder, since=since), "headers")
        raw = logs.scan_raw(spark, folder, multiline=multiline, since=since, headers=headers)
        raw = materialise(raw.join(again, FILE, "left_semi"), "raw")
        checked = logs.check_logs(spark, folder, listed=again, headers=headers)
        result = preprocess(raw, options, filters, codebook, run_time, True, checked)
        table = finished_table(result, options, keep_seq=True)
        names = changed.select("unit", "output_name")
        sinks.write_preprocessed(table, out, FILE, file_format, names, "overwrite")
        written = table.select(F.col(FILE).alias("unit")).distinct()
        stale = stale.unionByName(names.join(written, "unit", "left_anti"))
    sinks.delete_units(stale, out)
    rows = current.select(F.lit(run).alias("run"), *[n.split()[0] for n in _STATE.split(", ")][1:])
    rows.write.mode("append").parquet(state)
    return Rerun(result, changed.select("unit", "output_name"), removed)
