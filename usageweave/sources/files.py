"""Finding files and reading delimited text with named columns."""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageweave import constants as C
from usageweave.operators.storage import materialise, scratch_folder

_CSV = {
    "header": True,
    "ignoreLeadingWhiteSpace": True,
    "quote": '"',
    "escape": '"',
    # Headers are known from the catalogue.
    "enforceSchema": True,
}
FILE = "source_file"
ORDER = "file_order"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


#: Files one scan takes on. Spark keeps what it lists and deals out in the driver, some 2 KB a file.
FILES_AT_ONCE = 20_000
# For scans of many files: what opening one costs in bytes that could be read meanwhile, so that
# a task takes more of them, and no listings that stay in the driver for later scans.
_MANY = {
    "spark.sql.files.openCostInBytes": str(512 * 1024),
    "spark.sql.hive.manageFilesourcePartitions": "false",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Let Spark list folders in a few tasks a core. By itself it takes up to 10,000, one for
    each folder, and setting them up takes the driver longer than the listing.
    """
    few = max(32, 4 * spark.sparkContext.defaultParallelism)
    few = min(int(spark.conf.get(_LISTING_TASKS)), few)
    with _settings(spark, {_LISTING_TASKS: str(few)}):
        yield


# Folders with so few entries are looked into by the driver, so many of them at most.
_FEW_ENTRIES, _MOST_OPENED = 100, 1_000


def _is_seen(path: str) -> bool:
    """Whether Spark's scans look at a path, by its name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
    return not hidden and not name.endswith("._COPYING_")


def _entries(spark: SparkSession, folder: str) -> Iterator[list[str]]:
    """Paths of files and folders that together hold all that Spark sees below ``folder``."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    waiting = [root] if system.exists(root) else []
    for opened in count():
        if not waiting:
            return
        path = waiting.pop()
        if opened >= _MOST_OPENED:
            yield [path.toString()]
            continue
        found = system.listStatus(path)
        paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)
        if len(found) <= _FEW_ENTRIES:
            here = [(p, p.toString(), f.isDirectory()) for p, f in zip(paths, found)]
            waiting += [p for p, text, is_folder in here if is_folder and _is_seen(text)]
            yield [text for _, text, is_folder in here if not is_folder and _is_seen(text)]
            continue
        del found
        paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths)
        for start in range(0, paths.size(), 5_000):
            texts = paths.slice(start, start + 5_000).mkString("\0").split("\0")
            yield [text for text in texts if _is_seen(text)]


def _batches(spark: SparkSession, folder: str) -> Iterator[list[str]]:
    """``folder`` alone, or if it holds more than some ``FILES_AT_ONCE`` files, lists of paths
    that hold about as many and together all.
    """
    # Packed, as they are kept until the last scan ends.
    packed, n_entries, spread = [], 0, []
    for entries in _entries(spark, folder):
        if entries:
            packed.append(zlib.compress("\0".join(entries).encode()))
            n_entries += len(entries)
            spread += entries[:: len(entries) // 20 + 1]
    # The size of a batch follows from how many files some twenty entries hold.
    some = spread[:: len(spread) // 20 + 1]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = 0
    for entry in some:
        path = path_of(entry)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files += system.getContentSummary(path).getFileCount()
    each = max(1.0, files / max(1, len(some)))
    if n_entries * each <= FILES_AT_ONCE:
        yield [folder]
        return
    gc.collect()  # what was listed
    entries = (e for chunk in packed for e in zlib.decompress(chunk).decode().split("\0"))
    size = max(1, int(FILES_AT_ONCE / each))
    while batch := list(islice(entries, size)):
        # These are names, not patterns.
        yield [re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path in batch]


def read_in_batches(
    spark: SparkSession, folder: str, name: str, read: Callable[[list[str]], DataFrame]
) -> DataFrame:
    """``read`` of all files below ``folder``.

    Spark's list of the files of a scan is in the driver. More than some ``FILES_AT_ONCE``
    files are therefore read in batches, whose rows are stored one after the other.
    """
    path = None
    for paths in _batches(spark, folder):
        if paths == [folder]:
            with few_listing_tasks(spark):
                return read(paths)
        path = path or scratch_folder(spark, name)
        with few_listing_tasks(spark), _settings(spark, _MANY):
            df = read(paths)
            schema = df.schema
            df.write.mode("append").parquet(path)
        # Spark keeps the batch's list of files until Python has given up the frame.
        del df
        gc.collect()
    return spark.read.schema(schema).parquet(path)


def _decoded(path: Column) -> Column:
    """Metadata paths are percent-encoded; a plus sign in them is literal."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _is_chosen(path: Column, pattern: str, ignore: tuple[str, ...]) -> Column:
    chosen = F.substring_index(path, "/", -1).rlike(pattern)
    for text in ignore:
        chosen = chosen & ~F.contains(path, F.lit(text))
    return chosen


def select_files(
    df: DataFrame,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    since: datetime | None = None,
) -> DataFrame:
    """Keep rows of files whose name matches, whose path is not ignored, and that were not
    last changed before ``since``. Spark leaves the others out of the scan.
    """
    chosen = _is_chosen(_decoded(F.col("_metadata.file_path")), pattern, ignore)
    if since is not None:
        chosen = chosen & (F.col("_metadata.file_modification_time") >= F.lit(since))
    return df.filter(chosen)


def list_files(
    spark: SparkSession,
    folder: str,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    since: datetime | None = None,
    times: bool = False,
) -> DataFrame:
    """Sorted ``source_file`` paths below ``folder``, with ``times`` also their length and
    when they were ``modified``; contents are not read.
    """
    length, modified = F.lit(0).cast("long"), F.timestamp_seconds(F.lit(0))

    def read(paths: list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        scanned = files.select(
            _decoded(F.col("_metadata.file_path")).alias(FILE),
            F.lit(True).alias("scanned"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
        # Scans pass over files without a byte; Spark's list of files, which is in the driver
        # anyway, has them.
        names = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string")
        path = F.regexp_replace("path", "^file:///", "file:/")
        names = names.select(
            _decoded(path).alias(FILE),
            F.lit(False).alias("scanned"),
            length.alias("length"),
            modified.alias("modified"),
        )
        every = scanned.unionByName(names).filter(_is_chosen(F.col(FILE), pattern, ignore))
        known = F.max(F.struct("scanned", "length", "modified")).alias("known")
        return every.groupBy(FILE).agg(known).select(FILE, "known.*")

    every = read_in_batches(spark, folder, "listed", read)
    if since is not None:
        every = every.filter(~F.col("scanned") | (F.col("modified") >= F.lit(since)))
    every = every.drop("scanned").orderBy(FILE)
    return every if times else every.select(FILE)


#: A quoted cell, with doubled quotes inside.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
#: The text of a row that has more cells than its header has names.
MALFORMED = "malformed"
_RECORD = "_record"


def _cells(line: Column) -> Column:
    """The cells of a header line, without quotes and blanks in front."""
    found = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(rf",[ \t]*({_QUOTED}|[^,]*)"), F.lit(1)
    )

    def plain(cell: Column) -> Column:
        inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)

    return F.transform(found, plain)


def _n_cells(record: Column) -> Column:
    """How many cells a line has; commas in quoted cells don't count."""
    bare = F.regexp_replace(record, rf"(^|,)[ \t]*{_QUOTED}", "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def header_catalogue(
    spark: SparkSession,
    folder: str,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    since: datetime | None = None,
) -> DataFrame:
    """(source_file, header): the cells of the first line of every matching file that isn't
    blank. A file without such a line is not in it.

    The lines come from a text scan by Spark, so from wherever Spark reads; of all but a
    file's first block every line is dropped as it is read.
    """

    def read(paths: list[str]) -> DataFrame:
        lines = spark.read.option("recursiveFileLookup", True).text(paths)
        lines = select_files(lines, pattern, ignore, since)
        lines = lines.filter(F.col("_metadata.file_block_start") == 0).select(
            _decoded(F.col("_metadata.file_path")).alias(FILE),
            "value",
            F.monotonically_increasing_id().alias("row"),
        )
        lines = lines.filter(F.col("value").rlike(r"[^\x00-\x20]"))
        first = lines.groupBy(FILE).agg(F.min_by("value", "row").alias("value"))
        return first.select(FILE, _cells(F.col("value")).alias("header"))

    return read_in_batches(spark, folder, "headers", read)


def _has_all(required: tuple[str, ...]) -> Column:
    wanted = F.lit(True)
    for name in required:
        wanted = wanted & F.array_contains("header", name)
    return wanted


def check_files(
    spark: SparkSession,
    folder: str,
    required: tuple[str, ...],
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    since: datetime | None = None,
    listed: DataFrame | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """(source_file, problem) of every matching file: what keeps it from being read, or null.

    The files (``listed``) and their ``headers`` are looked up if they are not given.
    """
    if listed is None:
        listed = list_files(spark, folder, pattern, ignore, since)
    if headers is None:
        headers = header_catalogue(spark, folder, pattern, ignore, since)
    absent = F.array_except(F.array(*[F.lit(n) for n in required]), "header")
    problem = F.when(F.col("header").isNull(), "Empty file").when(
        F.size(absent) > 0, F.concat(F.lit("No column "), F.array_join(absent, ", "))
    )
    return listed.join(headers, FILE, "left").select(FILE, problem.alias("problem"))


def unique_names(names: list[str], reserved: tuple[str, ...] = ()) -> dict[str, str]:
    """A column name for each of ``names`` that no other one equals, whatever its case: those
    that only differ in case from an earlier or a reserved name get a number.
    """
    kept = {n.lower(): n for n in reserved}
    out, taken = {}, set()
    for name in names:
        plain = name or "unnamed"
        new, n = plain, 1
        while new.lower() in taken or kept.get(new.lower(), new) != new:
            n += 1
            new = f"{plain}_{n}"
        taken.add(new.lower())
        out[name] = new
    return out


def _with_origin(df: DataFrame, names: list[str]) -> DataFrame:
    """``source_file`` and a ``file_order`` that sorts rows as in the file."""
    return df.select(
        *names,
        _decoded(F.col("_metadata.file_path")).alias(FILE),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(ORDER),
    )


def _nothing(spark: SparkSession, names: list[str]) -> DataFrame:
    order = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    columns = [F.lit(None).cast("string").alias(n) for n in [*names, FILE]]
    return spark.range(0).select(*columns, order.alias(ORDER))


def read_tables(
    spark: SparkSession,
    folder: str,
    pattern: str = C.RAW_FILE_PATTERN,
    ignore: tuple[str, ...] = C.RAW_FILE_IGNORE,
    multiline: bool = False,
    required: tuple[str, ...] = (),
    reserved: tuple[str, ...] = (),
    mark_malformed: bool = False,
    may_be_empty: bool = False,
    since: datetime | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """All matching CSV files below ``folder`` as text columns, with ``source_file`` and
    ``file_order``.

    Columns are matched by name, in the case they are written in, even when files order
    them differently: Spark binds CSV columns by position, so the catalogue of headers is
    looked at first. Of names that only differ in case all but one get a number behind them,
    and none takes a ``reserved`` name of another case. Of equal names in one file the first
    counts. Files without one of the ``required`` columns are skipped; that none is left is
    an error, or with ``may_be_empty`` an empty table with these columns.

    Missing cells at the end of a row are null. A row with more cells than its header has
    names can't be told apart by name: with ``mark_malformed`` its text is in a column of
    this name and its cells are null; else the cells beyond are left out.

    ``headers`` is the stored header catalogue, if it is known already.
    """
    if headers is None:
        headers = materialise(header_catalogue(spark, folder, pattern, ignore, since), "headers")
    good = headers.filter(_has_all(required))
    layouts = good.select("header").distinct()
    found = [r["header"] for r in layouts.limit(2).collect()]
    if not found:
        if not may_be_empty:
            raise ValueError(f"no file with the columns {[*required]} in {folder}")
        out = _nothing(spark, list(unique_names([*required], reserved).values()))
        return out.withColumn(MALFORMED, F.lit(None).cast("string")) if mark_malformed else out
    if len(found) == 1:
        names, width = list(dict.fromkeys(found[0])), len(found[0])
    else:
        # Column names of all files: a log has some ten of them.
        each = layouts.select(F.explode("header").alias("name")).distinct().orderBy("name")
        names = [r["name"] for r in each.collect()]
        width = layouts.agg(F.max(F.size("header"))).first()[0]
    cells = [f"_c{i}" for i in range(width)]
    reader = (
        spark.read.options(**_CSV)
        .option("recursiveFileLookup", True)
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", _RECORD)
        .schema(", ".join(f"{c} string" for c in [*cells, _RECORD]))
    )
    n_names, part = F.lit(width), None
    if len(found) == 1:
        places = {n: F.col(cells[found[0].index(n)]) for n in names}
        if not headers.filter(~_has_all(required)).isEmpty():
            part = good.select(FILE), "left_semi"
    else:
        part = good, "inner"  # stored: Spark knows its size
        line = F.array(*cells)
        places = {
            n: F.get(line, F.array_position("header", F.lit(n)).cast("int") - 1) for n in names
        }
        n_names = F.size("header")
    columns = unique_names(names, reserved)
    record = F.col(_RECORD)
    whole = F.coalesce(record, F.array_join(F.array(*cells), ",", ""))
    n_cells = F.when(record.isNull(), width).otherwise(_n_cells(record))
    malformed = F.when(n_cells > n_names, whole)
    good_row = F.col(MALFORMED).isNull() if mark_malformed else F.lit(True)
    # Missing-value texts are null.
    values = [
        F.when(good_row & ~e.isin(*C.MISSING_CELLS), e).alias(columns[n])
        for n, e in places.items()
    ]
    marked = [MALFORMED] if mark_malformed else []

    def read(paths: list[str]) -> DataFrame:
        rows = select_files(reader.csv(paths), pattern, ignore, since)
        rows = _with_origin(rows, [*cells, _RECORD])
        if part is not None:
            rows = rows.join(part[0], FILE, part[1])
        if mark_malformed:
            rows = rows.withColumn(MALFORMED, malformed)
        return rows.select(*values, FILE, ORDER, *marked)

    return read_in_batches(spark, folder, "rows", read)
