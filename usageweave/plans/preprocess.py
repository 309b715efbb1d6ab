"""The preprocessing job: raw logs in, analysis table and unit report out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave import __version__
from usageweave import constants as C
from usageweave.config import StudyOptions
from usageweave.functions.times import require_utc
from usageweave.operators import columns as cols
from usageweave.operators import engagement, enrich, labelling, reports, sessions
from usageweave.operators.ordering import order_log
from usageweave.operators.storage import materialise, require_scratch
from usageweave.operators.timezones import apply_timezone_mode, bad_zone_rows
from usageweave.operators.units import Lane, split_lanes
from usageweave.sources.files import MALFORMED


@dataclass(frozen=True)
class Result:
    """``rows`` is the finished table; ``quarantine`` has the input rows that no
    result can hold, each with its ``reason``.
    """

    rows: DataFrame
    quarantine: DataFrame
    raw: DataFrame
    kinds: DataFrame
    unit: str
    filters: DataFrame | None = None
    files: DataFrame | None = None

    def report(self) -> DataFrame:
        """Status and counts per unit; with ``files`` also of files without rows."""
        report = reports.unit_report(
            self.raw, self.kinds, self.rows, self.unit, self.quarantine
        )
        if self.files is None:
            return report
        return reports.with_empty_units(report, self.files, self.unit)

    def unexpected_labels(self) -> DataFrame:
        """Listed apps whose label in the log is not one of those listed."""
        if self.filters is None:
            raise ValueError("the run had no filter list")
        return labelling.unexpected_labels(self.raw, self.filters)

    def unknown_types(self) -> DataFrame:
        """Rows per interaction type that no raw spelling maps to."""
        return reports.unknown_interaction_counts(self.raw)


def read_times(raw: DataFrame, options: StudyOptions) -> DataFrame:
    """Row-level corrections that need no other row."""
    if options.normalise_usernames:
        raw = cols.normalise_usernames(raw)
    raw = raw.withColumn("timestamp_text", F.col("event_timestamp"))
    return cols.fix_timestamps(cols.rename_interaction_types(raw))


# What the scans look at; everything else rides along in one struct, so that
# sorts and windows move narrow rows.
SCANNED = ("file_order", "event_timestamp", "interaction_type", "app_package_name")


#: Reasons for quarantine.
BAD_TIME = "unreadable event timestamp"
BAD_ZONE = "unusable primary time zone"
BAD_ROW = "malformed row"


def labelled_log(
    df: DataFrame, lane: Lane, options: StudyOptions, filters: DataFrame | None
) -> DataFrame:
    """Ordered rows that go into sessionising, other columns in ``rest``.

    ``df`` has been through ``apply_timezone_mode``.
    """
    df = df.filter(~F.col("zone_error")).drop("zone_error", "timestamp_text")
    scanned = [lane.unit, *SCANNED]
    # Looked up before the log is ordered, applied after types are removed.
    listing = options.use_filter_list and filters is not None
    if listing:
        df = labelling.mark_listed(df, filters)
        scanned.append("listed")
    rest = F.struct(*[c for c in df.columns if c not in scanned])
    df = df.select(*scanned, rest.alias("rest"))
    df = cols.remove_types(order_log(df, lane, options), options)
    df = cols.device_model(df, lane)
    return labelling.relabel_listed(df) if listing else df


def usage_table(
    df: DataFrame, lane: Lane, options: StudyOptions, codebook: DataFrame | None
) -> DataFrame:
    """Sessions, engagement, flags, calendar and categories of a labelled log."""
    df = sessions.sessions(df, lane, options)
    df = engagement.usage_details(df, lane, options)
    df = engagement.add_usage_flags(df, options)
    df = cols.remove_types(df, options)
    df = df.withColumn("event_timestamp", F.timestamp_micros(C.EVENT_US))
    df = cols.calendar_columns(df.select("*", "rest.*").drop("rest"))
    return enrich.enrich_codebook(df, codebook if options.use_codebook else None)


def preprocess(
    raw: DataFrame,
    options: StudyOptions,
    filters: DataFrame | None = None,
    codebook: DataFrame | None = None,
    run_time: datetime | None = None,
    keep_stages: bool = False,
    files: DataFrame | None = None,
) -> Result:
    """Run the whole job over all units at once.

    ``raw`` needs the columns of a raw log plus the unit key and ``file_order``; rows
    with a text in a column ``malformed`` go into quarantine.  With ``keep_stages`` the result and the types each unit
    has are stored, so that the report does not compute them again.  ``files``
    (unit key, and perhaps ``problem``) lists the files there are, so that it names those
    without rows, too.
    Every row of ``raw`` goes into ``rows`` or ``quarantine``, but for those that
    the options remove by type or zone.
    """
    require_utc(raw.sparkSession)
    require_scratch(raw.sparkSession)
    unit = options.unit
    raw = raw.withColumn(unit, F.coalesce(F.col(unit), F.lit("")))
    timed = read_times(raw, options)
    kinds, finished = [], []
    reason = F.lit(BAD_TIME)
    if MALFORMED in raw.columns:
        ragged = F.col(MALFORMED).isNotNull()
        timed = timed.withColumn("ts_error", F.col("ts_error") | ragged)
        reason = F.when(ragged, BAD_ROW).otherwise(BAD_TIME)
        raw = raw.filter(~ragged).drop(MALFORMED)
    rejected = [timed.filter("ts_error").withColumn("reason", reason)]
    # Rows per unit are counted on the raw log: no time is parsed for that.
    for part, lane in split_lanes(raw, options):
        readable = read_times(part, options).filter(~F.col("ts_error"))
        zoned = apply_timezone_mode(readable, lane, options, text="timestamp_text")
        bad_zone = lane.finish(bad_zone_rows(readable, lane, options, text="timestamp_text"))
        rejected.append(bad_zone.withColumn("reason", F.lit(BAD_ZONE)))
        log = labelled_log(zoned.drop("ts_error"), lane, options, filters)
        kinds.append(reports.unit_kinds(lane.finish(log), unit))
        finished.append(lane.finish(usage_table(log, lane, options, codebook)))
    rows = reduce(DataFrame.unionByName, finished)
    seen = reduce(DataFrame.unionByName, kinds)
    if keep_stages:
        rows = materialise(rows, "finished")
        seen = materialise(seen, "kinds")
    rows = cols.admin_columns(rows, run_time or datetime.now(), __version__)
    return Result(
        rows=rows,
        quarantine=reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True), rejected
        ),
        raw=timed,
        kinds=seen,
        unit=unit,
        filters=filters,
        files=files,
    )


def finished_table(
    result: Result, options: StudyOptions, keep_seq: bool = False
) -> DataFrame:
    """Result rows in output form: formatted times, output columns in order.

    ``keep_seq`` keeps the row number in the unit, which the writer sorts by.
    """
    rows = cols.format_timestamps(result.rows)
    keys = [result.unit, C.SEQ] if keep_seq else [result.unit]
    return cols.project_output(rows, options, *keys)
