"""One registered query per operator, with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import frames as fr
from checks import sql as q
from usageweave import StudyOptions, TimezoneMode, __version__
from usageweave import constants as C
from usageweave.functions import times
from usageweave.operators import columns as cols
from usageweave.operators import engagement, enrich, labelling, reports, sessions
from usageweave.operators import timeline, timezones
from usageweave.operators.storage import materialise, scratch_folder
from usageweave.operators.units import by_unit
from usageweave.plans.jobs import categorise, plot_tables
from usageweave.plans.preprocess import BAD_ROW, BAD_TIME, BAD_ZONE, finished_table, preprocess
from usageweave.plans.rerun import preprocess_folder
from usageweave.sources import logs, sinks
from usageweave.sources.files import read_in_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UNIT = fr.UNIT
KEEP = StudyOptions(unit=UNIT)
MINIMAL = fr.minimal()
FULL = fr.options()
RUN_TIME = datetime(2024, 2, 1)
N = KEEP.custom_engagement_seconds


def register(name: str, oracle: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


# --- scalar and row-level operators ----------------------------------------


@register(
    "rename_interactions",
    q.with_(q.log(), q.named())
    + "SELECT file_order, participant_id, kind AS interaction_type FROM named",
)
def _(spark, folder):
    df = cols.rename_interaction_types(fr.log(spark, folder))
    return df.select("file_order", "participant_id", "interaction_type")


def _spelled_sql() -> str:
    iso = {"yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S"}
    cases = []
    for n, (pattern, tail) in fr.SPELLINGS.items():
        stem, _, frac = pattern.partition(".")
        form = iso[stem] + (".%f" if frac else "")
        cases.append(f"WHEN {n} THEN concat(strftime(ts, '{form}'), '{tail}')")
    return f"spelled AS (SELECT *, CASE file_order % 7 {' '.join(cases)} END AS txt FROM log)"


_FIXED = """zulu AS (SELECT *, replace(txt, 'Z', '+00:00') AS z FROM spelled),
  dotted AS (SELECT *, CASE WHEN contains(z, '.') THEN z
    WHEN length(z) >= 6 AND z[-6] IN ('+', '-') THEN concat(z[:-7], '.000', z[-6:])
    ELSE concat(z, '.000') END AS d FROM zulu),
  fixed AS (SELECT *, CASE WHEN length(d) >= 25 THEN d END AS f FROM dotted)"""


@register(
    "fix_timestamp",
    q.with_(q.log(), _spelled_sql(), _FIXED)
    + "SELECT file_order, f AS fixed, txt IS NOT NULL AND f IS NULL AS rejected FROM fixed",
)
def _(spark, folder):
    text = F.col("event_timestamp")
    return fr.spelled_log(spark, folder).select(
        "file_order",
        times.fix_timestamp(text).alias("fixed"),
        times.timestamp_error(text).alias("rejected"),
    )


@register(
    "parse_timestamp",
    q.with_(q.log(), _spelled_sql(), _FIXED)
    + """SELECT file_order, CASE WHEN f IS NOT NULL THEN epoch_us(CASE
        WHEN file_order % 7 IN (0, 2) THEN date_trunc('second', ts) ELSE ts END)
        + CASE file_order % 7 WHEN 2 THEN 5 WHEN 3 THEN -2 ELSE 0 END * 3600000000
      END AS event_us FROM fixed""",
)
def _(spark, folder):
    df = cols.fix_timestamps(fr.spelled_log(spark, folder))
    return df.select("file_order", F.unix_micros("event_timestamp").alias("event_us"))


@register(
    "normalise_username",
    q.with_(q.log())
    + """SELECT username, count(*) AS rows FROM (SELECT replace(username, 'Target child',
      'Target Child') AS username FROM log) GROUP BY 1""",
)
def _(spark, folder):
    df = cols.normalise_usernames(fr.log(spark, folder))
    return df.groupBy("username").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "target_child",
    q.with_(q.log())
    + "SELECT file_order, username FROM log WHERE username ILIKE '%target child%'",
)
def _(spark, folder):
    df = cols.target_child_only(fr.log(spark, folder))
    return df.select("file_order", "username")


@register(
    "calendar_columns",
    q.with_(q.log())
    + f"""SELECT file_order, CAST(date AS VARCHAR) AS date, day, "weekdayMF", "weekdayMTh",
      "weekdaySuTh", hour, quarter FROM (SELECT file_order,
      {q.calendar(q.local("epoch_us(ts)", "coalesce(timezone, 'UTC')"))} FROM log)""",
)
def _(spark, folder):
    df = fr.log(spark, folder).withColumns(
        {
            C.EVENT_US: F.unix_micros("event_timestamp"),
            "timezone": F.coalesce("timezone", F.lit("UTC")),
        }
    )
    names = ["day", "weekdayMF", "weekdayMTh", "weekdaySuTh", "hour", "quarter"]
    return cols.calendar_columns(df).select(
        "file_order", F.col("date").cast("string").alias("date"), *names
    )


# --- order in the unit ------------------------------------------------------

_ORDER_SQL = """SELECT participant_id, file_order, seq, us AS event_us,
  gap AS data_time_gap_hours FROM ordered"""
_ORDER = ["participant_id", "file_order", "seq", "event_us", "data_time_gap_hours"]


def _order(spark, folder, opts, time):
    return fr.ordered(spark, folder, opts, lambda df, ln: df, time).select(*_ORDER)


@register("tie_break", q.with_(q.base(KEEP, "ties")) + _ORDER_SQL)
def _(spark, folder):
    return _order(spark, folder, KEEP, "ties")


@register("tie_break_sliced", q.with_(q.base(KEEP, "ties")) + _ORDER_SQL)
def _(spark, folder):
    return _order(spark, folder, StudyOptions(unit=UNIT, **fr.HOT), "ties")


@register("data_time_gap", q.with_(q.base(KEEP)) + _ORDER_SQL)
def _(spark, folder):
    return _order(spark, folder, KEEP, "plain")


@register(
    "remove_types",
    q.with_(q.base(KEEP, "dense"), q.kept(KEEP))
    + """SELECT participant_id, file_order, kind AS interaction_type,
      gap AS data_time_gap_hours FROM kept""",
)
def _(spark, folder):
    df = fr.ordered(
        spark, folder, KEEP, lambda d, ln: cols.remove_types(d, KEEP), "dense"
    )
    return df.select(
        "participant_id", "file_order", "interaction_type", "data_time_gap_hours"
    )


# --- time zones -------------------------------------------------------------


@register(
    "primary_timezone",
    q.with_(q.log(), q.primary()) + "SELECT participant_id, zone AS primary_timezone FROM primary_tz",
)
def _(spark, folder):
    return timezones.primary_timezone(fr.log(spark, folder), UNIT, None)


@register(
    "discover_timezones",
    q.with_(q.log()) + "SELECT DISTINCT timezone FROM log WHERE timezone IS NOT NULL",
)
def _(spark, folder):
    return timezones.discover_timezones(fr.log(spark, folder))


@register(
    "detect_timezones",
    q.with_(q.log())
    + """SELECT DISTINCT timezone FROM (SELECT timezone FROM log UNION ALL
      SELECT CASE file_order % 7 WHEN 0 THEN 'UTC' WHEN 1 THEN 'UTC' WHEN 2 THEN 'UTC-05:00'
      WHEN 3 THEN 'UTC+02:00' END FROM log) WHERE timezone IS NOT NULL""",
)
def _(spark, folder):
    return timezones.detect_timezones(fr.spelled_log(spark, folder))


_ZONE = "America/Chicago"


def _tz_sql(rows: str, zone: str) -> str:
    return f"""SELECT file_order, {zone} AS timezone,
      strftime({q.local("epoch_us(ts)", zone)}, '%Y-%m-%d %H:%M:%S.%f') AS local_time
      FROM {rows}"""


def _tz(spark, folder, mode):
    selected = mode in (TimezoneMode.KEEP_SELECTED, TimezoneMode.CONVERT_TO_SELECTED)
    opts = fr.options(timezone_mode=mode, selected_timezone=_ZONE if selected else None)
    df = by_unit(
        fr.log(spark, folder),
        lambda d, ln: timezones.apply_timezone_mode(d, ln, opts),
        opts,
    )
    local = times.wall_clock(F.unix_micros("event_timestamp"), F.col("timezone"))
    text = F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select("file_order", "timezone", text.alias("local_time"))


_WITH_PRIMARY = "log JOIN primary_tz USING (participant_id)"


@register(
    "tz_mode0",
    q.with_(q.log()) + _tz_sql("log", f"'{_ZONE}'") + f" WHERE timezone = '{_ZONE}'",
)
def _(spark, folder):
    return _tz(spark, folder, TimezoneMode.KEEP_SELECTED)


@register("tz_mode1", q.with_(q.log()) + _tz_sql("log", f"'{_ZONE}'"))
def _(spark, folder):
    return _tz(spark, folder, TimezoneMode.CONVERT_TO_SELECTED)


@register(
    "tz_mode2",
    q.with_(q.log(), q.primary()) + _tz_sql(_WITH_PRIMARY, "zone") + " WHERE log.timezone = zone",
)
def _(spark, folder):
    return _tz(spark, folder, TimezoneMode.KEEP_PRIMARY)


@register("tz_mode3", q.with_(q.log(), q.primary()) + _tz_sql(_WITH_PRIMARY, "zone"))
def _(spark, folder):
    return _tz(spark, folder, TimezoneMode.CONVERT_TO_PRIMARY)


# --- dimensions -------------------------------------------------------------


@register(
    "app_filters",
    q.with_(q.filters())
    + "SELECT app_package_name, array_to_string(labels, '|') AS labels FROM filters",
)
def _(spark, folder):
    return fr.filters(spark, folder).select(
        "app_package_name", F.concat_ws("|", "labels").alias("labels")
    )


@register(
    "codebook_first",
    q.with_(q.first_codebook())
    + 'SELECT app_package_name, broad_app_category, "genreId" FROM cb',
)
def _(spark, folder):
    return fr.first_codebook(spark, folder).select(
        "app_package_name", "broad_app_category", "genreId"
    )


def _dedup_sql(order: str) -> str:
    return q.with_(q.codebook_rows()) + (
        f"""SELECT app_package_name, row_no, broad_app_category, "genreId" FROM (SELECT *,
        row_number() OVER (PARTITION BY app_package_name ORDER BY row_no {order}) AS pos
        FROM cb_rows) WHERE pos = 1"""
    )


_CODEBOOK = ["app_package_name", "row_no", "broad_app_category", "genreId"]


@register("codebook_dedup_first", _dedup_sql("ASC"))
def _(spark, folder):
    rows = fr.codebook_rows(spark, folder)
    return enrich.dedupe_keep(rows, "app_package_name", "row_no", "first").select(*_CODEBOOK)


@register("codebook_dedup_last", _dedup_sql("DESC"))
def _(spark, folder):
    rows = fr.codebook_rows(spark, folder)
    return enrich.dedupe_keep(rows, "app_package_name", "row_no", "last").select(*_CODEBOOK)


@register(
    "codebook_duplicates",
    q.with_(q.codebook_rows())
    + """SELECT app_package_name, row_no, occurrences FROM (SELECT *, count(*) OVER
      (PARTITION BY app_package_name) AS occurrences FROM cb_rows) WHERE occurrences > 1""",
)
def _(spark, folder):
    rows = enrich.duplicate_rows(fr.codebook_rows(spark, folder), "app_package_name")
    return rows.select("app_package_name", "row_no", "occurrences")


# --- joins ------------------------------------------------------------------


@register(
    "label_filtered_apps",
    q.with_(q.log(), q.named(), q.filters(), q.labelled("named"))
    + "SELECT file_order, app AS app_package_name, kind AS interaction_type FROM labelled",
)
def _(spark, folder):
    df = cols.rename_interaction_types(fr.log(spark, folder))
    return labelling.label_filtered_apps(df, fr.filters(spark, folder)).select(
        "file_order", "app_package_name", "interaction_type"
    )


_MISMATCH = """bad AS (SELECT DISTINCT app_package_name, labels, application_label
  FROM log JOIN filters USING (app_package_name)
  WHERE NOT coalesce(list_contains(labels, application_label), false))"""


@register(
    "unexpected_labels",
    q.with_(q.log(), q.filters(), _MISMATCH)
    + """SELECT app_package_name, array_to_string(labels, '|') AS expected_labels,
      application_label AS found_label FROM bad""",
)
def _(spark, folder):
    found = labelling.unexpected_labels(fr.log(spark, folder), fr.filters(spark, folder))
    text = F.concat_ws("|", "expected_labels")
    return found.withColumn("expected_labels", text)


@register(
    "merge_unexpected_labels",
    q.with_(q.log(), q.filters(), _MISMATCH)
    + """SELECT concat(app_package_name, ': expected any of ''[''',
      array_to_string(labels, ''', '''), ''']'', found ''',
      coalesce(application_label, 'nan'), '''') AS message FROM bad
      UNION SELECT concat(p_brand, ': known before') FROM part""",
)
def _(spark, folder):
    found = labelling.unexpected_labels(fr.log(spark, folder), fr.filters(spark, folder))
    known = F.concat(F.lit("  "), "p_brand", F.lit(": known before "))
    existing = fr.table(spark, folder, "part").select(known.alias("message"))
    return labelling.merge_unexpected_labels(labelling.label_messages(found), existing)


_CB_SQL = """SELECT file_order, coalesce(broad_app_category, 'Unknown') AS broad_app_category,
  coalesce("genreId", 'Unknown') AS {genre}
  FROM log LEFT JOIN cb USING (app_package_name)"""


@register(
    "enrich_codebook",
    q.with_(q.log(), q.first_codebook()) + _CB_SQL.format(genre='"genreId_scraped"'),
)
def _(spark, folder):
    df = enrich.enrich_codebook(fr.log(spark, folder), fr.first_codebook(spark, folder))
    return df.select("file_order", "broad_app_category", "genreId_scraped")


@register(
    "map_categories",
    q.with_(q.log(), q.first_codebook()) + _CB_SQL.format(genre='"genreId"'),
)
def _(spark, folder):
    df = enrich.map_categories(fr.log(spark, folder), fr.first_codebook(spark, folder))
    return df.select("file_order", "broad_app_category", "genreId")


@register(
    "category_top10",
    q.with_(q.log(), q.first_codebook())
    + """SELECT coalesce(broad_app_category, 'Unknown') AS broad_app_category,
      count(*) AS rows FROM log LEFT JOIN cb USING (app_package_name)
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, folder):
    return categorise(fr.log(spark, folder), fr.first_codebook(spark, folder))[1]


# --- sessions ---------------------------------------------------------------


def _stops(spark, folder, opts, names):
    rules = sessions.valid_rules(opts)

    def step(df, lane):
        df = lane.settle(sessions.same_app_stops(df, lane, rules), "stops")
        return sessions.other_app_stop(df, lane, rules)

    df = fr.ordered(spark, folder, opts, step)
    df = df.filter(F.col("interaction_type") == rules.resumed)
    found = [
        F.col("valid_stopped" if n == "stopped" else f"valid_{n}.moved").alias(f"{n}_us")
        for n in names
    ]
    resolved = sessions.resolve_stop(rules).alias("stop_us")
    return df.select("participant_id", "seq", *found, resolved)


def _stops_sql(opts, names):
    found = ", ".join(f"{n}_us" for n in names)
    listed = f"participant_id, seq, {found}, end_us AS stop_us"
    return (
        q.with_(q.base(opts), q.closed(opts, "valid", "ordered", "val"))
        + f"SELECT {listed} FROM val_found WHERE kind = 'Activity Resumed'"
    )


for _name, _part in (
    ("next_same_app_stop", "same"),
    ("next_other_app_stop", "other"),
    ("next_activity_stopped", "stopped"),
):

    @register(_name, _stops_sql(KEEP, [_part]))
    def _(spark, folder, part=_part):
        return _stops(spark, folder, KEEP, [part])


for _name, _opts in (("resolve_stop_valid", KEEP), ("resolve_stop_minimal", MINIMAL)):

    @register(_name, _stops_sql(_opts, ["same", "other", "stopped"]))
    def _(spark, folder, opts=_opts):
        return _stops(spark, folder, opts, ["same", "other", "stopped"])


def _session_rows(df):
    return df.select(
        "participant_id",
        "seq",
        "interaction_type",
        F.unix_micros("start_timestamp").alias("start_us"),
        F.unix_micros("stop_timestamp").alias("stop_us"),
    )


_SESSION_SQL = "SELECT participant_id, seq, kind AS interaction_type, start_us, stop_us FROM "


def _valid(spark, folder, opts, time="plain"):
    return _session_rows(
        fr.ordered(
            spark,
            folder,
            opts,
            lambda df, ln: sessions.valid_sessions(df, ln, opts),
            time,
        )
    )


for _name, _opts, _time in (
    ("valid_sessions", KEEP, "plain"),
    ("valid_sessions_minimal", MINIMAL, "plain"),
    ("valid_sessions_ties", KEEP, "ties"),
    ("valid_sessions_sliced", StudyOptions(unit=UNIT, **fr.HOT), "plain"),
):

    @register(
        _name,
        q.with_(q.base(_opts, _time), q.closed(_opts, "valid", "ordered", "val"))
        + _SESSION_SQL
        + "val",
    )
    def _(spark, folder, opts=_opts, time=_time):
        return _valid(spark, folder, opts, time)


def _filtered_frame(spark, folder, opts, time="plain"):
    listed = fr.filters(spark, folder)

    def step(df, ln):
        return sessions.filtered_sessions(
            labelling.label_filtered_apps(df, listed), ln, opts
        )

    return fr.ordered(spark, folder, opts, step, time)


def _filtered_ctes(opts, time="plain"):
    return ",\n".join(
        [
            q.base(opts, time),
            q.filters(),
            q.labelled("ordered"),
            q.closed(opts, "filtered", "labelled", "filt"),
        ]
    )


@register("filtered_sessions", q.with_(_filtered_ctes(KEEP)) + _SESSION_SQL + "filt")
def _(spark, folder):
    return _session_rows(_filtered_frame(spark, folder, KEEP))


@register(
    "resolve_stop_filtered",
    q.with_(_filtered_ctes(MINIMAL, "ties"))
    + "SELECT participant_id, seq, end_us AS stop_us FROM filt_found "
    "WHERE kind = 'Filtered App Resumed'",
)
def _(spark, folder):
    rules = sessions.filtered_rules(MINIMAL)
    listed = fr.filters(spark, folder)

    def step(df, lane):
        df = labelling.label_filtered_apps(df, listed)
        df = lane.settle(sessions.same_app_stops(df, lane, rules), "stops")
        return sessions.other_app_stop(df, lane, rules)

    df = fr.ordered(spark, folder, MINIMAL, step, "ties")
    return df.filter(F.col("interaction_type") == rules.resumed).select(
        "participant_id", "seq", sessions.resolve_stop(rules).alias("stop_us")
    )


def _all_sessions(spark, folder, opts, time="plain", then=None):
    listed = fr.filters(spark, folder)

    def step(df, ln):
        df = sessions.sessions(labelling.label_filtered_apps(df, listed), ln, opts)
        return then(df, ln) if then else df

    return fr.ordered(spark, folder, opts, step, time)


def _all_ctes(opts, time="plain"):
    return ",\n".join(
        [
            _filtered_ctes(opts, time),
            q.closed(opts, "valid", "filt", "val", has_times=True),
            q.durations(opts, "val"),
        ]
    )


_SHORT = StudyOptions(unit=UNIT, minimum_usage_seconds=3600)


@register(
    "durations",
    q.with_(_all_ctes(_SHORT))
    + """SELECT participant_id, seq, kind AS interaction_type,
      round(seconds, 6) AS duration_seconds, round(seconds / 60, 6) AS duration_minutes
      FROM timed""",
)
def _(spark, folder):
    return _all_sessions(spark, folder, _SHORT).select(
        "participant_id",
        "seq",
        "interaction_type",
        F.round("duration_seconds", 6).alias("duration_seconds"),
        F.round("duration_minutes", 6).alias("duration_minutes"),
    )


@register(
    "disordered_count",
    q.with_(_all_ctes(KEEP))
    + """SELECT participant_id, count(*) FILTER (start_us > stop_us) AS disordered
      FROM timed GROUP BY 1""",
)
def _(spark, folder):
    return reports.disordered_count(_all_sessions(spark, folder, KEEP), UNIT)


_DETAIL_COLUMNS = {
    scope: [
        f"{scope}_app_new_engage_30s",
        f"{scope}_app_new_engage_custom_{N}s",
        f"{scope}_app_switched_app",
        f"{scope}_app_usage_time_gap_hours",
    ]
    for scope in ("any", "valid")
}


def _details(spark, folder, opts, time, columns):
    df = _all_sessions(
        spark, folder, opts, time, lambda d, ln: engagement.usage_details(d, ln, opts)
    )
    return df.select("participant_id", "seq", "interaction_type", *columns)


def _details_sql(opts, time, columns):
    return (
        q.with_(_all_ctes(opts, time), q.details(opts, "timed"))
        + "SELECT participant_id, seq, kind AS interaction_type, "
        + f"{', '.join(columns)} FROM detailed"
    )


for _name, _opts, _time, _cols in (
    ("any_usage_details", KEEP, "plain", _DETAIL_COLUMNS["any"]),
    ("valid_usage_details", KEEP, "plain", _DETAIL_COLUMNS["valid"]),
    ("usage_details_ties", KEEP, "ties", sum(_DETAIL_COLUMNS.values(), [])),
    (
        "usage_details_sliced",
        StudyOptions(unit=UNIT, **fr.HOT),
        "plain",
        sum(_DETAIL_COLUMNS.values(), []),
    ),
):

    @register(_name, _details_sql(_opts, _time, _cols))
    def _(spark, folder, opts=_opts, time=_time, columns=_cols):
        return _details(spark, folder, opts, time, columns)


@register(
    "first_engagement",
    q.with_(_all_ctes(KEEP, "dense"), q.details(KEEP, "timed"))
    + f"""SELECT participant_id,
      CAST(sum(any_app_new_engage_30s) FILTER (first_any) AS BIGINT) AS first_any_new,
      CAST(sum(valid_app_new_engage_30s) FILTER (first_any) AS BIGINT) AS first_any_valid_new,
      CAST(sum(any_app_new_engage_custom_{N}s) FILTER (first_valid) AS BIGINT) AS first_valid_any_new,
      CAST(sum(valid_app_new_engage_custom_{N}s) FILTER (first_valid) AS BIGINT) AS first_valid_new
      FROM (SELECT *, seq = min(seq) OVER (PARTITION BY participant_id) AS first_any,
        kind = 'App Usage' AND seq = min(CASE WHEN kind = 'App Usage' THEN seq END)
          OVER (PARTITION BY participant_id) AS first_valid
        FROM detailed WHERE kind IN ('App Usage', 'Filtered App Usage')) GROUP BY 1""",
)
def _(spark, folder):
    def step(df, ln):
        df = engagement.previous_usage(df, ln)
        kind = F.col("interaction_type")
        firsts = {
            "first_any": kind.isin(*engagement.USAGE_TYPES["any"])
            & F.col("_any_seen").isNull(),
            "first_valid": (kind == C.APP_USAGE) & F.col("_valid_seen").isNull(),
        }
        df = df.withColumns(firsts).drop("_any_seen", "_any_prev", "_valid_seen", "_valid_prev")
        return engagement.usage_details(df, ln, KEEP)

    df = _all_sessions(spark, folder, KEEP, "dense", step)
    df = df.filter(F.col("interaction_type").isin(*engagement.USAGE_TYPES["any"]))

    def at(first: str, column: str):
        return F.sum(F.when(F.col(first), F.col(column)))

    return df.groupBy("participant_id").agg(
        at("first_any", "any_app_new_engage_30s").alias("first_any_new"),
        at("first_any", "valid_app_new_engage_30s").alias("first_any_valid_new"),
        at("first_valid", f"any_app_new_engage_custom_{N}s").alias("first_valid_any_new"),
        at("first_valid", f"valid_app_new_engage_custom_{N}s").alias("first_valid_new"),
    )


@register(
    "usage_flags",
    q.with_(_all_ctes(KEEP))
    + f"""SELECT participant_id, seq,
      {q.flags(KEEP, "gap", "(seconds / 60)")} AS any_app_usage_flags FROM timed""",
)
def _(spark, folder):
    df = engagement.add_usage_flags(_all_sessions(spark, folder, KEEP), KEEP)
    return df.select(
        "participant_id",
        "seq",
        F.concat_ws("|", "any_app_usage_flags").alias("any_app_usage_flags"),
    )


# --- units and runs ---------------------------------------------------------


@register(
    "device_model",
    q.with_(q.base(KEEP), q.kept(KEEP), q.device("kept"))
    + "SELECT DISTINCT participant_id, possible_device_model FROM device",
)
def _(spark, folder):
    df = fr.ordered(
        spark,
        folder,
        KEEP,
        lambda d, ln: cols.device_model(cols.remove_types(d, KEEP), ln),
    )
    return df.select("participant_id", "possible_device_model").distinct()


@register(
    "unknown_interactions",
    q.with_(q.log(), q.named())
    + f"""SELECT kind AS interaction_type, count(*) AS rows FROM named
      WHERE kind NOT IN {q.in_list(C.MAPPED_TYPES)} GROUP BY 1""",
)
def _(spark, folder):
    df = cols.rename_interaction_types(fr.log(spark, folder))
    return reports.unknown_interaction_counts(df)


@register(
    "unit_participant",
    q.with_(q.log())
    + """SELECT concat('log ', participant_id) AS source_file,
      min(participant_id) AS participant_id FROM log GROUP BY 1""",
)
def _(spark, folder):
    df = fr.log(spark, folder).withColumn(
        "source_file", F.concat(F.lit("log "), "participant_id")
    )
    return reports.unit_participant(df, "source_file")


def _run(spark, folder, opts=FULL, raw=None, keep_stages=False):
    return preprocess(
        fr.text_log(spark, folder) if raw is None else raw,
        opts,
        fr.filters(spark, folder),
        fr.first_codebook(spark, folder),
        RUN_TIME,
        keep_stages,
    )


_REPORT_SQL = q.with_(
    q.full(FULL),
    """report AS (SELECT participant_id, rows_in, CAST(0 AS BIGINT) AS unreadable_times,
      CAST(0 AS BIGINT) AS unusable_zones,
      has_valid, has_filtered, coalesce(rows_kept, 0) AS rows_kept,
      coalesce(missing_ends, 0) AS missing_ends, coalesce(disordered, 0) AS disordered,
      CASE WHEN coalesce(disordered, 0) > 0 THEN 'error' WHEN has_valid THEN 'processed'
        ELSE 'empty' END AS status,
      CASE WHEN coalesce(disordered, 0) > 0 THEN 'Start timestamp later than stop timestamp'
        WHEN NOT has_valid THEN 'No valid app usage data found' END AS message
      FROM (SELECT participant_id, count(*) AS rows_in FROM log GROUP BY 1)
      LEFT JOIN (SELECT participant_id,
          bool_or(kind IN ('Activity Resumed', 'Activity Paused')) AS has_valid,
          bool_or(kind IN ('Filtered App Resumed', 'Filtered App Paused')) AS has_filtered
        FROM labelled GROUP BY 1) USING (participant_id)
      LEFT JOIN (SELECT participant_id, count(*) AS rows_kept,
          count(*) FILTER (kind = 'End of Usage Missing') AS missing_ends,
          count(*) FILTER (start_us > stop_us) AS disordered
        FROM finished GROUP BY 1) USING (participant_id))""",
)


@register("unit_report", _REPORT_SQL + "SELECT * FROM report")
def _(spark, folder):
    return _run(spark, folder, keep_stages=True).report()


# Some devices name a zone that does not exist, some have no readable time.
_USER = "CAST(substring(participant_id, 2) AS INT)"
_NO_TIME, _NO_ZONE = f"{_USER} % 11 = 5", f"{_USER} % 7 = 3"
_BAD_SQL = f"""bad AS (SELECT participant_id, CASE WHEN {_NO_TIME} THEN '{BAD_TIME}'
      WHEN {_NO_ZONE} THEN '{BAD_ZONE}' END AS reason, count(*) AS rows FROM log GROUP BY 1, 2)"""


def _run_with_bad_units(spark, folder):
    raw = fr.text_log(spark, folder).withColumns(
        {
            "event_timestamp": F.expr(f"CASE WHEN {_NO_TIME} THEN 'x' ELSE event_timestamp END"),
            "timezone": F.expr(f"CASE WHEN {_NO_ZONE} THEN 'Mars/Base' ELSE timezone END"),
        }
    )
    return _run(spark, folder, raw=raw, keep_stages=True)


@register(
    "quarantine_reasons",
    q.with_(q.log(), _BAD_SQL) + "SELECT * FROM bad WHERE reason IS NOT NULL",
)
def _(spark, folder):
    rows = _run_with_bad_units(spark, folder).quarantine
    return rows.groupBy("participant_id", "reason").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "unit_report_bad_units",
    q.with_(q.log(), _BAD_SQL)
    + f"""SELECT participant_id, rows AS rows_in, CASE WHEN reason = '{BAD_TIME}' THEN rows
      ELSE 0 END AS unreadable_times, CASE WHEN reason = '{BAD_ZONE}' THEN rows ELSE 0 END
      AS unusable_zones, CAST(0 AS BIGINT) AS rows_kept, CASE WHEN reason = '{BAD_TIME}'
      THEN 'No readable event timestamp' ELSE 'No usable primary time zone' END AS message
      FROM bad WHERE reason IS NOT NULL""",
)
def _(spark, folder):
    report = _run_with_bad_units(spark, folder).report().filter("status = 'error'")
    return report.select(
        "participant_id", "rows_in", "unreadable_times", "unusable_zones", "rows_kept", "message"
    )


@register(
    "unknown_types_of_run",
    q.with_(q.log(), q.named())
    + f"""SELECT kind AS interaction_type, count(*) AS rows FROM named
      WHERE kind NOT IN {q.in_list(C.MAPPED_TYPES)} GROUP BY 1""",
)
def _(spark, folder):
    return _run(spark, folder).unknown_types()


@register(
    "run_summary",
    _REPORT_SQL
    + """SELECT count(*) AS total_units, count(*) FILTER (status = 'processed') AS processed_units,
      count(*) FILTER (status = 'empty') AS empty_units,
      count(*) FILTER (status = 'error') AS failed_units,
      round(100.0 * count(*) FILTER (status = 'processed') / count(*), 6) AS success_percent
      FROM report""",
)
def _(spark, folder):
    df = reports.run_summary(_run(spark, folder, keep_stages=True).report())
    return df.withColumn("success_percent", F.round("success_percent", 6))


# --- whole jobs -------------------------------------------------------------


def _output(df, admin=False):
    """Finished columns in a form both engines hash alike."""
    hidden = [] if admin else ["preprocessor_version", "datetime_of_preprocessing"]
    return df.withColumns(
        {
            "any_app_usage_flags": F.concat_ws("|", "any_app_usage_flags"),
            "duration_seconds": F.round("duration_seconds", 6),
            "duration_minutes": F.round("duration_minutes", 6),
            "date": F.col("date").cast("string"),
        }
    ).drop(*hidden)


def _full_sql(opts):
    return (
        q.with_(q.full(opts))
        + "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM "
        + f"(SELECT {q.finished_output(opts)} FROM finished)"
    )


@register("preprocess_full", _full_sql(FULL))
def _(spark, folder):
    return _output(finished_table(_run(spark, folder), FULL))


@register("preprocess_full_sliced", _full_sql(FULL))
def _(spark, folder):
    opts = fr.options(**fr.HOT)
    return _output(finished_table(_run(spark, folder, opts), opts))


@register(
    "format_timestamps",
    q.with_(q.full(FULL))
    + f"""SELECT file_order, event_timestamp, start_timestamp, stop_timestamp FROM
      (SELECT file_order, {q.finished_output(FULL)} FROM finished)""",
)
def _(spark, folder):
    df = cols.format_timestamps(_run(spark, folder).rows)
    return df.select(
        "file_order", "event_timestamp", "start_timestamp", "stop_timestamp"
    )


@register(
    "project_output",
    q.with_(q.full(FULL))
    + f"""SELECT * REPLACE (CAST(date AS VARCHAR) AS date), '{__version__}' AS preprocessor_version,
      '02-01-2024 00:00:00' AS datetime_of_preprocessing FROM
      (SELECT {q.finished_output(FULL)} FROM finished)""",
)
def _(spark, folder):
    return _output(finished_table(_run(spark, folder), FULL), admin=True)


def _typed(spark, folder, opts=FULL):
    """A stored finished table, which is what the plot tables are made from."""
    table = materialise(finished_table(_run(spark, folder, opts), opts), "finished")
    return logs.finished_types(table)


_SEGMENT_SQL = f"""bounds AS (SELECT participant_id, min(CAST(local_ts AS DATE)) AS first_date,
    max(CAST(local_ts AS DATE)) AS last_date FROM finished GROUP BY 1),
  bars AS (SELECT f.*, b.*, unnest(range(0, 1 + date_diff('day', CAST(start_local AS DATE),
      least(CAST(stop_local AS DATE), b.last_date)))) AS day_no
    FROM finished f JOIN bounds b ON b.participant_id = f.participant_id
    WHERE kind IN ('App Usage', 'Filtered App Usage') AND stop_local IS NOT NULL),
  sized AS (SELECT *, CAST(start_local AS DATE) + CAST(day_no AS INT) AS day,
      date_diff('day', CAST(start_local AS DATE), CAST(stop_local AS DATE)) AS days,
      {q.hours("start_local")} AS start_h, {q.hours("stop_local")} AS stop_h FROM bars)"""
_PLOT = fr.options(plot_filtered_usage=True, removed_types=())


@register(
    "daily_usage_segments",
    q.with_(q.full(_PLOT), _SEGMENT_SQL)
    + f"""SELECT participant_id, CAST(day AS VARCHAR) AS segment_date,
      round(CASE WHEN day_no = 0 THEN start_h ELSE 0.0 END, 6) AS left_hours,
      round(CASE WHEN day_no = 0 THEN
          least(24 - start_h, epoch_us(stop_local - start_local) / 1e6 / 3600)
        WHEN day_no = days THEN stop_h ELSE 24.0 END, 6) AS width_hours,
      coalesce(category, 'Uncategorised') AS broad_app_category,
      coalesce(MAP {{ {", ".join(f"'{a}': '{b}'" for a, b in C.CATEGORY_COLOURS.items())} }}[
        coalesce(category, 'Uncategorised')], '#000000') AS colour FROM sized""",
)
def _(spark, folder):
    typed = _typed(spark, folder, _PLOT)
    book = fr.first_codebook(spark, folder)
    bars = plot_tables(typed, book, _PLOT, UNIT)["usage"]
    return bars.select(
        "participant_id",
        F.col("segment_date").cast("string").alias("segment_date"),
        F.round("left_hours", 6).alias("left_hours"),
        F.round("width_hours", 6).alias("width_hours"),
        "broad_app_category",
        "colour",
    )


@register(
    "event_markers",
    q.with_(q.full(_PLOT))
    + f"""SELECT participant_id, CAST(CAST(local_ts AS DATE) AS VARCHAR) AS date,
      kind AS interaction_type, round({q.hours("local_ts")}, 6) AS event_hours,
      CASE kind WHEN 'Device Shutdown' THEN 'red' WHEN 'Device Startup' THEN 'green'
        ELSE 'gray' END AS colour FROM finished
      WHERE kind IN ('Device Shutdown', 'Device Startup', 'End of Usage Missing')""",
)
def _(spark, folder):
    return timeline.event_markers(_typed(spark, folder, _PLOT)).select(
        "participant_id",
        F.col("date").cast("string").alias("date"),
        "interaction_type",
        F.round("event_hours", 6).alias("event_hours"),
        "colour",
    )


@register(
    "date_spine",
    q.with_(q.full(_PLOT), _SEGMENT_SQL)
    + """SELECT participant_id, CAST(CAST(unnest(generate_series(first_date, last_date,
      INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date FROM bounds""",
)
def _(spark, folder):
    spine = timeline.date_spine(_typed(spark, folder, _PLOT), UNIT)
    return spine.withColumn("date", F.col("date").cast("string"))


@register(
    "gap_segments",
    q.with_(q.full(_PLOT), _SEGMENT_SQL)
    + f""", holes AS (SELECT f.participant_id, first_date, CAST(local_ts AS DATE) AS day, gap,
        {q.hours("local_ts")} AS h FROM finished f JOIN bounds b
        ON b.participant_id = f.participant_id WHERE gap > 0),
      spans AS (SELECT *, CASE WHEN gap - h > 0 THEN CAST(floor((gap - h) / 24) AS INT)
        ELSE 0 END AS full_days, CASE WHEN gap - h > 0
        THEN (gap - h) - 24 * floor((gap - h) / 24) ELSE 0 END AS remaining FROM holes),
      pieces AS (SELECT participant_id, first_date, day, 0.0 AS left_hours, h AS width_hours
          FROM spans
        UNION ALL SELECT participant_id, first_date, day - CAST(k AS INT), 0.0, 24.0 FROM
          (SELECT *, unnest(range(1, full_days + 1)) AS k FROM spans)
        UNION ALL SELECT participant_id, first_date, day - (full_days + 1), 24 - remaining,
          remaining FROM spans WHERE remaining > 0)
      SELECT participant_id, CAST(day AS VARCHAR) AS segment_date,
        round(left_hours, 6) AS left_hours, round(width_hours, 6) AS width_hours
      FROM pieces WHERE day >= first_date""",
)
def _(spark, folder):
    bars = plot_tables(_typed(spark, folder, _PLOT), None, _PLOT, UNIT)["gaps"]
    return bars.select(
        "participant_id",
        F.col("segment_date").cast("string").alias("segment_date"),
        F.round("left_hours", 6).alias("left_hours"),
        F.round("width_hours", 6).alias("width_hours"),
    )


_CHILD = fr.options(plot_filtered_usage=True, plot_target_child_only=True)


@register(
    "plot_usage",
    q.with_(_all_ctes(KEEP))
    + """SELECT participant_id, seq, kind AS interaction_type, username FROM timed
      WHERE kind IN ('App Usage', 'Filtered App Usage') AND username = 'Target Child'""",
)
def _(spark, folder):
    df = timeline.select_plot_usage(_all_sessions(spark, folder, KEEP), _CHILD)
    return df.select("participant_id", "seq", "interaction_type", "username")


# --- files ------------------------------------------------------------------


def _write_logs(spark, folder, name=None) -> str:
    """The log as one CSV folder per participant."""
    path = scratch_folder(spark, "raw-logs")
    device = name if name is not None else F.concat(F.lit("Raw "), "participant_id")
    df = fr.text_log(spark, folder).withColumn("device", device)
    df = df.repartition("device").sortWithinPartitions("device", "file_order")
    sinks.write_folders(df.drop("file_order"), path, "device", "csv", header=True)
    return path


def _line_numbers(df):
    lines = Window.partitionBy("source_file").orderBy("file_order")
    return df.withColumn("line_no", F.row_number().over(lines).cast("long"))


@register(
    "scan_raw",
    q.with_(q.log())
    + """SELECT study_id, participant_id, username, app_package_name, application_label,
      interaction_type, concat(CAST(ts AS VARCHAR), 'Z') AS event_timestamp, timezone,
      row_number() OVER (PARTITION BY participant_id ORDER BY file_order) AS line_no
      FROM log""",
)
def _(spark, folder):
    path = _write_logs(spark, folder)
    return _line_numbers(logs.scan_raw(spark, path)).select(*logs.RAW_COLUMNS, "line_no")


_CELLS = [c for c in logs.RAW_COLUMNS if c not in ("study_id", "event_timestamp")]
_TEXT_TIME = "concat(CAST(ts AS VARCHAR), 'Z') AS event_timestamp"


def _write_mixed(spark, folder) -> str:
    """The log in several layouts, beside files that are no logs: every third device in
    another order and with names that differ in case only, one file without a header, one
    with nothing but a header, and one of another kind.
    """
    path = scratch_folder(spark, "mixed-logs")
    df = fr.text_log(spark, folder).withColumn("device", F.concat(F.lit("Raw "), UNIT))
    df = df.withColumn("Note", F.concat(F.lit("n"), F.col("file_order").cast("string")))
    third = F.expr("CAST(substr(participant_id, 2) AS INT) % 3")
    kept = df.repartition("device").sortWithinPartitions("device", "file_order")
    plain = kept.select("device", *logs.RAW_COLUMNS, "Note").where(third != 0)
    turned = kept.where(third == 0).select(
        "event_timestamp",
        F.col("Note").alias("note"),
        *reversed(_CELLS),
        F.lit("x").alias("NOTE_2"),
        "device",
    )
    sinks.write_folders(plain, f"{path}/one", "device", "csv", header=True)
    sinks.write_folders(turned, f"{path}/two", "device", "csv", header=True)
    lines = kept.limit(3).select(F.concat_ws(",", *logs.RAW_COLUMNS).alias("value"))
    lines.write.text(f"{path}/headerless")
    empty = F.lit(",".join(logs.RAW_COLUMNS)).alias("value")
    spark.range(1).select(empty).coalesce(1).write.text(f"{path}/empty")
    spark.range(2).select(F.lit("a,b").alias("value")).coalesce(1).write.text(f"{path}/other")
    return path


@register(
    "scan_raw_mixed",
    q.with_(q.log())
    + f"""SELECT CASE WHEN user_no % 3 <> 0 THEN study_id END AS study_id, {", ".join(_CELLS)},
      {_TEXT_TIME}, concat('n', CAST(file_order AS VARCHAR)) AS note,
      row_number() OVER (PARTITION BY participant_id ORDER BY file_order) AS line_no
      FROM (SELECT *, CAST(substr(participant_id, 2) AS INT) AS user_no FROM log)""",
)
def _(spark, folder):
    path = _write_mixed(spark, folder)
    df = logs.scan_raw(spark, path, r"part-.*\.(csv|txt)$")
    # Names that differ in case only are columns of their own.
    note = F.coalesce("Note", "note_3")
    return _line_numbers(df).select(*logs.RAW_COLUMNS, note.alias("note"), "line_no")


_RAGGED = "file_order % 11 = 4"


def _write_ragged(spark, folder) -> str:
    """The log as text lines, where some labels have a comma without quotes."""
    path = scratch_folder(spark, "ragged-logs")
    df = fr.text_log(spark, folder).withColumn("device", F.concat(F.lit("Raw "), UNIT))
    label = F.expr(f"CASE WHEN {_RAGGED} THEN concat(application_label, ', Inc') ELSE '\"a, b\"' END")
    df = df.withColumn("application_label", label).withColumn("is_head", F.lit(False))
    cells = F.array_join(F.array(*logs.RAW_COLUMNS), ",", "")
    lines = df.select("device", cells.alias("value"), "file_order")
    head = lines.select("device").distinct().withColumns(
        {"value": F.lit(",".join(logs.RAW_COLUMNS)), "file_order": F.lit(-1).cast("long")}
    )
    rows = lines.withColumn("file_order", F.col("file_order").cast("long")).unionByName(head)
    rows = rows.repartition("device").sortWithinPartitions("device", "file_order")
    sinks.write_folders(rows.drop("file_order"), path, "device", "text")
    return path


@register(
    "quarantine_ragged",
    q.with_(q.log())
    + f"""SELECT participant_id, CASE WHEN {_RAGGED} THEN '{BAD_ROW}' ELSE 'read' END AS reason,
      count(*) AS rows FROM log GROUP BY 1, 2""",
)
def _(spark, folder):
    path = _write_ragged(spark, folder)
    raw = materialise(logs.scan_raw(spark, path, r"\.txt$"), "ragged")
    nothing = StudyOptions(removed_types=(), timezone_mode=TimezoneMode.CONVERT_TO_PRIMARY)
    result = preprocess(raw, nothing, run_time=RUN_TIME)
    device = F.regexp_extract("source_file", "Raw (P[0-9]+)", 1).alias("participant_id")
    read = result.raw.filter("NOT ts_error").select(device, F.lit("read").alias("reason"))
    gone = result.quarantine.select(device, "reason")
    return read.unionByName(gone).groupBy("participant_id", "reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


@register(
    "select_files",
    q.with_(q.log())
    + """SELECT participant_id, count(*) AS rows FROM log
      WHERE username <> 'Other' GROUP BY 1""",
)
def _(spark, folder):
    shelf = F.when(F.col("username") == "Other", "Archive ").otherwise("Raw ")
    path = _write_logs(spark, folder, F.concat(shelf, "participant_id"))
    df = logs.scan_raw(spark, path)
    return df.groupBy("participant_id").agg(F.count(F.lit(1)).alias("rows"))


def _read_back(spark, path, step=lambda df: df):
    """Rows of a folder that the writer made, with the names of their own folders."""
    schema = None

    def read(paths):
        nonlocal schema
        reader = spark.read.option("header", True).option("escape", '"').option("basePath", path)
        rows = (reader if schema is None else reader.schema(schema)).csv(paths)
        schema = rows.schema
        return step(rows)

    return read_in_batches(spark, path, "back", read)


def _written(spark, folder):
    path = scratch_folder(spark, "finished")
    table = finished_table(_run(spark, folder), FULL, keep_seq=True)
    sinks.write_preprocessed(table, path, UNIT, "csv")
    return path


@register(
    "write_roundtrip",
    q.with_(q.full(FULL))
    + f"""SELECT concat(participant_id, ' Automatically Preprocessed') AS output_name,
      event_timestamp, app_package_name, interaction_type, start_timestamp, stop_timestamp,
      data_time_gap_hours, duration_seconds, CASE WHEN any_app_usage_flags = '' THEN '[]'
        ELSE concat('[''', replace(any_app_usage_flags, '|', ''', '''), ''']') END
        AS any_app_usage_flags FROM (SELECT {q.finished_output(FULL)} FROM finished)""",
)
def _(spark, folder):
    back = _read_back(spark, _written(spark, folder))
    return back.select(
        "output_name",
        "event_timestamp",
        "app_package_name",
        "interaction_type",
        "start_timestamp",
        "stop_timestamp",
        F.col("data_time_gap_hours").cast("double").alias("data_time_gap_hours"),
        F.round(F.col("duration_seconds").cast("double"), 6).alias("duration_seconds"),
        "any_app_usage_flags",
    )


_FILES = fr.options(unit="source_file")


@register(
    "rerun_changed_units",
    q.with_(q.full(FULL))
    + f"""SELECT participant_id, event_timestamp, app_package_name, interaction_type,
      start_timestamp, stop_timestamp, data_time_gap_hours, duration_seconds
      FROM (SELECT {q.finished_output(FULL)} FROM finished)""",
)
def _(spark, folder):
    """A folder that files are added to, replaced in and taken from, run after each change."""
    path, out = scratch_folder(spark, "rerun-logs"), scratch_folder(spark, "rerun-results")
    df = fr.text_log(spark, folder).withColumn("output_name", F.concat(F.lit("Raw "), UNIT))
    user = "CAST(substr(participant_id, 2) AS INT)"
    later = f"{user} % 7 = 3"
    half = f"{user} % 5 = 1 AND file_order % 2 = 1"
    gone = df.where(f"{user} % 11 = 2").withColumn("output_name", F.lit("Raw gone"))

    def put(rows):
        rows = rows.repartition("output_name").sortWithinPartitions("output_name", "file_order")
        rows = rows.drop("file_order")
        sinks.write_folders(rows, path, "output_name", "csv", "overwrite", header=True)

    def run():
        dimensions = fr.filters(spark, folder), fr.first_codebook(spark, folder)
        return preprocess_folder(spark, path, out, _FILES, *dimensions, RUN_TIME, "csv")

    put(df.where(f"NOT ({later}) AND NOT ({half})").unionByName(gone))
    run()
    put(df.where(f"({later}) OR {user} % 5 = 1"))
    sinks.delete_units(gone, path)
    run()
    return _read_back(spark, out).select(
        "participant_id",
        "event_timestamp",
        "app_package_name",
        "interaction_type",
        "start_timestamp",
        "stop_timestamp",
        F.col("data_time_gap_hours").cast("double").alias("data_time_gap_hours"),
        F.round(F.col("duration_seconds").cast("double"), 6).alias("duration_seconds"),
    )


@register(
    "categorised_roundtrip",
    q.with_(q.full(FULL))
    + f"""SELECT concat(CASE WHEN participant_id IN ('P1', 'P2') THEN 'log' ELSE participant_id END,
        ' Automatically Preprocessed_with_categories') AS name,
      count(DISTINCT participant_id) AS folders, count(*) AS rows,
      count(*) FILTER (broad_app_category = 'Unknown') AS without, CAST(0 AS BIGINT) AS out_of_order
      FROM finished GROUP BY 1""",
)
def _(spark, folder):
    """Two units with the same stem, in different folders, keep folders of their own."""
    rows = materialise(finished_table(_run(spark, folder), FULL, keep_seq=True), "finished")
    rows = rows.drop("broad_app_category")
    same = F.col(UNIT).isin("P1", "P2")
    stem = F.when(same, F.concat(UNIT, F.lit("/log"))).otherwise(F.concat(F.lit("x/"), UNIT))
    path = F.concat(stem, F.lit(" Automatically Preprocessed.csv"))
    rows = rows.withColumns({"source_file": path, "number": F.col(C.SEQ)})
    mapped, _ = categorise(rows, fr.first_codebook(spark, folder))
    out = scratch_folder(spark, "categorised")
    sinks.write_categorised(mapped, out, order=C.SEQ)
    row, file = F.monotonically_increasing_id(), F.input_file_name()
    back = _read_back(spark, out, lambda df: df.withColumns({"row": row, "file": file}))
    of_file = Window.partitionBy("file").orderBy("row")
    back = back.withColumn("before", F.lag(F.col("number").cast("long")).over(of_file))
    name = F.regexp_replace("output_name", " [0-9a-f]{16}$", "").alias("name")
    return back.groupBy(name).agg(
        F.count_distinct("output_name").alias("folders"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("broad_app_category") == "Unknown").alias("without"),
        F.count_if(F.col("before") >= F.col("number").cast("long")).alias("out_of_order"),
    )


@register(
    "scan_preprocessed",
    q.with_(q.full(FULL))
    + """SELECT app AS app_package_name, CAST(CAST(local_ts AS DATE) AS VARCHAR) AS date,
      strftime(start_local, '%Y-%m-%d %H:%M:%S') AS start_local,
      strftime(stop_local, '%Y-%m-%d %H:%M:%S') AS stop_local,
      strftime(local_ts, '%Y-%m-%d %H:%M:%S.%f') AS event_local FROM finished""",
)
def _(spark, folder):
    df = logs.scan_preprocessed(spark, _written(spark, folder))
    seconds = "yyyy-MM-dd HH:mm:ss"
    return df.select(
        "app_package_name",
        F.col("date").cast("string").alias("date"),
        F.date_format("start_local", seconds).alias("start_local"),
        F.date_format("stop_local", seconds).alias("stop_local"),
        F.date_format("event_local", f"{seconds}.SSSSSS").alias("event_local"),
    )

