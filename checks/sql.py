"""Pieces of the checking SQL (DuckDB), formulated without running windows
over stops: every stop is the minimum of an explicit search."""

from __future__ import annotations

from checks import frames as fr
from usageweave import constants as C
from usageweave.config import StudyOptions


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def rename_case(column: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.RAW_INTERACTION_NAMES.items())
    return f"CASE {column} {cases} ELSE {column} END"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def log(time: str = "plain") -> str:
    listed = ", ".join(fr.columns(fr.LOG_COLUMNS))
    return (
        f"log AS (SELECT {listed}, {fr.TIMES[time]} AS ts "
        f"FROM (SELECT *, {fr.K} AS k FROM events) e)"
    )


def named(source: str = "log") -> str:
    return f"""named AS (SELECT file_order, participant_id, study_id, username,
      {rename_case("interaction_type")} AS kind, app_package_name AS app,
      application_label AS label, ts, epoch_us(ts) AS raw, timezone FROM {source})"""


def ordered(opts: StudyOptions) -> str:
    stops = in_list(sorted({*opts.same_app_stops, *opts.other_app_stops}))
    return f"""ranked AS (SELECT *,
      CASE WHEN kind = 'Activity Resumed' THEN 0 WHEN kind IN {stops} THEN 2
        WHEN kind IN {in_list(C.KNOWN_TYPES)} THEN 1 ELSE 3 END AS prio FROM named),
    tied AS (SELECT *, count(*) OVER (PARTITION BY participant_id, raw) AS n,
      row_number() OVER (PARTITION BY participant_id, raw ORDER BY prio, file_order) AS i
      FROM ranked),
    seqd AS (SELECT *, raw - CASE WHEN n > 1 THEN i ELSE 0 END AS us,
      row_number() OVER (PARTITION BY participant_id ORDER BY raw, i DESC) AS seq
      FROM tied),
    ordered AS (SELECT *, coalesce((200 * (us - lag(us) OVER
        (PARTITION BY participant_id ORDER BY seq)) + 3600000000) // 7200000000, 0)
        / 100.0 AS gap FROM seqd)"""


def base(opts: StudyOptions, time: str = "plain") -> str:
    return ",\n".join([log(time), named(), ordered(opts)])


def kept(opts: StudyOptions, source: str = "ordered", name: str = "kept") -> str:
    test = f"kind NOT IN {in_list(opts.removed_types)}" if opts.removed_types else "true"
    return f"{name} AS (SELECT * FROM {source} WHERE {test} OR gap > 0)"


def closed(
    opts: StudyOptions, kind: str, source: str, name: str, has_times: bool = False
) -> str:
    """Searches of every resume, then the resolved sessions."""
    if kind == "valid":
        resumed, paused, stopped = (
            "Activity Resumed", "Activity Paused", "Activity Stopped",
        )
        usage, same = "App Usage", opts.same_app_stops
        single, missing_start = "z.us", "NULL"
    else:
        resumed, paused, stopped = (
            "Filtered App Resumed", "Filtered App Paused", "Filtered App Stopped",
        )
        usage, same = "Filtered App Usage", opts.filtered_same_app_stops
        single, missing_start = "short", "r.us"
    found = f"{name}_found"
    start = "r.start_us" if has_times else "NULL"
    stop = "r.stop_us" if has_times else "NULL"
    keep = [
        "file_order", "participant_id", "study_id", "username", "app", "label",
        "ts", "raw", "timezone", "us", "seq", "gap",
    ]
    listed = ", ".join(f"r.{c}" for c in keep)
    later = "s.participant_id = r.participant_id AND s.seq > r.seq"
    return f"""{name}_hits AS (SELECT r.participant_id, r.seq,
        min(CASE WHEN s.app = r.app AND s.kind IN {in_list(same)} THEN s.seq END) AS same_seq,
        min(CASE WHEN (s.app = r.app) IS NOT TRUE
          AND s.kind IN {in_list(opts.other_app_stops)} THEN s.seq END) AS other_seq,
        min(CASE WHEN s.app = r.app AND s.kind = '{stopped}' THEN s.seq END) AS stopped_seq
      FROM {source} r JOIN {source} s ON {later}
      WHERE r.kind = '{resumed}' GROUP BY ALL),
    {found} AS (SELECT r.*, h.same_seq, h.other_seq, h.stopped_seq,
        a.us AS same_us, b.us AS other_us, z.us AS stopped_us,
        CASE WHEN z.us - r.us < {C.LONG_USAGE_MICROS} THEN z.us END AS short,
        CASE WHEN a.raw <= b.raw THEN a.us ELSE b.us END AS first_us,
        CASE WHEN r.kind <> '{resumed}' THEN NULL
          WHEN a.us IS NOT NULL AND b.us IS NOT NULL THEN
            CASE WHEN first_us - r.us < {C.LONG_USAGE_MICROS} THEN first_us ELSE short END
          ELSE {single} END AS end_us
      FROM {source} r
      LEFT JOIN {name}_hits h ON h.participant_id = r.participant_id AND h.seq = r.seq
      LEFT JOIN {source} a ON a.participant_id = r.participant_id AND a.seq = h.same_seq
      LEFT JOIN {source} b ON b.participant_id = r.participant_id AND b.seq = h.other_seq
      LEFT JOIN {source} z ON z.participant_id = r.participant_id AND z.seq = h.stopped_seq),
    {name} AS (SELECT {listed},
        CASE WHEN r.kind = '{resumed}' THEN CASE WHEN r.end_us IS NOT NULL
          THEN '{usage}' ELSE 'End of Usage Missing' END ELSE r.kind END AS kind,
        CASE WHEN r.kind = '{resumed}' THEN CASE WHEN r.end_us IS NOT NULL
          THEN r.us ELSE {missing_start} END ELSE {start} END AS start_us,
        CASE WHEN r.kind = '{resumed}' THEN r.end_us ELSE {stop} END AS stop_us
      FROM {found} r WHERE r.kind <> '{paused}')"""


def durations(opts: StudyOptions, source: str, name: str = "timed") -> str:
    seconds = "(stop_us - start_us) / 1e6"
    return f"""{name} AS (SELECT *, CASE WHEN kind = 'App Usage'
        AND {seconds} >= {opts.minimum_usage_seconds} THEN {seconds} END AS seconds
      FROM {source})"""


def details(opts: StudyOptions, source: str, name: str = "detailed") -> str:
    """Previous usages by explicit search for the latest earlier one."""
    n = opts.custom_engagement_seconds
    out = []
    for scope, kinds in (
        ("valid", "('App Usage')"),
        ("any", "('App Usage', 'Filtered App Usage')"),
    ):
        member = f"r.kind IN {kinds}"
        opens = (
            "fv.seq = r.seq"
            if scope == "valid"
            else "fa.seq = r.seq AND r.kind <> 'App Usage'"
        )
        compared = (
            "r.kind IN ('App Usage', 'Filtered App Usage') "
            "AND fa.seq <> r.seq AND coalesce(fv.seq <> r.seq, true)"
        )
        p = f"{scope[0]}p"
        secs = f"CASE WHEN {compared} THEN (r.start_us - {p}.stop_us) / 1e6 END"
        for test, label in (("30", "30s"), (str(n), f"custom_{n}s")):
            out.append(
                f"CASE WHEN {member} THEN CASE WHEN {opens} THEN 1 "
                f"WHEN {secs} > {test} THEN 1 ELSE 0 END END "
                f"AS {scope}_app_new_engage_{label}"
            )
        out.append(
            f"CASE WHEN {member} THEN CASE WHEN {secs} IS NOT NULL AND "
            f"(r.app = {p}.app) IS NOT TRUE THEN 1 ELSE 0 END END "
            f"AS {scope}_app_switched_app"
        )
        out.append(
            f"CASE WHEN {member} THEN CAST(coalesce(floor({secs} / 3600), 0) AS DOUBLE) "
            f"END AS {scope}_app_usage_time_gap_hours"
        )

    def prev(scope: str, kinds: str) -> str:
        return f"""{name}_{scope} AS (SELECT r.participant_id, r.seq, max(s.seq) AS prev_seq
        FROM {source} r JOIN {source} s ON s.participant_id = r.participant_id
          AND s.seq < r.seq AND s.kind IN {kinds} AND s.stop_us IS NOT NULL GROUP BY ALL)"""

    def first(scope: str, kinds: str) -> str:
        return f"""{name}_first_{scope} AS (SELECT participant_id, min(seq) AS seq
        FROM {source} WHERE kind IN {kinds} GROUP BY ALL)"""

    any_kinds, valid_kinds = "('App Usage', 'Filtered App Usage')", "('App Usage')"
    unit = "participant_id"
    return f"""{prev("any", any_kinds)}, {prev("valid", valid_kinds)},
    {first("any", any_kinds)}, {first("valid", valid_kinds)},
    {name} AS (SELECT r.*, {", ".join(out)}
      FROM {source} r
      LEFT JOIN {name}_any ai ON ai.{unit} = r.{unit} AND ai.seq = r.seq
      LEFT JOIN {source} ap ON ap.{unit} = r.{unit} AND ap.seq = ai.prev_seq
      LEFT JOIN {name}_valid vi ON vi.{unit} = r.{unit} AND vi.seq = r.seq
      LEFT JOIN {source} vp ON vp.{unit} = r.{unit} AND vp.seq = vi.prev_seq
      LEFT JOIN {name}_first_any fa ON fa.{unit} = r.{unit}
      LEFT JOIN {name}_first_valid fv ON fv.{unit} = r.{unit})"""


def flags(opts: StudyOptions, gap: str, minutes: str) -> str:
    def chain(value: str, thresholds, label: str) -> str:
        cases = " ".join(
            f"WHEN {value} >= {t} THEN '>{t}-HR {label}'"
            for t in sorted(thresholds, reverse=True)
        )
        return f"CASE {cases} END"

    gap_flag = chain(gap, opts.gap_thresholds_hours, "TIME GAP")
    usage_flag = chain(f"({minutes} / 60)", opts.usage_thresholds_hours, "APP USAGE")
    return f"concat_ws('|', {gap_flag}, {usage_flag})"


def codebook_rows() -> str:
    listed = ", ".join(fr.columns(fr.CODEBOOK_COLUMNS))
    return f"cb_rows AS (SELECT {listed} FROM part)"


def first_codebook() -> str:
    return f"""{codebook_rows()},
    cb AS (SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER
      (PARTITION BY app_package_name ORDER BY row_no) AS pos FROM cb_rows) WHERE pos = 1)"""


def filters() -> str:
    listed = ", ".join(fr.columns(fr.FILTER_COLUMNS))
    return f"""filter_rows AS (SELECT {listed} FROM part),
    filters AS (SELECT app_package_name, list_transform(string_split(label, ','),
        lambda x: trim(x)) AS labels FROM (SELECT trim(package_name) AS app_package_name,
        coalesce(trim(app_label), 'nan') AS label, row_number() OVER
        (PARTITION BY trim(package_name) ORDER BY row_no DESC) AS pos FROM filter_rows
        WHERE trim(package_name) <> '' AND lower(trim(package_name)) <> 'nan')
      WHERE pos = 1)"""


def labelled(source: str, name: str = "labelled") -> str:
    return f"""{name} AS (SELECT r.* REPLACE (CASE
        WHEN coalesce(list_contains(f.labels, r.label), false) THEN CASE r.kind
          WHEN 'Activity Resumed' THEN 'Filtered App Resumed'
          WHEN 'Activity Paused' THEN 'Filtered App Paused'
          WHEN 'Activity Stopped' THEN 'Filtered App Stopped'
          WHEN 'Activity Destroyed' THEN 'Filtered App Destroyed'
          ELSE r.kind END ELSE r.kind END AS kind)
      FROM {source} r LEFT JOIN filters f ON f.app_package_name = r.app)"""


def primary(source: str = "log", name: str = "primary_tz") -> str:
    """Modal zone, ties to the one seen first, UTC without any."""
    return f"""{name} AS (SELECT participant_id, coalesce(max(zone), 'UTC') AS zone FROM
      (SELECT participant_id, timezone AS zone, row_number() OVER (PARTITION BY participant_id
          ORDER BY timezone IS NULL, count(*) DESC, min(file_order)) AS pos
        FROM {source} GROUP BY participant_id, timezone) WHERE pos = 1 GROUP BY 1)"""


def local(us: str, zone: str) -> str:
    return f"((make_timestamp({us}) AT TIME ZONE 'UTC') AT TIME ZONE {zone})"


def calendar(local_time: str) -> str:
    dow = f"dayofweek({local_time})"
    return f"""CAST({local_time} AS DATE) AS date, CAST({dow} + 1 AS INT) AS day,
      CAST({dow} BETWEEN 1 AND 5 AS INT) AS "weekdayMF",
      CAST({dow} BETWEEN 1 AND 4 AS INT) AS "weekdayMTh",
      CAST({dow} BETWEEN 0 AND 4 AS INT) AS "weekdaySuTh",
      CAST(hour({local_time}) AS INT) AS hour, CAST(quarter({local_time}) AS INT) AS quarter"""


def device(source: str, name: str = "device") -> str:
    tests = " OR ".join(f"contains(app, '{p}')" for p in C.TABLET_PACKAGES)
    return f"""{name} AS (SELECT participant_id, CASE WHEN coalesce(bool_or({tests}), false)
      THEN 'Amazon Fire' ELSE 'Android' END AS possible_device_model
      FROM {source} GROUP BY 1)"""


def hours(t: str) -> str:
    return f"(hour({t}) + minute({t}) / 60 + floor(second({t})) / 3600)"


def full(opts: StudyOptions) -> str:
    """Every step of the whole job, ending in ``finished``."""
    return ",\n".join(
        [
            log(),
            primary(),
            "zoned AS (SELECT l.* REPLACE (p.zone AS timezone) FROM log l "
            "JOIN primary_tz p USING (participant_id))",
            named("zoned"),
            ordered(opts),
            kept(opts),
            device("kept"),
            filters(),
            first_codebook(),
            labelled("kept"),
            closed(opts, "filtered", "labelled", "filt"),
            closed(opts, "valid", "filt", "val", has_times=True),
            durations(opts, "val"),
            details(opts, "timed"),
            kept(opts, "detailed", "rest"),
            f"""finished AS (SELECT r.*, d.possible_device_model,
              coalesce(c.broad_app_category, 'Unknown') AS broad_app_category,
              coalesce(c."genreId", 'Unknown') AS genre, c.broad_app_category AS category,
              {local("r.us", "r.timezone")} AS local_ts,
              date_trunc('second', {local("r.start_us", "r.timezone")}) AS start_local,
              date_trunc('second', {local("r.stop_us", "r.timezone")}) AS stop_local
              FROM rest r JOIN device d USING (participant_id)
              LEFT JOIN cb c ON c.app_package_name = r.app)""",
        ]
    )


STAMP = "'%m-%d-%Y %H:%M:%S'"


def finished_output(opts: StudyOptions) -> str:
    """Output columns of ``finished`` (flags as text)."""
    n = opts.custom_engagement_seconds
    detail = ", ".join(
        f"{s}_app_{c}"
        for s in ("valid", "any")
        for c in (
            "new_engage_30s",
            f"new_engage_custom_{n}s",
            "switched_app",
            "usage_time_gap_hours",
        )
    )
    offset = "CAST((epoch_us(local_ts) - us) / 60000000 AS INT)"
    text = (
        "concat(strftime(local_ts, '%Y-%m-%d %H:%M:%S.%f'), "
        f"CASE WHEN {offset} < 0 THEN '-' ELSE '+' END, "
        f"lpad(CAST(abs({offset}) // 60 AS VARCHAR), 2, '0'), ':', "
        f"lpad(CAST(abs({offset}) % 60 AS VARCHAR), 2, '0'))"
    )
    return f"""study_id, participant_id, possible_device_model, username,
      {text} AS event_timestamp, {calendar("local_ts")}, timezone,
      app AS app_package_name, label AS application_label, broad_app_category,
      genre AS "genreId_scraped", kind AS interaction_type,
      strftime(start_local, {STAMP}) AS start_timestamp,
      strftime(stop_local, {STAMP}) AS stop_timestamp,
      round(seconds, 6) AS duration_seconds, round(seconds / 60, 6) AS duration_minutes,
      {flags(opts, "gap", "(seconds / 60)")} AS any_app_usage_flags,
      gap AS data_time_gap_hours, {detail}"""
