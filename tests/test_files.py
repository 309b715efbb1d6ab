"""Messy files in, finished files out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usageweave import StudyOptions, TimezoneMode
from usageweave.operators import reports
from usageweave.operators.storage import materialise
from usageweave.plans.jobs import plot_tables
from usageweave.plans.preprocess import finished_table, preprocess
from usageweave.plans.rerun import preprocess_folder
from usageweave.sources import dimensions, files, logs, sinks

HEAD = (
    "study_id,participant_id,username,app_package_name,application_label,"
    "interaction_type,event_timestamp,timezone"
)
OPTIONS = StudyOptions(timezone_mode=TimezoneMode.CONVERT_TO_PRIMARY)


def row(kind, stamp, app="a.b", label="AB", zone="America/Chicago"):
    return f"S1,P1,Target Child,{app},{label},{kind},{stamp},{zone}"


@pytest.fixture
def folder(tmp_path):
    raw = tmp_path / "raw data"
    (raw / "deep er").mkdir(parents=True)
    (raw / "Archive").mkdir()
    first = [
        HEAD,
        row("Unknown importance: 1", "2024-01-01T06:00:00Z"),
        row("Unknown importance: 2", "2024-01-01T06:10:00Z"),
        row("Unknown importance: 1", "bad time"),
        row("Unknown importance: 1", "2024-01-02T05:50:00.5Z", app="c.d", label="C, D"),
        row("Unknown importance: 23", "2024-01-02T06:20:00Z", app="c.d", label="x"),
        row("Unknown importance: 1", "2024-01-04T06:20:00Z", app='"q""uote"', label="NA"),
    ]
    # "C, D" holds a comma: quote the cell.
    first[4] = first[4].replace("C, D", '"C, D"')
    (raw / "Raw P1+a.csv").write_text("\n".join(first) + "\n")
    second = "timezone, participant_id,event_timestamp,interaction_type,app_package_name\n"
    second += "None, P2,2024-01-01T00:00:00-05:00, Move to Foreground,x.y\n"
    second += "None, P2,2024-01-01T00:00:40-05:00, Move to Background,x.y\n"
    second += "None, P2,2024-01-01T00:41:00-05:00,Unknown importance: 23,x.y\n"
    (raw / "deep er" / "Raw P2.csv").write_text(second)
    (raw / "Raw empty.csv").write_text(HEAD + "\n")
    (raw / "Archive" / "Raw P3.csv").write_text("\n".join(first))
    (raw / "My Survey.csv").write_text("\n".join(first))
    (raw / "notes.txt").write_text("nothing")
    return str(raw)


def test_files_are_chosen_by_name_and_path(spark, folder):
    got = [r.source_file.rsplit("/", 1)[1] for r in files.list_files(spark, folder).collect()]
    assert sorted(got) == ["Raw P1+a.csv", "Raw P2.csv", "Raw empty.csv"]


def test_columns_are_matched_by_name(spark, folder):
    rows = logs.scan_raw(spark, folder).orderBy("source_file", "file_order").collect()
    assert len(rows) == 9
    p1 = [r for r in rows if r.participant_id == "P1"]
    p2 = [r for r in rows if r.participant_id == "P2"]
    assert [r.event_timestamp for r in p1][:3] == [
        "2024-01-01T06:00:00Z",
        "2024-01-01T06:10:00Z",
        "bad time",
    ]
    assert p1[3].application_label == "C, D"
    assert p1[5].app_package_name == 'q"uote'
    assert p1[5].application_label is None
    assert [r.timezone for r in p2] == [None] * 3
    assert p2[0].interaction_type == "Move to Foreground"
    assert p2[0].study_id is None


def test_common_header_is_read_directly(spark, tmp_path):
    for n in (1, 2):
        text = "\n".join([HEAD, row("x", f"2024-01-0{n}T06:00:00Z")])
        (tmp_path / f"p{n}.csv").write_text(text)
    df = logs.scan_raw(spark, str(tmp_path))
    assert df.count() == 2
    assert [r.timezone for r in logs.folder_timezones(spark, str(tmp_path)).collect()] == [
        "America/Chicago"
    ]


def test_odd_headers_and_files_do_not_stop_a_folder(spark, tmp_path):
    stamp = "2024-01-01T06:00:00Z"
    (tmp_path / "a.csv").write_text(
        f'\ufeff\n \n"event_timestamp" , note,interaction_type,"x ""y"", z",note,\r\n{stamp},1,t,q,2,end\r\n'
    )
    (tmp_path / "b.csv").write_text(f"Note,interaction_type,event_timestamp,Timezone\n3,t,{stamp},UTC\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    (tmp_path / "head.csv").write_text("event_timestamp,interaction_type\n")
    (tmp_path / "headless.csv").write_text(f"1,t,{stamp}\n")
    (tmp_path / "binary.csv").write_bytes(bytes(range(256)) * 40)
    df = logs.scan_raw(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    rows = {r.source_file.rsplit("/", 1)[1]: r.asDict() for r in df.collect()}
    assert set(rows) == {"a.csv", "b.csv"}
    assert (rows["a.csv"]["note_2"], rows["a.csv"]["Note"]) == ("1", None)
    assert (rows["b.csv"]["note_2"], rows["b.csv"]["Note"]) == (None, "3")
    assert rows["a.csv"]['x "y", z'] == "q" and rows["a.csv"]["unnamed"] == "end"
    # A name in another case is not the log's column.
    assert rows["b.csv"]["Timezone_2"] == "UTC" and rows["b.csv"]["timezone"] is None
    problems = {
        r.source_file.rsplit("/", 1)[1]: r.problem
        for r in logs.check_logs(spark, str(tmp_path)).collect()
    }
    assert problems.pop("binary.csv").startswith("No column")
    assert problems == {
        "a.csv": None,
        "b.csv": None,
        "none.csv": "Empty file",
        "blank.csv": "Empty file",
        "head.csv": None,
        "headless.csv": "No column interaction_type, event_timestamp",
    }


def test_folder_without_a_good_file_gives_a_report(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("")
    raw = logs.scan_raw(spark, str(tmp_path))
    assert raw.count() == 0 and set(logs.RAW_COLUMNS) < set(raw.columns)
    result = preprocess(raw, OPTIONS, files=logs.check_logs(spark, str(tmp_path)))
    got = {r.source_file.rsplit("/", 1)[1]: (r.status, r.message) for r in result.report().collect()}
    assert got == {
        "x.csv": ("error", "No column interaction_type, event_timestamp"),
        "y.csv": ("error", "Empty file"),
    }


RAGGED = [
    (row("Unknown importance: 1", "2024-01-01T06:00:00Z"), False),
    (row("Unknown importance: 2", "2024-01-01T06:10:00Z") + ",one,two", True),
    (row("Unknown importance: 2", "2024-01-01T06:11:00Z", label="A, B"), True),
    (row("Unknown importance: 2", "2024-01-01T06:12:00Z", label='"A, ""B"""'), False),
    ("S1,P1,Target Child,a.b,AB,Unknown importance: 23,2024-01-01T06:20:00Z", False),
    (row("Unknown importance: 2", "2024-01-01T06:13:00Z") + ",", True),
    (row("Unknown importance: 1", "2024-01-01T06:14:00Z", label='5" tall, wide'), True),
]


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("layouts", [1, 2])
def test_ragged_rows_go_into_quarantine(spark, tmp_path, layouts, multiline):
    text = "\n".join([HEAD, *[line for line, _ in RAGGED]]) + "\n"
    (tmp_path / "Raw P1.csv").write_text(text)
    if layouts == 2:
        wide = HEAD + ",c9,c10\n" + RAGGED[1][0].replace("P1", "P2") + "\n"
        (tmp_path / "Raw P2.csv").write_text(wide)
        (tmp_path / "Raw P3.csv").write_text(HEAD + "\n" + RAGGED[1][0] + "\n")
    raw = materialise(logs.scan_raw(spark, str(tmp_path), multiline=multiline), "raw")
    of_p1 = raw.filter(F.col("source_file").contains("P1"))
    bad = of_p1.filter("malformed IS NOT NULL")
    assert sorted(r.malformed for r in bad.collect()) == sorted(x for x, b in RAGGED if b)
    assert {r.participant_id for r in bad.collect()} == {None}
    good = of_p1.filter("malformed IS NULL").orderBy("file_order").collect()
    assert [r.application_label for r in good] == ["AB", 'A, "B"', "AB"]
    assert good[2].timezone is None
    options = StudyOptions(removed_types=(), timezone_mode=TimezoneMode.CONVERT_TO_PRIMARY)
    result = preprocess(raw, options, files=logs.check_logs(spark, str(tmp_path)))
    reasons = [r.reason for r in result.quarantine.collect()]
    assert reasons.count("malformed row") == sum(b for _, b in RAGGED) + (layouts == 2)
    assert len(reasons) + raw.filter("malformed IS NULL").count() == raw.count()
    report = {r.source_file.rsplit("/", 1)[1]: r for r in result.report().collect()}
    assert report["Raw P1.csv"].rows_in == len(RAGGED)
    assert (report["Raw P1.csv"].unreadable_times, report["Raw P1.csv"].unusable_zones) == (0, 0)
    if layouts == 2:
        assert report["Raw P3.csv"].message == "Malformed rows"


def test_folder_to_finished_table(spark, folder):
    raw = materialise(logs.scan_raw(spark, folder), "raw")
    listed = files.list_files(spark, folder)
    result = preprocess(raw, OPTIONS, keep_stages=True, files=listed)
    out = finished_table(result, OPTIONS).filter("interaction_type = 'App Usage'")
    got = {
        (r.participant_id, r.start_timestamp, r.stop_timestamp, r.duration_seconds)
        for r in out.collect()
    }
    # P1's first usage has a pause and another app's resume after it; P2's has
    # no stop by another app, so that only its own stop event counts.
    assert ("P1", "01-01-2024 00:00:00", "01-01-2024 00:10:00", 600.0) in got
    assert ("P2", "01-01-2024 00:00:00", "01-01-2024 00:41:00", 2460.0) in got
    assert result.quarantine.count() == 1
    report = result.report()
    status = {r.source_file.rsplit("/", 1)[1]: (r.status, r.message) for r in report.collect()}
    assert status == {
        "Raw P1+a.csv": ("processed", None),
        "Raw P2.csv": ("processed", None),
        "Raw empty.csv": ("error", "Empty file"),
    }
    summary = reports.run_summary(report).first()
    assert (summary.total_units, summary.processed_units, summary.failed_units) == (3, 2, 1)


def run_again(spark, folder, out, options=OPTIONS, **more):
    rerun = preprocess_folder(spark, folder, out, options, file_format="csv", **more)
    changed = {r.unit.rsplit("/", 1)[1] for r in rerun.changed.collect()}
    return rerun, changed, {r.unit.rsplit("/", 1)[1] for r in rerun.removed.collect()}


def test_a_run_lists_files_and_reads_headers_once(spark, folder, tmp_path, monkeypatch):
    calls = []

    def counted(name):
        plain = getattr(files, name)
        monkeypatch.setattr(files, name, lambda *a, **k: calls.append(name) or plain(*a, **k))

    counted("list_files")
    counted("header_catalogue")
    rerun, changed, _ = run_again(spark, folder, str(tmp_path / "out"))
    assert sorted(calls) == ["header_catalogue", "list_files"]
    report = {r.source_file.rsplit("/", 1)[1] for r in rerun.result.report().collect()}
    assert report == changed


def test_only_changed_files_are_run_again(spark, folder, tmp_path):
    from pathlib import Path

    out = str(tmp_path / "out")
    _, changed, removed = run_again(spark, folder, out)
    assert changed == {"Raw P1+a.csv", "Raw P2.csv", "Raw empty.csv"} and not removed
    before = {p: p.stat().st_mtime_ns for p in Path(out).rglob("part-*.csv")}
    rerun, changed, removed = run_again(spark, folder, out)
    assert rerun.result is None and not changed and not removed
    # One file grows, one is new with the stem of another, one goes, and one has rows no more.
    p2 = Path(folder) / "deep er" / "Raw P2.csv"
    p2.write_text(p2.read_text() + "None, P2,2024-01-01T01:41:00-05:00, Move to Foreground,x.y\n")
    (Path(folder) / "deep er" / "Raw P1+a.csv").write_text(
        "\n".join([HEAD, *[row(f"Unknown importance: {n}", f"2024-02-01T06:0{n}:00Z") for n in (1, 2)]])
    )
    (Path(folder) / "Raw empty.csv").unlink()
    rerun, changed, removed = run_again(spark, folder, out)
    assert changed == {"Raw P2.csv", "Raw P1+a.csv"} and removed == {"Raw empty.csv"}
    assert {r.source_file for r in rerun.result.raw.collect()} == {
        r.unit for r in rerun.changed.collect()
    }
    kept = [p for p in before if "P1+a Auto" in str(p)]
    assert kept and all(p.stat().st_mtime_ns == before[p] for p in kept)
    fresh = str(tmp_path / "fresh")
    run_again(spark, folder, fresh)
    names = F.regexp_replace("output_name", " [0-9a-f]{16}$", "")

    def content(path):
        rows = spark.read.option("header", True).csv(path).withColumn("output_name", names)
        return sorted(map(str, rows.drop("datetime_of_preprocessing").collect()))

    assert content(out) == content(fresh)
    p2.write_text(HEAD + "\n")
    _, changed, _ = run_again(spark, folder, out)
    assert changed == {"Raw P2.csv"}
    assert not [p for p in Path(out).iterdir() if "P2 Auto" in p.name]


def test_other_options_or_dimensions_run_all_files_again(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    book = spark.createDataFrame([("a.b", "Games", "G")], "app_package_name string, broad_app_category string, genreId string")
    run_again(spark, folder, out, codebook=book)
    assert not run_again(spark, folder, out, codebook=book)[1]
    other = book.withColumn("genreId", F.lit("H"))
    assert len(run_again(spark, folder, out, codebook=other)[1]) == 3
    options = StudyOptions(timezone_mode=TimezoneMode.CONVERT_TO_PRIMARY, custom_engagement_seconds=77)
    assert len(run_again(spark, folder, out, options, codebook=other)[1]) == 3
    with pytest.raises(ValueError, match="source_file"):
        run_again(spark, folder, out, StudyOptions(unit="participant_id"))


def test_null_units_are_written(spark, tmp_path):
    rows = [(None, 0, "a"), ("", 0, "b"), (None, 1, "c"), ("x/y", 0, "d")]
    df = spark.createDataFrame(rows, "device string, seq long, app_package_name string")
    path = str(tmp_path / "out")
    sinks.write_preprocessed(df, path, "device")
    back = spark.read.parquet(path).select("output_name", "unit", "app_package_name").collect()
    assert sorted(r.app_package_name for r in back) == ["a", "b", "c", "d"]
    assert len({r.output_name for r in back}) == 3
    assert {r.unit for r in back if r.app_package_name in "ac"} == {None}


def test_finished_files_round_trip(spark, folder, tmp_path):
    raw = materialise(logs.scan_raw(spark, folder), "raw")
    result = finished_table(preprocess(raw, OPTIONS), OPTIONS, keep_seq=True)
    path = str(tmp_path / "out")
    sinks.write_preprocessed(result, path, "source_file", "csv")
    names = {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert names == {
        "output_name=P1+a Automatically Preprocessed",
        "output_name=P2 Automatically Preprocessed",
    }
    back = logs.scan_preprocessed(spark, path)
    assert back.count() == result.count()
    assert "seq" not in back.columns
    for unit in back.select("source_file").distinct().collect():
        rows = back.filter(F.col("source_file") == unit.source_file)
        stamps = [r.event_timestamp for r in rows.orderBy("file_order").collect()]
        assert stamps == sorted(stamps)
    tables = plot_tables(back, None, OPTIONS, "source_file")
    bars = tables["usage"].collect()
    assert {(str(r.segment_date), r.left_hours) for r in bars} >= {("2024-01-01", 0.0)}
    assert tables["dates"].count() == 5
    assert tables["gaps"].count() > 0
    target = str(tmp_path / "mapped")
    sinks.write_categorised(back.drop("start_local", "stop_local", "event_local"), target)
    mapped = spark.read.option("header", True).csv(target)
    assert {r.unit.rsplit("/", 1)[1] for r in mapped.collect()} == {"Raw P1+a.csv", "Raw P2.csv"}
    assert mapped.count() == back.count()
    assert {p.name for p in (tmp_path / "mapped").iterdir() if p.is_dir()} == {
        "output_name=P1+a Automatically Preprocessed_with_categories",
        "output_name=P2 Automatically Preprocessed_with_categories",
    }


def test_written_units_stay_apart_and_in_order(spark, tmp_path):
    """Equal stems, dotted ids, and text times that fall back with the clock."""
    times = ["2024-11-03T05:30:00Z", "2024-11-03T06:10:00Z", "2024-11-03T07:00:00Z"]
    for site in ("siteA", "siteB"):
        (tmp_path / "in" / site).mkdir(parents=True)
        lines = [HEAD, *[row(site, t) for t in times]]
        (tmp_path / "in" / site / "Raw P1.csv").write_text("\n".join(lines))
    (tmp_path / "in" / "Raw nohead.csv").write_text(row("P9", times[0]) + "\n")
    raw = materialise(logs.scan_raw(spark, str(tmp_path / "in")), "raw")
    listed = files.list_files(spark, str(tmp_path / "in"))
    options = StudyOptions(selected_timezone="America/Chicago", removed_types=())
    result = preprocess(raw, options, files=listed)
    status = {r.source_file.rsplit("/", 1)[1]: r.status for r in result.report().collect()}
    assert status["Raw nohead.csv"] == "error"
    for unit, n_units in (("source_file", 2), ("participant_id", 2)):
        table = finished_table(result, options, keep_seq=True)
        if unit == "participant_id":
            dotted = F.concat(F.lit("S1.00"), F.when(F.col("source_file").contains("A"), "1").otherwise("2"))
            table = table.withColumn(unit, dotted).drop("source_file")
        path = str(tmp_path / f"out-{unit}")
        sinks.write_preprocessed(table, path, unit, "csv")
        back = logs.scan_preprocessed(spark, path)
        found = {}
        for r in back.orderBy("source_file", "file_order").collect():
            found.setdefault(r.source_file, []).append(r.event_timestamp)
        assert len(found) == n_units
        for stamps in found.values():
            assert len(stamps) >= 3 and stamps == [s for s in stamps if s]
            hours = [s[11:16] for s in stamps]
            assert hours == sorted(hours, key=lambda h: ["00:30", "01:10", "01:00"].index(h))
    with pytest.raises(ValueError, match="keep_seq"):
        sinks.write_preprocessed(finished_table(result, options), str(tmp_path / "x"), "source_file")


def test_local_time_of_finished_rows_ignores_the_offset(spark):
    rows = [("2024-01-01 00:00:00-05:00",), ("2024-01-01 00:00:00.250000+02:00",), (None,)]
    df = spark.createDataFrame(rows, "event_timestamp string").withColumns(
        {c: F.lit(None).cast("string") for c in ("start_timestamp", "stop_timestamp")}
    )
    got = [r.event_local for r in logs.finished_types(df).collect()]
    assert [str(x) for x in got] == ["2024-01-01 00:00:00", "2024-01-01 00:00:00.250000", "None"]


def test_finished_files_without_times_are_skipped(spark, tmp_path):
    good = "start_timestamp,stop_timestamp\n01-02-2024 00:00:00,01-02-2024 01:00:00\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "bad.csv").write_text("start_timestamp,other\n01-02-2024 00:00:00,1\n")
    rows = logs.scan_preprocessed(spark, str(tmp_path)).collect()
    assert [str(r.date) for r in rows] == ["2024-01-02"]
    (tmp_path / "good.csv").unlink()
    with pytest.raises(ValueError):
        logs.scan_preprocessed(spark, str(tmp_path))


def test_dimension_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Package,Labels,More\na , One\na,\"Two, 2\",x\n,q\n")
    got = dimensions.scan_app_filters(spark, str(tmp_path / "f.csv")).collect()
    assert [(r.app_package_name, r.labels) for r in got] == [("a", ["Two", "2"])]
    book = "app_package_name,broad_app_category,genreId\na,Games,G\na,Other,O\nb,,T\n"
    (tmp_path / "c.csv").write_text(book)
    got = dimensions.scan_codebook(spark, str(tmp_path / "c.csv")).orderBy("app_package_name")
    assert [tuple(r) for r in got.collect()] == [("a", "Games", "G"), ("b", None, "T")]


def test_codebook_job_writes_only_with_duplicates(spark, tmp_path):
    source = tmp_path / "book.csv"
    source.write_text("app_package_name,genreId\nb,1\na,2\nb,3\n")
    out, report = str(tmp_path / "clean"), str(tmp_path / "report")
    assert sinks.dedupe_codebook_job(spark, str(source), out, "last", report)
    clean = spark.read.option("header", True).csv(out).collect()
    assert sorted(tuple(r) for r in clean) == [("a", "2"), ("b", "3")]
    assert spark.read.option("header", True).csv(report).count() == 2
    again = str(tmp_path / "again")
    assert not sinks.dedupe_codebook_job(spark, out, again)
    assert not (tmp_path / "again").exists()


def test_label_log_is_written_only_when_new(spark, tmp_path):
    old = spark.createDataFrame([(" b ",), ("c",)], "message string")
    path = str(tmp_path / "log")
    new = spark.createDataFrame([("b",)], "message string")
    assert not sinks.update_label_log(new, old, path)
    new = spark.createDataFrame([("b",), ("a",)], "message string")
    assert sinks.update_label_log(new, old, path)
    assert [r.value for r in spark.read.text(path).orderBy("value").collect()] == ["a", "b", "c"]


def test_folders_are_listed_in_few_tasks(spark, tmp_path):
    """A folder for each unit is not a listing task for each unit."""
    for i in range(60):
        (tmp_path / "raw" / f"unit {i}").mkdir(parents=True)
        path = tmp_path / "raw" / f"unit {i}" / "Raw log.csv"
        path.write_text(f"{HEAD}\n{row('Unknown importance: 1', '2024-01-01T06:00:00Z')}\n")
    before = spark.conf.get(files._LISTING_TASKS)
    context = spark.sparkContext
    context.setJobGroup("listing-test", "listing")
    headers = files.header_catalogue(spark, str(tmp_path / "raw"))
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing-test")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) <= 32
    assert spark.conf.get(files._LISTING_TASKS) == before
    assert headers.count() == 60
    assert logs.scan_raw(spark, str(tmp_path / "raw")).count() == 60


ALL_TYPES = StudyOptions(removed_types=(), timezone_mode=TimezoneMode.CONVERT_TO_PRIMARY)


@pytest.fixture
def small_batches(monkeypatch):
    """Scans of four files, writes of three folders; the paths each scan was given."""
    taken = []
    batches = files._batches

    def noted(spark, folder):
        for paths in batches(spark, folder):
            taken.append(paths)
            yield paths

    monkeypatch.setattr(files, "FILES_AT_ONCE", 4)
    monkeypatch.setattr(files, "_batches", noted)
    monkeypatch.setattr(sinks, "FOLDERS_AT_ONCE", 3)
    return taken


@pytest.fixture
def many(tmp_path):
    """Odd names, two layouts, a file without a byte, files at three depths."""
    names = ["a.csv", "b [1].csv", "c{2}*.csv", "d+%41.csv", "e\\f.csv", "deep/g.csv"]
    names += [f"deep/er {n}/Raw h{n}.csv" for n in range(5)]
    for n, name in enumerate(names):
        path = tmp_path / "many" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        head, lines = HEAD, [row(f"Unknown importance: {i}", f"2024-01-01T06:{n:02}:0{i}Z") for i in (1, 2)]
        if n % 4 == 1:
            turn = lambda line: ",".join(reversed(line.split(",")))
            head, lines = 'Note,"x ""y"", z",' + turn(head), ["n,z," + turn(x) for x in lines]
        path.write_text("\n".join([head, *lines, "1,2,3,4,5,6,7,8,9,10,11"][: 4 if n % 3 == 0 else 3]) + "\n")
    (tmp_path / "many" / "none.csv").write_text("")
    (tmp_path / "many" / "_hidden.csv").write_text(HEAD)
    (tmp_path / "many" / "_logs").mkdir()
    (tmp_path / "many" / "_logs" / "z.csv").write_text(HEAD)
    return str(tmp_path / "many")


def test_many_files_are_read_in_batches(spark, many, small_batches, monkeypatch):
    def results():
        raw = sorted(logs.scan_raw(spark, many).collect(), key=lambda r: (r.source_file, r.file_order))
        rows = [sorted((k, str(v)) for k, v in r.asDict().items() if k != "file_order") for r in raw]
        listed = files.list_files(spark, many, times=True).collect()
        return rows, listed, sorted(map(str, logs.check_logs(spark, many).collect()))

    in_batches = results()
    # Headers and rows, and three more passes over twelve files.
    assert [len(paths) for paths in small_batches] == [4] * 15
    del small_batches[:]
    monkeypatch.setattr(files, "FILES_AT_ONCE", 1000)
    assert results() == in_batches
    assert small_batches == [[many]] * len(small_batches)
    assert len(in_batches[1]) == 12 and len(in_batches[0]) == 11 * 2 + 4


def test_finished_folders_are_written_and_read_in_batches(spark, many, small_batches, tmp_path):
    raw = materialise(logs.scan_raw(spark, many), "raw")
    table = finished_table(preprocess(raw, ALL_TYPES), ALL_TYPES, keep_seq=True)
    path = str(tmp_path / "out")
    sinks.write_preprocessed(table, path, "source_file", "csv")
    assert sum(p.is_dir() for p in (tmp_path / "out").iterdir()) == 11
    # One file for each part of a unit, and none beside it.
    assert not list((tmp_path / "out").rglob(".part-*"))
    del small_batches[:]
    back = logs.scan_preprocessed(spark, path)
    assert [len(paths) for paths in small_batches] == [4, 4, 3] * 2
    assert back.count() == table.count() >= 11
    assert back.select("source_file").distinct().count() == 11
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_preprocessed(table, path, "source_file", "csv")


def test_a_rerun_in_batches_does_what_one_run_does(spark, many, small_batches, tmp_path):
    from pathlib import Path

    out = str(tmp_path / "out")
    _, changed, removed = run_again(spark, many, out, ALL_TYPES)
    assert len(changed) == 12 and not removed
    assert not run_again(spark, many, out, ALL_TYPES)[1]
    lines = [row(f"Unknown importance: {i}", f"2024-01-01T07:0{i}:00Z", app="c.d") for i in (1, 2)]
    (Path(many) / "a.csv").write_text("\n".join([HEAD, *lines]) + "\n")
    (Path(many) / "deep" / "g.csv").unlink()
    _, changed, removed = run_again(spark, many, out, ALL_TYPES)
    assert (changed, removed) == ({"a.csv"}, {"g.csv"})
    back = spark.read.option("header", True).csv(out)
    assert back.groupBy("unit").count().count() == 10
    apps = back.where("unit LIKE '%/a.csv'").select("app_package_name").distinct().collect()
    assert [r.app_package_name for r in apps] == ["c.d"]
