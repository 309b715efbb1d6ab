"""Row-level expressions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usageweave import StudyOptions
from usageweave import constants as C
from usageweave.functions import times, values
from usageweave.operators import columns as cols
from usageweave.operators import labelling, timezones
from usageweave.operators.units import Lane
from usageweave.sources import sinks
from usageweave.sources.dimensions import app_filters, codebook


def evaluate(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


FIXED = {
    "2024-01-01T00:00:00Z": "2024-01-01T00:00:00.000+00:00",
    "2024-01-01T00:00:00-05:00": "2024-01-01T00:00:00.000-05:00",
    "2024-01-01T00:00:00.123Z": "2024-01-01T00:00:00.123+00:00",
    "2024-01-01 00:00:00": None,
    "2024-01-01 00:00:00.123456": "2024-01-01 00:00:00.123456",
    "2024-01-01": None,
}


def test_fix_timestamp(spark):
    rows = [(t,) for t in FIXED] + [(None,)]
    got = evaluate(spark, rows, "t string", times.fix_timestamp(F.col("t")))
    assert got == [*FIXED.values(), None]


def test_reading_agrees_with_fixing(spark):
    texts = [*FIXED, "x" * 30, "2024-13-01T00:00:00.000+00:00", None]
    rows = [(t,) for t in texts]
    fixed = times.parse_timestamp(times.fix_timestamp(F.col("t")))
    read = times.read_timestamp(F.col("t"))
    assert evaluate(spark, rows, "t string", fixed) == evaluate(spark, rows, "t string", read)
    errors = evaluate(spark, rows, "t string", times.timestamp_error(F.col("t")))
    assert errors == [False, False, False, True, False, True, True, True, False]


@pytest.mark.parametrize(
    ("text", "zone"),
    [
        ("2024-01-01T00:00:00Z", "UTC"),
        ("2024-01-01T00:00:00.5+00:00", "UTC"),
        ("2024-01-01T00:00:00.5-05:30", "UTC-05:30"),
        ("2024-01-01T00:00:00.5+0200", "UTC+02:00"),
        ("2024-01-01 00:00:00.123456", None),
        ("2024-01-01", None),
    ],
)
def test_text_offset_zone(spark, text, zone):
    assert evaluate(spark, [(text,)], "t string", times.text_offset_zone(F.col("t"))) == [zone]


def test_wall_clock_follows_daylight_saving(spark):
    rows = [("2024-03-10T07:59:59Z",), ("2024-03-10T08:00:00Z",)]
    micros = F.unix_micros(F.try_to_timestamp("t"))
    local = times.wall_clock(micros, F.lit("America/Chicago"))
    got = evaluate(spark, rows, "t string", times.local_text(local, micros))
    assert got == [
        "2024-03-10 01:59:59.000000-06:00",
        "2024-03-10 03:00:00.000000-05:00",
    ]


def test_flags_take_the_highest_threshold(spark):
    rows = [(0.5, 30.0), (6.0, 60.0 * 24), (None, None), (30.0, None), (1.0, 59.9)]
    flags = values.usage_flags(F.col("g"), F.col("m"), (1, 6, 12, 24), (1, 6, 12, 24))
    assert evaluate(spark, rows, "g double, m double", flags) == [
        [],
        [">6-HR TIME GAP", ">24-HR APP USAGE"],
        [],
        [">24-HR TIME GAP"],
        [">1-HR TIME GAP"],
    ]
    fallback = values.usage_flags(F.col("g"), F.col("m"), (), ())
    assert evaluate(spark, [(2.0, 200.0)], "g double, m double", fallback) == [
        [">3-HR APP USAGE"]
    ]


def test_priorities(spark):
    kinds = ["Activity Resumed", "Screen Non-interactive", "App Launch", "Odd", None]
    got = evaluate(
        spark,
        [(k,) for k in kinds],
        "k string",
        values.event_priority(F.col("k"), C.OTHER_APP_STOPS),
    )
    assert got == [0, 2, 1, 3, 3]


def test_vocabulary():
    assert len(C.KNOWN_TYPES) == 45
    assert len(C.REMOVABLE_TYPES) == 31
    assert StudyOptions().filtered_same_app_stops == (
        "Filtered App Paused",
        "Filtered App Resumed",
        "Filtered App Stopped",
        "Filtered App Destroyed",
    )
    with pytest.raises(ValueError):
        StudyOptions(same_app_stops=("App Usage",))


def test_filter_list_rules(spark):
    rows = [
        (1, "a", " One , Two "),
        (2, "b", "old"),
        (3, " b\t", "new"),
        (4, " ", "blank"),
        (5, "NaN", "x"),
        (6, None, "x"),
        (7, "c", None),
    ]
    df = spark.createDataFrame(rows, "n int, p string, l string")
    got = {r[0]: r[1] for r in app_filters(df.select("p", "l", "n"), "n").collect()}
    assert got == {"a": ["One", "Two"], "b": ["new"], "c": ["nan"]}
    with pytest.raises(ValueError):
        app_filters(df.select("p", "n"), "n")


def test_codebook_needs_its_key(spark):
    df = spark.createDataFrame([(1, "x")], "n int, other string")
    with pytest.raises(ValueError):
        codebook(df, "n")


def test_labels(spark):
    log = spark.createDataFrame(
        [
            ("a", "One", "Activity Resumed"),
            ("a", "One", "Screen Interactive"),
            ("a", None, "Activity Paused"),
            ("a", "It's", "Activity Paused"),
            ("z", "One", "Activity Stopped"),
        ],
        "app_package_name string, application_label string, interaction_type string",
    )
    filters = spark.createDataFrame(
        [("a", ["One", "T'wo"])], "app_package_name string, labels array<string>"
    )
    got = [r.interaction_type for r in labelling.label_filtered_apps(log, filters).collect()]
    assert sorted(got) == sorted(
        [
            "Filtered App Resumed",
            "Screen Interactive",
            "Activity Paused",
            "Activity Paused",
            "Activity Stopped",
        ]
    )
    lines = labelling.label_messages(labelling.unexpected_labels(log, filters))
    assert {r.message for r in lines.collect()} == {
        """a: expected any of '['One', "T'wo"]', found 'nan'""",
        """a: expected any of '['One', "T'wo"]', found 'It's'""",
    }


def test_primary_timezone_rules(spark):
    rows = [
        ("tie", 1, "B", "2024-01-01T00:00:00Z"),
        ("tie", 2, "A", "2024-01-01T00:00:00Z"),
        ("tie", 3, "A", "2024-01-01T00:00:00Z"),
        ("tie", 4, "B", "2024-01-01T00:00:00Z"),
        ("tie", 5, None, "2024-01-01T00:00:00Z"),
        ("text", 1, None, "2024-01-01T00:00:00.0+02:00"),
        ("text", 2, None, "2024-01-01T00:00:00.0-05:00"),
        ("none", 1, None, None),
    ]
    df = spark.createDataFrame(
        rows, "u string, file_order int, timezone string, event_timestamp string"
    )
    want = {"tie": "B", "text": "UTC+02:00", "none": "UTC"}
    table = timezones.primary_timezone(df, "u")
    assert {r[0]: r[1] for r in table.collect()} == want
    for lane in (Lane("u"), Lane("u", 3)):
        rows = timezones.attach_primary_timezone(df, lane, "event_timestamp").collect()
        assert {r.u: r.primary_timezone for r in rows} == want
        assert len(rows) == df.count()


def test_device_model_ignores_missing_packages(spark):
    rows = [("a", None), ("a", "x.com.amazon.imp.y"), ("b", None), ("b", "comXamazonXimp")]
    df = spark.createDataFrame(rows, "u string, app_package_name string")
    got = cols.device_model(df, Lane("u")).select("u", "possible_device_model").distinct()
    assert {r[0]: r[1] for r in got.collect()} == {"a": "Amazon Fire", "b": "Android"}


def test_output_names(spark):
    rows = [("file:/x/Raw P1 data.csv",), ("P2",), ("/d/Raw a.b.csv",)]
    got = evaluate(spark, rows, "p string", sinks.output_name(F.col("p")))
    assert got == [
        "P1 data Automatically Preprocessed",
        "P2 Automatically Preprocessed",
        "a.b Automatically Preprocessed",
    ]


def test_selected_zone_is_checked(spark):
    df = spark.createDataFrame([("x", "UTC")], "u string, timezone string")
    for zone in (None, "Mars/Base"):
        options = StudyOptions(unit="u", selected_timezone=zone)
        with pytest.raises(ValueError):
            timezones.apply_timezone_mode(df, Lane("u"), options)
