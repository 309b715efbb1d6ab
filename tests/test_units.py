"""Windowed operators against the row-by-row model, plain and sliced."""

from __future__ import annotations

import pytest
from model import close, details, order_unit, random_log
from pyspark.sql import functions as F

from usageweave import StudyOptions, TimezoneMode
from usageweave import constants as C
from usageweave.operators.engagement import usage_details
from usageweave.operators import reports, units
from usageweave.operators.ordering import order_log
from usageweave.operators.sessions import filtered_sessions, sessions, valid_sessions
from usageweave.operators.timezones import apply_timezone_mode, bad_zone_rows
from usageweave.operators.units import by_unit, split_lanes, whole_unit

SCHEMA = (
    "unit string, file_order long, us long, interaction_type string, "
    "app_package_name string"
)


def frame(spark, rows):
    data = [(r["unit"], r["order"], r["us"], r["kind"], r["app"]) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("event_timestamp", F.timestamp_micros("us"))


def presets(name, **more):
    make = StudyOptions if name == "all" else StudyOptions.minimal
    return make(unit="unit", **more)


LANES = {"plain": {}, "sliced": {"hot_unit_rows": 40, "slice_rows": 35}}


def expected_units(rows, options):
    stops = {*options.same_app_stops, *options.other_app_stops}
    fix = options.correct_duplicate_timestamps
    return {
        u: order_unit([r for r in rows if r["unit"] == u], stops, C.KNOWN_TYPES, fix)
        for u in {r["unit"] for r in rows}
    }


def model_filtered(rows, o):
    return close(
        rows, "Filtered App Resumed", "Filtered App Paused", "Filtered App Stopped",
        "Filtered App Usage", o.filtered_same_app_stops, o.filtered_other_app_stops,
        True, True,
    )


def model_valid(rows, o):
    return close(
        rows, "Activity Resumed", "Activity Paused", "Activity Stopped", "App Usage",
        o.same_app_stops, o.other_app_stops, False, False,
    )


def sessions_of(df):
    picked = df.select(
        "unit",
        "seq",
        "interaction_type",
        F.unix_micros("start_timestamp"),
        F.unix_micros("stop_timestamp"),
    )
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: t[:2])


def sessions_model(units):
    rows = [
        (u, r["seq"], r["kind"], r.get("start"), r.get("stop"))
        for u, rs in units.items()
        for r in rs
    ]
    return sorted(rows, key=lambda t: t[:2])


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize(("fix", "ties"), [(True, 0.3), (True, 0.97), (False, 0.97)])
def test_order_and_gaps(spark, lane, fix, ties):
    rows = random_log(1, 3, 120, ties=ties) + random_log(2, 1, 20)
    for r in rows[-20:]:
        r["unit"] = "small"
    options = presets("all", correct_duplicate_timestamps=fix, **LANES[lane])
    out = by_unit(frame(spark, rows), lambda d, ln: order_log(d, ln, options), options)
    got = {
        (r.unit, r.file_order): (r.seq, r.event_us, r.data_time_gap_hours)
        for r in out.collect()
    }
    assert len(got) == len(rows)
    for u, rs in expected_units(rows, options).items():
        for r in rs:
            seq, us, gap = got[u, r["order"]]
            assert (seq, us) == (r["seq"], r["moved"])
            if r["gap"] is None:
                assert gap is None
            else:
                assert gap == pytest.approx(r["gap"], abs=0.00501)


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize("preset", ["all", "minimal"])
def test_filtered_sessions(spark, lane, preset):
    rows = random_log(3, 3, 150, spread_hours=8)
    options = presets(preset, **LANES[lane])

    def step(df, ln):
        return filtered_sessions(order_log(df, ln, options), ln, options)

    units = {
        u: model_filtered(rs, options) for u, rs in expected_units(rows, options).items()
    }
    out = by_unit(frame(spark, rows), step, options)
    assert sessions_of(out) == sessions_model(units)


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize(("preset", "apps"), [("all", 1), ("all", 4), ("minimal", 4)])
def test_valid_sessions(spark, lane, preset, apps):
    rows = random_log(5, 3, 150, spread_hours=8, apps=apps)
    options = presets(preset, **LANES[lane])

    def step(df, ln):
        return valid_sessions(order_log(df, ln, options), ln, options)

    units = {
        u: model_valid(rs, options) for u, rs in expected_units(rows, options).items()
    }
    out = by_unit(frame(spark, rows), step, options)
    assert sessions_of(out) == sessions_model(units)


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize("preset", ["all", "minimal"])
def test_sessions_and_details(spark, lane, preset):
    rows = random_log(6, 3, 160, spread_hours=2)
    options = presets(preset, **LANES[lane])

    def step(df, ln):
        df = sessions(order_log(df, ln, options), ln, options)
        return usage_details(df, ln, options)

    out = by_unit(frame(spark, rows), step, options)
    units = {
        u: details(model_valid(model_filtered(rs, options), options))
        for u, rs in expected_units(rows, options).items()
    }
    assert sessions_of(out) == sessions_model(units)
    names = ["new_engage_30s", "new_engage_custom_300s", "switched_app"]
    names.append("usage_time_gap_hours")
    found = {(r.unit, r.seq): r for r in out.collect()}
    for u, rs in units.items():
        for r in rs:
            for scope in ("any", "valid"):
                got = [found[u, r["seq"]][f"{scope}_app_{n}"] for n in names]
                assert got == (r[scope] or [None] * 4)


def test_lanes_split_only_hot_units(spark):
    rows = random_log(7, 2, 30) + [
        {**r, "unit": "big"} for r in random_log(8, 1, 90)
    ]
    options = presets("all", hot_unit_rows=40, slice_rows=20)
    lanes = split_lanes(frame(spark, rows), options)
    assert [ln.slices for _, ln in lanes] == [0, 5]
    assert lanes[0][0].count() == 60
    assert {r.unit for r in lanes[1][0].select("unit").distinct().collect()} == {"big"}
    same = presets("all")
    assert len(split_lanes(frame(spark, rows), same)) == 1


def test_many_slices_share_few_ranges(spark, monkeypatch):
    monkeypatch.setattr(units, "BROADCAST_ROWS", 0)
    rows = random_log(14, 3, 80)
    options = presets("all", hot_unit_rows=40, slice_rows=6)
    hot, lane = split_lanes(frame(spark, rows), options)[1]
    assert (lane.slices, lane.ranges, lane.small) == (40, 4, False)
    out = order_log(hot, lane, options)
    sizes = out.groupBy(C.SLICE).count().collect()
    assert len(sizes) >= 40 and max(r["count"] for r in sizes) <= 6
    out = sessions(out, lane, options)
    expected = expected_units(rows, options)
    expected = {u: model_valid(model_filtered(rs, options), options) for u, rs in expected.items()}
    assert sessions_of(out) == sessions_model(expected)


def test_hot_units_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(units, "MAX_HOT_UNITS", 2)
    rows = random_log(12, 3, 60)
    options = presets("all", hot_unit_rows=40, slice_rows=20)
    with pytest.raises(ValueError, match="raise hot_unit_rows"):
        split_lanes(frame(spark, rows), options)


def test_large_dimensions_are_not_broadcast(spark):
    log = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "k string")
    table = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")

    def joined():
        df = units.lookup_join(log, table, ["k"])
        plan = df._jdf.queryExecution().sparkPlan().toString()
        return sorted(df.collect(), key=str), "BroadcastHashJoin" in plan

    few, broadcast = joined()
    assert broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joined() == (few, False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_assert_ordered_fails_the_job(spark):
    rows = spark.sql(
        "SELECT timestamp'2024-01-02' AS start_timestamp, timestamp'2024-01-01' AS stop_timestamp"
    )
    with pytest.raises(Exception, match="later than stop"):
        reports.assert_ordered(rows).collect()
    fine = rows.withColumn("stop_timestamp", F.col("start_timestamp"))
    assert reports.assert_ordered(fine).collect() == fine.collect()


def test_whole_unit_in_both_lanes(spark):
    rows = random_log(9, 2, 50)
    for lane in LANES.values():
        options = presets("all", **lane)
        out = by_unit(
            frame(spark, rows),
            lambda d, ln: whole_unit(d, ln, {"n": F.count(F.lit(1))}),
            options,
        )
        assert {r.n for r in out.select("n").collect()} == {50}


def test_partition_count_does_not_matter(spark):
    rows = random_log(10, 4, 80)
    options = presets("all")

    def run():
        return sessions_of(
            by_unit(
                frame(spark, rows),
                lambda d, ln: sessions(order_log(d, ln, options), ln, options),
                options,
            )
        )

    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("mode", list(TimezoneMode))
@pytest.mark.parametrize("lane", LANES)
def test_bad_zones_are_found_without_windows(spark, mode, lane):
    """The rows that the zone mode marks, null zones and units without a name among them."""
    zones = ["Mars/Base", "Mars/Base", "UTC", None, "", "America/Chicago"]
    rows = [
        (f"u{u}" if u else None, i, zones[(u * 5 + i * i) % (2 + u % 5)], f"t{i}+0{u % 4}:00")
        for u in range(12)
        for i in range(9 * (u + 1))
    ]
    df = spark.createDataFrame(rows, "unit string, file_order long, timezone string, text string")
    options = StudyOptions(
        unit="unit", timezone_mode=mode, selected_timezone="UTC", **LANES[lane]
    )
    found = 0
    for part, lane_ in split_lanes(df, options):
        marked = apply_timezone_mode(part, lane_, options, "text").filter("zone_error")
        bad = bad_zone_rows(part, lane_, options, "text")
        columns = ["unit", "file_order", "timezone", "text"]
        assert bad.columns == marked.drop("zone_error").columns
        expected = sorted(map(str, marked.select(columns).collect()))
        assert sorted(map(str, bad.select(columns).collect())) == expected
        assert "Window" not in bad._jdf.queryExecution().toString()
        found += len(expected)
    chosen = (TimezoneMode.KEEP_SELECTED, TimezoneMode.CONVERT_TO_SELECTED)
    assert (found > 0) == (mode not in chosen)
