from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa

from sunloom.kernels import stamps
from sunloom.operators import clocks

LOG = "rec_id long, site string, system string, seq_no long, raw_ts string, meas_val_f double, mask string, year int"
META = "site string, system string, power_column_label string, data_sampling double, time_shift_manual int, gmt_offset double, time_zone string, time_zone_correction int, revised_at timestamp_ntz"
ZONES = [("America/New_York", -5.0, -4.0, "EST", "EDT"), ("America/Phoenix", -7.0, float("nan"), "MST", None), ("Australia/Adelaide", 9.5, 10.5, "ACST", "ACDT"), ("Europe/Berlin", 1.0, 2.0, "CET", "CEST")]
UTC = timezone.utc


def run(spark, log, meta):
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([("s", *r, at) for r in meta], META) if meta else spark.createDataFrame([], META)
    z = spark.createDataFrame(ZONES, "time_zone string, std_offset_h double, dst_offset_h double, std_abbr string, dst_abbr string")
    rows = [(i, "s", s, q, t, 1.0, "clash", 7) for i, (s, q, t) in enumerate(log)]
    got = {r.rec_id: r.utc_ms for r in clocks.found(spark.createDataFrame(rows, LOG), m, z).collect()}
    return [got.get(i) for i in range(len(log))]


def ms(*a, us=0):
    return round(datetime(*a, tzinfo=UTC).timestamp() * 1000) + round(us / 1000)


PHX = ("a", "p", None, 0, -7.0, "America/Phoenix", 0)


def test_formats(spark):
    six = ms(2022, 3, 4, 12, 6, 0)
    texts = {
        "2022-03-04 05:06:00": six, " 2022-03-04T05:06\t": six, "20220304T050600": six, "2022-063 05:06": six, "04.3.2022 05:06": six, "04-Mar-22 05:06": six, "3/4/2022 5:06:00 AM": six,
        "03/04/2022 05:06": six, "2022-03-04T12:06:00Z": six, "2022-03-04 12:06:00 UTC": six, "2022-03-04T05:06:00-07:00": six, "2022-03-04 05:06:00 MST": six, "Fri, 04 Mar 2022 13:06:00 +0100": six,
        "1646395560": six, "1646395560000": six, "1646395560000000": six, "44624.2125": six, "2022-03-04 05:06:00.4995": six + 500, "1646395560000499": six, "1646395560000500": six + 1,
        "3/4/2022 12:06:00 AM": ms(2022, 3, 4, 7, 6), "3/4/2022 12:06:00 PM": ms(2022, 3, 4, 19, 6), "2022-06-31 24:61": None, "2022-02-30 01:00:00": None, "2022-02-29 01:00:00": None, "2023-366 01:00": None,
        "2024-366 01:00": ms(2024, 12, 31, 8), "": None, None: None, "null": None, "2022": None, "x" * 100_000: None, "2022-03-04 05:06:00 XYZ": None, "99999999999": None, "2022-03-0": None,
    }
    log = [("a", i, t) for i, t in enumerate(texts)] + [("a", 90, "1/13/2022 00:00:00")]
    got = run(spark, log, [PHX[:1] + PHX[1:]])
    for (t, want), g in zip(texts.items(), got):
        assert g == want, (t, g, want)


def test_day_and_month_order_is_the_systems(spark):
    log = [("a", 1, "02/03/2022 00:00"), ("a", 2, "13/03/2022 00:00"), ("b", 1, "02/03/2022 00:00"), ("b", 2, "03/13/2022 00:00")]
    got = run(spark, log, [("a", "p", None, 0, 0.0, None, None), ("b", "p", None, 0, 0.0, None, 0)])
    assert got == [ms(2022, 3, 2), ms(2022, 3, 13), ms(2022, 2, 3), ms(2022, 3, 13)]


def test_corrections_and_offsets(spark):
    meta = [("a", "p", None, None, 3.0, "Europe/Berlin", 2), ("b", "p", None, 0, 5.5, None, None), ("c", "p", None, 0, float("nan"), None, 1), ("d", "p", None, 1, -2.0, None, 5)]
    log = [("a", 1, "2022-07-01 00:00:00"), ("b", 1, "2022-07-01 00:00:00"), ("c", 1, "2022-07-01 00:00:00"), ("c", 2, "2022-07-01 00:00:00Z"), ("d", 1, "2022-07-01 00:00:00"), ("none", 1, "2022-07-01 00:00:00"), (None, 1, "1646395560")]
    first = ms(2022, 7, 1)
    assert run(spark, log, meta) == [first + 3_600_000, first - 19_800_000, None, first, first + 7_200_000, None, 1646395560000]


def test_repeated_hour_by_order_against_brute_force(spark):
    rng = np.random.default_rng(4)
    for zone in ("America/New_York", "Australia/Adelaide", "Europe/Berlin"):
        z = ZoneInfo(zone)
        change = next(t for t in (datetime(2022, 1, 1, tzinfo=UTC) + timedelta(hours=h) for h in range(8760)) if t.astimezone(z).utcoffset() > (t + timedelta(hours=1)).astimezone(z).utcoffset())
        log, want = [], []
        for seq, minute in enumerate(range(-240, 240, 10)):
            t = change + timedelta(minutes=minute)
            want.append(round(t.timestamp() * 1000))
            text = t.strftime("%Y-%m-%dT%H:%M:%SZ") if rng.random() < 0.2 else t.astimezone(z).strftime("%Y-%m-%d %H:%M:%S")
            log.append(("a", seq * 3, text))
        order = rng.permutation(len(log))
        got = run(spark, [log[i] for i in order], [("a", "p", None, 1, None, zone, 4)])
        assert got == [want[i] for i in order], zone


def test_zone_table_against_zoneinfo():
    for zone in ("America/New_York", "America/Phoenix", "Australia/Adelaide", "Africa/Casablanca"):
        z = ZoneInfo(zone)
        for _, year, segments, folds in clocks.zone_segments(zone, [1985, 2012, 2020, 2023, 2040, 2101, 2450, 9998]):
            assert [s[1] for s in segments[:-1]] == [s[0] for s in segments[1:]]
            for hour in range(0, 8700, 37):
                t = datetime(year, 1, 1, 14, tzinfo=UTC) + timedelta(hours=hour)
                at = (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)
                assert [s[2] for s in segments if s[0] <= at < s[1]] == [t.astimezone(z).utcoffset().total_seconds() * 1000]
    assert len(clocks.zone_segments("Africa/Casablanca", [2012])[0][2]) == 5
    assert clocks.zone_segments("No/Where", [2020]) == []


def test_all_years_and_all_changes_of_a_year(spark):
    berlin, casablanca = ("a", "p", None, 1, None, "Europe/Berlin", 0), ("b", "p", None, 1, None, "Africa/Casablanca", 0)
    texts = ["2040-07-01 12:00", "1985-07-01 12:00", "1970-07-01 12:00", "2500-07-01 12:00", "9999-12-31 23:00", "0001-01-01 00:00"]
    days = [f"2012-{m:02d}-{d:02d} 12:00" for m in range(1, 13) for d in (1, 15, 28)]
    log = [("a", i, t) for i, t in enumerate(texts)] + [("b", i, t) for i, t in enumerate(days)]
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([("s", *r, at) for r in (berlin, casablanca)], META)
    z = spark.createDataFrame([("Europe/Berlin", 1.0, 2.0, "CET", "CEST"), ("Africa/Casablanca", 0.0, 1.0, "WET", "WEST")], "time_zone string, std_offset_h double, dst_offset_h double, std_abbr string, dst_abbr string")
    rows = [(i, "s", s, q, t, 1.0, "clash", 7) for i, (s, q, t) in enumerate(log)]
    got = {r.rec_id: r for r in clocks.utc_times(spark.createDataFrame(rows, LOG), m, z).collect()}
    for i, (s, _, t) in enumerate(log):
        local = datetime.strptime(t, "%Y-%m-%d %H:%M").replace(tzinfo=ZoneInfo("Europe/Berlin" if s == "a" else "Africa/Casablanca"))
        want = (local.replace(tzinfo=None) - local.utcoffset() - datetime(1970, 1, 1)) // timedelta(milliseconds=1) if t[:4] != "0001" else None
        if want is not None:
            assert got[i].utc_ms == want and got[i].source == "zone", t
        assert got[i].tz_version == clocks.tz_version()


def test_a_shared_abbreviation_is_that_of_the_systems_zone(spark):
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([("s", k, "p", None, 0, 0.0, z, 0, at) for k, z in (("a", "Asia/Shanghai"), ("b", "America/Chicago"), ("c", None))], META)
    z = spark.createDataFrame([("Asia/Shanghai", 8.0, None, "CST", None), ("America/Chicago", -6.0, -5.0, "CST", "CDT")], "time_zone string, std_offset_h double, dst_offset_h double, std_abbr string, dst_abbr string")
    log = spark.createDataFrame([(i, "s", k, 1, "2022-01-01 00:00:00 CST", 1.0, "", 0) for i, k in enumerate("abc")], LOG)
    got = {r.rec_id: r.utc_ms for r in clocks.found(log, m, z).collect()}
    assert [got[i] - ms(2022, 1, 1) for i in range(3)] == [-8 * 3_600_000, 6 * 3_600_000, 6 * 3_600_000]


def test_masks_are_told_apart_and_read_once():
    texts = ["2022-03-04 05:06:00", None, "", "2022-03-04 05:06:00", "x" * 80, "é", "3/4/2022 5:06:00 am", "14/3/2022 00:00"]
    reader = stamps.Reader()
    got = {k: v.to_pylist() for k, v in reader.read(pa.array(texts)).items()}
    assert got["mask"][0] == got["mask"][3] == "9999-99-99 99:99:99" and got["mask"][1] is None and got["mask"][4] is None
    assert got["family"] == ["iso", None, None, "iso", None, None, "slash", "slash"]
    assert got["clock"][6] == ms(2022, 3, 4, 5, 6) and got["swapped"][6] == ms(2022, 4, 3, 5, 6) and got["hint"][7] == 1 and got["clock"][7] is None
    sliced = {k: v.to_pylist() for k, v in reader.read(pa.array(texts).slice(3, 4)).items()}
    assert all(sliced[k] == v[3:7] for k, v in got.items())
    assert reader.read(pa.array([], pa.string()))["mask"].to_pylist() == []


def test_latest_metadata_and_empty_tables(spark):
    old, new = datetime(2020, 1, 1), datetime(2021, 1, 1)
    m = spark.createDataFrame([("s", "a", "p", 5.0, 0, 1.0, None, 0, new), ("s", "a", "p", 5.0, 0, 9.0, None, 0, old), ("s", "a", "p", 5.0, 0, 1.0, None, 0, new), ("s", None, "p", 5.0, 0, 1.0, None, 0, new)], META)
    assert [(r.system, r.gmt_offset) for r in clocks.latest_metadata(m).collect()] == [("a", 1.0)]
    assert run(spark, [], []) == []
