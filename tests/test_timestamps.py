from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import timestamps as T


def us(*a):
    return int((datetime(*a) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


INSTANTS = [
    ("2025-12-23T05:03:05.000Z", us(2025, 12, 23, 5, 3, 5)), ("2019-02-28 04:30:37.813366562+00:00", us(2019, 2, 28, 4, 30, 37, 813366)),
    ("20191017T155800+0100", us(2019, 10, 17, 14, 58)), (" 2023-05-25t00:03:43z", us(2023, 5, 25, 0, 3, 43)), ("2021-08-28 07:22:01 IST", us(2021, 8, 28, 6, 22, 1)),
    ("2024-06-22 03:46:15 +01", us(2024, 6, 22, 2, 46, 15)), ("Sun, 14 Dec 2025 00:00:05 GMT", us(2025, 12, 14, 0, 0, 5)), ("2016-09-21T10:45:00-05:00", us(2016, 9, 21, 15, 45)),
    ("2019-10-22 22:30:19 CEST", us(2019, 10, 22, 20, 30, 19)), ("1571208900", 1571208900 * 10**6), ("1767014225000", 1767014225 * 10**6),
    ("2016-02-29T24:00:00Z", us(2016, 3, 1)), ("2018-11-23 20:37 UTC", us(2018, 11, 23, 20, 37)),
]
CLOCKS = [
    ("15/10/19 00:30", "dmy", us(2019, 10, 15, 0, 30)), ("6/22/2024 1:01:03", "mdy", us(2024, 6, 22, 1, 1, 3)), ("15/10/19 00:30", "ymd", us(2015, 10, 19, 0, 30)),
    ("22.10.2025 14:48:20,000", "dmy", us(2025, 10, 22, 14, 48, 20)), ("2020-285T08:16:04", "ymd", us(2020, 10, 11, 8, 16, 4)), ("17-Oct-2025 13:00:00", "ymd", us(2025, 10, 17, 13)),
    ("03/29/2023 12:07 AM", "mdy", us(2023, 3, 29, 0, 7)), ("03/29/2023 12:07 PM", "mdy", us(2023, 3, 29, 12, 7)), ("25/10/2019 24:00", "dmy", us(2019, 10, 26)),
    ("2023/10/23 05:46", "", us(2023, 10, 23, 5, 46)), ("2023-02-21T21:15", "ymd", us(2023, 2, 21, 21, 15)),
]
NOTHING = [
    None, "", "not-a-time", "NaN", "#REF!", "-", "2018-07", "25:61", "2022-11-31 06:00:00+00:00", "2021-13-01T00:00:00Z", "0000-00-00 00:00:00", "2020-06-07T24:15:00Z",
    "31/04/2021 08:15", "2019-02-30 10:00:00", "2019-02-28 10:00:00 XYZ", "13:07 PM 2020-01-01", "2019-366T00:00:00", "x" * 100_000, "٢٠١٩-٠١-٠١T00:00:00Z", "2019-01-01 25:00",
]


def read(texts, orders=None):
    return T.read_texts(pa.array(texts, pa.string()), np.array(orders or ["ymd"] * len(texts), dtype=object))


def test_texts_that_name_their_zone():
    utc, local = read([t for t, _ in INSTANTS])
    assert utc.tolist() == [u for _, u in INSTANTS]
    assert (local == T.NONE).all()


def test_clock_times():
    utc, local = read([t for t, _, _ in CLOCKS], [o for _, o, _ in CLOCKS])
    assert local.tolist() == [u for _, _, u in CLOCKS]
    assert (utc == T.NONE).all()


def test_texts_that_denote_nothing():
    utc, local = read(NOTHING)
    assert (utc == T.NONE).all() and (local == T.NONE).all()
    assert read(["01/02/2020 10:00"], [""])[1][0] == T.NONE  # no order known


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Dublin", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe"]))
def test_clock_times_agree_with_the_zone_database(t, zone):
    t = t.replace(microsecond=0)
    z = ZoneInfo(zone)
    offsets = [t.replace(tzinfo=z, fold=f).utcoffset() for f in (0, 1)]
    clock = int((t - datetime(1970, 1, 1)).total_seconds()) * T.SECOND
    first, second, _, _ = (x[0] for x in T.place_clock(np.array([clock]), zone))
    if offsets[0] < offsets[1]:
        assert first == T.NONE
    else:
        want = [int((t.replace(tzinfo=timezone.utc) - o).timestamp()) * T.SECOND for o in offsets]
        assert [first, second] == want


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "reading_id long, file_id long, line_no int, station_ref string, datetime string, ingested_at timestamp" + extra)


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, station_ref string, seq_no int, clock_zone string, date_order string")


NOW = datetime(2030, 1, 1)


def placed(spark, readings, fs, **kw):
    return {r.reading_id: r.utc_us for r in T.to_instants(readings, fs, **kw).collect()}


def test_repeated_hour_is_resolved_by_recording_order(spark):
    texts = ["00:30", "01:00", "01:30", "01:00", "01:30", "02:00"]
    rows = [(i, 1, i, "g", f"2024-10-27T{t}", NOW) for i, t in enumerate(texts)]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "g", 1, "Europe/Dublin", "ymd")]))
    start = us(2024, 10, 26, 23, 30)
    assert [got[i] - start for i in range(6)] == [k * 1800 * T.SECOND for k in range(6)]


def test_repeated_hour_without_a_wrap_follows_the_cadence(spark):
    rows = [(i, 1, i, "g", f"2024-10-27T{t}", NOW) for i, t in enumerate(["00:30", "01:00", "01:30", "03:00", "03:30"])]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "g", 1, "Europe/Dublin", "ymd")]))
    assert got[1] - got[0] == 1800 * T.SECOND and got[2] - got[1] == 1800 * T.SECOND


def test_skipped_hour_and_unknown_zone_denote_nothing(spark):
    rows = [(1, 1, 1, "g", "2024-03-31T01:30", NOW), (2, 1, 2, "g", "2024-03-31T02:30", NOW), (3, 9, 1, "g", "2024-03-31T02:30", NOW), (4, None, None, None, None, None)]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "g", 1, "Europe/Dublin", "ymd")]))
    assert got == {1: None, 2: us(2024, 3, 31, 1, 30), 3: None, 4: None}


def test_posix_signs_and_plain_offsets(spark):
    rows = [(i, i, 1, "g", "2024-01-01T12:00", NOW) for i in (1, 2, 3)]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "g", 1, "Etc/GMT+1", "ymd"), (2, "g", 2, "+01:00", "ymd"), (3, "g", 3, "no/zone", "ymd")]), estimate_zones=False)
    assert got == {1: us(2024, 1, 1, 13), 2: us(2024, 1, 1, 11), 3: None}


def test_missing_zone_is_estimated_from_arrival_and_neighbours(spark):
    # the unknown file continues one that ends at 10:00 UTC and is followed by one from 14:00 UTC on
    rows = [(1, 1, 1, "g", "2024-01-05T09:45:00.000Z", NOW), (2, 1, 2, "g", "2024-01-05T10:00:00.000Z", NOW)]
    rows += [(10 + k, 2, k, "g", f"2024-01-05T{15 + k // 4:02d}:{15 * (k % 4):02d}", datetime(2024, 1, 5, 14, 0)) for k in range(1, 16)]
    rows += [(90, 3, 1, "g", "2024-01-05T14:00:00.000Z", NOW)]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "g", 1, "UTC", "ymd"), (2, "g", 2, None, "ymd"), (3, "g", 3, "UTC", "ymd")]))
    assert got[11] == us(2024, 1, 5, 10, 15)


def test_clashing_names_repeats_and_empty(spark):
    rows = [(1, 1, 1, "g", "2024-01-01T12:00", NOW, 1, 2)] * 2
    df = frame(spark, rows, ", f int, change int")
    fs = files(spark, [(1, "g", 1, "UTC", "ymd")] * 2)
    got = T.to_instants(df, fs)
    assert got.columns == [*df.columns, "utc_us"] and got.count() == 2
    assert T.to_instants(df.limit(0), fs).count() == 0
    assert T.restated_instants(frame(spark, rows[:0]), fs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1850, 1, 1), datetime(9990, 1, 1)), st.sampled_from(["Europe/Dublin", "Europe/Berlin", "America/New_York"]))
def test_clock_times_of_any_year_agree_with_the_zone_database(t, zone):
    t = t.replace(microsecond=0)
    offset = t.replace(tzinfo=ZoneInfo(zone)).utcoffset()
    first, second, _, _ = (x[0] for x in T.place_clock(np.array([us(*t.timetuple()[:6])]), zone))
    if first != T.NONE:  # else skipped, as the other property test has it
        assert us(*t.timetuple()[:6]) - int(offset.total_seconds()) * T.SECOND in (first, second)


def test_years_long_past_and_long_to_come(spark):
    texts = {1: "1960-01-15 12:00", 2: "1965-07-15 12:00", 3: "2110-07-15 12:00", 4: "2837-07-15 12:00"}
    zones = {1: "Europe/Dublin", 2: "America/New_York", 3: "Europe/Berlin", 4: "Europe/Berlin"}
    got = placed(spark, frame(spark, [(k, k, 1, "g", t, NOW) for k, t in texts.items()]), files(spark, [(k, "g", k, z, "ymd") for k, z in zones.items()]))
    assert got == {1: us(1960, 1, 15, 12), 2: us(1965, 7, 15, 16), 3: us(2110, 7, 15, 10), 4: us(2837, 7, 15, 10)}


def test_padded_texts_of_any_length_are_read():
    assert read(["2024-01-01" + " " * 500 + "10:00Z"])[0][0] == us(2024, 1, 1, 10)


def test_lines_with_a_zone_of_their_own_bind_the_repeated_hour(spark):
    texts = ["2024-10-27T01:20", "2024-10-27T01:10:00+00:00", "2024-10-27T01:20", "2024-10-27T02:00"]
    got = placed(spark, frame(spark, [(i, 1, i, "g", t, NOW) for i, t in enumerate(texts)]), files(spark, [(1, "g", 1, "Europe/Dublin", "ymd")]))
    assert [got[0], got[2]] == [us(2024, 10, 27, 0, 20), us(2024, 10, 27, 1, 20)]


def test_lines_left_out_decide_all_the_same(spark):
    texts = ["00:30", "01:00", "01:30", "01:00", "01:30", "02:00"]
    rows = frame(spark, [(i, 1, i, "g", f"2024-10-27T{t}", NOW) for i, t in enumerate(texts)])
    fs = files(spark, [(1, "g", 1, "Europe/Dublin", "ymd")])
    all_ = placed(spark, rows, fs)
    assert placed(spark, rows, fs, only=F.col("reading_id") == 3) == {3: all_[3]}


def test_a_skipped_clock_time_rules_a_zone_out(spark):
    # 01:30 on 31 March does not exist in Dublin, yet its arrival fits Dublin's offset of later in the day best
    rows = [(k, 2, k, "g", t, datetime(2024, 3, 31, 12, 0)) for k, t in enumerate(["2024-03-31T01:15", "2024-03-31T01:30", "2024-03-31T12:55"])]
    got = placed(spark, frame(spark, rows), files(spark, [(1, "h", 1, "Europe/Dublin", "ymd"), (2, "g", 2, None, "ymd")]))
    assert got[1] == us(2024, 3, 31, 0, 30)


def test_readings_between_a_files_ends_count_for_its_zone(spark):
    # lines out of order: only a middle one arrives before it could have been taken under +00:00
    rows = [(1, 2, 1, "g", "2024-01-05T10:00", datetime(2024, 1, 5, 23)), (2, 2, 2, "g", "2024-01-05T11:00", datetime(2024, 1, 5, 9, 30)), (3, 2, 3, "g", "2024-01-05T12:00", datetime(2024, 1, 5, 23))]
    got = placed(spark, frame(spark, rows), files(spark, [(2, "g", 2, None, "ymd")]))
    assert got[2] == us(2024, 1, 5, 9)
