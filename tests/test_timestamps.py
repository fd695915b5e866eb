from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.functions import zones
from logloom.operators import timestamps as t

NONE = -(1 << 62)


def us(text, zone="UTC", order="DMY", load=None):
    days = NONE if load is None else (load - date(1970, 1, 1)).days
    value, ok = t.to_utc_us([text], [zone], [order], np.array([days]))
    return int(value[0]) if ok[0] else None


def at(*args, micros=0):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micros


@pytest.mark.parametrize(
    "text,zone,order,load,want",
    [
        ("2026-03-22T05:24:48.4181587+00:00", "UTC", "DMY", None, at(2026, 3, 22, 5, 24, 48, micros=418158)),
        ("2025-11-12 12:00:33 CET", "Europe/Berlin", "DMY", None, at(2025, 11, 12, 11, 0, 33)),
        ("2026-02-20 06:21:36 GMT-05:00", "America/New_York", "MDY", None, at(2026, 2, 20, 11, 21, 36)),
        ("2025-11-22 19:43:01.676 AEDT", "Australia/Sydney", "DMY", None, at(2025, 11, 22, 8, 43, 1, micros=676000)),
        ("2026-01-05 10:00:00 CST", "America/Chicago", "MDY", None, at(2026, 1, 5, 16)),
        ("2026-01-05 10:00:00 CST", "Europe/Berlin", "MDY", None, None),
        ("2025-11-03 06:00:00 NPT", "Asia/Kathmandu", "DMY", None, at(2025, 11, 3, 0, 15)),
        ("2025-10-12 15: 40: 02.153 Z", "UTC", "DMY", None, at(2025, 10, 12, 15, 40, 2, micros=153000)),
        ("04.11.2025 15:54:11", "Europe/Berlin", "MDY", None, at(2025, 11, 4, 14, 54, 11)),
        ("04/06/2026 5:47:14 AM", "UTC", "MDY", None, at(2026, 4, 6, 5, 47, 14)),
        ("04/06/2026 12:47:14 AM", "UTC", "DMY", None, at(2026, 6, 4, 0, 47, 14)),
        ("1/2/2026 13:00:00", "UTC", None, None, None),
        ("13/13/2026 13:00:00", "UTC", "DMY", None, None),
        ("Fri, 17 Apr 2026 15:25:02 GMT", "Asia/Tokyo", "DMY", None, at(2026, 4, 17, 15, 25, 2)),
        ("09/Mar/2026:07:38:50 -0300", "UTC", "DMY", None, at(2026, 3, 9, 10, 38, 50)),
        ("20260119T152917Z", "UTC", "DMY", None, at(2026, 1, 19, 15, 29, 17)),
        ("2026-03-27 10:29", "UTC", "DMY", None, at(2026, 3, 27, 10, 29)),
        ("April 17, 2026 1:51:26 PM", "UTC", "DMY", None, at(2026, 4, 17, 13, 51, 26)),
        ("28 April 2026 05:38:22", "UTC", "DMY", None, at(2026, 4, 28, 5, 38, 22)),
        ("Dec 31 16:15:47", "UTC", "DMY", date(2026, 1, 1), at(2025, 12, 31, 16, 15, 47)),
        ("Jan  1 16:15:47", "UTC", "DMY", date(2026, 1, 1), at(2026, 1, 1, 16, 15, 47)),
        ("Feb 29 16:15:47", "UTC", "DMY", date(2026, 1, 1), at(2024, 2, 29, 16, 15, 47)),
        ("Dec 31 16:15:47", "UTC", "DMY", None, None),
        ("1762725389", "Asia/Tokyo", "DMY", None, 1762725389_000000),
        ("1774775264291", "UTC", "DMY", None, 1774775264_291000),
        ("1776933135364055", "UTC", "DMY", None, 1776933135_364055),
        ("1774800225708072579", "UTC", "DMY", None, 1774800225_708072),
        ("/Date(1776275826032)/", "UTC", "DMY", None, 1776275826_032000),
        ("/Date(1776275826032+0100)/", "UTC", "DMY", None, 1776275826_032000),
        ("٢٠٢٥-١٢-٠١ ٠٢:٤٤:١٧ Z", "UTC", "DMY", None, at(2025, 12, 1, 2, 44, 17)),
        (' "2026-02-05 03:44:50 +00:00" ', "UTC", "DMY", None, at(2026, 2, 5, 3, 44, 50)),
        ("2026-04-15t08:00:06z", "UTC", "DMY", None, at(2026, 4, 15, 8, 0, 6)),
        ("2025-12-19T14:22:45+11", "UTC", "DMY", None, at(2025, 12, 19, 3, 22, 45)),
        ("2026-02-30 11:20:07", "UTC", "DMY", None, None),
        ("2026-01-09T27:61:00Z", "UTC", "DMY", None, None),
        ("T+00:14:09", "UTC", "DMY", None, None),
        ("2026-01-09 10:00:00", "Nowhere/Else", "DMY", None, None),
        ("2026-01-09 10:00:00", None, "DMY", None, None),
        ("Tue Mar 03 2026 14:05:06 GMT+0100 (Central European Standard Time)", "UTC", "DMY", None, at(2026, 3, 3, 13, 5, 6)),
        ("2026-03-03T14:05:06+01:00[Europe/Berlin]", "UTC", "DMY", None, at(2026, 3, 3, 13, 5, 6)),
        ("Wednesday, 15. September 2025, 10:00:00.123456 CEST", "Europe/Berlin", "DMY", None, at(2025, 9, 15, 8, micros=123456)),
        (" " * 500 + "2026-03-03T14:05:06Z" + " " * 500, "UTC", "DMY", None, at(2026, 3, 3, 14, 5, 6)),
        ("3. März 2026 14:05:06", "UTC", "DMY", None, at(2026, 3, 3, 14, 5, 6)),
        ("2026-062T14:05:06Z", "UTC", "DMY", None, at(2026, 3, 3, 14, 5, 6)),
        ("2025-366T14:05:06Z", "UTC", "DMY", None, None),
        ("2026-W10-2T14:05:06Z", "UTC", "DMY", None, at(2026, 3, 3, 14, 5, 6)),
        ("2026-W01-1T00:00:00Z", "UTC", "DMY", None, at(2025, 12, 29)),
        ("2025-W53-1T00:00:00Z", "UTC", "DMY", None, None),
        ("2026-03-03T24:00:00Z", "UTC", "DMY", None, at(2026, 3, 4)),
        ("2026-03-03T24:00:01Z", "UTC", "DMY", None, None),
        ("2016-12-31T23:59:60Z", "UTC", "DMY", None, at(2017, 1, 1)),
        ("2016-12-31T23:58:60Z", "UTC", "DMY", None, None),
        ("2045-07-01 12:00:00", "Europe/Berlin", "DMY", None, at(2045, 7, 1, 10)),
        ("2012-07-01 12:00:00 MSK", "Europe/Moscow", "DMY", None, at(2012, 7, 1, 8)),
        ("2026-07-01 12:00:00 MSK", "Europe/Moscow", "DMY", None, at(2026, 7, 1, 9)),
        ("2026-07-01 12:00:00 CET", "Europe/Berlin", "DMY", None, at(2026, 7, 1, 11)),
        ("A" * 50_000 + "(", "UTC", "DMY", None, None),
        (None, "UTC", "DMY", None, None),
        ("", "UTC", "DMY", None, None),
        ("x" * 100_000, "UTC", "DMY", None, None),
    ],
)
def test_texts(text, zone, order, load, want):
    assert us(text, zone, order, load) == want


def test_changes_of_offset():
    # A time that never occurs and one that occurs twice are read with the offset before the change.
    assert us("2026-03-29 02:30:00", "Europe/Berlin") == at(2026, 3, 29, 1, 30)
    assert us("2025-10-26 02:30:00", "Europe/Berlin") == at(2025, 10, 26, 0, 30)
    assert us("2025-10-26 03:00:00", "Europe/Berlin") == at(2025, 10, 26, 2)
    assert us("2025-10-26 02:30:00 CET", "Europe/Berlin") == at(2025, 10, 26, 1, 30)


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1975, 1, 1), datetime(2037, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Europe/Lisbon"]))
def test_zone_tables_against_the_library(local, name):
    want = local.replace(tzinfo=ZoneInfo(name), fold=0).timestamp()
    got = zones.table(name).to_utc(np.array([int((local - datetime(1970, 1, 1)).total_seconds()) * 1_000_000]))[0]
    assert got == int(want // 1) * 1_000_000


def test_tables_are_those_of_the_named_version(spark):
    sources = spark.createDataFrame([("a", "Europe/Berlin"), ("b", "No/Zone"), ("c", None), ("d", "../../etc/passwd")], "source_id string, time_zone string")
    tables = t.shared_tables(sources).value
    assert list(tables) == ["Europe/Berlin"] and zones.version() != "system"
    days, none = np.array([NONE] * 2), np.array(["DMY"] * 2)
    assert t.to_utc_us(["2026-01-01 00:00:00"] * 2, ["Europe/Berlin", "Asia/Tokyo"], none, days, tables)[1].tolist() == [True, False]


def test_operator(spark):
    sources = spark.createDataFrame([("a", "x", "Europe/Berlin", "DMY")], "source_id string, source_type string, time_zone string, date_order string")
    schema = "id bigint, source_id string, ts string, load_day date, utc_us string, _zone0 int"
    rows = [(1, "a", "2026-01-01 00:00:00", None, "clash", 1), (2, None, "2026-01-01T00:00:00Z", None, None, 2), (3, "b", "2026-01-01 00:00:00", None, None, 3), (4, "a", "0001-01-01T00:00:00", None, None, 4), (1, "a", "2026-01-01 00:00:00", None, "clash", 1)]
    got = t.normalize_timestamps(spark.createDataFrame(rows, schema), sources, "ts", "load_day").orderBy("id").collect()
    assert [r["utc_us"] for r in got] == [at(2025, 12, 31, 23)] * 2 + [at(2026, 1, 1), None, None]
    empty = spark.createDataFrame([], schema)
    assert t.normalize_timestamps(empty, sources, "ts", "load_day").count() == 0
