"""Timestamps of all notations, wall clocks around clock changes, and what denotes no instant."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.timestamps import with_instant

UTC = timezone.utc


def us(*parts, micro=0):
    return int((datetime(*parts, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + micro


def instants(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, v string, zone string, slash string")
    return {r.k: r.instant_us for r in with_instant(df, "v", "zone", "slash").collect()}


CASES = [
    ("2018-01-03T12:27:52.599897Z", "Europe/Berlin", "dmy", us(2018, 1, 3, 12, 27, 52, micro=599897)),
    ("2018-01-03T12:27:52.5+01:00", "Europe/Berlin", "dmy", us(2018, 1, 3, 11, 27, 52, micro=500000)),
    ("2018-01-03T19:10+1100", None, None, us(2018, 1, 3, 8, 10)),
    ("2016-10-24 22:45:07+00", None, None, us(2016, 10, 24, 22, 45, 7)),
    ("2018-07-04", "America/New_York", "mdy", us(2018, 7, 4, 4)),
    ("2017-08-29 22:18:28 EDT", "America/New_York", "mdy", us(2017, 8, 30, 2, 18, 28)),
    ("2018-07-01 10:00:00 CET", "Europe/Berlin", "dmy", us(2018, 7, 1, 9)),
    ("2018-07-01 10:00:00 EST", "Australia/Sydney", "dmy", us(2018, 7, 1, 0)),
    ("2018-07-01 10:00:00 IST", "Asia/Kolkata", "dmy", us(2018, 7, 1, 4, 30)),
    ("D:20170923122543+02'00'", None, None, us(2017, 9, 23, 10, 25, 43)),
    ("D:20170808135343Z00'00'", None, None, us(2017, 8, 8, 13, 53, 43)),
    ("D:2017", "UTC", "dmy", us(2017, 1, 1)),
    ("20180103T132445Z", None, None, us(2018, 1, 3, 13, 24, 45)),
    ("20180103091241", "Asia/Tokyo", "dmy", us(2018, 1, 3, 0, 12, 41)),
    ("1514988385", None, None, 1514988385 * 10**6), ("1515064182135", None, None, 1515064182135000),
    ("Wed, 03 Jan 2018 14:31:27 +0100", None, None, us(2018, 1, 3, 13, 31, 27)),
    ("Sun Apr 15 03:12:55 2018", "UTC", "dmy", us(2018, 4, 15, 3, 12, 55)),
    ("Jan 12, 2018 12:37:57 AM", "UTC", "mdy", us(2018, 1, 12, 0, 37, 57)),
    ("11/04/2018 01:45 PM", "UTC", "mdy", us(2018, 11, 4, 13, 45)), ("11/04/2018 01:45 PM", "UTC", "dmy", us(2018, 4, 11, 13, 45)),
    ("03.01.2018 10:44:43", "Europe/Berlin", "dmy", us(2018, 1, 3, 9, 44, 43)), ("13 July 2017 19:41:50", "UTC", "dmy", us(2017, 7, 13, 19, 41, 50)),
    # a wall time that occurs twice is the first; a skipped one moves on by the gap
    ("2018-10-28 02:30:00", "Europe/Berlin", "dmy", us(2018, 10, 28, 0, 30)), ("2018-03-25 02:30:00", "Europe/Berlin", "dmy", us(2018, 3, 25, 1, 30)),
    ("2024-02-29", "UTC", "dmy", us(2024, 2, 29)), ("2018-01-03T24:00:00", "UTC", "dmy", us(2018, 1, 4)),
    (None, "UTC", "dmy", None), ("", "UTC", "dmy", None), ("n/a", "UTC", "dmy", None), ("D:", "UTC", "dmy", None), ("2021-13-45 10:00", "UTC", "dmy", None),
    ("2023-02-29", "UTC", "dmy", None), ("2018-01-03 25:00:00", "UTC", "dmy", None), ("13:30 PM", "UTC", "dmy", None), ("2018-01-03", None, None, None), ("2018-01-03 10:00:00 QQQ", "UTC", "dmy", None),
]


def test_notations(spark):
    got = instants(spark, [c[:3] for c in CASES])
    assert {k: (CASES[k][0], v) for k, v in got.items()} == {k: (c[0], c[3]) for k, c in enumerate(CASES)}


def test_columns_stay(spark):
    df = spark.createDataFrame([("2018-01-03", "UTC", "dmy", 1)], "v string, zone string, slash string, instant_us int")
    out = with_instant(df, "v", "zone", "slash")
    assert out.columns == ["v", "zone", "slash", "instant_us"] and out.first().instant_us == us(2018, 1, 3)
    assert with_instant(df.limit(0), "v", "zone", "slash").count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.datetimes(datetime(1900, 1, 1), datetime(2100, 1, 1)), min_size=1, max_size=60))
def test_days(spark, times):
    got = instants(spark, [(t.isoformat(), "UTC", "dmy") for t in times])
    assert [got[k] for k in range(len(times))] == [us(t.year, t.month, t.day, t.hour, t.minute, t.second, micro=t.microsecond) for t in times]
