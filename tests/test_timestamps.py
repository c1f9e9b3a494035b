from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from traceloom.functions.timestamps import normalise

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "UTC", "Australia/Sydney", "Asia/Tokyo", "Europe/London"]


def micros(spark, rows, zone="Europe/Berlin", near=None, **more):
    df = spark.createDataFrame([(i, t, s, n) for i, (t, s, n) in enumerate(rows)], "id long, text string, src string, near timestamp")
    zones = spark.createDataFrame([("a", zone), ("b", "America/New_York"), ("b", "America/New_York")], "filename string, zone_name string")
    out = normalise(df, "text", "src", zones, near=near, **more).collect()
    return [r.utc_micros for r in sorted(out, key=lambda r: r.id)]


def at(*parts, zone="UTC", fold=0, micro=0):
    moment = dt.datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold)
    return int(moment.timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2023-01-02 00:38:31 +0530", at(2023, 1, 1, 19, 8, 31)),
        ("2023-01-06T03:29:41+01:00", at(2023, 1, 6, 2, 29, 41)),
        ("2023-01-03T12:40:55Z", at(2023, 1, 3, 12, 40, 55)),
        ("2022-12-03T13:22:48.828027Z", at(2022, 12, 3, 13, 22, 48, micro=828027)),
        ("2022-12-13T04:08:31,608+00:00", at(2022, 12, 13, 4, 8, 31, micro=608000)),
        ("Tue Jan 10 09:28:32 2023 +0100", at(2023, 1, 10, 8, 28, 32)),
        ("Tue Jan 10 09:28:32 2023", at(2023, 1, 10, 8, 28, 32)),
        ("Tue Jan 10 09:28:32 CET 2023", at(2023, 1, 10, 8, 28, 32)),
        ("Tue, 10 Jan 2023 13:19:30 -0800", at(2023, 1, 10, 21, 19, 30)),
        ("1672915543", 1672915543 * 10**6),
        ("1673107394 +0100", 1673107394 * 10**6),
        ("1672079394947", 1672079394947 * 10**3),
        ("1672915543.25", 1672915543_250000),
        ("2022-11-29 01:52:24 EST", at(2022, 11, 29, 6, 52, 24)),
        ("2022-12-12T19:28:58[America/Los_Angeles]", at(2022, 12, 12, 19, 28, 58, zone="America/Los_Angeles")),
        ("2022-12-12T19:28:58[UTC]", at(2022, 12, 12, 19, 28, 58)),
        ("2022-12-12T19:28:58[america/los_angeles]", at(2022, 12, 12, 19, 28, 58, zone="America/Los_Angeles")),
        ("2022-12-12T19:28:58[Etc/GMT+5]", at(2022, 12, 13, 0, 28, 58)),
        ("2022-12-12T19:28:58[America/Port-au-Prince]", at(2022, 12, 12, 19, 28, 58, zone="America/Port-au-Prince")),
        ("2022-12-12T19:28:58[America/Port_of_Spain] ", at(2022, 12, 12, 19, 28, 58, zone="America/Port_of_Spain")),
        ("[2022-12-12 19:28:58]", at(2022, 12, 12, 18, 28, 58)),
        ("14.12.2022 10:09 Uhr", at(2022, 12, 14, 9, 9)),
        ("December 22, 2022 4:54 AM", at(2022, 12, 22, 3, 54)),
        ("26 Nov 2022, 11:06:58", at(2022, 11, 26, 10, 6, 58)),
        ("3. März 2023 um 8:05", at(2023, 3, 3, 7, 5)),
        ("20230105T204636Z", at(2023, 1, 5, 20, 46, 36)),
        (" 2023/01/02 14:51:05+00:00 ", at(2023, 1, 2, 14, 51, 5)),
        ("2022-12-21", at(2022, 12, 20, 23)),
        ("17/01/2023, 23:27:23", at(2023, 1, 17, 22, 27, 23)),
        ("24.01.23, 19:59", at(2023, 1, 24, 18, 59)),
        ("1/27/23, 1:27 PM", at(2023, 1, 27, 12, 27)),
        ("‎[27/01/2023, 12:00:00 AM]", at(2023, 1, 26, 23)),
        ("2023-10-29 02:30:00", at(2023, 10, 29, 0, 30)),  # twice: the first
        ("2023-03-26 02:30:00", at(2023, 3, 26, 1, 30)),  # skipped: moved forward
        ("2024-13-45", None),
        ("30.02.2023 10:00", None),
        ("2023-01-01 25:00:00", None),
        ("2023-01-01 10:00:00 QQQ", None),
        ("13:30 PM", None),
        ("yesterday", None),
        ("??/01/2023, 02:13:42", None),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_forms(spark, text, want):
    assert micros(spark, [(text, "a", None)]) == [want]


def test_gap_policy(spark):
    assert micros(spark, [("2023-03-26 02:30:00", "a", None), ("2023-03-26 03:30:00", "a", None)], gap_policy="null") == [None, at(2023, 3, 26, 1, 30)]


def test_order_of_day_and_month_is_one_per_source(spark):
    rows = [("03/04/2023, 10:00", "a", None), ("13/04/2023, 10:00", "a", None), ("03/04/2023, 10:00", "b", None), ("03/14/2023, 10:00", "b", None)]
    assert micros(spark, rows, zone="UTC") == [at(2023, 4, 3, 10), at(2023, 4, 13, 10), at(2023, 3, 4, 15), at(2023, 3, 14, 14)]


def test_undecided_order_takes_the_delivery_time_then_the_span(spark):
    near = dt.datetime(2023, 3, 4, 20)
    assert micros(spark, [("03/04/2023, 10:00", "a", near)], zone="UTC", near="near") == [at(2023, 3, 4, 10)]
    days = [(f"0{m}/05/2023, 10:00", "a", None) for m in (3, 4, 5)]
    assert micros(spark, days, zone="UTC")[1] == at(2023, 5, 4, 10)


def test_unknown_source(spark):
    assert micros(spark, [("2023-01-02 10:00:00", "nowhere", None), ("2023-01-02 10:00:00", None, None), ("2023-01-02T10:00:00Z", None, None)]) == [None, None, at(2023, 1, 2, 10)]


def test_against_zoneinfo(spark):
    r = random.Random(1)
    rows, want = [], []
    for _ in range(300):
        zone = r.choice(ZONES)
        moment = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=r.randrange(4 * 365 * 86400))
        local = moment.astimezone(ZoneInfo(zone))
        rows.append((local.strftime("%Y-%m-%dT%H:%M:%S") + f"[{zone}]", "a", None))
        want.append(int(local.replace(fold=0).timestamp()) * 10**6)
    assert micros(spark, rows) == want


def test_empty_and_clashing_columns(spark):
    zones = spark.createDataFrame([], "filename string, zone_name string")
    df = spark.createDataFrame([("2023-01-02T10:00:00Z", "a", "x", "y")], "t string, s string, _ts_text string, source string")
    assert normalise(df.limit(0), "t", "s", zones).collect() == []
    row = normalise(df, "t", "s", zones).first()
    assert (row.utc_micros, row["_ts_text"], row["source"]) == (at(2023, 1, 2, 10), "x", "y")
