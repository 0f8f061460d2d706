import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from millrace.functions import instants

UTC = dt.UTC


def micros(*a, zone=UTC, us=0, fold=0):
    return int((dt.datetime(*a, fold=fold, tzinfo=zone) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**6 + us


LONDON, BERLIN, NEW_YORK = ZoneInfo("Europe/London"), ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("lon", "2024-03-18 10:11:45", micros(2024, 3, 18, 10, 11, 45, zone=LONDON)),
    ("lon", " 2024-07-01T09:00 ", micros(2024, 7, 1, 9, 0, zone=LONDON)),
    ("lon", "2024-07-01", micros(2024, 7, 1, zone=LONDON)),
    ("ber", "2024-04-18T14:33:49+02:00", micros(2024, 4, 18, 12, 33, 49)),
    ("ber", "2024-03-18 11:16:49.123456Z", micros(2024, 3, 18, 11, 16, 49, us=123456)),
    ("ber", "2024-09-30T17:28:37.979", micros(2024, 9, 30, 17, 28, 37, zone=BERLIN, us=979000)),
    ("ber", "2024-09-30T17:28:37.1234567", micros(2024, 9, 30, 17, 28, 37, zone=BERLIN, us=123456)),
    ("ber", "01.03.2024 14:58:28", micros(2024, 3, 1, 14, 58, 28, zone=BERLIN)),
    ("ber", "18 Mar 2024 11:16", micros(2024, 3, 18, 11, 16, zone=BERLIN)),
    ("ber", "2024/03/04 14:36:24", micros(2024, 3, 4, 14, 36, 24, zone=BERLIN)),
    ("ber", "20240303T160915+0100", micros(2024, 3, 3, 15, 9, 15)),
    ("ber", "20240320T104913", micros(2024, 3, 20, 10, 49, 13, zone=BERLIN)),
    ("ber", "1711365639", 1711365639 * 10**6),
    ("ber", "1711102975123", 1711102975123 * 1000),
    ("lon", "45438.5", micros(2024, 5, 26, 12, 0, zone=LONDON)),
    ("lon", "45438.6604398", micros(2024, 5, 26, 15, 51, 2, zone=LONDON)),
    ("lon", "2023-10-16 11:50 BST", micros(2023, 10, 16, 10, 50)),
    ("lon", "2024-04-24 12:55 CEST", micros(2024, 4, 24, 10, 55)),
    ("lon", "2025-03-01 11:34 EST", micros(2025, 3, 1, 16, 34)),
    ("lon", "2025-03-17 13:38 EDT", micros(2025, 3, 17, 17, 38)),
    ("nyc", "Sun, 19 May 2024 11:59:04 -0500", micros(2024, 5, 19, 16, 59, 4)),
    ("nyc", "3/24/2024 3:03 PM", micros(2024, 3, 24, 15, 3, zone=NEW_YORK)),
    ("nyc", "3/4/2024 12:00 AM", micros(2024, 3, 4, 0, 0, zone=NEW_YORK)),
    ("nyc", "3/4/2024 12:30 PM", micros(2024, 3, 4, 12, 30, zone=NEW_YORK)),
    ("lon", "24/3/2024 15:03", micros(2024, 3, 24, 15, 3, zone=LONDON)),
    ("lon", "4/3/2024 15:03", micros(2024, 3, 4, 15, 3, zone=LONDON)),
    ("ber", "2024-10-27 02:30:00", micros(2024, 10, 27, 0, 30)),  # repeated: the earlier
    ("ber", "2024-03-31 02:30:00", micros(2024, 3, 31, 1, 30)),  # skipped: forward by the gap
    *[("lon", bad, None) for bad in (None, "", "  ", "TBC", "n/a", "31/02/2024 10:15", "0000-00-00 00:00:00", "2024-13-01", "2024-02-30 10:00", "2024-01-01 24:00:00", "2024-01-01 10:60", "2024-01-01 10:00 XYZ", "2024-01-01T10:00:00+25:00", "3/24/2024 13:03 PM", "x" * 5000)],
    ("none", "2024-03-18 10:11:45", None),
    ("none", "2024-03-18T10:11:45Z", micros(2024, 3, 18, 10, 11, 45)),
    ("odd", "2024-03-18 10:11:45", None),
    (None, "2024-03-18T10:11:45Z", micros(2024, 3, 18, 10, 11, 45)),
]


@pytest.fixture(scope="module")
def zones(spark):
    arrivals = [("lon", "Europe/London", 1), ("ber", "Europe/Berlin", 1), ("nyc", "America/New_York", 1), ("odd", "Mars/Olympus", 1), ("lon", "Europe/Berlin", 2), (None, "UTC", 3)]
    df = spark.createDataFrame(arrivals, "file_hash string, site_zone string, intake_id long").withColumn("received_at", F.timestamp_seconds("intake_id"))
    return instants.file_zones(df)


def test_every_form(spark, zones):
    data = [(k, f, t, want) for k, (f, t, want) in enumerate(CASES)]
    df = spark.createDataFrame(data, "k int, source_file_id string, written string, want long")
    for r in instants.normalise(df, "written", "source_file_id", zones).collect():
        assert r.utc_micros == r.want, (r.source_file_id, r.written, r.form, r.utc_micros, r.want)


def test_clock_changes_are_named_and_agree_with_zoneinfo(spark, zones):
    r = random.Random(5)
    names = {"lon": LONDON, "ber": BERLIN, "nyc": NEW_YORK}
    data = []
    for k in range(600):
        f = r.choice(list(names))
        base = r.choice([dt.datetime(2024, 3, 31), dt.datetime(2024, 10, 27), dt.datetime(2024, 3, 10), dt.datetime(2024, 11, 3)])
        data.append((k, f, (base + dt.timedelta(minutes=r.randint(-60, 300))).strftime("%Y-%m-%dT%H:%M:%S")))
    out = instants.normalise(spark.createDataFrame(data, "k int, source_file_id string, written string"), "written", "source_file_id", zones)
    cases = set()
    for x in out.collect():
        zone, local = names[x.source_file_id], dt.datetime.fromisoformat(x.written)
        want = local.replace(tzinfo=zone, fold=0).astimezone(UTC)
        there = want.astimezone(zone).replace(tzinfo=None)
        case = "skipped" if there != local else "repeated" if (want + dt.timedelta(hours=1)).astimezone(zone).replace(tzinfo=None) == local else "plain"
        assert (x.utc_micros, x.clock_case) == (int(want.timestamp()) * 10**6, case), x
        cases.add(case)
    assert cases == {"skipped", "repeated", "plain"}


def test_a_file_without_evidence_takes_the_default(spark, zones):
    df = spark.createDataFrame([("ber", "4/3/2024 10:00"), ("lon", "13/3/2024 10:00"), ("lon", "3/13/2024 10:00"), ("lon", "1/2/2024 10:00")], "source_file_id string, written string")
    day = {r.written: r.utc_micros for r in instants.normalise(df, "written", "source_file_id", zones).collect()}
    month = {r.written: r.utc_micros for r in instants.normalise(df, "written", "source_file_id", zones, month_first_default=True).collect()}
    assert day["4/3/2024 10:00"] == micros(2024, 3, 4, 10, 0, zone=BERLIN) and month["4/3/2024 10:00"] == micros(2024, 4, 3, 10, 0, zone=BERLIN)
    assert day["3/13/2024 10:00"] is None and month["13/3/2024 10:00"] is None


def test_dates_that_do_not_exist_show_no_order(spark, zones):
    df = spark.createDataFrame([("nyc", "31/02/2024 10:15"), ("nyc", "31/02/2024 10:16"), ("nyc", "6/24/2024 1:45 PM"), ("nyc", "6/7/2024 1:45 PM")], "source_file_id string, written string")
    got = {r.written: r.utc_micros for r in instants.normalise(df, "written", "source_file_id", zones).collect()}
    assert got["31/02/2024 10:15"] is None
    assert got["6/24/2024 1:45 PM"] == micros(2024, 6, 24, 13, 45, zone=NEW_YORK) and got["6/7/2024 1:45 PM"] == micros(2024, 6, 7, 13, 45, zone=NEW_YORK)


def test_days_agree_with_the_calendar(spark):
    dates = [dt.date(1, 1, 1), dt.date(9999, 12, 31), *(dt.date(1890, 1, 1) + dt.timedelta(days=k) for k in range(0, 90_000, 7))]
    df = spark.createDataFrame([(d.year, d.month, d.day, (d - dt.date(1970, 1, 1)).days) for d in dates] + [(2023, 2, 29, None), (2024, 4, 31, None), (2024, 13, 1, None), (0, 1, 1, None)], "y int, m int, d int, want int")
    assert df.where(~instants._days(F.col("y"), F.col("m"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0


def test_empty(spark, zones):
    df = spark.createDataFrame([], "source_file_id string, written string, site_zone string, file_hash string")
    assert instants.normalise(df, "written", "source_file_id", zones).count() == 0


def test_overlaps_of_half_an_hour(spark):
    zone = "Australia/Lord_Howe"
    df = spark.createDataFrame([("f", "2024-04-07T01:45:00"), ("f", "2024-04-07T01:15:00"), ("f", "2024-10-06T02:15:00"), ("f", "2024-04-07T03:00:00")], "source_file_id string, written string")
    got = {r.written[5:16]: (r.utc_micros, r.clock_case) for r in instants.normalise(df, "written", "source_file_id", spark.createDataFrame([("f", zone)], "file_hash string, site_zone string")).collect()}
    assert got["04-07T01:45"] == (micros(2024, 4, 6, 14, 45), "repeated")
    assert got["04-07T01:15"][1] == got["04-07T03:00"][1] == "plain" and got["10-06T02:15"] == (micros(2024, 10, 5, 15, 45), "skipped")
