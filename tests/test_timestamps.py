import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np

from opinara.operators import timestamps as ts

LOCALES = [("google_play", "in", "Asia/Kolkata", "dmy"), ("google_play", "us", "America/New_York", "mdy"), ("app_store", "de", "Europe/Berlin", "dmy")]
ABBREVIATIONS = [("IST", 330), ("GMT", 0), ("UTC", 0), ("EST", -300)]
DDL = "landing_id bigint, source string, country string, published_at string, scraped_at string, created_at string, zone_name string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], DDL)
    loc = spark.createDataFrame(LOCALES, "source_name string, country_code string, zone_name string, date_order string")
    abb = spark.createDataFrame(ABBREVIATIONS, "abbreviation string, utc_offset_minutes int")
    return {(r["landing_id"], r["field_name"]): r["utc_micros"] for r in ts.normalise_timestamps(df, loc, abb, **kw).collect()}


def at(*a, tz="UTC", us=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(tz)).timestamp()) * 1_000_000 + us


def test_notations(spark):
    cases = [
        ("google_play", "in", "2026-06-24T07:44:51", at(2026, 6, 24, 7, 44, 51, tz="Asia/Kolkata")),
        ("Google-Play ", " IN", "2026-06-24", at(2026, 6, 24, tz="Asia/Kolkata")),
        ("google_play", "us", "03/29/2026 11:02 PM", at(2026, 3, 29, 23, 2, tz="America/New_York")),
        ("google_play", "in", "03/04/2026 11:02", at(2026, 4, 3, 11, 2, tz="Asia/Kolkata")),
        ("google_play", None, "03/04/2026 11:02", at(2026, 4, 3, 11, 2)),
        ("google_play", "us", "03.04.2026 11:02", at(2026, 4, 3, 11, 2, tz="America/New_York")),
        ("app_store", "de", "2026-03-29 02:30:00", at(2026, 3, 29, 1, 30)),  # skipped hour moves ahead
        ("app_store", "de", "2025-10-26 02:30:00", at(2025, 10, 26, 0, 30)),  # repeated hour: the earlier instant
        ("x", "in", "Dec 14, 2025, 5:17:34 PM IST", at(2025, 12, 14, 11, 47, 34)),
        ("x", "in", "Thu, 08 Jan 2026 07:40:44 +0530", at(2026, 1, 8, 2, 10, 44)),
        ("x", "in", "October 8, 2025 at 7:13 AM", at(2025, 10, 8, 7, 13)),
        ("x", "in", "2025-11-02T09:35:23[Europe/Berlin]", at(2025, 11, 2, 8, 35, 23)),
        ("x", "in", "2026-01-15 12:00:00 America/New_York", at(2026, 1, 15, 17)),
        ("x", "in", "2026-05-21T02:31:50+00", at(2026, 5, 21, 2, 31, 50)),
        ("x", "in", "2026-05-21T02:31:50.25+05:30", at(2026, 5, 20, 21, 1, 50, us=250000)),
        ("x", "in", "20260629T234754Z", at(2026, 6, 29, 23, 47, 54)),
        ("x", "in", "1771736528", 1771736528000000), ("x", "in", "1771736528500", 1771736528500000), ("x", "in", "1771736528500123", 1771736528500123),
    ]
    got = run(spark, [(i, s, c, v, None, None) for i, (s, c, v, _) in enumerate(cases)])
    for i, (*_, want) in enumerate(cases):
        assert got[i, "published_at"] == want, cases[i]


def test_unreadable_and_empty(spark):
    bad = [None, "", "  ", "-", "yesterday", "2026-02-30", "0000-00-00 00:00:00", "2026-13-45T00:00:00Z", "2026-01-01 10:00 Mars/Olympus", "2026-01-01 10:00 XYZT", "x" * 20000]
    assert run(spark, [(i, "s", None, v, v, v) for i, v in enumerate(bad)]) == {}
    assert run(spark, []) == {}


def test_blocks_give_one_viterbi(spark):
    rows = [(i, "google_play", "in", f"0{1 + i % 9}/0{1 + i % 7}/2026 10:00", None, None) for i in range(300)]
    assert run(spark, rows) == run(spark, rows, block_rows=40)


def test_order_decides_without_rule():
    # two readings of equal prior: the one that keeps format and time order wins
    fmt = np.array([[0, -1, -1, -1], [0, 1, -1, -1], [0, -1, -1, -1]])
    when = np.array([[10, 0, 0, 0], [5, 20, 0, 0], [30, 0, 0, 0]])
    prior = np.array([[0, np.inf, np.inf, np.inf], [0, 0, np.inf, np.inf], [0, np.inf, np.inf, np.inf]])
    cost = ts._transfer(fmt, when, prior)
    assert cost[0, 0] == 1.0  # stepping back once is cheaper than changing the format twice


def test_only_the_order_settles_dates_without_locale(spark):
    """Slash dates of a country without a locale row: their neighbours decide, also across blocks."""
    month_first = ["03/25/2026 10:00", "05/04/2026 10:00", "05/20/2026 10:00"]
    day_first = ["25/03/2026 10:00", "04/05/2026 10:00", "20/05/2026 10:00"]
    rows = [(i, s, "zz", v, None, None) for s, first, values in (("a", 0, month_first), ("b", 100, day_first)) for i, v in enumerate(values, first)]
    rows += [(51, "a", None, "05/04/2026 10:00", None, None)]
    for size in (100_000, 1):
        got = run(spark, rows, block_rows=size)
        assert got[1, "published_at"] == got[101, "published_at"] == at(2026, 5, 4, 10)
        assert got[51, "published_at"] == at(2026, 4, 5, 10)
