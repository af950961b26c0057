"""Mixed timestamps: the grammar by hand, zones against the time zone database, votes, and awkward tables."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cairnlake.llm import stamps

SCHEMA = "stamp_id long, source string, zone string, raw string"


def us(*when):
    return int(datetime(*when, tzinfo=UTC).timestamp()) * 1_000_000


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.stamp_id: (r.utc_us, r.rule, r.ambiguous) for r in stamps.normalise(df, **options).collect()}


GOOD = [
    ("1733025832", 1733025832_000_000, "epoch"), ("1733942329007", 1733942329007_000, "epoch"), ("0000000000", 0, "epoch"),
    ("2024-02-29", us(2024, 2, 29), "plain"), ("20240229", us(2024, 2, 29), "plain"), ("29.02.2024", us(2024, 2, 29), "plain"), ("29 Feb 2024", us(2024, 2, 29), "plain"),
    (" \t2024-01-02T03:04\v\f", us(2024, 1, 2, 3, 4), "plain"), ("2024-01-02 03:04:05", us(2024, 1, 2, 3, 4, 5), "plain"), ("20240102T12:00AM", us(2024, 1, 2), "plain"),
    ("2024-01-02 12:30 PM", us(2024, 1, 2, 12, 30), "plain"), ("2024-01-02 01:30PM", us(2024, 1, 2, 13, 30), "plain"), ("2024-01-02T03:04:05Z", us(2024, 1, 2, 3, 4, 5), "plain"),
    ("2024-01-02T03:04 +0530", us(2024, 1, 1, 21, 34), "plain"), ("2024-01-02T03:04-14:59", us(2024, 1, 2, 18, 3), "plain"), ("02 Jan 2024 03:04 AM Z", us(2024, 1, 2, 3, 4), "plain"),
    ("05/05/2024", us(2024, 5, 5), "plain"), ("31/12/2099", us(2099, 12, 31), "plain"), ("12/31/2024", us(2024, 12, 31), "plain"), ("01/02/2024", us(2024, 2, 1), "default"),
]
BAD = [
    None, "", " ", "2024-02-30", "2024-13-01", "1999-01-01", "2100-01-01", "2024-01-02T24:00", "2024-01-02T23:60", "2024-01-02T23:59:60", "2024-01-02 00:30 AM", "2024-01-02 13:30 PM",
    "2024-01-02  03:04", "2024-01-02T3:04", "2024-01-02T03:04+15:00", "2024-01-02T03:04+05:60", "2024-01-02T03:04+05", "2024-01-02Z", "2024-1-2", "2 Jan 2024", "02 jan 2024", "02 JAN 2024",
    "30/02/2024", "2024/01/02", "123456789", "12345678901", "12345678901234", "٢٠٢٤-01-02", "2024-01-02T", "2024-01-02t03:04", "2024-01-02T03:04z", "2024-01-02T03:04 ", "x", "02.01.2024.", "²0240102",
    "x" * 100_000, "2024-01-02T03:04am", "2024-01-02T03:04  PM",
]


def test_grammar(spark):
    rows = [(i, "s", "UTC", raw) for i, (raw, *_) in enumerate(GOOD)] + [(1000 + i, "s", "UTC", raw) for i, raw in enumerate(BAD)]
    got = found(spark, rows)
    # two slashed stamps vote once for each order: no side wins
    for i, (raw, instant, rule) in enumerate(GOOD):
        assert got[i] == (instant, rule, rule == "default"), raw
    for i, raw in enumerate(BAD):
        expected = (us(2024, 1, 2, 3, 4), "plain", False) if raw == "2024-01-02T03:04 " else (None, "bad", False)  # trailing blanks go
        assert got[1000 + i] == expected, raw


def test_votes(spark):
    """Over ten times the other's votes win; sources vote apart, the null source too; bad and two-way stamps do not vote."""
    rows, n = [], 0

    def add(source, raw, times=1):
        nonlocal n
        for _ in range(times):
            rows.append((n, source, "UTC", raw))
            n += 1

    asked = {}
    for source, day, month in (("a", 0, 1), ("b", 1, 10), ("c", 1, 11), ("d", 11, 1), ("e", 10, 1), ("f", 0, 0), (None, 0, 3)):
        add(source, "25/12/2024", day)
        add(source, "12/25/2024", month)
        add(source, "05/05/2024", 30)
        add(source, "25/12/2024 24:00", 50)
        asked[n] = source
        add(source, "03/04/2024")
    got = found(spark, rows)
    april, march = us(2024, 4, 3), us(2024, 3, 4)
    expected = {"a": (march, "votes", True), "b": (april, "default", True), "c": (march, "votes", True), "d": (april, "votes", True), "e": (april, "default", True), "f": (april, "default", True), None: (march, "votes", True)}
    assert {source: got[i] for i, source in asked.items()} == expected
    assert found(spark, rows, most_sources=1) == got  # verdicts joined instead of broadcast


def brute(wall, zone):
    """All instants at which the zone's clock shows a wall time, by trying every offset that the zone has near it."""
    rules = ZoneInfo(zone)
    near = [wall.replace(tzinfo=UTC) + timedelta(minutes=m) for m in range(-24 * 60, 24 * 60 + 1, 30)]
    offsets = {t.astimezone(rules).utcoffset() for t in near}
    hits = sorted({(wall - o).replace(tzinfo=UTC) for o in offsets if (wall - o).replace(tzinfo=UTC).astimezone(rules).replace(tzinfo=None) == wall})
    if len(hits) == 1:
        return hits[0], False
    after = (wall.replace(tzinfo=UTC) + timedelta(days=1)).astimezone(rules).utcoffset()
    return (wall - after).replace(tzinfo=UTC), True


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "America/Sao_Paulo", "Africa/Casablanca", "UTC"])
def test_zones_against_brute_force(zone):
    rng = random.Random(1)
    may, _, _ = stamps.changes(zone)
    times = [datetime(2000, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 365 * 90)) for _ in range(60)]
    times += [datetime.fromtimestamp(t, UTC).replace(tzinfo=None, second=0) + timedelta(minutes=m) for t in may[:30] for m in (-61, -1, 0, 1, 29, 30, 59, 60, 61)]
    for wall in times:
        instant, odd = brute(wall, zone)
        assert stamps.in_zone(int(wall.replace(tzinfo=UTC).timestamp()), zone) == (int(instant.timestamp()), odd), (zone, wall)


def test_awkward_rows(spark):
    """Unknown zones are bad where a zone is needed, and do not vote; repeated rows, clashing columns, empty table."""
    rows = [(1, "a", None, "2024-01-02"), (2, "a", "Nowhere/None", "2024-01-02"), (3, "a", None, "2024-01-02T00:00Z"), (4, "a", None, "1733025832"), (5, "a", "", "12/25/2024"), (6, "a", "UTC", "03/04/2024")]
    got = found(spark, rows)
    assert [got[i][1] for i in range(1, 7)] == ["bad", "bad", "plain", "epoch", "bad", "default"]
    assert found(spark, [(None, None, None, None)]) == {None: (None, "bad", False)}
    twice = spark.createDataFrame([(1, "a", "UTC", "2024-01-02")] * 2, SCHEMA).withColumns({c: F.lit("clash") for c in ("utc", "utc_us", "rule", "ambiguous", "verdict", "salt", "id")})
    assert [tuple(r) for r in stamps.normalise(twice).collect()] == [(1, datetime(2024, 1, 2), us(2024, 1, 2), "plain", False)] * 2
    assert stamps.normalise(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW stamps AS SELECT * FROM '{sf_dir}/stamps.parquet'")
    expected = sorted(con.execute(f"SELECT stamp_id, utc_us, rule, ambiguous FROM ({stamps.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in stamps.op11_mixed_stamps(spark, sf_dir).collect()) == expected
