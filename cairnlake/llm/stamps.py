"""Normalising mixed timestamps: texts in many forms become instants in UTC.

A recursive-descent scanner reads every stamp in ``mapPartitions`` and emits a parsed tuple: an epoch, a date and time, or a
slashed date that two orders can read. Slashed stamps that only one order can read vote for it in their source
(``reduceByKey``, so votes are added up before they are shuffled). The verdict of a source is the order with more than
``margin`` times the other's votes, day first without one. Each row is then finished alone: its verdict is looked up, and a
wall time without an offset finds its offset by bisection over the transitions of its zone.

Verdicts are broadcast while ``most_sources`` sources at most have slashed stamps (counted first); beyond, rows are joined with the
verdicts, every source dealt over ``SALTS`` keys. Nothing else leaves its task. Stamps are read again by
the second pass; only slashed ones are read by the first.

Defined results: null, empty or unreadable stamps, dates that no calendar has and wall times in a null or unknown zone are
``bad`` and never vote; the null source votes for itself; a wall time that its zone skips or repeats takes the
offset after the change and is ambiguous; repeated rows are separate rows; an empty table gives an empty result. Extra
columns are not read. Zones are those of the system's time zone database, which must be the same on all executors.
"""

from __future__ import annotations

from bisect import bisect_right
from datetime import UTC, date, datetime
from operator import add
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = "\x20\t\n\v\f\r"
PAIRS = {f"{n:02d}": n for n in range(100)}
# Month names, and the century that a stamp can have.
MONTHS = {"Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6, "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12}
CENTURY = "20"
#: Sources whose verdicts are broadcast (some 100 bytes each); with more of them, rows are joined with their verdicts.
MOST_SOURCES = 100_000
#: Keys over which a source is dealt in that join.
SALTS = 64
DAY_FIRST, MONTH_FIRST = 0, 1
EPOCH = date(1970, 1, 1).toordinal()
#: Filled within a task; never sent.
KNOWN_ZONES: dict = {}


class Unreadable(Exception):
    """The stamp does not follow the grammar."""


class Scanner:
    """One stamp, read from left to right; every method reads one part of the grammar or raises Unreadable."""

    __slots__ = ("at", "text")

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def take(self, wanted: str) -> bool:
        if self.text.startswith(wanted, self.at):
            self.at += len(wanted)
            return True
        return False

    def expect(self, wanted: str) -> None:
        if not self.text.startswith(wanted, self.at):
            raise Unreadable
        self.at += len(wanted)

    def two(self, high: int = 99) -> int:
        """Two digits."""
        value = PAIRS.get(self.text[self.at : self.at + 2], 100)
        if value > high:
            raise Unreadable
        self.at += 2
        return value

    def year(self) -> int:
        self.expect(CENTURY)
        return int(CENTURY) * 100 + self.two()

    def month_name(self) -> int:
        name = self.text[self.at : self.at + 3]
        if name not in MONTHS:
            raise Unreadable
        self.at += 3
        return MONTHS[name]

    def stamp(self) -> tuple:
        """("epoch", microseconds) or ("date", dates, seconds of the day, offset in seconds or None)."""
        text = self.text
        if len(text) in (10, 13) and text.isdigit() and text.isascii():
            return "epoch", int(text) * (1_000_000 if len(text) == 10 else 1_000)
        dates = self.date()
        seconds, offset = self.time() if self.at < len(text) else (0, None)
        if self.at < len(text):
            raise Unreadable
        return "date", dates, seconds, offset

    def date(self) -> tuple:
        """Days since 1970 by reading order: (day,) or, for slashes, (day first or None, month first or None)."""
        mark = self.text[2:3]
        if mark == "/":
            first = self.two()
            self.expect("/")
            second = self.two()
            self.expect("/")
            year = self.year()
            return calendar(year, second, first), calendar(year, first, second)
        if mark == ".":
            day = self.two()
            self.expect(".")
            month = self.two()
            self.expect(".")
            return (calendar(self.year(), month, day),)
        if mark == " ":
            day = self.two()
            self.expect(" ")
            month = self.month_name()
            self.expect(" ")
            return (calendar(self.year(), month, day),)
        year = self.year()
        dashed = self.take("-")
        month = self.two()
        if dashed:
            self.expect("-")
        return (calendar(year, month, self.two()),)

    def time(self) -> tuple:
        """Seconds of the day, and the offset in seconds or None."""
        if not (self.take("T") or self.take(" ")):
            raise Unreadable
        hour = self.two()
        self.expect(":")
        minute = self.two(59)
        second = self.two(59) if self.take(":") else 0
        half = self.half()
        if half is None:
            if hour > 23:
                raise Unreadable
        elif 1 <= hour <= 12:
            hour = hour % 12 + half
        else:
            raise Unreadable
        return hour * 3600 + minute * 60 + second, self.offset()

    def half(self) -> int | None:
        """0 for AM, 12 for PM, None (and nothing read) without either."""
        if self.at == len(self.text):
            return None
        for mark, hours in (("AM", 0), ("PM", 12), (" AM", 0), (" PM", 12)):
            if self.take(mark):
                return hours
        return None

    def offset(self) -> int | None:
        if self.at == len(self.text):
            return None
        self.take(" ")
        if self.take("Z"):
            return 0
        sign = 1 if self.take("+") else -1
        if sign < 0:
            self.expect("-")
        hour = self.two(14)
        self.take(":")
        return sign * (hour * 3600 + self.two(59) * 60)


def calendar(year: int, month: int, day: int) -> int | None:
    """Days since 1970, None for a date that does not exist."""
    try:
        return date(year, month, day).toordinal() - EPOCH
    except ValueError:
        return None


def scan(raw: str | None) -> tuple | None:
    """What ``Scanner.stamp`` reads, None for a bad stamp."""
    if raw is None:
        return None
    try:
        found = Scanner(raw.strip(BLANKS)).stamp()
    except Unreadable:
        return None
    return None if found[0] == "date" and not any(day is not None for day in found[1]) else found


def transitions(zone: str | None) -> tuple[list[int], list[int], list[int]] | None:
    """``changes`` of a zone, worked out once a task."""
    if zone not in KNOWN_ZONES:
        KNOWN_ZONES[zone] = changes(zone)
    return KNOWN_ZONES[zone]


def changes(zone: str | None, step: int = 7 * 86400) -> tuple[list[int], list[int], list[int]] | None:
    """Of a zone's changes of offset: the wall seconds from which each may hold and those from which it surely
    holds (in between, wall times are skipped or repeated), and the offsets before, between and after them. None for an
    unknown zone. No zone of the database has two changes within a step."""
    try:
        rules = ZoneInfo(zone)
    except (TypeError, ValueError, KeyError, OSError):
        return None
    begin, end = datetime(1999, 12, 25, tzinfo=UTC), datetime(2100, 1, 8, tzinfo=UTC)
    offset = lambda t: int(datetime.fromtimestamp(t, rules).utcoffset().total_seconds())
    at, last = int(begin.timestamp()), int(end.timestamp())
    before = offset(at)
    may, sure, offsets = [], [], [before]
    while at < last:
        after = offset(at + step)
        if after != before:
            low, high = at, at + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == before else (low, middle)
            may.append(high + min(before, after))
            sure.append(high + max(before, after))
            offsets.append(after)
            before = after
        at += step
    return may, sure, offsets


def in_zone(wall: int, zone: str | None) -> tuple[int, bool] | None:
    """UTC seconds of a wall time, and whether its zone skips or repeats it; None for an unknown zone."""
    table = transitions(zone)
    if table is None:
        return None
    may, sure, offsets = table
    n = bisect_right(may, wall)
    return wall - offsets[n], n > 0 and wall < sure[n - 1]


def parsed(rows):
    """(id, source, zone, what was scanned or None) of rows (id, source, zone, raw)."""
    for key, source, zone, raw in rows:
        found = scan(raw)
        if found is not None and found[0] == "date" and found[3] is None and transitions(zone) is None:
            found = None
        yield key, source, zone, found


def ballots(rows):
    """(source, (votes for day first, for month first)) of slashed stamps that one order only can read."""
    for _, source, _, found in parsed(rows):
        if found is not None and found[0] == "date" and len(found[1]) == 2 and None in found[1]:
            yield source, (int(found[1][1] is None), int(found[1][0] is None))


def finish(found: tuple | None, zone: str | None, verdict: int | None) -> tuple:
    """(microseconds since 1970 or None, rule, ambiguous) of a parsed stamp; verdict: the order its source voted for."""
    if found is None:
        return None, "bad", False
    if found[0] == "epoch":
        return found[1], "epoch", False
    _, dates, seconds, offset = found
    able = {day for day in dates if day is not None}
    if len(able) == 1:
        (day,) = able
        rule = "plain"
    else:
        day = dates[DAY_FIRST if verdict is None else verdict]
        rule = "default" if verdict is None else "votes"
    wall = day * 86400 + seconds
    instant, odd = (wall - offset, False) if offset is not None else in_zone(wall, zone)
    return instant * 1_000_000, rule, odd or rule != "plain"


def normalise(
    stamps: DataFrame,
    id_col: str = "stamp_id",
    source_col: str = "source",
    zone_col: str = "zone",
    raw_col: str = "raw",
    margin: int = 10,
    most_sources: int = MOST_SOURCES,
) -> DataFrame:
    """(id, utc, utc_us, rule, ambiguous) of every row; utc is the instant as a timestamp, utc_us its microseconds since 1970."""
    spark = stamps.sparkSession
    rows = stamps.select(stamps[id_col].alias("id"), stamps[source_col].alias("source"), stamps[zone_col].alias("zone"), stamps[raw_col].alias("raw"))
    slashed = rows.where(F.col("raw").contains("/"))
    votes = slashed.rdd.mapPartitions(ballots).reduceByKey(lambda a, b: tuple(map(add, a, b)))
    verdicts = votes.flatMapValues(lambda n: [DAY_FIRST] if n[0] > margin * n[1] else [MONTH_FIRST] if n[1] > margin * n[0] else [])
    schema = rows.select("id").schema.add("utc_us", "long").add("rule", "string").add("ambiguous", "boolean")

    if slashed.select("source").distinct().count() <= most_sources:
        known = spark.sparkContext.broadcast(verdicts.collectAsMap())
        done = rows.rdd.mapPartitions(lambda part: ((key, *finish(found, zone, known.value.get(source))) for key, source, zone, found in parsed(part)))
    else:
        table = spark.createDataFrame(verdicts, "source string, verdict int", verifySchema=False)
        dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # a wide hash of the row: equal stamps of a source differ in their ids
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "raw", "zone"), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, salted["source"].eqNullSafe(dealt["source"]) & (salted["salt"] == dealt["salt"]), "left")
        wide = joined.select(F.struct("id", "verdict").alias("key"), salted["source"], "zone", "raw")
        done = wide.rdd.mapPartitions(lambda part: ((key[0], *finish(found, zone, key[1])) for key, _, zone, found in parsed(part)))
    out = spark.createDataFrame(done, schema, verifySchema=False)
    return out.select(F.col("id").alias(id_col), F.timestamp_micros("utc_us").alias("utc"), "utc_us", "rule", "ambiguous")


def op11_mixed_stamps(spark, sf_dir: str) -> DataFrame:
    """Contract: every row of stamps, margin 10."""
    return normalise(spark.read.parquet(f"{sf_dir}/stamps.parquet")).select("stamp_id", "utc_us", "rule", "ambiguous")


def _offset(instant: str) -> str:
    """DuckDB: seconds by which the zone's wall clock is ahead of UTC at an instant given in seconds."""
    return f"(CAST(epoch(timezone(zone, to_timestamp({instant}))) AS BIGINT) - ({instant}))"


#: Written from the contract with patterns, apart from the scanner: each form is a regular expression.
ORACLE = rf"""
WITH s AS (SELECT stamp_id, source, zone, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS t FROM stamps),
f AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{10}}') THEN try_cast(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{{13}}') THEN try_cast(t AS BIGINT) * 1000 END AS ep,
    regexp_extract(t, '^(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|20[0-9]{{6}}|[0-9][0-9][.][0-9][0-9][.]20[0-9][0-9]|[0-9][0-9] (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9][0-9]|[0-9][0-9]/[0-9][0-9]/20[0-9][0-9])([T ].*)?$', 1) AS dt FROM s),
c AS (SELECT *, substring(t, length(dt) + 1) AS tm FROM f),
p AS (SELECT *, regexp_matches(dt, '/') AS slashed,
    CASE WHEN dt = '' THEN NULL
      WHEN regexp_full_match(dt, '[0-9]{{8}}') THEN left(dt, 4) || '-' || dt[5:6] || '-' || dt[7:8]
      WHEN regexp_matches(dt, '-') THEN dt
      WHEN regexp_matches(dt, '[A-Z]') THEN dt[8:11] || '-' || lpad(CAST(1 + (strpos('JanFebMarAprMayJunJulAugSepOctNovDec', dt[4:6]) - 1) // 3 AS VARCHAR), 2, '0') || '-' || dt[1:2]
      ELSE dt[7:10] || '-' || dt[4:5] || '-' || dt[1:2] END AS d1,
    CASE WHEN regexp_matches(dt, '/') THEN dt[7:10] || '-' || dt[1:2] || '-' || dt[4:5] END AS d2,
    tm = '' OR regexp_full_match(tm, '[T ][0-9][0-9]:[0-5][0-9](:[0-5][0-9])?( ?[AP]M)?( ?(Z|[+-](0[0-9]|1[0-4]):?[0-5][0-9]))?') AS tm_ok,
    regexp_extract(tm, ' ?([AP])M', 1) AS half, try_cast(nullif(tm[2:3], '') AS INT) AS hh, try_cast(nullif(tm[5:6], '') AS INT) AS mi, coalesce(try_cast(nullif(regexp_extract(tm, '^.{{6}}:([0-9][0-9])', 1), '') AS INT), 0) AS ss,
    regexp_extract(tm, '(Z|[+-][0-9:]+)$', 1) AS o FROM c),
q AS (SELECT *, (try_cast(d1 AS DATE) - DATE '1970-01-01') AS n1, (try_cast(d2 AS DATE) - DATE '1970-01-01') AS n2,
    tm_ok AND (tm = '' OR CASE WHEN half = '' THEN hh <= 23 ELSE hh BETWEEN 1 AND 12 END) AS good,
    CASE WHEN tm = '' THEN 0 ELSE CASE WHEN half = '' THEN hh ELSE hh % 12 + CASE half WHEN 'P' THEN 12 ELSE 0 END END * 3600 + mi * 60 + ss END AS sec,
    CASE WHEN o = '' THEN NULL WHEN o = 'Z' THEN 0 ELSE (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (try_cast(o[2:3] AS INT) * 3600 + try_cast(right(o, 2) AS INT) * 60) END AS shift FROM p),
r AS (SELECT *, ep IS NULL AND dt <> '' AND good AND (n1 IS NOT NULL OR n2 IS NOT NULL) AS dated FROM q),
v AS (SELECT source, count(*) FILTER (n2 IS NULL) AS dv, count(*) FILTER (n1 IS NULL) AS mv FROM r WHERE dated AND slashed GROUP BY source),
w AS (SELECT r.*, dated AND n1 <> n2 AS two, CASE WHEN mv > 10 * dv THEN 'm' WHEN dv > 10 * mv THEN 'd' END AS won FROM r LEFT JOIN v ON r.source IS NOT DISTINCT FROM v.source),
x AS (SELECT *, CASE WHEN dated THEN CAST(CASE WHEN two AND won = 'm' THEN n2 ELSE coalesce(n1, n2) END AS BIGINT) * 86400 + sec END AS wall FROM w),
y AS (SELECT *, {_offset("wall - 86400")} AS o1, {_offset("wall + 86400")} AS o2 FROM x),
z AS (SELECT *, shift IS NULL AND o1 <> o2 AND ({_offset("wall - o1")} = o1) = ({_offset("wall - o2")} = o2) AS odd,
    CASE WHEN shift IS NOT NULL THEN shift WHEN {_offset("wall - o2")} = o2 OR {_offset("wall - o1")} <> o1 THEN o2 ELSE o1 END AS used FROM y)
SELECT stamp_id, CASE WHEN dated THEN (wall - used) * 1000000 ELSE ep END AS utc_us,
  CASE WHEN ep IS NOT NULL THEN 'epoch' WHEN NOT coalesce(dated, FALSE) THEN 'bad' WHEN two AND won IS NOT NULL THEN 'votes' WHEN two THEN 'default' ELSE 'plain' END AS rule,
  coalesce(dated AND (two OR odd), FALSE) AS ambiguous FROM z
"""
