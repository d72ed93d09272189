"""Timestamps of many notations to microseconds of UTC, by a sweep over sorted wall times.

Wall times and the changes of their zones' offsets are range-partitioned and sorted together; every
wall time takes the offset of the last change before it, and what a range doesn't hold itself comes
from the ranges before it. No zone is gathered in one task. The order of days and months that a
source votes for reaches its rows by the same sweep.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut, fresh

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_Y, _D = "(20[0-9]{2})", "([0-9]{2})"
#: Groups: 1-3 y-m-d, 4-6 ymd, 7-9 d.m.y, 10-12 d b y, 13-15 slashed, 16-18 time, 19 half of the day, 20 offset.
PATTERN = (
    rf"^(?:{_Y}-{_D}-{_D}|{_Y}{_D}{_D}|{_D}\.{_D}\.{_Y}|{_D}\x20({'|'.join(MONTHS)})\x20{_Y}|{_D}/{_D}/{_Y})"
    rf"(?:[T\x20]([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9]))?)?\z"
)
#: The same groups as comma-separated fields: year, month, day, the two slashed numbers, hour, minute, second, half, offset.
FIELDS = "$1$4$9$12$15,$2$5$8$11,$3$6$7$10,$13,$14,$16,$17,$18,$19,$20"
FIRST_YEAR, END_YEAR = 2000, 2100
RESULTS = ("utc_us", "rule", "ambiguous")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, null for a date that doesn't exist."""
    return F.unix_date(F.concat_ws("-", year, month, day).try_cast("date"))


def parsed(raw: Column) -> dict[str, Column]:
    """By name: epoch_us of plain numbers; days, or the days of both orders of a slashed date; seconds of the day; offset in seconds.

    Null are all of a text that isn't a stamp. Fields of a stamp are null where it lacks them; a date
    that doesn't exist has no days.
    """
    text = F.btrim(raw, F.lit(SPACE))
    digits = text.rlike(r"^(?:[0-9]{10}|[0-9]{13})\z")
    number = F.when(digits, text).cast("long")
    f = F.when(text.rlike(PATTERN), F.split(F.regexp_replace(text, PATTERN, FIELDS), ",", -1))
    part = lambda i: F.get(f, F.lit(i))
    number_at = lambda i: F.coalesce(part(i).try_cast("int"), F.when(f.isNotNull(), 0))
    named = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), part(1)).cast("string"), 2, "0")
    month = F.when(part(1).rlike("^[A-Z]"), named).otherwise(part(1))
    hour, half, sign = number_at(5), part(8), F.substring(part(9), 1, 1)
    valid = (half == "") | hour.between(1, 12)
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0))
    size = F.substring(part(9), 2, 2).try_cast("int") * 3600 + F.substring(part(9), -2, 2).try_cast("int") * 60
    slashed = part(3) != ""
    return {
        "epoch_us": F.when(F.length(text) == 10, number * 1_000_000).otherwise(number * 1_000),
        "slashed": F.coalesce(slashed, F.lit(False)),
        "days": F.when(valid & ~slashed, _days(part(0), month, part(2))),
        "day_first": F.when(valid & slashed, _days(part(0), part(4), part(3))),
        "month_first": F.when(valid & slashed, _days(part(0), part(3), part(4))),
        "seconds": (hour * 3600 + number_at(6) * 60 + number_at(7)).cast("long"),
        "offset": F.when(sign == "Z", 0).when(sign == "+", size).when(sign == "-", -size),
    }


@lru_cache(maxsize=1)
def _zones() -> frozenset[str]:
    from zoneinfo import available_timezones

    if not (found := frozenset(available_timezones())):
        raise RuntimeError("this machine has no time zone database")
    return found


def offset_changes(zone: str) -> list[tuple[int, int, int]]:
    """(at, until, offset) in seconds: from wall time `at` the zone's offset is `offset`; wall times before `until` are skipped or repeated.

    The first has held since before 2000. A change to a later clock skips, one to an earlier repeats;
    either way wall times between the two take the offset after the change. No rows for an unknown zone.
    """
    if zone not in _zones():
        return []
    from zoneinfo import ZoneInfo

    tz = ZoneInfo(zone)
    at = lambda t: int((datetime.fromtimestamp(t, UTC).astimezone(tz)).utcoffset().total_seconds())
    day = 86400
    first = int((datetime(FIRST_YEAR, 1, 1, tzinfo=UTC) - timedelta(days=3)).timestamp())
    end = int((datetime(END_YEAR, 1, 1, tzinfo=UTC) + timedelta(days=3)).timestamp())
    before = at(first)
    found = [(first, first, before)]
    for t in range(first, end, day):
        after = at(t + day)
        if after == before:
            continue
        low, high = t, t + day  # the change is in (low, high]
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if at(middle) == before else (low, middle)
        found.append((high + min(before, after), high + max(before, after), after))
        before = after
    return found


def zone_changes(stamps: DataFrame, zone_col: str = "zone") -> DataFrame:
    """(zone, at, until, offset) of the known zones in the table; their number is bounded by the time zone database."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for zone in b.column(0).to_pylist():
                rows = offset_changes(zone)
                at, until, offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([zone] * len(rows), pa.string()), *map(pa.array, (at, until, offset))], ["zone", "at", "until", "offset"])

    named = stamps.select(F.col(zone_col).cast("string").alias("zone")).where("zone IS NOT NULL").distinct()
    return cut(named.mapInArrow(run, "zone string, at long, until long, offset long"))


def sweep(rows: DataFrame, marks: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """rows with the `carried` columns of the last mark at or before each of them in the order of the keys.

    Each row needs a mark with its own first key before it. Rows and marks are range-partitioned and
    sorted together, rows of equal keys by a hash of their columns, so that none, however frequent,
    fills a range. The last mark before a range, a row for each range, is broadcast; the rest is one
    pass over sorted rows.
    """
    name = fresh(rows, marks)
    by = [f"{name}k{i}" for i in range(len(keys))]
    own, tie, row, last, part, carry = (name + x for x in ("own", "tie", "row", "last", "part", "carry"))
    hashed = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    key = lambda df: [df[k].alias(b) for k, b in zip(keys, by, strict=True)]
    mark = F.struct(*carried)
    here = rows.select(*key(rows), F.lit(1).alias(own), F.xxhash64(*hashed).alias(tie), F.struct("*").alias(row), F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType).alias(last))
    there = marks.select(*key(marks), F.lit(0).alias(own), F.lit(0).cast("long").alias(tie), F.lit(None).cast(here.schema[row].dataType).alias(row), mark.alias(last))
    order = [*by, own, tie]
    placed = cut(here.unionAll(there).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    lasts = placed.groupBy(part).agg(F.max_by(last, F.when(F.col(own) == 0, F.struct(*by))).alias(last))
    before = lasts.select(part, F.last(last, ignorenulls=True).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)).alias(carry))
    # a row for each range, whatever is in it; the join leaves the order of rows as it is
    ordered = placed.join(F.broadcast(before), part, "left").select(own, row, last, carry)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if not b.num_rows:
                continue
            is_row = b.column(0).to_numpy() == 1
            if state is None:
                state = b.column(3).slice(0, 1)
            place = np.maximum.accumulate(np.where(is_row, 0, np.arange(1, b.num_rows + 1)))
            filled = pa.concat_arrays([state, b.column(2)]).take(pa.array(place))
            state = filled.slice(b.num_rows - 1, 1)
            keep = pa.array(is_row)
            yield pa.RecordBatch.from_arrays([b.column(1).filter(keep), filled.filter(keep)], [row, last])

    schema = ordered.select(row, last).schema
    return ordered.mapInArrow(fill, schema).select(f"{row}.*", *[F.col(f"{last}.{c}").alias(c) for c in carried])


def normalise(stamps: DataFrame, *, raw_col: str = "raw", zone_col: str = "zone", source_col: str = "source", over: float = 1.0) -> DataFrame:
    """stamps with utc_us (null for a bad stamp), rule and ambiguous; columns of these names are replaced.

    rule: bad, epoch, votes (the order of day and month that over `over` times as many of the source's
    unambiguous stamps have as have the other), default (day first), else plain. ambiguous: votes,
    default, and wall times that their zone skips or repeats, which take the offset after the change.
    A stamp without an offset and with a null or unknown zone is bad, and bad stamps don't vote. A
    null source is one like any other. Every row counts, repeated ones too; texts may be of any
    length; empty in, empty out.
    """
    name = fresh(stamps)
    n = lambda x: name + x
    c = lambda x: F.col(name + x)
    kept = [x for x in stamps.columns if x not in RESULTS]
    changes = zone_changes(stamps, zone_col)
    known = changes.select(F.col("zone").alias(n("zone"))).distinct()  # bounded by the time zone database
    rows = stamps.select(*[F.col(f"`{x}`") for x in kept]).withColumns({n(x): e for x, e in parsed(F.col(f"`{raw_col}`").cast("string")).items()})
    rows = rows.withColumns({n("source"): F.col(f"`{source_col}`").cast("string"), n("zone"): F.col(f"`{zone_col}`").cast("string")})
    rows = rows.join(F.broadcast(known.withColumn(n("known"), F.lit(True))), n("zone"), "left")
    placed = c("offset").isNotNull() | F.coalesce(c("known"), F.lit(False))
    either = c("slashed") & c("day_first").isNotNull() & c("month_first").isNotNull() & (c("day_first") != c("month_first"))
    first = F.coalesce(c("days"), c("day_first"), c("month_first"))
    good = placed & first.isNotNull()
    rows = cut(rows.withColumns({
        n("open"): F.coalesce(good & either, F.lit(False)),
        n("vote"): F.when(good & c("slashed") & c("day_first").isNull(), -1).when(good & c("slashed") & c("month_first").isNull(), 1).otherwise(0),
        n("days"): F.when(good, first),
    }).drop(n("slashed"), n("day_first"), n("known")))
    # day or month first: votes of a source travel to its open rows like a mark
    votes = rows.where(c("open") | (c("vote") != 0)).groupBy(n("source")).agg(F.count_if(c("vote") > 0).alias(n("dmy")), F.count_if(c("vote") < 0).alias(n("mdy")))
    rest = [x for x in rows.columns if x != n("month_first")]
    dmy, mdy = c("dmy") > over * c("mdy"), c("mdy") > over * c("dmy")
    settled = sweep(rows.where(c("open")), votes, [n("source")], [n("dmy"), n("mdy")])
    settled = settled.withColumns({n("days"): F.when(mdy & ~dmy, c("month_first")).otherwise(c("days")), n("rule"): F.when(dmy != mdy, "votes").otherwise("default")})
    plain = rows.where(~c("open")).withColumn(n("rule"), F.when(c("epoch_us").isNotNull(), "epoch").when(c("days").isNull(), "bad").otherwise("plain"))
    dated = plain.select(*rest, n("rule")).unionAll(settled.select(*rest, n("rule")))
    dated = cut(dated.withColumn(n("wall"), c("days").cast("long") * 86400 + c("seconds")))
    needs = c("wall").isNotNull() & c("offset").isNull()
    marks = changes.select(F.col("zone").alias(n("zone")), F.col("at").alias(n("wall")), F.col("until").alias(n("until")), F.col("offset").alias(n("shift")))
    walls = sweep(dated.where(needs), marks, [n("zone"), n("wall")], [n("until"), n("shift")])
    out = lambda df, us, odd: df.select(*[F.col(f"`{x}`") for x in kept], us.alias("utc_us"), c("rule").alias("rule"), (odd | c("rule").isin("votes", "default")).alias("ambiguous"))
    fixed = out(dated.where(~needs), F.coalesce(c("epoch_us"), (c("wall") - c("offset")) * 1_000_000), F.lit(False))
    return out(walls, (c("wall") - c("shift")) * 1_000_000, c("wall") < c("until")).unionAll(fixed)
