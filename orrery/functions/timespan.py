"""Half-open timespans [begin, end) in integer nanoseconds, as a pair of columns or a struct.

An empty span has begin >= end and is stored as (MAX, MIN); unbounded ends are
MIN and MAX. The begin and end of a null span are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

MIN_NSEC = 0
MAX_NSEC = 4_102_444_800_000_000_000  # 2100-01-01
DAY = 86_400_000_000_000


@dataclass(frozen=True)
class Timespan:
    """A literal span; None means unbounded."""

    begin: int | None = None
    end: int | None = None

    @property
    def bounds(self) -> tuple[int, int]:
        low = MIN_NSEC if self.begin is None else min(max(self.begin, MIN_NSEC), MAX_NSEC)
        high = MAX_NSEC if self.end is None else min(max(self.end, MIN_NSEC), MAX_NSEC)
        return (low, high) if low < high else (MAX_NSEC, MIN_NSEC)

    @property
    def empty(self) -> bool:
        low, high = self.bounds
        return low >= high

    @classmethod
    def instant(cls, t: int) -> Timespan:
        return cls(t, t + 1)

    @classmethod
    def day_obs(cls, day: int, offset_seconds: int = 0) -> Timespan:
        """The 24 hours of a YYYYMMDD integer, shifted."""
        import datetime

        when = datetime.datetime(day // 10000, day // 100 % 100, day % 100, tzinfo=datetime.UTC)
        begin = int(when.timestamp()) * 1_000_000_000 + offset_seconds * 1_000_000_000
        return cls(begin, begin + DAY)

    def overlaps(self, other: Timespan | int) -> bool:
        if isinstance(other, int):
            return self.contains(other)
        (a, b), (c, d) = self.bounds, other.bounds
        return b > c and d > a

    def contains(self, other: Timespan | int) -> bool:
        a, b = self.bounds
        if isinstance(other, int):
            return a <= other < b
        c, d = other.bounds
        return a <= c and b >= d

    def before(self, other: Timespan) -> bool:
        (a, b), (c, d) = self.bounds, other.bounds
        return b <= c and a < d

    def after(self, other: Timespan) -> bool:
        (a, b), (c, d) = self.bounds, other.bounds
        return a >= d and b > c

    def intersection(self, *others: Timespan) -> Timespan:
        pairs = [self.bounds, *(o.bounds for o in others)]
        return Timespan(max(p[0] for p in pairs), min(p[1] for p in pairs))

    def difference(self, other: Timespan) -> list[Timespan]:
        (a, b), (c, d) = self.bounds, other.bounds
        if self.empty or not self.overlaps(other):
            return [] if self.empty else [self]
        return [Timespan(x, y) for x, y in ((a, c), (d, b)) if x < y]

    def column(self) -> Column:
        return span(*(F.lit(x).cast("long") for x in self.bounds))


def span(begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))


def is_empty(s: Column) -> Column:
    return s["begin"] >= s["end"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["begin"]) & (b["end"] > a["begin"])


def contains(a: Column, b: Column) -> Column:
    return (a["begin"] <= b["begin"]) & (a["end"] >= b["end"])


def contains_time(a: Column, t: Column) -> Column:
    return (a["begin"] <= t) & (a["end"] > t)


def before(a: Column, b: Column) -> Column:
    return (a["end"] <= b["begin"]) & (a["begin"] < b["end"])


def after(a: Column, b: Column) -> Column:
    return (a["begin"] >= b["end"]) & (a["end"] > b["begin"])


def begin_of(s: Column) -> Column:
    return F.coalesce(s["begin"], F.lit(0).cast("long"))


def end_of(s: Column) -> Column:
    return F.coalesce(s["end"], F.lit(0).cast("long"))


def is_null(s: Column) -> Column:
    return s["begin"].isNull()


def intersection(a: Column, b: Column) -> Column:
    return span(F.greatest(a["begin"], b["begin"]), F.least(a["end"], b["end"]))


def difference(a: Column, b: Column) -> Column:
    """An array of the 0, 1 or 2 non-empty pieces of ``a`` outside ``b``."""
    pieces = F.array(span(a["begin"], F.least(a["end"], b["begin"])), span(F.greatest(a["begin"], b["end"]), a["end"]))
    apart = F.array(span(a["begin"], a["end"]))
    return F.filter(F.when(overlaps(a, b), pieces).otherwise(apart), lambda s: s["begin"] < s["end"])


def from_timestamp(t: Column) -> Column:
    """Nanoseconds of a column of timestamps without a zone, whatever the session's zone is."""
    t = t.cast("timestamp_ntz")
    clock = F.hour(t) * 3600 + F.minute(t) * 60
    micros = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return (F.unix_date(F.to_date(t)).cast("long") * 86_400 + clock) * 1_000_000_000 + micros * 1000


def day_obs_span(day: Column, offset_seconds: int = 0) -> Column:
    """The span of a column of YYYYMMDD integers, in TAI, whatever the session's zone is."""
    begin = F.unix_date(F.to_date(day.cast("string"), "yyyyMMdd")).cast("long") * DAY + offset_seconds * 1_000_000_000
    return span(begin, begin + DAY)
