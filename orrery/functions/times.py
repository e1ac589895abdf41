"""Times: literals of several formats and scales as TAI nanoseconds since 1970, and columns between UTC and TAI."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, functions as F

# TAI minus UTC in seconds from each date on.
LEAP_SECONDS = (
    (1972, 1, 10), (1972, 7, 11), (1973, 1, 12), (1974, 1, 13), (1975, 1, 14), (1976, 1, 15), (1977, 1, 16),
    (1978, 1, 17), (1979, 1, 18), (1980, 1, 19), (1981, 7, 20), (1982, 7, 21), (1983, 7, 22), (1985, 7, 23),
    (1988, 1, 24), (1990, 1, 25), (1991, 1, 26), (1992, 7, 27), (1993, 7, 28), (1994, 7, 29), (1996, 1, 30),
    (1997, 7, 31), (1999, 1, 32), (2006, 1, 33), (2009, 1, 34), (2012, 7, 35), (2015, 7, 36), (2017, 1, 37),
)
_MJD_1970 = 40587
_DATE = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?$")
_YDAY = re.compile(r"(\d{4}):(\d{3})(?::(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?$")
_TT_TAI = 32_184_000_000


def tai_offset(utc_nsec: int) -> int:
    """Nanoseconds that TAI is ahead of UTC at a UTC time."""
    day = datetime.datetime.fromtimestamp(utc_nsec // 1_000_000_000, datetime.UTC)
    found = 10
    for year, month, seconds in LEAP_SECONDS:
        if (day.year, day.month) >= (year, month):
            found = seconds
    return found * 1_000_000_000


def parse_time(text: str) -> int:
    """TAI nanoseconds of ``[format/]value[/scale]``; the format is guessed if it isn't given.

    Formats: mjd, jd, iso, isot, fits, yday, unix. Scales: utc, tai, tt. Without a
    scale mjd and jd are TAI and all others UTC. A zone of +00:00 at the end is taken, too.
    """
    parts = text.replace("+00:00", "").strip().split("/")
    form = scale = None
    if len(parts) > 1 and parts[0].lower() in ("mjd", "jd", "iso", "isot", "fits", "yday", "unix"):
        form = parts.pop(0).lower()
    if len(parts) > 1:
        scale = parts.pop().lower()
        if scale not in ("utc", "tai", "tt"):
            raise ValueError(f"unknown time scale {scale!r} in {text!r}")
    if len(parts) != 1:
        raise ValueError(f"cannot read the time {text!r}")
    value = parts[0]
    if form is None:
        number = re.fullmatch(r"[+-]?\d+(?:\.\d*)?", value)
        form = "mjd" if number else "yday" if _YDAY.match(value) else "iso"
    if form in ("mjd", "jd", "unix"):
        days, _, frac = value.partition(".")
        whole, part = int(days), int((frac + "0" * 18)[:18] or 0)
        unit = 1_000_000_000 if form == "unix" else 86_400_000_000_000
        nsec = whole * unit + (part * unit + 5 * 10**17) // 10**18
        nsec -= {"unix": 0, "mjd": _MJD_1970 * unit, "jd": 0}[form]
        if form == "jd":
            nsec -= (2440587 * 2 + 1) * (unit // 2)
        scale = scale or ("utc" if form == "unix" else "tai")
    else:
        m = _YDAY.match(value) if form == "yday" else _DATE.match(value)
        if not m:
            raise ValueError(f"cannot read the time {text!r}")
        if form == "yday":
            day = datetime.date(int(m[1]), 1, 1) + datetime.timedelta(int(m[2]) - 1)
            clock, frac = m.group(3, 4, 5), m[6]
        else:
            day = datetime.date(int(m[1]), int(m[2]), int(m[3]))
            clock, frac = m.group(4, 5, 6), m[7]
        h, mi, s = (int(x or 0) for x in clock)
        seconds = (day - datetime.date(1970, 1, 1)).days * 86400 + h * 3600 + mi * 60 + s
        nsec = seconds * 1_000_000_000 + int(((frac or "") + "0" * 9)[:9])
        scale = scale or "utc"
    if scale == "utc":
        nsec += tai_offset(nsec)
    elif scale == "tt":
        nsec -= _TT_TAI
    return nsec


# ---------------------------------------------------------------- columns


def _starts() -> list[tuple[int, int, int]]:
    """(UTC nanoseconds, seconds before, seconds from then on) of each leap second."""
    out, before = [], 10
    for year, month, seconds in LEAP_SECONDS:
        days = (datetime.date(year, month, 1) - datetime.date(1970, 1, 1)).days
        out.append((days * 86_400_000_000_000, before, seconds))
        before = seconds
    return out


def tai_of(utc: Column) -> Column:
    """TAI nanoseconds of a column of UTC nanoseconds since 1970, which is computed once."""

    def shifted(t: Column) -> Column:
        offset = F.lit(10)
        for start, _, seconds in _starts():
            offset = F.when(t >= start, F.lit(seconds)).otherwise(offset)
        return t + offset.cast("long") * 1_000_000_000

    return F.transform(F.array(utc), shifted)[0]


def utc_of(tai: Column) -> Column:
    """UTC nanoseconds of a column of TAI nanoseconds; a leap second repeats the second before it."""
    offset = F.lit(10)
    for start, before, seconds in _starts():
        offset = F.when(tai >= start + before * 1_000_000_000, F.lit(seconds)).otherwise(offset)
    return tai - offset.cast("long") * 1_000_000_000
