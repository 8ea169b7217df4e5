"""Timestamps read off an image, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Clock

# Patterns and digit layouts of overlay clocks.
DMY = r"(\d{2})[-/](\d{2})[-/](\d{4})\D{0,4}(\d{2}):?(\d{2}):?(\d{2})"
YMD = r"(\d{4})[-/](\d{2})[-/](\d{2})\D{0,4}(\d{2}):?(\d{2}):?(\d{2})"
#: Start and length of day, month, year, hour, minute and second in a run of so many digits.
RUNS = {14: [(1, 2), (3, 2), (5, 4), (9, 2), (11, 2), (13, 2)], 16: [(1, 2), (4, 2), (7, 4), (11, 2), (13, 2), (15, 2)]}


def _seconds(day: Column, month: Column, year: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since 1970, null if there is no such date."""
    return F.when(second < 60, F.unix_seconds(F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)"))))


def parsed_seconds(c: Column) -> Column:
    """Day-first, else year-first, else a run of 14 or 16 digits, as seconds since 1970. An impossible date is null and
    ends the search. PM adds twelve hours before noon, 12 AM is 0."""
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    parts = lambda p: [F.try_to_number(F.regexp_extract(text, p, i), F.lit("9999")).cast("int") for i in range(1, 7)]
    half = lambda h: F.when(F.contains(text, F.lit("PM")) & (h < 12), h + 12).when(F.contains(text, F.lit("AM")) & (h == 12), 0).otherwise(h)
    dd, mm, yy, hh, mi, ss = parts(DMY)
    dmy = _seconds(dd, mm, yy, half(hh), mi, ss)
    yy, mm, dd, hh, mi, ss = parts(YMD)
    ymd = _seconds(dd, mm, yy, half(hh), mi, ss)
    digits = F.regexp_replace(text, r"\D", "")
    run = None
    for n, places in RUNS.items():
        field = [F.try_to_number(F.substring(digits, a, k), F.lit("9999")).cast("int") for a, k in places]
        here = F.length(digits) == n
        run = F.when(here, _seconds(*field)) if run is None else run.when(here, _seconds(*field))
    return F.when(text.rlike(DMY), dmy).when(text.rlike(YMD), ymd).otherwise(run)


def plausible_year(seconds: Column, params: Clock = Clock()) -> Column:
    return F.coalesce(F.year(F.timestamp_seconds(seconds)).between(params.min_year, params.max_year), F.lit(False))
