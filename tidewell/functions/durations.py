"""Durations and frequencies written as text, such as ``180min``, ``1h30min``, ``-4s`` or ``M``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000

# Unit aliases and their length in microseconds.
UNIT_MICROS = {
    "us": 1, "micros": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "L": 1_000, "millisecond": 1_000, "milliseconds": 1_000,
    "s": SECOND, "S": SECOND, "sec": SECOND, "second": SECOND, "seconds": SECOND,
    "m": 60 * SECOND, "min": 60 * SECOND, "T": 60 * SECOND, "minute": 60 * SECOND, "minutes": 60 * SECOND,
    "h": 3600 * SECOND, "H": 3600 * SECOND, "hour": 3600 * SECOND, "hours": 3600 * SECOND,
    "d": 86400 * SECOND, "D": 86400 * SECOND, "day": 86400 * SECOND, "days": 86400 * SECOND,
    "w": 7 * 86400 * SECOND, "week": 7 * 86400 * SECOND, "weeks": 7 * 86400 * SECOND,
}

# Calendar aliases as (months, label at the end of the period).
UNIT_MONTHS = {
    "M": (1, True), "ME": (1, True), "MS": (1, False),
    "Q": (3, True), "QE": (3, True), "QS": (3, False),
    "Y": (12, True), "YE": (12, True), "A": (12, True), "YS": (12, False), "AS": (12, False),
}

_PART = re.compile(r"\s*([+-]?\d*\.?\d*)\s*([A-Za-z]+)\s*")
_CLOCK = re.compile(r"\s*([+-])?(?:(\d+)\s*days?,?\s*)?(\d{1,2}):(\d{2}):(\d{2})(\.\d{1,6})?\s*")


@dataclass(frozen=True)
class Calendar:
    """A step of whole months, labelled at the first or last day of the period."""

    months: int
    at_end: bool


def parse_frequency(text: str) -> int | Calendar:
    """Fixed length in microseconds, or a calendar step."""
    match = re.fullmatch(r"\s*(-?\d*)\s*([A-Z]+)\s*", text)
    if match and match[2] in UNIT_MONTHS:
        count = {"": 1, "-": -1}.get(match[1]) or int(match[1])
        months, at_end = UNIT_MONTHS[match[2]]
        return Calendar(count * months, at_end)
    return parse_duration(text)


def parse_duration(text: str) -> int:
    """Length in whole microseconds; finer parts are refused because Spark cannot hold them."""
    clock = _CLOCK.fullmatch(text)
    if clock:
        days, hours, minutes, seconds = (int(clock[i] or 0) for i in (2, 3, 4, 5))
        whole = ((days * 24 + hours) * 60 + minutes) * 60 + seconds
        micros = whole * SECOND + round(float(clock[6] or 0) * SECOND)
        return -micros if clock[1] == "-" else micros
    pos, total, sign = 0, 0.0, 1
    while pos < len(text):
        part = _PART.match(text, pos)
        if not part or part[2] not in UNIT_MICROS:
            raise ValueError(f"{text!r} is not a duration")
        number = part[1]
        if pos == 0 and number.startswith("-"):
            sign, number = -1, number[1:]
        total += float(number) * UNIT_MICROS[part[2]] if number not in ("", "+") else UNIT_MICROS[part[2]]
        pos = part.end()
    if not text.strip() or total != int(total):
        raise ValueError(f"{text!r} is not a whole number of microseconds")
    return sign * int(total)


def positive_duration(text: str) -> int:
    micros = parse_duration(text)
    if micros <= 0:
        raise ValueError(f"{text!r} must be positive")
    return micros


def from_micros(column: Column) -> Column:
    return F.timestamp_micros(column.cast("bigint"))


def add_frequency(ts: Column, frequency: int | Calendar, periods: int | Column = 1) -> Column:
    """Move a timestamp by a number of periods.

    Calendar steps land on the anchor day. A timestamp off its anchor uses up one period to
    get there, so one step forward from mid-month lands on the next anchor.
    """
    count = periods if isinstance(periods, Column) else F.lit(periods)
    if not isinstance(frequency, Calendar):
        return from_micros(F.unix_micros(ts) + count.cast("bigint") * F.lit(frequency))
    grain = next(g for g in (12, 3, 1) if frequency.months % g == 0)
    anchors = count * F.lit(frequency.months // grain)
    day_time = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))
    month = F.trunc(ts, "month")
    months_past = F.pmod(F.month(month) - (0 if frequency.at_end else 1), F.lit(grain))
    if frequency.at_end:
        anchored = (months_past == 0) & (F.last_day(ts) == F.to_date(ts))
        back = F.when(anchored, 0).when(months_past == 0, grain).otherwise(months_past)
    else:
        anchored = (months_past == 0) & (F.dayofmonth(ts) == 1)
        back = months_past
    steps = F.when(anchored | (anchors > 0), anchors).otherwise(anchors + 1)
    target = F.add_months(F.add_months(month, -back), (steps * grain).cast("int"))
    landed = F.last_day(target) if frequency.at_end else target
    moved = from_micros(F.unix_micros(landed.cast("timestamp")) + day_time)
    return F.when(anchors == 0, ts).otherwise(moved)
