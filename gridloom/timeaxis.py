"""Calendar time with units: a datetime knows how precisely it was given, a duration counts calendar units."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass
from enum import IntEnum
from functools import total_ordering


class Unit(IntEnum):
    """From fine to coarse."""

    SECOND = 0
    MINUTE = 1
    HOUR = 2
    DAY = 3
    WEEK = 4
    MONTH = 5
    YEAR = 6


SECONDS = {Unit.SECOND: 1, Unit.MINUTE: 60, Unit.HOUR: 3600, Unit.DAY: 86400, Unit.WEEK: 604800}
_LETTERS = {"Y": Unit.YEAR, "M": Unit.MONTH, "W": Unit.WEEK, "D": Unit.DAY, "TH": Unit.HOUR, "TM": Unit.MINUTE, "TS": Unit.SECOND}


@dataclass(frozen=True)
class Duration:
    """A whole number of one unit, as in P3M or PT6H."""

    n: int
    unit: Unit

    @staticmethod
    def parse(text: str) -> Duration:
        m = re.fullmatch(r"P(T?)(\d+)([YMWDHS])", text.strip().upper())
        if not m or m[1] + m[3] not in _LETTERS:
            raise ValueError(f"not a duration of one unit: {text!r}")
        return Duration(int(m[2]), _LETTERS[m[1] + m[3]])

    def __str__(self) -> str:
        mark = next(k for k, u in _LETTERS.items() if u == self.unit)
        return f"P{'T' * (len(mark) - 1)}{self.n}{mark[-1]}"

    def convert(self, unit: Unit) -> Duration:
        """In another unit, rounded up; months count 30 days and years 12 months or 365 days."""
        if unit == self.unit:
            return self
        if self.unit >= Unit.MONTH and unit >= Unit.MONTH:
            months = self.n * (12 if self.unit == Unit.YEAR else 1)
            return Duration(-(-months // (12 if unit == Unit.YEAR else 1)), unit)
        size = {**SECONDS, Unit.MONTH: 30 * 86400, Unit.YEAR: 365 * 86400}
        return Duration(-(-self.n * size[self.unit] // size[unit]), unit)


@total_ordering
@dataclass(frozen=True, eq=False)
class DateTime:
    """A point in time and its unit. Points of different units are neither equal nor before each other."""

    at: dt.datetime
    unit: Unit

    @staticmethod
    def parse(text: str | DateTime | dt.date) -> DateTime:
        if isinstance(text, DateTime):
            return text
        if isinstance(text, dt.datetime):
            return DateTime(text.replace(tzinfo=None, microsecond=0), Unit.SECOND)
        if isinstance(text, dt.date):
            return DateTime(dt.datetime(text.year, text.month, text.day), Unit.DAY)
        # only digits count, so that a time zone is of no effect
        digits = re.sub(r"\D", "", text)[:14]
        units = {4: Unit.YEAR, 6: Unit.MONTH, 8: Unit.DAY, 10: Unit.HOUR, 12: Unit.MINUTE, 14: Unit.SECOND}
        if len(digits) not in units:
            raise ValueError(f"not a datetime: {text!r}")
        full = digits + "00000101000000"[len(digits) :]
        return DateTime(dt.datetime.strptime(full, "%Y%m%d%H%M%S"), units[len(digits)]).floor()

    def floor(self, unit: Unit | None = None) -> DateTime:
        """The start of the unit that holds the point."""
        u, a = self.unit if unit is None else unit, self.at
        if u == Unit.SECOND:
            a = a.replace(microsecond=0)
        elif u <= Unit.HOUR:
            a = a.replace(second=0, microsecond=0, minute=0 if u == Unit.HOUR else a.minute)
        else:
            a = dt.datetime(a.year, a.month if u <= Unit.MONTH else 1, a.day if u <= Unit.WEEK else 1)
        return DateTime(a, u)

    def last(self, unit: Unit) -> DateTime:
        """The last of the finer units in the point's own."""
        a = self.floor().at
        if self.unit >= Unit.MONTH:
            month = a.month if self.unit == Unit.MONTH else 12
            a = dt.datetime(a.year, month, calendar.monthrange(a.year, month)[1])
        if self.unit >= Unit.DAY:
            a = a.replace(hour=23)
        if self.unit >= Unit.HOUR:
            a = a.replace(minute=59)
        if self.unit >= Unit.MINUTE:
            a = a.replace(second=59)
        return DateTime(a, unit).floor()

    def __add__(self, d: Duration) -> DateTime:
        if d.unit in SECONDS:
            return DateTime(self.at + dt.timedelta(seconds=d.n * SECONDS[d.unit]), self.unit)
        months = self.at.year * 12 + self.at.month - 1 + d.n * (12 if d.unit == Unit.YEAR else 1)
        year, month = divmod(months, 12)
        day = min(self.at.day, calendar.monthrange(year, month + 1)[1])
        return DateTime(self.at.replace(year=year, month=month + 1, day=day), self.unit)

    def since(self, other: DateTime, unit: Unit | None = None) -> int:
        """Whole units from other to this."""
        u = self.unit if unit is None else unit
        a, b = self.floor(u).at, other.floor(u).at
        if u == Unit.YEAR:
            return a.year - b.year
        if u == Unit.MONTH:
            return (a.year - b.year) * 12 + a.month - b.month
        return int((a - b).total_seconds()) // SECONDS[u]

    def digits(self) -> float:
        """As a number of its digits, as in 20210305."""
        return float(self.at.strftime("%Y%m%d%H%M%S")[: {Unit.YEAR: 4, Unit.MONTH: 6, Unit.WEEK: 8, Unit.DAY: 8, Unit.HOUR: 10, Unit.MINUTE: 12, Unit.SECOND: 14}[self.unit]])

    def epoch(self) -> int:
        return int((self.at - dt.datetime(1970, 1, 1)).total_seconds())

    def day_of_week(self) -> int:
        """Sunday is 0."""
        return (self.at.weekday() + 1) % 7

    def __str__(self) -> str:
        return self.at.strftime({Unit.YEAR: "%Y", Unit.MONTH: "%Y-%m", Unit.WEEK: "%Y-%m-%d", Unit.DAY: "%Y-%m-%d", Unit.HOUR: "%Y-%m-%dT%H", Unit.MINUTE: "%Y-%m-%dT%H:%M", Unit.SECOND: "%Y-%m-%dT%H:%M:%S"}[self.unit])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DateTime) and self.unit == other.unit and self.at == other.at

    def __lt__(self, other: DateTime) -> bool:
        return self.unit == other.unit and self.at < other.at

    def __le__(self, other: DateTime) -> bool:
        return not other < self

    def __ge__(self, other: DateTime) -> bool:
        return not self < other

    def __hash__(self) -> int:
        return hash((self.at, self.unit))
