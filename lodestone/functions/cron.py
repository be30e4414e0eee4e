"""Schedules: five-field expressions, the next instant that fits, and a stable offset for each schedule."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
ALIASES = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
FIELDS = ((0, 59, []), (0, 23, []), (1, 31, []), (1, 12, MONTHS), (0, 7, DAYS))
HORIZON_YEARS = 5


def _number(text: str, low: int, names: list[str]) -> int:
    return names.index(text.lower()) + low if text.lower() in names else int(text)


def _field(text: str, low: int, high: int, names: list[str]) -> frozenset[int]:
    found: set[int] = set()
    for part in text.split(","):
        span, slash, step = part.partition("/")
        first, dash, last = span.partition("-")
        if span == "*":
            a, b = low, high
        else:
            a = _number(first, low, names)
            b = _number(last, low, names) if dash else high if slash else a
        if not low <= a <= b <= high or (slash and int(step) < 1):
            raise ValueError(f"not a range of {low} to {high}: {part}")
        found.update(range(a, b + 1, int(step) if slash else 1))
    return frozenset(found)


@dataclass(frozen=True)
class Cron:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool

    @classmethod
    def parse(cls, text: str) -> Cron:
        parts = ALIASES.get(text.strip().lower(), text).split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"five fields are needed: {text!r}")
        minutes, hours, days, months, weekdays = (_field(p, *f) for p, f in zip(parts, FIELDS))
        return cls(minutes, hours, days, months, frozenset(d % 7 for d in weekdays), parts[2].startswith("*"), parts[4].startswith("*"))

    def on_day(self, at: datetime) -> bool:
        """Of two restricted day fields either may fit; an unrestricted one leaves it to the other."""
        by_date, by_week = at.day in self.days, at.isoweekday() % 7 in self.weekdays
        fits = by_date or by_week if not (self.any_day or self.any_weekday) else by_date and by_week
        return fits and at.month in self.months

    def next_after(self, instant: datetime, zone: str = "UTC") -> datetime | None:
        """The first fitting minute of civil time strictly after an instant, as UTC; null past five years.

        A time that a clock change skips fires as much later as the clock moved; one that comes twice fires the first time.
        """
        tz = ZoneInfo(zone)
        day = instant.astimezone(tz).replace(tzinfo=None, hour=0, minute=0, second=0, microsecond=0)
        for n in range(366 * HORIZON_YEARS):
            at = day + timedelta(days=n)
            if self.on_day(at):
                for hour in sorted(self.hours):
                    for minute in sorted(self.minutes):
                        fire = at.replace(hour=hour, minute=minute, tzinfo=tz, fold=0).astimezone(UTC)
                        if fire > instant:
                            return fire
        return None


def jitter_offset(seed: str, schedule: str, span: int) -> int:
    """Seconds within a span, the same for a machine and schedule always: 64-bit FNV-1a of both, a zero byte between."""
    if span == 0:
        return 0
    value = 0xCBF29CE484222325  # fixed values: the published offset basis and prime
    for byte in seed.encode() + b"\0" + schedule.encode():
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return value % span
