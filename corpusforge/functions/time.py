"""Epochs, recency and schedules. The present is always a parameter."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions.text import col


def epoch(*fields) -> Column:
    """Seconds since 1970 from the first usable field: a number, or an ISO date."""

    def one(c):
        s = col(c).cast("string")
        iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_timestamp(F.try_to_timestamp(s)).cast("double"))
        return F.coalesce(s.try_cast("double"), iso)

    return F.coalesce(*[one(c) for c in fields])


def recency(score, when, as_of: float, half_life_days: float, weight: float) -> Column:
    """score * ((1 - w) + w * 0.5 ^ (age / half-life)); without a date, the score."""
    w = min(max(weight, 0.0), 1.0)
    life = max(half_life_days, 0.1) * 86400.0
    age = F.greatest(F.lit(float(as_of)) - col(when), F.lit(0.0))
    return F.when(col(when).isNull(), col(score)).otherwise(col(score) * ((1 - w) + w * F.pow(F.lit(0.5), age / life)))


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(span.partition("-")[0]), int(span.partition("-")[2] or (high if step else span)))
        if not low <= a <= b <= high:
            raise ValueError(f"{part} is outside {low}-{high}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_run(cron: str, after: float, zone: str = "Europe/Rome") -> int:
    """The first epoch after ``after`` at which a five-field cron is due in its zone.

    Local times that daylight saving skips are passed over.
    """
    minute, hour, day, month, weekday = cron.split()
    minutes, hours, months = _field(minute, 0, 59), _field(hour, 0, 23), _field(month, 1, 12)
    days, weekdays = _field(day, 1, 31), {d % 7 for d in _field(weekday, 0, 7)}
    tz = ZoneInfo(zone)
    date = datetime.fromtimestamp(after, tz).date()
    for _ in range(366 * 5):
        by_day, by_week = date.day in days, date.isoweekday() % 7 in weekdays
        due = by_day and by_week if "*" in (day, weekday) else by_day or by_week
        if date.month in months and due:
            for h in sorted(hours):
                for m in sorted(minutes):
                    local = datetime(date.year, date.month, date.day, h, m, tzinfo=tz)
                    at = int(local.timestamp())
                    if at > after and datetime.fromtimestamp(at, tz).replace(tzinfo=None) == local.replace(tzinfo=None):
                        return at
        date += timedelta(days=1)
    raise ValueError(f"{cron} is never due")
