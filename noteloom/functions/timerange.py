"""Time ranges: phrases to bounds at the driver, bounds to a predicate."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date spellings, scope words, units.
DATE_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d")
SPARK_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
SCOPES = {"created": "created", "modified": "modified", "updated": "modified", "edited": "modified"}
UNITS = ("minute", "hour", "day", "week", "month", "year")
TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class TimeRange:
    """Bounds (inclusive, either may be open) and the timestamp they apply to: created, modified or both."""

    start: datetime | None
    end: datetime | None
    mode: str = "modified"


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def parse_date(text: str) -> datetime | None:
    try:
        return _utc(datetime.fromisoformat(text.strip().replace("Z", "+00:00")))
    except ValueError:
        pass
    for f in DATE_FORMATS:
        try:
            return _utc(datetime.strptime(text.strip(), f))
        except ValueError:
            continue
    return None


def back(t: datetime, n: int, unit: str) -> datetime:
    """``n`` units earlier; days of shorter months are clamped."""
    if unit in ("month", "year"):
        months = t.year * 12 + t.month - 1 - n * (12 if unit == "year" else 1)
        year, month = divmod(months, 12)
        return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))
    return t - timedelta(**{f"{unit}s": n})


def _floor(t: datetime, unit: str) -> datetime:
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return {"day": day, "week": day - timedelta(days=day.weekday()), "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[unit]


def parse_range(text: str | None, now: datetime) -> TimeRange | None:
    """A phrase such as 'created last week' to a range; None if it says nothing."""
    rest, mode, now = (text or "").strip().lower(), "modified", _utc(now)
    for word, scope in SCOPES.items():
        if rest.startswith(word):
            mode, rest = scope, rest[len(word) :].strip(" ,:-")
            break
    if not rest:
        return None
    if m := re.fullmatch(r"between\s+(.+?)\s+and\s+(.+)", rest):
        a, b = map(parse_date, m.groups())
        return TimeRange(a, b, mode) if a and b else None
    if m := re.fullmatch(r"(since|after|before)\s+(.+)", rest):
        if (t := parse_date(m[2])) is None:
            return None
        return {"since": TimeRange(t, None, mode), "after": TimeRange(t + TICK, None, mode), "before": TimeRange(None, t - TICK, mode)}[m[1]]
    if rest in ("today", "today's"):
        return TimeRange(_floor(now, "day"), now, mode)
    if rest in ("yesterday", "yday"):
        return TimeRange(_floor(now, "day") - timedelta(days=1), _floor(now, "day"), mode)
    if m := re.fullmatch(r"(this|last)\s+(week|month|year)", rest):
        here = _floor(now, m[2])
        return TimeRange(here, now, mode) if m[1] == "this" else TimeRange(back(here, 1, m[2]), here, mode)
    if m := re.fullmatch(rf"(?:(?:in|over|during)\s+the\s+)?(?:(?:last|past)\s+)?(\d+)\s+({'|'.join(UNITS)})s?(?:\s+ago)?", rest):
        return TimeRange(back(now, int(m[1]), m[2]), now, mode)
    if t := parse_date(rest):
        return TimeRange(_floor(t, "day"), _floor(t, "day") + timedelta(days=1), mode)
    return None


def structured_range(spec: dict, now: datetime) -> TimeRange:
    """{start, end} or {last, unit}, with an optional mode."""
    mode = spec.get("mode", "modified")
    if mode not in ("created", "modified", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    if spec.get("last") is not None:
        unit = str(spec.get("unit", "")).rstrip("s")
        if unit not in UNITS or int(spec["last"]) < 1 or spec.get("start") or spec.get("end"):
            raise ValueError("'last' takes a positive number and a unit, and excludes start and end")
        return TimeRange(back(_utc(now), int(spec["last"]), unit), _utc(now), mode)
    bounds = [parse_date(str(spec[k])) if spec.get(k) else None for k in ("start", "end")]
    if not any(bounds):
        raise ValueError("a start, an end, or last and unit are needed")
    if all(bounds) and bounds[0] > bounds[1]:
        raise ValueError("start lies after end")
    return TimeRange(bounds[0], bounds[1], mode)


def timestamp_of(*candidates: Column) -> Column:
    """First candidate (text, or epoch seconds as text) that reads as a timestamp."""
    tried = []
    for c in candidates:
        s = c.cast("string")
        tried += [F.try_to_timestamp(s, F.lit(f)) for f in SPARK_FORMATS]
        tried.append(F.when(s.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(s.try_cast("double"))))
    return F.coalesce(*tried)


def within(r: TimeRange, created: Column, modified: Column) -> Column:
    """Inclusive at both ends; without a timestamp nothing matches."""

    def one(c: Column) -> Column:
        ok = c.isNotNull()
        if r.start is not None:
            ok = ok & (c >= F.lit(r.start))
        return ok & (c <= F.lit(r.end)) if r.end is not None else ok

    return {"created": one(created), "modified": one(modified), "both": one(created) | one(modified)}[r.mode]
