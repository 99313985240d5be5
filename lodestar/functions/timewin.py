"""Time rules as half-open windows, so that predicates on the raw column prune files."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Window = tuple[datetime | None, datetime | None]


def _month(d: datetime, by: int) -> datetime:
    n = d.year * 12 + d.month - 1 + by
    return datetime(n // 12, n % 12 + 1, 1)


def _months_ago(d: datetime, n: int) -> datetime:
    """The same day of a month before, or that month's last day."""
    month = _month(d, -n)
    return month.replace(day=min(d.day, monthrange(month.year, month.month)[1]))


def time_window(rule: str, as_of: datetime, compat: bool = False) -> Window:
    """(from, to), from included and to excluded; None: open.

    compat: last week and last month reach up to now and beyond, as the first version of these
    rules had it; otherwise they end where this week or month begins.
    """
    r = rule.lower().replace("_", " ").strip()
    day = datetime(as_of.year, as_of.month, as_of.day)
    week, month, year = day - timedelta(days=day.weekday()), day.replace(day=1), datetime(day.year, 1, 1)
    quarter = datetime(day.year, 3 * ((day.month - 1) // 3) + 1, 1)
    if r in ("today", "now", "current", "this morning"):
        return (day, day + timedelta(hours=12)) if r == "this morning" else (day, day + timedelta(days=1))
    if r == "yesterday":
        return day - timedelta(days=1), day
    if r in ("now-1d", "now-24h", "past 24 hours"):
        return as_of - timedelta(hours=24), None
    if m := re.fullmatch(r"(\d+) days? ago", r):
        return None, as_of - timedelta(days=int(m[1]))
    if m := re.fullmatch(r"(?:past |last )?(\d+) (day|hour|month)s?", r):
        n = int(m[1])
        back = {"day": lambda: as_of - timedelta(days=n), "hour": lambda: as_of - timedelta(hours=n), "month": lambda: _months_ago(day, n)}
        return back[m[2]](), None
    if r == "this week":
        return week, None if compat else week + timedelta(days=7)
    if r == "last week":
        return week - timedelta(days=7), None if compat else week
    if r in ("this month", "current month"):
        return month, None if compat else _month(month, 1)
    if r == "last month":
        return _month(month, -1), None if compat else month
    if r in ("this quarter", "current quarter"):
        return quarter, _month(quarter, 3)
    if r == "last quarter":
        return _month(quarter, -3), quarter
    if r in ("this year", "current year"):
        return year, datetime(year.year + 1, 1, 1)
    if r == "last year":
        return datetime(year.year - 1, 1, 1), year
    if m := re.fullmatch(r"q([1-4]) (\d{4})", r):
        start = datetime(int(m[2]), 3 * int(m[1]) - 2, 1)
        return start, _month(start, 3)
    if m := re.fullmatch(r"(\d{4})", r):
        return datetime(int(m[1]), 1, 1), datetime(int(m[1]) + 1, 1, 1)
    raise ValueError(f"unknown time rule {rule!r}")


def in_window(column: Column, window: Window) -> Column:
    low, high = window
    out = F.lit(True)
    if low is not None:
        out = column >= F.lit(low.isoformat(" ")).cast("timestamp_ntz")
    if high is not None:
        upper = column < F.lit(high.isoformat(" ")).cast("timestamp_ntz")
        out = upper if low is None else out & upper
    return out


def up_to(column: Column, moment: datetime) -> Column:
    """At or before a moment: the rule N days ago includes its end."""
    return column <= F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
