"""Partial dates: a text of some precision stands for a half-open interval."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta


@dataclass(frozen=True)
class DatePart:
    start: datetime
    end: datetime
    precision: str


# The ten accepted forms, from the coarsest.
_FORMS = [
    ("year", r"(\d{4})"),
    ("month", r"(\d{4})-(\d{2})"),
    ("month", r"(\d{4})(\d{2})"),
    ("day", r"(\d{4})-(\d{2})-(\d{2})"),
    ("day", r"(\d{4})(\d{2})(\d{2})"),
    ("hour", r"(\d{4})-(\d{2})-(\d{2})T(\d{2})"),
    ("minute", r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})"),
    ("second", r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})"),
    ("week", r"(\d{4})-W(\d{2})"),
    ("week", r"(\d{4})-V(\d{2})"),
]


def parse_date(text: str) -> DatePart | None:
    """The interval that a partial date stands for; None if it is no date."""
    for precision, form in _FORMS:
        m = re.fullmatch(form, text)
        if not m:
            continue
        n = [int(g) for g in m.groups()]
        try:
            if precision == "week":
                start = datetime.combine(date.fromisocalendar(n[0], n[1], 1), datetime.min.time())
                return DatePart(start, start + timedelta(weeks=1), precision)
            start = datetime(*(n + [1, 1])[: max(3, len(n))]) if len(n) < 3 else datetime(*n)
            if precision == "year":
                end = start.replace(year=start.year + 1)
            elif precision == "month":
                end = (start + timedelta(days=32)).replace(day=1)
            else:
                end = start + timedelta(**{f"{precision}s": 1})
            return DatePart(start, end, precision)
        except (ValueError, OverflowError):
            continue
    return None
