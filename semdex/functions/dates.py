"""Date arguments: a number of days, weeks or 30-day months ago, or a day's local midnight."""

from __future__ import annotations

import datetime as dt
import re

FORMS = "expected YYYY-MM-DD or a relative age like 7d, 2w or 3m"
DAYS = {"d": 1, "w": 7, "m": 30}


def parse_date(text: str, now: dt.datetime | None = None, tz: dt.tzinfo | None = None) -> dt.datetime:
    """The instant a date argument names, in UTC; ValueError tells the forms. tz: whose midnight counts (default: local)."""
    now = now or dt.datetime.now(dt.timezone.utc)
    text = text.strip()
    if not text:
        raise ValueError(f"empty date; {FORMS}")
    if m := re.fullmatch(r"([0-9]+)([dwm])", text):
        days = int(m[1]) * DAYS[m[2]]
        epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        if days > (now - epoch).total_seconds() / 86_400:
            raise ValueError(f"'{text}' is too far in the past")
        return now - dt.timedelta(days=days)
    try:
        day = dt.datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        raise ValueError(f"could not parse date '{text}'; {FORMS}") from None
    early, late = (day.replace(tzinfo=tz, fold=f) if tz else day.replace(fold=f).astimezone() for f in (0, 1))
    if early.utcoffset() != late.utcoffset():
        raise ValueError(f"'{text}' is ambiguous in local time; {FORMS}")
    return early.astimezone(dt.timezone.utc)
