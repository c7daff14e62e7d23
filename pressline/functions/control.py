"""Small driver-side helpers: feed cursors, windows of sources and cron expressions (also as a Column)."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

CURSOR_CHARS = 500
CURSOR_ID = re.compile(r"(?:[a-f0-9-]{36}|legacy:[0-9]{1,18})")


class InvalidCursor(ValueError):
    pass


def _iso(value) -> str | None:
    try:
        when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return when.astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def encode_cursor(timestamp: str, row_id: str, source: str) -> str:
    raw = json.dumps({"timestamp": timestamp, "id": row_id, "source": source}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(value: str | None, source: str) -> tuple[str, str] | None:
    """(timestamp, id) of a cursor of this source; None without one; InvalidCursor for anything else."""
    if not value:
        return None
    try:
        if len(value) > CURSOR_CHARS:
            raise ValueError("too long")
        data = json.loads(base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)))
        when = _iso(data["timestamp"])
        if data["source"] != source or not isinstance(data["id"], str) or not CURSOR_ID.fullmatch(data["id"]) or not when:
            raise ValueError("not of this feed")
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidCursor("invalid feed cursor") from e
    return when, data["id"]


CRON_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6))


def cron_values(field: str, low: int, high: int) -> set[int]:
    """Values that a cron field allows; steps count from the field's (or range's) first value."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        else:
            first, _, last = span.partition("-")
            if not first.isdigit() or (last and not last.isdigit()):
                continue
            a, b = int(first), int(last or first)
        if step and not (step.isdigit() and int(step)):
            continue
        out |= {v for v in range(a, b + 1, int(step or 1)) if low <= v <= high}
    return out


def cron_matches(expression: str, when: datetime) -> bool:
    fields = expression.split()
    if len(fields) != 5:
        return False
    now = (when.minute, when.hour, when.day, when.month, (when.weekday() + 1) % 7)
    return all(v in cron_values(f, a, b) for f, v, (_, a, b) in zip(fields, now, CRON_FIELDS, strict=True))


def cron_column(expression: str, ts: Column) -> Column:
    """The same as a predicate on timestamps."""
    fields = expression.split()
    if len(fields) != 5:
        return F.lit(False)
    now = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1)
    out = F.lit(True)
    for f, v, (_, a, b) in zip(fields, now, CRON_FIELDS, strict=True):
        out = out & v.isin(*sorted(cron_values(f, a, b)))
    return out


# Seconds that a window reaches back before its watermark, and that the first one holds; the largest page.
WINDOW_OVERLAP, FIRST_WINDOW, MAX_PAGE = 300, 3600, 100_000


class Window(NamedTuple):
    """Where a source is read: articles of [start, end], page by page, news before removals."""

    start: datetime
    end: datetime
    page: int = 0
    phase: str = "news"


def window_of(checkpoint: dict | None, now: datetime) -> Window:
    """The window that a checkpoint names, or the next one: from its watermark, with an overlap, to now; the first one is an hour."""
    state = checkpoint or {}
    if state.get("kind") == "window":
        try:
            w = Window(datetime.fromisoformat(state["from"]), datetime.fromisoformat(state["to"]), state["page"], state.get("phase") or "news")
        except (KeyError, TypeError, ValueError) as e:
            raise ValueError("invalid pagination checkpoint") from e
        if w.start > w.end or type(w.page) is not int or not 0 <= w.page <= MAX_PAGE:
            raise ValueError("invalid pagination checkpoint")
        return w
    mark = state.get("watermark")
    start = datetime.fromisoformat(mark) - timedelta(seconds=WINDOW_OVERLAP) if mark else now - timedelta(seconds=FIRST_WINDOW)
    return Window(start, now)


def after_page(window: Window, full: bool, phases=("news",)) -> dict:
    """The checkpoint after a page: the next page of a full one, else the next phase, else the watermark at the window's end."""
    here = {"kind": "window", "from": window.start.isoformat(), "to": window.end.isoformat()}
    if full and window.page < MAX_PAGE:
        return here | {"page": window.page + 1, "phase": window.phase}
    rest = phases[phases.index(window.phase) + 1 :]
    return here | {"page": 0, "phase": rest[0]} if rest else {"watermark": window.end.isoformat()}
