"""Small date functions: RFC 3339 texts, epochs, cut-offs."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def valid_rfc3339(c: Column) -> Column:
    """Whether a text has the shape of RFC 3339; null has not."""
    return F.coalesce(c.rlike(RFC3339), F.lit(False))


#: The last millisecond that a timestamp can hold.
LAST_MS = 9_223_372_036_854_775


def epoch_ms_text(ms: Column) -> Column:
    """UTC text of milliseconds, to the second; '' for null, for what is not positive and for what no timestamp can hold (from the year 294247)."""
    held = F.when((ms > 0) & (ms <= LAST_MS), ms)
    return F.coalesce(F.date_format(F.timestamp_millis(held), "y-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def parse_cutoff(text: str, now_ms: int | None = None) -> str:
    """A cut-off as RFC 3339: a date, an instant, or a span before now such as 7d. Raises ValueError for anything else."""
    if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", text):
        return f"{text}T00:00:00Z"
    if re.match(RFC3339.replace(r"\z", r"\Z"), text):
        return text
    span = re.fullmatch(r"(\d{1,9})([smhdw])", text)
    if not span:
        raise ValueError(f"not a date, an instant or a span: {text}")
    now = (now_ms if now_ms is not None else int(time.time() * 1000)) // 1000
    return datetime.fromtimestamp(now - int(span[1]) * _UNITS[span[2]], UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
