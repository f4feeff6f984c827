"""Time window text and tumbling windows."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, functions as F

from wirelake.errors import InvalidTimeWindowError

_UNIT = {"ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def parse_time_window(text: str) -> timedelta:
    """'5m', '1.5h', '100ms' -> timedelta."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|[smhd])", str(text).lower())
    if not found:
        raise InvalidTimeWindowError(text)
    return timedelta(**{_UNIT[found[2]]: float(found[1])})


def window_micros(window: str | timedelta) -> int:
    span = window if isinstance(window, timedelta) else parse_time_window(window)
    return span // timedelta(microseconds=1)


def window_seconds(window: str | timedelta) -> float:
    return window_micros(window) / 1e6


def interval_text(window: str | timedelta) -> str:
    """Text that `pyspark.sql.functions.window` and watermarks accept."""
    size = window_micros(window)
    if size <= 0:
        raise InvalidTimeWindowError(window)
    return f"{size} microseconds"


def tumbling(window: str | timedelta, column: str = "timestamp") -> Column:
    """Epoch-aligned, left-closed window struct over `column`; take `.start` as its label."""
    return F.window(F.col(column), interval_text(window))
