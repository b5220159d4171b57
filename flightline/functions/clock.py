"""m:ss clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_clock(t: Column) -> Column:
    s = t.cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def parse_clock(text: Column) -> Column:
    """Seconds of an ``m:ss`` text, null when it is not one."""
    p = F.split(text, ":")
    return F.when(text.rlike(r"^\d+:\d+"), p[0].try_cast("double") * 60 + p[1].try_cast("double"))
