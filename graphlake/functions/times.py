"""Daily slots and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_slot(now: Column, hour: int, minute: int = 0) -> Column:
    """The latest daily time at or before ``now``."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today <= now, today).otherwise(today - F.make_dt_interval(F.lit(1)))


def is_due(now: Column, last_run: Column, hour: int, minute: int = 0) -> Column:
    """Whether nothing ran since the latest slot."""
    return last_run.isNull() | (last_run < last_slot(now, hour, minute))


def size_mb(text: Column) -> Column:
    """``2g``, ``512m``, ``1024k`` in whole megabytes; null for other text."""
    n = F.regexp_extract(text, r"^\s*([0-9]+)\s*[kKmMgG][bB]?\s*$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])[bB]?\s*$", 1))
    return F.when(unit == "g", n * 1024).when(unit == "m", n).when(unit == "k", (n / 1024).cast("bigint"))
