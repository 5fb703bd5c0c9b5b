"""Latency distributions and speed metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(plan: Callable[[], DataFrame], warmup: int = 3, least: int = 10, least_ms: float = 200.0, most: int = 1_000_000) -> list[int]:
    """Nanoseconds of runs into the noop sink, after warm-up."""
    out: list[int] = []
    for _ in range(warmup):
        plan().write.format("noop").mode("overwrite").save()
    while len(out) < most and (len(out) < least or sum(out) < least_ms * 1e6):
        began = time.perf_counter_ns()
        plan().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter_ns() - began)
    return out


def distribution(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, nearest-rank p25, median, p75 and p99, max, mean and population deviation of each key."""

    def rank(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")

    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), rank(0.25).alias("p25"), rank(0.5).alias("median"), rank(0.75).alias("p75"),
        rank(0.99).alias("p99"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"),
    )
