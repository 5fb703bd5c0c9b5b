"""Analyses over measurements: bins, bands, winners, ratios, Pareto points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_bucket(n: Column) -> Column:
    """Needle lengths by doubling; 0 and NULL count as 1."""
    n = F.coalesce(n, F.lit(1))
    return (
        F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 8, "5-8").when(n <= 16, "9-16").when(n <= 32, "17-32").otherwise("33+")
    )


def selectivity_band(s: Column) -> Column:
    return (
        F.when(s == 0, "0").when(s < 1e-4, "<1e-4").when(s < 1e-3, "<1e-3").when(s < 1e-2, "<1e-2").when(s < 1e-1, "<1e-1").otherwise(">=1e-1")
    )


def decade_bins(rows: DataFrame, x: str, y: str, filled: bool = False) -> DataFrame:
    """Thirds of decades of x > 0: centre, count and quartiles of y by interpolation. ``filled``: empty bins between too, with n = 0, and the edges."""
    k = F.floor(F.log10(x) * 3)
    bins = rows.where(F.col(x) > 0).groupBy(k.cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.percentile(y, 0.25).alias("q25"), F.percentile(y, 0.5).alias("q50"), F.percentile(y, 0.75).alias("q75")
    )
    if filled:
        every = bins.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("bin"))
        bins = every.join(bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bins = bins.withColumn("center", F.pow(F.lit(10.0), (F.col("bin") + 0.5) / 3))
    if filled:
        bins = bins.withColumns({"low": F.pow(F.lit(10.0), F.col("bin") / 3), "high": F.pow(F.lit(10.0), (F.col("bin") + 1) / 3)})
    return bins


def equal_bins(rows: DataFrame, x: str, y: str, bins: int, log: bool = False) -> DataFrame:
    """Bins of equal width over x's range, or over that of its logarithm (x > 0); each at its median x, with the median y."""
    at = F.log10(x) if log else F.col(x)
    kept = rows.where(F.col(x) > 0) if log else rows
    ends = kept.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.floor((at - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    binned = kept.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(spread, F.lit(bins - 1)).cast("long"))  # ends is one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.median(x).alias("x"), F.median(y).alias("y"))


def collapse(rows: DataFrame, x: str, y: str, how: str, *keys: str) -> DataFrame:
    """Rows of one x (and key) as their ``mean`` or ``median``, or as they are (``none``)."""
    if how == "none":
        return rows.select(*keys, x, y)
    if how not in ("mean", "median"):
        raise ValueError(f"collapse by {how!r}; there are mean, median and none")
    return rows.groupBy(*keys, x).agg((F.avg(y) if how == "mean" else F.median(y)).alias(y))


def numeric_first(column: str) -> list[Column]:
    """An order: numbers by value, then texts by themselves."""
    return [F.asc_nulls_last(F.expr(f"try_cast(`{column}` AS double)")), F.asc(column)]


def single_shot(rows: DataFrame, keys: list[str], once: list[str], value: str, over: list[str]) -> DataFrame:
    """Measurements that several rows repeat (as a build's): one for each ``once``, the largest; then the median of them for each of ``over``."""
    return rows.groupBy(*keys, *once).agg(F.max(value).alias(value)).groupBy(*over).agg(F.median(value).alias(value))


def compression(rows: DataFrame, system: str) -> DataFrame:
    """Of each system: raw over stored bytes and payload bytes, and MB/s of building and decoding, by sums."""
    total = {c: F.sum(c) for c in ("raw_bytes", "footprint_bytes", "payload_bytes", "build_ns", "decode_ns")}
    return rows.groupBy(system).agg(
        (total["raw_bytes"] / total["footprint_bytes"]).alias("ratio_total"), (total["raw_bytes"] / total["payload_bytes"]).alias("ratio_payload"),
        (total["raw_bytes"] * 1000 / F.nullif(total["build_ns"], F.lit(0))).alias("build_mb_s"), (total["raw_bytes"] * 1000 / F.nullif(total["decode_ns"], F.lit(0))).alias("decode_mb_s"),
    )


def default_chunk(rows: DataFrame, chunk: str) -> DataFrame:
    """The chunk size to show first: whole columns if they were measured, else the least."""
    return rows.agg(F.coalesce(F.min(F.when(F.col(chunk) == 0, 0)), F.min(chunk)).alias(chunk))


def decode_speed(rows: DataFrame, gbps: str, median_ns: str, decode_ns: str) -> DataFrame:
    """Rows with ``decode_gbps`` = gbps * median / decode; what is not finite is NULL."""
    speed = F.col(gbps) * F.col(median_ns) / F.nullif(F.col(decode_ns), F.lit(0))
    return rows.withColumn("decode_gbps", F.when(~F.isnan(speed) & (F.abs(speed) != float("inf")), speed))


def takeaways(rows: DataFrame, cell: list[str], system: str, value: str, base: str, tie: float = 0.05) -> DataFrame:
    """Of each system against ``base``: cells it wins, ties (within a share) and loses, and its median and largest speed-up."""
    found = ratios(rows, cell, system, value, base).withColumn("speedup", 1 / F.col("ratio"))
    return found.groupBy(system).agg(
        F.count_if(F.col("ratio") < 1 - tie).alias("wins"), F.count_if(F.abs(F.col("ratio") - 1) <= tie).alias("ties"), F.count_if(F.col("ratio") > 1 + tie).alias("losses"),
        F.median("speedup").alias("median_speedup"), F.max("speedup").alias("best_speedup"),
    )


def winners(rows: DataFrame, cell: list[str], system: str, value: str) -> DataFrame:
    """Median of each system in each cell with its rank; ties go by name."""
    medians = rows.groupBy(*cell, system).agg(F.median(value).alias("median"))
    return medians.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("median", system)))


def ratios(rows: DataFrame, cell: list[str], system: str, value: str, base: str) -> DataFrame:
    """Each system's median over the base system's, in cells that have both."""
    medians = rows.groupBy(*cell, system).agg(F.median(value).alias("m"))
    against = medians.where(F.col(system) == base).select(*cell, F.col("m").alias("b"))
    return medians.where(F.col(system) != base).join(against, cell).select(*cell, system, (F.col("m") / F.col("b")).alias("ratio"))


def mean(value: Column) -> Column:
    """The mean by an exact sum to 18 decimals, so that neither the order of rows nor their number moves its last digits.

    Of doubles a sum drifts with the rows, and two means that are equal may then beat each other. Values of 1e10 and more, and what is not finite, take the plain mean.
    """
    exact = F.abs(value) < 1e10
    total = F.sum(F.when(exact, value.cast("decimal(38,18)"))).cast("double")
    return F.when(F.max(F.abs(value)) < 1e10, total / F.count(value)).otherwise(F.avg(value))


def pareto(points: DataFrame, name: str, high: str, low: str) -> DataFrame:
    """Points that no other beats on one axis without losing on the other; those with a NULL are beaten by none.

    Of each ``high`` only the least ``low`` can stand, and only if it is less than all of larger ``high``: a running minimum over the
    distinct values of ``high`` (one for each system at most) instead of every point against every other.
    """
    best = points.groupBy(F.col(high).alias("_h")).agg(F.min(low).alias("_l"))
    above = Window.orderBy(F.desc_nulls_last("_h")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_above", F.min("_l").over(above))
    found = points.join(best, F.col(high) == F.col("_h"), "left")
    stands = (F.col(low) == F.col("_l")) & (F.col("_above").isNull() | (F.col("_above") > F.col(low)))
    return found.where(F.col(high).isNull() | F.col(low).isNull() | stands).select(name, high, low)


def upper_median(value: str) -> Column:
    """The element at half of the number, in order: from above, the nearest rank of a half. Counts by value meet, never a group's rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def pivot_medians(rows: DataFrame, system: str, length: str, value: str, lengths: list[int]) -> DataFrame:
    out = rows.groupBy(system).pivot(length, lengths).agg(F.median(value))
    return out.select(system, *[F.col(str(n)).alias(f"len_{n}") for n in lengths])
