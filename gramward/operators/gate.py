"""Truth, bitmaps and the gate: no figure is reported before its matches are right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramward.functions.predicates import Query, matches


def bitmap_words(rows: DataFrame, id_column: str, condition: Column) -> DataFrame:
    """``word, bits, popcount`` of the matching ids, least significant bit first; empty words are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(id_column), F.lit(64)).cast("int"))
    found = rows.where(condition).groupBy(F.floor(F.col(id_column) / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return found.withColumn("popcount", F.bit_count("bits").cast("long"))


def truths(rows: DataFrame, id_column: str, column: str, queries: list[Query], sample: int = 8) -> DataFrame:
    """``query_id, op, match_count, selectivity, sample`` of many queries, without a scan or sort for each.

    Counts are conditional aggregates of one pass. For the samples of first ids a second pass gives a row for each match; a
    rank limit keeps the least ``sample`` of each query within each task, before they meet.
    """
    col = F.col(column)
    counts = rows.agg(F.count(col).alias("n"), *[F.count_if(matches(col, q)).alias(f"q{k}") for k, q in enumerate(queries)])
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q.id).alias("query_id"), F.lit(q.op).alias("op"), F.col(f"q{k}").alias("match_count")) for k, q in enumerate(queries)])
    flat = counts.select("n", F.explode(listed).alias("q")).select("q.*", (F.col("q.match_count") / F.col("n")).alias("selectivity"))
    hit = F.filter(F.array(*[F.when(matches(col, q), F.lit(k)) for k, q in enumerate(queries)]), lambda k: k.isNotNull())
    met = rows.select(F.col(id_column).alias("id"), F.explode(hit).alias("k"))
    few = met.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where(F.col("_r") <= sample)
    first = few.groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("sample"))  # at most `sample` ids
    return flat.join(first, "k", "left").select("query_id", "op", "match_count", "selectivity", F.coalesce("sample", F.array().cast("array<long>")).alias("sample"))


def gate(expected: DataFrame, actual: DataFrame, id_column: str) -> DataFrame:
    """One row: expected and actual counts, whether the sets are equal, and the first divergent id."""
    e = expected.select(F.col(id_column).alias("e"))
    a = actual.select(F.col(id_column).alias("a"))
    both = e.join(a, F.col("e") == F.col("a"), "full")
    return both.agg(
        F.count("e").alias("expected"), F.count("a").alias("actual"),
        F.min(F.when(F.col("e").isNull() | F.col("a").isNull(), F.coalesce("e", "a"))).alias("first_divergent"),
    ).withColumn("gate_ok", F.col("first_divergent").isNull())


def explain(expected: DataFrame, actual: DataFrame, rows: DataFrame, id_column: str, column: str, shown: int = 128) -> DataFrame:
    """The gate's row with the first divergent row's text, up to ``shown`` bytes, what is no UTF-8 replaced."""
    found = gate(expected, actual, id_column)
    raw = F.substring(F.col(column).cast("binary"), 1, shown)
    text = rows.select(F.col(id_column).alias("first_divergent"), F.make_valid_utf8(raw.cast("string")).alias("divergent_text"))
    return found.join(text, "first_divergent", "left").select("expected", "actual", "first_divergent", "gate_ok", "divergent_text")


def canary(rows: DataFrame, id_column: str, column: str, q: Query, flipped: int = 0) -> DataFrame:
    """A deliberately wrong variant: the answer of one row is turned over. A gate must catch it."""
    right = F.coalesce(matches(F.col(column), q), F.lit(False))
    return rows.where(right != (F.col(id_column) == flipped))
