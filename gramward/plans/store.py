"""The result store: dimensions, one fact, and the view that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_key(*columns: str) -> Column:
    """Columns joined by a bar, NULL as a dash."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def dimension(fact: DataFrame, name: str, *columns: str) -> DataFrame:
    return fact.select(*columns).distinct().withColumn(f"{name}_key", natural_key(*columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.join(old, key, "left_anti"))


def replace_changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Idempotent load: rows of a key with an equal content hash stay, changed ones are replaced, others added."""
    same = old.join(new.select(key, F.col(content).alias("_new")), key, "left")
    kept = same.where(F.col("_new").isNull() | (F.col("_new") == F.col(content))).drop("_new")
    return kept.unionByName(new.join(kept, key, "left_anti"))


def with_latest(runs: DataFrame) -> DataFrame:
    newest = runs.groupBy("run_dir").agg(F.max("started_at").alias("_newest"))
    return runs.join(newest, "run_dir").withColumn("is_latest", F.col("started_at") == F.col("_newest")).drop("_newest")


def attach_builds(queries: DataFrame, builds: DataFrame, keys: list[str]) -> DataFrame:
    """Each query row with its build row. A row without one fails the job when it runs."""
    marked = queries.join(builds.withColumn("_found", F.lit(True)), keys, "left")
    return marked.where(F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.lit("query row without build row")).isNull())).drop("_found")


def gate_ok(status: str, truth_hash: str, hash_: str, truth_count: str, count: str) -> Column:
    right = (F.col(status) == "ok") & (F.col(truth_hash) == F.col(hash_)) & (F.col(truth_count) == F.col(count))
    return F.coalesce(right, F.lit(False))


def label(candidate: str, strategy: str, scanner: str, config: str | None = None) -> Column:
    """``candidate/strategy+scanner@k=v,...``: the scanner and the settings (a map, in order of its keys) where there are any."""
    scan = F.when(F.col(scanner).isNotNull(), F.concat(F.lit("+"), F.col(scanner))).otherwise("")
    parts = [F.col(candidate), F.lit("/"), F.col(strategy), scan]
    if config is not None:
        pairs = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat_ws("=", e["key"], e["value"]))
        parts.append(F.when(F.size(config) > 0, F.concat(F.lit("@"), F.array_join(pairs, ","))).otherwise(""))
    return F.concat(*parts)


def spec_key(*columns: str) -> Column:
    """16 hex digits of the content: arrays are sorted, so that their order does not count."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.array_join(F.array_sort(c), ",") for c in columns]), 256), 1, 16)


def is_text(needles: Column) -> Column:
    """Whether all needles are UTF-8."""
    return F.forall(needles, lambda n: F.is_valid_utf8(n.cast("string")))


def needle_text(needles: Column) -> Column:
    """Needles as text joined by `` | ``; those that are not UTF-8 in hex."""
    shown = F.transform(needles, lambda n: F.when(F.is_valid_utf8(n.cast("string")), n.cast("string")).otherwise(F.concat(F.lit("\\x"), F.hex(n))))
    return F.array_join(shown, " | ")


def view(fact: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """The fact with its dimensions and derived metrics. Dimensions are joined as the planner sizes them."""
    out = fact
    for rows, key in dimensions:
        out = out.join(rows, key)
    domain = {"selectivity_domain": F.col("eval_domain_matches") / F.col("eval_domain")} if "eval_domain_matches" in out.columns else {}
    return out.withColumns(domain | {
        "ns_per_value": F.col("median_ns") / F.col("n_values"), "ns_per_domain_value": F.col("median_ns") / F.coalesce("eval_domain", "n_values"),
        "dedup_factor": F.col("n_values") / F.coalesce("eval_domain", "n_values"),
        "gbps_raw": F.col("raw_bytes") / F.col("median_ns"), "compression_ratio": F.col("raw_bytes") / F.col("footprint_bytes"),
    })
