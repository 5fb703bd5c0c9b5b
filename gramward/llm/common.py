"""Shared plumbing: scratch tables, slices of batches, free column names and connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, where all is one machine, may leave it unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gramward-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gramward/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that no plan needs any more."""
    for path in [t._scratch for t in tables]:
        _delete(path)
        _SCRATCH.remove(path)


@contextlib.contextmanager
def passing_scratch(*kept: str) -> Iterator[None]:
    """Delete the scratch tables made within, but for those ``kept``: for steps whose result is written by their end."""
    before = set(_SCRATCH)
    yield
    for path in [p for p in _SCRATCH if p not in before and p not in kept]:
        _delete(path)
        _SCRATCH.remove(path)


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path in _SCRATCH:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a worker makes of one stays small. Spark bounds a batch itself by its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores in front until they clash with no column, in any case, nor with each other."""
    used, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores, where a plain scan has fewer partitions than there are cores, as one of a small file has; else as they are."""
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def numbered_columns(df: DataFrame) -> DataFrame:
    """The columns under plain names, since a name with a dot cannot be given to Python workers."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root = least node.

    Alternates large-star and small-star rounds, so each round costs a fixed number of
    shuffles and the number of rounds grows with the logarithm of the longest path. Roots
    themselves are rows too. The least neighbours are written tables, so that both sides of a join with them are plain
    exchanges and Spark splits the partition of a hub. Nothing but a row count and a checksum reaches the driver.
    """
    now = materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = materialise(both.join(least, "x").where("y > x and y != m").select(F.col("y").alias("u"), F.col("m").alias("v")), "large")
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        changed = _mark(following)
        drop_scratch(now, least, large, lowest)
        now = following
        if changed == mark:
            break
        mark = changed
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]

