"""The result store on disk: runs loaded once each, replaced where they changed, with their history kept."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramward.plans import store
from gramward.sources.columns import read_results

RUN_FIELDS = "run_key string, run_dir string, started_at string, content string, spec_key string, platform_key string, suite_key string, n_rows long"
RESULT_FIELDS = "system string, dataset string, query_id string, op string, status string, median_ns double, n_values long, eval_domain long, eval_domain_matches long, raw_bytes long, footprint_bytes long, error string"


def platform_key(host: str, os: str, arch: str, cpu: str, cores: int) -> str:
    return "|".join("-" if x is None else str(x) for x in (host, os, arch, cpu, cores))


def single_suites(bindings: DataFrame) -> DataFrame:
    """``dataset, suite``: the suite each dataset was run with. Two for one dataset fail the job when it runs."""
    found = bindings.select("dataset", "suite").distinct().groupBy("dataset").agg(F.count("*").alias("_n"), F.max("suite").alias("suite"))
    one = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("more than one suite for "), "dataset")).isNull())
    return found.where(one).select("dataset", "suite")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds between two RFC 3339 texts, whatever their time zones."""
    return F.unix_timestamp(F.to_timestamp(later)) - F.unix_timestamp(F.to_timestamp(earlier))


def with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The runs that have results, newest first."""
    return runs.join(results.select("run_key").distinct(), "run_key", "left_semi").orderBy(F.desc("started_at"), "run_key")


def with_platform(runs: DataFrame, platforms: DataFrame) -> DataFrame:
    return runs.join(platforms, "platform_key")


class Store:
    """Tables ``runs`` and ``results`` under a folder; results are partitioned by run, so that a changed run replaces its own part only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def runs(self) -> DataFrame:
        """Every load of every run, marked ``is_latest`` for the newest start of a folder."""
        rows = self.spark.read.schema(RUN_FIELDS).parquet(f"{self.folder}/runs") if self._exists("runs") else self.spark.createDataFrame([], RUN_FIELDS)
        return store.with_latest(rows)

    def results(self) -> DataFrame:
        fields = f"{RESULT_FIELDS}, run_key string"
        return self.spark.read.schema(fields).parquet(f"{self.folder}/results") if self._exists("results") else self.spark.createDataFrame([], fields)

    def load(self, run_dir: str) -> str:
        """Load a run folder (run.json, results.jsonl): ``same`` if its content is there, ``changed`` if it replaced it, else ``new``.

        A run is its folder and start; one that started anew is another run, and the older stays as history.
        """
        about = json.loads(Path(run_dir, "run.json").read_text())
        content = hashlib.sha256(Path(run_dir, "results.jsonl").read_bytes() + json.dumps(about, sort_keys=True).encode()).hexdigest()[:16]
        key = hashlib.sha256(f"{Path(run_dir).name}|{about['started_at']}".encode()).hexdigest()[:16]
        old = self.runs().where(F.col("run_key") == key).select("content").head(1)
        if old and old[0]["content"] == content:
            return "same"
        rows = read_results(self.spark, f"{run_dir}/results.jsonl", RESULT_FIELDS).withColumn("run_key", F.lit(key))
        suites = self.spark.createDataFrame([(d["id"], d["suite"]) for d in about["datasets"]], "dataset string, suite string")
        suite_key = ",".join(f"{r['dataset']}={r['suite']}" for r in single_suites(suites).orderBy("dataset").collect())
        expected = rows.count()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_key").parquet(f"{self.folder}/results")
        stored = self.results().where(F.col("run_key") == key).count()
        if stored != expected:
            raise RuntimeError(f"{run_dir}: {stored} rows stored of {expected}")
        run = (key, Path(run_dir).name, about["started_at"], content, about.get("spec_key", "-"), platform_key(*[about["platform"].get(k) for k in ("host", "os", "arch", "cpu", "cores")]), suite_key, expected)
        self.spark.createDataFrame([run], RUN_FIELDS).withColumn("_part", F.col("run_key")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(f"{self.folder}/runs")
        return "changed" if old else "new"

    def view(self) -> DataFrame:
        """Results with their runs and derived metrics."""
        return store.view(self.results(), (self.runs().drop("n_rows"), "run_key"))
