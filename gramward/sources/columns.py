"""Ingest: one source column to (row_id, data) with a manifest."""

from __future__ import annotations

import json
import os
import tempfile
import warnings
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, column: str) -> DataFrame:
    return _text_or_bytes(spark.read.parquet(path), column)


def read_delimited(spark: SparkSession, path: str, column: str | int, sep: str = ",") -> DataFrame:
    """A header is required, quotes as in RFC 4180, short records fail, empty fields stay empty, quoted or not; there are no nulls."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("columnPruning", False)
    reader = reader.option("emptyValue", "").option("nullValue", "\u0000").option("mode", "FAILFAST")
    rows = reader.csv(path)
    found = _text_or_bytes(rows, rows.columns[column] if isinstance(column, int) else column)
    return found.select(F.coalesce("data", F.lit("")).alias("data"))


def _text_or_bytes(rows: DataFrame, column: str) -> DataFrame:
    if column not in rows.columns:
        raise ValueError(f"no column {column!r}; there are {rows.columns}")
    kind = rows.schema[column].dataType
    if not isinstance(kind, T.StringType | T.BinaryType):
        raise TypeError(f"column {column!r} is {kind.simpleString()}; string or binary is needed")
    return rows.select(F.col(column).alias("data"))


def extract_tsv_field(spark: SparkSession, path: str, field: int, prefix: str | None = None) -> DataFrame:
    """Field k of (gzip) TSV lines, stripped; empty ones and those without the prefix go."""
    value = F.trim(F.split("value", "\t")[field])
    rows = spark.read.text(path).select(value.alias("data")).where("data != ''")
    return rows.where(F.startswith("data", F.lit(prefix))) if prefix else rows


def extract_json_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    """A field of (gzip) JSON lines, stripped; bad lines and empty values go."""
    return spark.read.text(path).select(F.trim(F.get_json_object("value", f"$.{field}")).alias("data")).where("data != ''")


def first_in_order(rows: DataFrame, count: int | None) -> DataFrame:
    """The first rows in the order of the source; all without a count."""
    if count is None:
        return rows
    return rows.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(count).drop("_at")


def extract_english_literals(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """The text between the first quote and the last ``"@en`` of N-Triples lines; the first ``count`` in file order."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return rows.select(F.regexp_extract("value", r'^[^"]*"(.*)"@en', 1).alias("data")).where("data != ''").transform(first_in_order, count)


def extract_xml_element(spark: SparkSession, path: str, row_tag: str, element: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(f"`{element}` string").load(path)
    return rows.select(F.trim(F.col(element)).alias("data")).where("data != ''")


def extract_tar_tsv(spark: SparkSession, path: str, field: int) -> DataFrame:
    """Field k of every .tsv member of tar archives; an archive is read within one task."""

    def run(frames):
        import io
        import tarfile

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".tsv"):
                            fields = (line.decode("utf-8", "replace").rstrip("\n").split("\t") for line in archive.extractfile(member))
                            found = [f[field].strip() for f in fields if len(f) > field]
                            yield pd.DataFrame({"data": [x for x in found if x]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "data string")


def check_files(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Stop where a file of that name is not there or has another SHA-256."""
    found = {os.path.basename(r["path"]): r["sha256"] for r in file_digests(spark, path).collect()}
    wrong = sorted(name for name, digest in expected.items() if found.get(name) != digest)
    if wrong:
        raise ValueError(f"{path}: not as expected: {wrong}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def ingest(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """``row_id, data``: nulls removed, rows numbered from 0 in source order, or by ``order``.

    Numbering takes a count for each partition and an offset, not one sorted partition: a row's place in its partition comes
    with its id, and the offsets, one for each partition, are broadcast. Sorted rows are kept, since a second sort may deal them otherwise.
    """
    kept = rows.where(F.col("data").isNotNull()).select("data")
    if order is not None:
        kept = kept.sort(order).persist()
    placed = kept.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r["_part"]: r["n"] for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}  # one for each partition
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total - (k << 33)))
        total += counts[k]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _shift long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select((F.col("_at") + F.col("_shift")).alias("row_id"), "data")


def load_column(spark: SparkSession, folder: str, verify: bool = False) -> tuple[DataFrame, dict]:
    """A written column with its manifest, held against each other: row count, ids from 0 without gaps, byte counts; the checksum if asked."""
    manifest = json.loads(Path(folder, "manifest.json").read_text())
    rows = spark.read.parquet(f"{folder}/data.parquet")
    if rows.columns != ["row_id", "data"]:
        raise ValueError(f"{folder}: columns {rows.columns}, row_id and data are needed")
    found = rows.agg(
        F.count("*").alias("n"), F.coalesce(F.min("row_id"), F.lit(0)).alias("low"), F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("high"),
        F.count_distinct("row_id").alias("ids"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count("data").alias("values"),
    ).first()
    if not found["n"] == found["high"] == found["ids"] == found["values"] == manifest["num_rows"] or found["low"] or found["bytes"] != manifest["payload_bytes"]:
        raise ValueError(f"{folder}: the data is not what its manifest says")
    if verify and checksum_of(rows) != manifest["checksum"]:
        raise ValueError(f"{folder}: checksum differs")
    return rows, manifest


def checksum_of(rows: DataFrame) -> str:
    """The checksum of rows in order, which pass through the driver one by one: it is defined over their sequence."""
    from gramward.functions.truth import column_checksum

    ordered = rows.sort("row_id").select("data").toLocalIterator()
    return column_checksum(bytes(r[0]) if not isinstance(r[0], str) else r[0].encode() for r in ordered)


def column_stats(rows: DataFrame, column: str) -> DataFrame:
    """One row of counts and byte lengths, nulls apart."""
    size = F.octet_length(column)
    return rows.agg(
        F.count(column).alias("num_rows"), F.count_if(F.col(column).isNull()).alias("nulls_removed"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("payload_bytes"), F.min(size).cast("long").alias("min_len"),
        F.max(size).cast("long").alias("max_len"), F.avg(size).alias("mean_len"),
    )


def byte_histogram(rows: DataFrame, column: str) -> DataFrame:
    """``byte, n`` for all 256 values. Bytes are counted within Arrow batches before the shuffle."""
    data = F.col(column) if isinstance(rows.schema[column].dataType, T.BinaryType) else F.encode(F.col(column), "UTF-8")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for batch in batches:
            joined = b"".join(x.as_py() or b"" for x in batch.column(0))
            total += np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    parts = rows.select(data.alias("d")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    every = rows.sparkSession.range(256).select(F.col("id").cast("int").alias("byte"))
    return every.join(parts, "byte", "left").select("byte", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def write_column(rows: DataFrame, folder: str, dataset: str, source: dict) -> dict:
    """Write the canonical artifact and its manifest; refuses a column without rows."""
    stats = column_stats(rows, "data").first().asDict()
    if not stats["num_rows"]:
        raise ValueError(f"{dataset}: no rows")
    spark = rows.sparkSession
    rows.write.parquet(f"{folder}/data.parquet")
    manifest = {"format_version": 1, "id": dataset, "source": source, **stats}
    manifest["byte_freq"] = [r["n"] for r in byte_histogram(rows, "data").sort("byte").collect()]
    manifest["checksum"] = checksum_of(spark.read.parquet(f"{folder}/data.parquet"))
    write_json(f"{folder}/manifest.json", manifest)
    return manifest


def write_json(path: str, value: object) -> None:
    """Written beside and then renamed, so that a reader never sees half of it."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, suffix=".json") as file:
        json.dump(value, file, indent=1, sort_keys=True)
    os.replace(file.name, path)


def read_results(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Result rows of JSON lines. Malformed ones are told with their number and go; if strict, the first fails with its line."""
    lines = spark.read.text(path, wholetext=False).withColumn("_at", F.monotonically_increasing_id())
    parsed = F.from_json("value", schema.rstrip() + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.where(F.trim("value") != "").select("_at", "value", parsed.alias("r"))
    bad = rows.where(F.col("r._bad").isNotNull() | F.col("r").isNull())
    if strict:
        first = bad.orderBy("_at").select("value").first()
        if first:
            number = next((k for k, line in enumerate(_lines(path), 1) if line == first["value"]), "?")
            raise ValueError(f"{path}, line {number}: no result row: {first['value'][:80]!r}")
    else:
        count = bad.count()
        if count:
            warnings.warn(f"{path}: {count} malformed rows left out", stacklevel=2)
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return rows.where(F.col("r._bad").isNull() & F.col("r").isNotNull()).select(*[F.col(f"r.{n}").alias(n) for n in names])


def _lines(path: str) -> list[str]:
    if os.path.isfile(path):
        return Path(path).read_text(errors="replace").splitlines()
    return []


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of rows: CSV with a header, JSON lines, a JSON list, or an object with the list under ``rows``."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    rows = spark.read.option("multiLine", True).json(path)
    if rows.columns == ["rows"]:
        return rows.select(F.explode("rows").alias("row")).select("row.*")
    return rows
