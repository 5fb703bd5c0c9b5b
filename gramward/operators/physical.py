"""Other plans for the same answer: dictionary domain, chunks, grams, token covers, codecs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramward.functions.predicates import Query, matches


def direct(rows: DataFrame, column: str, q: Query) -> DataFrame:
    return rows.where(matches(F.col(column), q))


def dictionary(rows: DataFrame, column: str, q: Query, condition: Callable[[Column, Query], Column] = matches) -> DataFrame:
    """Each distinct value is tested once; rows follow by a semi join.

    Values are known by 128 bits of hash, so that a text is shuffled at most once, and only where the partial
    aggregation of its task has not met it already; rows themselves are joined by hash.
    """
    h, h2 = F.xxhash64(column), F.xxhash64(F.lit("value"), column)
    values = rows.where(F.col(column).isNotNull()).groupBy(h.alias("_h"), h2.alias("_h2")).agg(F.any_value(column).alias("_value"))
    hits = values.where(condition(F.col("_value"), q)).select("_h", "_h2")
    return rows.join(hits, (h == F.col("_h")) & (h2 == F.col("_h2")), "left_semi").select(*rows.columns)


def mandatory(column: Column, q: Query, size: int = 4) -> Column:
    """A necessary condition: for some needle, its rarest run of ``size`` bytes is there (the whole needle, if shorter)."""
    from gramward.functions.prefilters import commonness

    def piece(needle: bytes) -> str:
        text = needle.decode()
        cuts = [text[k : k + size] for k in range(max(1, len(text) - size + 1))]
        return min(cuts, key=lambda c: sum(commonness(b) for b in c.encode()))

    found = [F.contains(column, F.lit(piece(n))) if n else column.isNotNull() for n in dict.fromkeys(q.needles)]
    return reduce(Column.__or__, found)


def grouped_any(column: Column, q: Query, group: int = 8) -> Column:
    """``contains_any`` of many needles in groups: a group's shared first check, then its needles, groups joined by or."""
    from gramward.functions.prefilters import survives_any

    needles = list(dict.fromkeys(q.needles))
    parts = [Query(q.id, q.op, tuple(needles[k : k + group])) for k in range(0, len(needles), group)]
    return reduce(Column.__or__, [survives_any(column, p, "tail_code") & matches(column, p) for p in parts])


def dictionary_stats(rows: DataFrame, column: str, q: Query, id_column: str | None = None, chunk_rows: int = 0) -> DataFrame:
    """Sizes of the dictionary domain, over chunks of ids if asked: uniques, code bits and bytes, matches, dedup."""
    if chunk_rows % 64 or (chunk_rows and id_column is None):
        raise ValueError("chunk_rows must be a multiple of 64 and needs an id column")
    chunk = F.floor(F.col(id_column) / chunk_rows) if chunk_rows else F.lit(0)
    values = rows.where(F.col(column).isNotNull()).select(chunk.cast("long").alias("chunk"), F.col(column).alias("v"))
    uniques = values.groupBy("chunk", "v").agg(F.count("*").alias("n"))
    chunks = uniques.groupBy("chunk").agg(F.count("*").alias("u"), F.sum("n").alias("n"), F.count_if(matches(F.col("v"), q)).alias("m"))
    bits = F.greatest(F.lit(1), F.ceil(F.log2("u")))
    sized = chunks.select("u", "n", "m", bits.cast("long").alias("bits"))
    return sized.agg(
        F.sum("u").alias("eval_domain"), F.sum("m").alias("eval_domain_matches"), F.max("bits").alias("code_bits"),
        F.sum(F.ceil(F.col("n") * F.col("bits") / 8)).cast("long").alias("code_bytes"), (F.sum("n") / F.sum("u")).alias("dedup_factor"),
    )


def footprint(rows: DataFrame, column: str, id_column: str, chunk_rows: int = 0) -> DataFrame:
    """Payload and offset bytes of the raw layout, over chunks: 8 bytes for each row and one more for each chunk."""
    chunk = F.floor(F.col(id_column) / chunk_rows) if chunk_rows else F.lit(0)
    each = rows.where(F.col(column).isNotNull()).groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sum(F.octet_length(column)).alias("b"))
    return each.agg(
        F.count("*").alias("num_chunks"), F.sum("b").alias("payload"), F.sum((F.col("n") + 1) * 8).alias("offsets"),
        (F.sum("b") + F.sum((F.col("n") + 1) * 8)).alias("raw_bytes"),
    )


def codec_round_trip(rows: DataFrame, folder: str, codec: str, level: int | None = None) -> DataFrame:
    """Write with a Parquet codec (none, lz4_raw, zstd, snappy, gzip) and read back."""
    writer = rows.write.option("compression", codec)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def codec_sizes(folders: dict[str, str], spark: SparkSession) -> DataFrame:
    """``codec, bytes``: what the files of each folder hold."""
    out = None
    for codec, folder in folders.items():
        sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        sizes = sizes.select(F.lit(codec).alias("codec"), "bytes")
        out = sizes if out is None else out.union(sizes)
    return out


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores, where a plain scan has fewer partitions than there are cores, as one of a small file has; else as they are.

    For what makes many rows of one; a mere test of rows costs less than dealing them.
    """
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def grams(column: Column, size: int) -> Column:
    """Distinct n-grams of characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) - size + 1))
    return F.array_distinct(F.filter(F.transform(starts, lambda at: F.substring(column, at, F.lit(size))), lambda g: F.length(g) == size))


def gram_index(rows: DataFrame, id_column: str, column: str, size: int = 3) -> DataFrame:
    """The inverted index ``gram, id``; written once, it serves every later query."""
    return spread(rows.select(id_column, column)).select(F.explode(grams(F.col(column), size)).alias("gram"), id_column)


def gram_lookup(index: DataFrame, rows: DataFrame, id_column: str, column: str, q: Query, size: int = 3) -> DataFrame:
    """Ids whose rows hold every gram of some needle, then verified. Short needles verify all rows."""
    cut = [n.decode() for n in q.needles]
    if min(map(len, cut)) < size or q.op not in ("contains", "contains_any"):
        return direct(rows, column, q)
    candidates = None
    for needle in dict.fromkeys(cut):
        own = sorted({needle[k : k + size] for k in range(len(needle) - size + 1)})
        hit = index.where(F.col("gram").isin(own)).groupBy(id_column).agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(own)).select(id_column)
        candidates = hit if candidates is None else candidates.union(hit)
    return direct(rows.join(candidates.distinct(), id_column, "left_semi"), column, q)


def token_index(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """``token, id, n``: white-space tokens with their counts in each row."""
    return spread(rows.select(id_column, column)).select(id_column, F.explode(F.filter(F.split(column, " "), lambda t: t != "")).alias("token")).groupBy("token", id_column).agg(F.count("*").alias("n"))


#: A task gives its counts of tokens when it has so many different ones, or has read so many bytes: what it holds is bounded, whatever the texts.
TOKENS_HELD, BYTES_HELD = 500_000, 64 << 20


def _row_token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, n, rows``: occurrences, and rows that have the token, summed over rows of a task."""
    found, having, read = Counter(), Counter(), 0

    def given() -> Iterator[pa.RecordBatch]:
        tokens = list(found)
        for at in range(0, len(tokens), 1 << 16):
            own = tokens[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([found[t] for t in own], pa.int64()), pa.array([having[t] for t in own], pa.int64())], names=["token", "n", "rows"])
        found.clear()
        having.clear()

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            tokens = text.split(b" ")
            found.update(tokens)
            having.update(set(tokens))
            read += len(text)
            if read >= BYTES_HELD or len(found) >= TOKENS_HELD:
                yield from given()
                read = 0
    yield from given()


def token_counts(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """``token, term_freq, row_freq``: occurrences of each white-space token, and ids of rows that have it.

    Rows are counted within their task, so that only sums of a task's tokens are shuffled. Rows that share an id (or have none, which counts for
    no id) are the exception: their tokens meet by id first.
    """
    texts = rows.select(id_column, column).where(F.col(column).isNotNull())
    shared = rows.groupBy(id_column).agg(F.count("*").alias("_k")).where((F.col("_k") > 1) | F.col(id_column).isNull()).select(F.col(id_column).alias("_id"))
    met = None
    if not shared.isEmpty():
        same = F.col(id_column).eqNullSafe(F.col("_id"))
        met = token_index(texts.join(shared, same, "left_semi"), id_column, column).groupBy("token").agg(F.sum("n").alias("n"), F.count(id_column).alias("rows"))
        texts = texts.join(shared, same, "left_anti")
    alone = spread(texts.select(F.col(column).cast("binary"))).mapInArrow(_row_token_counts, "token binary, n long, rows long").select(F.col("token").cast("string").alias("token"), "n", "rows")
    counts = alone if met is None else alone.union(met)
    return counts.where(F.col("token") != "").groupBy("token").agg(F.sum("n").alias("term_freq"), F.sum("rows").alias("row_freq"))


def token_statistics(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """``token, term_freq, row_freq, place``: tokens in alphabetical order and the running sum of the term frequencies before each.

    The running sum goes by first characters: sums within one of them, and the total of those before. Order is by code point.
    """
    # Both sides of the join keep all columns of the counts (``_rows`` for that alone), and ``_first`` is never NULL, so that no test for it is put below one
    # of them: they are then one plan, and tokens are counted once.
    counts = token_counts(rows, id_column, column).withColumn("_first", F.coalesce(F.substring("token", 1, 2), F.lit("")))
    firsts = counts.groupBy("_first").agg(F.sum("term_freq").alias("_n"), F.sum("row_freq").alias("_rows"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each pair of first characters
    starts = firsts.select("_first", "_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_first").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_within", F.coalesce(F.sum("term_freq").over(within), F.lit(0)))
    joined = placed.join(starts, "_first").where(F.col("_rows") >= F.col("row_freq"))
    return joined.select("token", "term_freq", "row_freq", (F.col("_start") + F.col("_within")).alias("place"))


def token_cover(rows: DataFrame, id_column: str, column: str, needle: str) -> DataFrame:
    """Ids that hold a token through which every match of ``needle`` must pass: a sound superset of the matches.

    A match reaches over neighbouring tokens: a needle's inner words are whole tokens, its first
    word ends a token and its last one begins a token; a needle of one word lies within a token. The longest
    word is the cheapest cut.
    """
    words = needle.split(" ")
    k = max(range(len(words)), key=lambda i: len(words[i]))
    token = F.col("token")
    if len(words) == 1:
        test = F.contains(token, F.lit(needle))
    else:
        test = F.endswith(token, F.lit(words[0])) if k == 0 else F.startswith(token, F.lit(words[k])) if k == len(words) - 1 else token == words[k]
    if not words[k]:
        return rows.select(id_column)
    return token_index(rows, id_column, column).where(test).select(id_column).distinct()
