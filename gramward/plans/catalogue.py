"""The registered queries over the driver tables, and the same in SQL for the oracle."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramward.functions import prefilters, registry
from gramward.functions.predicates import matches, query
from gramward.operators import gate, generator, measure, physical
from gramward.plans import analytics, cover, loader, store
from gramward.sources import columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, table: str, sql: str | None = None):
    """Register a function of one table's DataFrame."""

    def add(make: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(_table(spark, sf_dir, table))
        if sql:
            ORACLES[name] = sql
        return make

    return add


def _predicate(name: str, table: str, id_column: str, column: str, condition: str, op: str, *needles: str) -> None:
    q = query(op, *needles)
    register(name, table, f"SELECT {id_column} FROM {table} WHERE {condition}")(lambda t: physical.direct(t, column, q).select(id_column))


_SIXTEEN = ["the and", "qu", "zz", "ung der", "benchmark", "tion the", "eau", "sch", "of the", "ñ", "ß", "ción", "xyz", "http", "@", "$"]
_predicate("pred_prefix", "pages", "page_id", "url", "starts_with(url, 'https://')", "prefix", "https://")
_predicate("pred_suffix", "part", "p_partkey", "p_name", "ends_with(p_name, 'e')", "suffix", "e")
_predicate("pred_contains", "documents", "doc_id", "text", "contains(text, 'the')", "contains", "the")
_predicate("pred_multi_contains", "documents", "doc_id", "text", "text LIKE '%the%of%'", "multi_contains", "the", "of")
_predicate("pred_multi_duplicate", "documents", "doc_id", "text", "text LIKE '%sst%sst%'", "multi_contains", "sst", "sst")
_predicate("pred_contains_any", "documents", "doc_id", "text", "contains(text, 'ung') OR contains(text, 'eau')", "contains_any", "ung", "eau")
_predicate("pred_any_k16", "documents", "doc_id", "text", " OR ".join(f"contains(text, '{n}')" for n in _SIXTEEN), "contains_any", *_SIXTEEN)
_predicate("pred_metachar", "documents", "doc_id", "text", "contains(text, '%') OR contains(text, '_') OR contains(text, chr(92))", "contains_any", "%", "_", "\\")
_predicate("pred_metachar_multi", "documents", "doc_id", "text", "text LIKE '%!%%!%%' ESCAPE '!'", "multi_contains", "%", "%")
_predicate("pred_json_props", "events", "event_id", "props", "props LIKE '%\"k\"%7%'", "multi_contains", '"k"', "7")


def _counts(table: DataFrame, column: str, queries: list) -> DataFrame:
    """``query_id, n``: conditional counts of many queries in one scan."""
    col = F.col(column)
    row = table.agg(*[F.count_if(matches(col, q)).alias(q.id) for q in queries])
    return row.select(F.explode(F.array(*[F.struct(F.lit(q.id).alias("query_id"), F.col(q.id).alias("n")) for q in queries])).alias("x")).select("x.*")


def _union_counts(table: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS query_id, count(*) FILTER (WHERE {c}) AS n FROM {table}" for k, c in conditions.items())


@register("pred_multi_wrong_order", "documents", _union_counts("documents", {"right": "text LIKE '%que%les%'", "wrong": "text LIKE '%les%que%'"}))
def _(t: DataFrame) -> DataFrame:
    return _counts(t, "text", [query("multi_contains", "que", "les", id="right"), query("multi_contains", "les", "que", id="wrong")])


_EMPTY = [query(op, "", id=op) for op in ("prefix", "suffix", "contains", "multi_contains", "contains_any")]


@register("pred_empty_needle", "documents", _union_counts("documents", {q.id: "text IS NOT NULL" for q in _EMPTY}))
def _(t: DataFrame) -> DataFrame:
    return _counts(t, "text", _EMPTY)


@register("pred_long_needle", "part", "SELECT p_brand, count(*) FILTER (WHERE contains(p_name, repeat('x', 500))) AS n FROM part GROUP BY p_brand")
def _(t: DataFrame) -> DataFrame:
    return t.groupBy("p_brand").agg(F.count_if(matches(F.col("p_name"), query("contains", "x" * 500))).alias("n"))


@register("pred_case_sensitive", "documents", _union_counts("documents", {"upper": "contains(text, 'The')", "lower": "contains(text, 'the')"}))
def _(t: DataFrame) -> DataFrame:
    return _counts(t, "text", [query("contains", "The", id="upper"), query("contains", "the", id="lower")])


_MATRIX = [("prefix", "A"), ("prefix", "Th"), ("suffix", "."), ("suffix", "e."), ("contains", "ation"), ("contains", "é"), ("contains", "The")]
_LIKE = {"prefix": "starts_with(text, '{}')", "suffix": "ends_with(text, '{}')", "contains": "contains(text, '{}')"}
_MATRIX_QUERIES = [query(op, n, id=f"{op}:{n}") for op, n in _MATRIX]


@register("pred_matrix", "documents", " UNION ALL ".join(
    f"SELECT '{op}:{n}' AS query_id, '{op}' AS op, count(*) FILTER (WHERE {_LIKE[op].format(n)}) AS match_count, "
    f"count(*) FILTER (WHERE {_LIKE[op].format(n)}) / count(text) AS selectivity, "
    f"array_to_string(list_slice(list_sort(list(doc_id) FILTER (WHERE {_LIKE[op].format(n)})), 1, 8), ',') AS sample FROM documents" for op, n in _MATRIX
))
def _(t: DataFrame) -> DataFrame:
    found = gate.truths(t, "doc_id", "text", _MATRIX_QUERIES)
    return found.withColumn("sample", F.when(F.size("sample") > 0, F.array_join(F.col("sample").cast("array<string>"), ",")))


def _binary(t: DataFrame) -> DataFrame:
    raw = F.encode(F.col("text"), "UTF-8")
    q = [query("contains", b"\xa9", id="inside_character"), query("multi_contains", b"\xc3", b"\xa9", id="ordered_bytes")]
    row = t.agg(*[F.count_if(matches(raw, x, binary=True)).alias(x.id) for x in q])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x.id).alias("query_id"), F.col(x.id).alias("n")) for x in q])).alias("x")).select("x.*")


register("pred_binary", "documents", _union_counts("documents", {
    "inside_character": "hex(encode(text)) SIMILAR TO '(..)*A9(..)*'", "ordered_bytes": "hex(encode(text)) SIMILAR TO '(..)*C3(..)*A9(..)*'"
}))(_binary)

# Ingest and its statistics.
_STATS = """SELECT count(text) AS num_rows, count(*) - count(text) AS nulls_removed, coalesce(sum(strlen(text)), 0)::BIGINT AS payload_bytes,
    min(strlen(text)) AS min_len, max(strlen(text)) AS max_len, avg(strlen(text)) AS mean_len FROM documents"""
register("ingest_stats", "documents", _STATS)(lambda t: columns.column_stats(t, "text"))
register("byte_histogram", "pages", """
    WITH b AS (SELECT unnest(list_transform(range(octet_length(encode(url))), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::INT)) AS byte FROM pages)
    SELECT r.range::INT AS byte, count(b.byte) AS n FROM range(256) r LEFT JOIN b ON b.byte = r.range GROUP BY 1""")(lambda t: columns.byte_histogram(t, "url"))


@register("rarest_byte", "pages", """
    WITH n(needle) AS (VALUES ('http'), ('example'), ('q.x')), c AS (SELECT needle, unnest(string_split(needle, '')) AS ch FROM n),
    p AS (SELECT sum(strlen(url)) AS payload FROM pages)
    SELECT needle, min((SELECT sum(strlen(url) - strlen(replace(url, ch, ''))) FROM pages) / payload) AS rarest_byte_freq FROM c, p GROUP BY needle""")
def _(t: DataFrame) -> DataFrame:
    freq = columns.byte_histogram(t, "url")
    total = freq.agg(F.greatest(F.sum("n"), F.lit(1)).alias("payload"))
    rows = [(n, b) for n in ("http", "example", "q.x") for b in set(n.encode())]
    needles = t.sparkSession.createDataFrame(rows, "needle string, byte int")
    return needles.join(freq, "byte").crossJoin(total).groupBy("needle").agg(F.min(F.col("n") / F.col("payload")).alias("rarest_byte_freq"))


# Truth and gate.
register("bitmap_words", "documents", """
    WITH m AS (SELECT doc_id // 64 AS word, doc_id % 64 AS b FROM documents WHERE contains(text, 'the'))
    SELECT word, bit_or(CASE WHEN b = 63 THEN -9223372036854775808 ELSE (1::BIGINT << b::INT) END) AS bits, count(DISTINCT b) AS popcount FROM m GROUP BY word""")(
    lambda t: gate.bitmap_words(t, "doc_id", matches(F.col("text"), query("contains", "the")))
)
_THE = query("contains", "the")


@register("truth_sample", "documents", "SELECT doc_id FROM documents WHERE contains(text, 'ung') ORDER BY doc_id LIMIT 8")
def _(t: DataFrame) -> DataFrame:
    return physical.direct(t, "text", query("contains", "ung")).select("doc_id").orderBy("doc_id").limit(8)


@register("gate_ok", "documents", "SELECT count(*) AS expected, count(*) AS actual, NULL::BIGINT AS first_divergent, true AS gate_ok FROM documents WHERE contains(text, 'the')")
def _(t: DataFrame) -> DataFrame:
    return gate.gate(physical.direct(t, "text", _THE), physical.dictionary(t, "text", _THE), "doc_id")


@register("gate_canary", "documents", """SELECT count(*) FILTER (WHERE m) AS expected, count(*) FILTER (WHERE m <> (doc_id = 0)) AS actual, 0::BIGINT AS first_divergent, false AS gate_ok
    FROM (SELECT doc_id, contains(text, 'the') AS m FROM documents)""")
def _(t: DataFrame) -> DataFrame:
    return gate.gate(physical.direct(t, "text", _THE), gate.canary(t, "doc_id", "text", _THE), "doc_id")


# Physical variants.
_RING = query("contains", "al")
register("dict_domain", "part", "SELECT p_partkey FROM part WHERE contains(p_name, 'al')")(lambda t: physical.dictionary(t, "p_name", _RING).select("p_partkey"))
_DICT = """WITH v AS (SELECT {chunk} AS chunk, p_name, count(*) AS n FROM part GROUP BY ALL),
    c AS (SELECT count(*) AS u, sum(n) AS n, count(*) FILTER (WHERE contains(p_name, 'al')) AS m, greatest(1, ceil(log2(count(*))))::BIGINT AS bits FROM v GROUP BY chunk)
    SELECT sum(u)::BIGINT AS eval_domain, sum(m)::BIGINT AS eval_domain_matches, max(bits) AS code_bits, sum(ceil(n * bits / 8))::BIGINT AS code_bytes, sum(n) / sum(u) AS dedup_factor FROM c"""
register("dict_stats", "part", _DICT.format(chunk="0"))(lambda t: physical.dictionary_stats(t, "p_name", _RING))
register("dict_chunked", "part", _DICT.format(chunk="p_partkey // 128"))(lambda t: physical.dictionary_stats(t, "p_name", _RING, "p_partkey", 128))
_NEEDLE = "tion"
_PF = """SELECT '{kernel}' AS kernel, count(url) AS n_rows, count(*) FILTER (WHERE {c}) AS survivors, count(*) FILTER (WHERE contains(url, 'tion')) AS matches,
    1 - count(*) FILTER (WHERE {c}) / count(url) AS prune_rate,
    (count(*) FILTER (WHERE {c}) - count(*) FILTER (WHERE contains(url, 'tion'))) / nullif(count(*) FILTER (WHERE {c}), 0) AS fp_rate FROM pages"""
for _kernel, _condition in {  # 'tion': its rarest byte is o, then n, as the commonness of t, i, o, n is 900, 700, 750, 670
    "tail_code": "contains(url, 'tion')", "none": "strlen(url) >= 4", "first_byte": "url LIKE '%t___%'", "rare_byte": "url LIKE '%___n%'",
    "first_last": "url LIKE '%t__n%'", "rare_pair": "url LIKE '%_i_n%'",
}.items():
    register(f"pf_{_kernel}", "pages", _PF.format(kernel=_kernel, c=_condition))(
        lambda t, kernel=_kernel: prefilters.attribution(t, "url", _NEEDLE.encode(), kernel)
    )


@register("pf_multi_any", "pages", """SELECT count(*) FILTER (WHERE contains(url, 'mple') OR contains(url, '/de/') OR contains(url, 'feed')) AS survivors,
    count(*) FILTER (WHERE contains(url, 'example') OR contains(url, '/de/') OR contains(url, 'source=feed')) AS matches FROM pages""")
def _(t: DataFrame) -> DataFrame:
    q = query("contains_any", "example", "/de/", "source=feed")
    survivors = reduce(Column.__or__, [prefilters.survives(F.col("url"), n, "tail_code") for n in q.needles])
    return t.agg(F.count_if(survivors).alias("survivors"), F.count_if(matches(F.col("url"), q)).alias("matches"))


@register("gram_index", "pages", "SELECT page_id FROM pages WHERE contains(url, 'blog.') OR contains(url, 'feed')")
def _(t: DataFrame) -> DataFrame:
    return physical.gram_lookup(physical.gram_index(t, "page_id", "url"), t, "page_id", "url", query("contains_any", "blog.", "feed")).select("page_id")


_FOOT = """WITH c AS (SELECT {chunk} AS chunk, count(*) AS n, sum(strlen(text)) AS b FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT count(*) AS num_chunks, sum(b)::BIGINT AS payload, sum((n + 1) * 8)::BIGINT AS offsets, (sum(b) + sum((n + 1) * 8))::BIGINT AS raw_bytes FROM c"""
register("footprint", "documents", _FOOT.format(chunk="0"))(lambda t: physical.footprint(t, "text", "doc_id"))
register("footprint_chunked", "documents", _FOOT.format(chunk="doc_id // 64"))(lambda t: physical.footprint(t, "text", "doc_id", 64))
register("token_freq", "documents", """
    WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), c AS (
    SELECT token, count(*) AS term_freq, count(DISTINCT doc_id) AS row_freq FROM t WHERE token <> '' GROUP BY token)
    SELECT token, term_freq, row_freq FROM c WHERE row_freq >= 20""")(
    lambda t: physical.token_counts(t, "doc_id", "text").where("row_freq >= 20")
)


@register("cover_scan", "documents", """WITH m AS (SELECT doc_id FROM documents WHERE contains(text, 'the and')),
    c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) WHERE ends_with(token, 'the'))
    SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM m ANTI JOIN c USING (doc_id)) AS missed""")
def _(t: DataFrame) -> DataFrame:
    found = physical.token_cover(t, "doc_id", "text", "the and").withColumn("c", F.lit(1))
    exact = physical.direct(t, "text", query("contains", "the and")).select("doc_id", F.lit(1).alias("m"))
    return found.join(exact, "doc_id", "full").agg(F.count("c").alias("candidates"), F.count("m").alias("matches"), F.count_if(F.col("c").isNull()).alias("missed"))


#: Tokens that a minimum cut is computed over; beyond, every row is tested.
CUT_TOKENS = 4096


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A needle that reaches over tokens: a minimum cut over those that can hold a part of it, rows that hold one of the cut, then verified.

    Tokens are the words of p_name with the space before them, but for the first. Those that can lie over the needle hold it, lie within it, or
    overlap it at an end.
    """
    rows = _table(spark, sf_dir, "part")
    needle = "ot r"
    tokens = F.filter(F.split(F.regexp_replace("p_name", " ", "\u0001 "), "\u0001"), lambda x: x != "")
    token = F.col("token")
    ends = [F.startswith(token, F.lit(needle[k:])) for k in range(1, len(needle))] + [F.endswith(token, F.lit(needle[:k])) for k in range(1, len(needle))]
    part = reduce(Column.__or__, [F.contains(token, F.lit(needle)), F.contains(F.lit(needle), token), *ends])
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(part)
    found = {r["token"]: r["n"] for r in counts.limit(CUT_TOKENS + 1).collect()}
    whole = physical.direct(rows, "p_name", query("contains", needle))
    if len(found) > CUT_TOKENS:
        return whole.select("p_partkey")
    chosen = cover.cover(needle, found)
    if not chosen:
        return whole.where(F.lit(False)).select("p_partkey")
    return whole.where(F.arrays_overlap(tokens, F.lit(sorted(chosen)))).select("p_partkey")


QUERIES["cover_min_cut"] = _cut
ORACLES["cover_min_cut"] = "SELECT p_partkey FROM part WHERE contains(p_name, 'ot r')"

# Generator.
QUERIES["gen_grid"] = lambda spark, sf_dir: generator.grid_frame(spark).groupBy("op").agg(F.count("*").alias("points"), F.sum("replicates").cast("long").alias("targets"))
ORACLES["gen_grid"] = """SELECT * FROM (VALUES ('prefix', 8 * 9, 8 * 9 * 5), ('suffix', 7 * 9, 7 * 9 * 5), ('contains', 7 * 9, 7 * 9 * 5),
    ('multi_contains', 4 * 3 * 5, 4 * 3 * 5 * 3), ('contains_any', 5 * 5 * 2, 5 * 5 * 2 * 3)) t(op, points, targets)"""
_PROBES = ["the", "ung", "eau", "ción", "zzz", "tion th", "a"]
_BAND = "CASE WHEN s = 0 THEN 0.0 " + " ".join(f"WHEN abs(log10(s) - log10({b})) <= 0.25 THEN {b}" for b in generator.DECADES) + " " + " ".join(f"WHEN abs(s - {b}) <= 0.2 * {b} THEN {b}" for b in generator.DENSE) + " END"
register("gen_probe", "documents", f"""WITH n(needle) AS (VALUES {", ".join(f"('{n}')" for n in _PROBES)}),
    c AS (SELECT needle, count(*) FILTER (WHERE contains(text, needle)) AS match_count, count(*) FILTER (WHERE contains(text, needle)) / count(text) AS s FROM n, documents GROUP BY needle)
    SELECT needle, match_count, s AS selectivity, ({_BAND})::DOUBLE AS band FROM c""")(
    lambda t: generator.probe(t, "text", _PROBES).withColumn("band", generator.band_of(F.col("selectivity")))
)
register("gen_estimate", "documents", f"""WITH n(needle) AS (VALUES {", ".join(f"('{n}')" for n in _PROBES)})
    SELECT needle, count(*) FILTER (WHERE contains(text, needle)) AS match_count, count(*) FILTER (WHERE contains(text, needle)) / count(text) AS selectivity
    FROM n, documents WHERE doc_id % greatest(1, ceil((SELECT count(*) FROM documents) / 65536))::BIGINT = 0 GROUP BY needle""")(
    lambda t: generator.probe(t, "text", _PROBES, stride=max(1, -(-t.count() // generator.SAMPLE_ROWS)), id_column="doc_id")
)
register("gen_eligible", "pages", " UNION ALL ".join(f"SELECT {n} AS length, count(*) FILTER (WHERE strlen(url) >= {n}) AS n FROM pages" for n in (8, 16, 32, 64)))(
    lambda t: generator.eligible(t, "url", (8, 16, 32, 64))
)
register("gen_workload", "pages")(lambda t: generator.generate(t, "page_id", "url"))
register("gen_dedup", "events", """SELECT DISTINCT op, array_to_string(CASE WHEN op = 'contains_any' THEN list_sort(needles) ELSE needles END, '|') AS needles FROM (
    SELECT CASE WHEN user_id % 2 = 0 THEN 'contains_any' ELSE 'multi_contains' END AS op, [event_type, substr(props, 7, 1)] AS needles FROM events)""")(
    lambda t: generator.dedupe(t.select(
        F.when(F.col("user_id") % 2 == 0, "contains_any").otherwise("multi_contains").alias("op"), F.array("event_type", F.substring("props", 7, 1)).alias("needles")
    )).withColumn("needles", F.array_join("needles", "|"))
)

# Measurements: no result files are at hand, so that a fact is derived from events in the same way on both sides.
_FACT = """SELECT event_id, event_type AS system, 1 + event_id % 64 AS needle_len, pow(10.0, -(user_id % 6)) * (CASE WHEN user_id % 11 = 0 THEN 0 ELSE 1 END) AS selectivity,
    cast(floor(abs(value) * 1000) AS BIGINT) + 1 AS median_ns, 1000 + user_id % 5 * 500 AS n_values, 100 + user_id % 7 * 50 AS eval_domain,
    CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, event_id % 23 <> 0 AS gate_passed, 'run' || (event_id % 3) AS run_dir, event_id % 5 AS started_at,
    'host' || (user_id % 4) AS host, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS prune_rate, 64000 AS raw_bytes, 8000 + user_id % 9 * 4000 AS footprint_bytes
    FROM events"""


def fact(t: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return t.select(
        "event_id", F.col("event_type").alias("system"), (1 + e % 64).alias("needle_len"),
        (F.pow(F.lit(10.0), -(u % 6)) * F.when(u % 11 == 0, 0).otherwise(1)).alias("selectivity"), (F.floor(F.abs("value") * 1000).cast("long") + 1).alias("median_ns"),
        (1000 + u % 5 * 500).alias("n_values"), (100 + u % 7 * 50).alias("eval_domain"), F.when(e % 17 == 0, "error").otherwise("ok").alias("status"),
        (e % 23 != 0).alias("gate_passed"), F.concat(F.lit("run"), e % 3).alias("run_dir"), (e % 5).alias("started_at"), F.concat(F.lit("host"), u % 4).alias("host"),
        F.when(e % 4 != 0, (e % 100) / 100.0).alias("prune_rate"), F.lit(64000).alias("raw_bytes"), (8000 + u % 9 * 4000).alias("footprint_bytes"),
    )


def analysis(name: str, sql: str):
    def add(make: Callable[[DataFrame], DataFrame]):
        return register(name, "events", f"WITH f AS ({_FACT}) {sql}")(lambda t: make(fact(t)))

    return add




def _ok() -> Column:
    return F.col("status") == "ok"


def _ns() -> Column:
    return F.col("median_ns") / F.col("n_values")


analysis("latency_stats", """SELECT system, count(*) AS n, min(median_ns) AS min, quantile_disc(median_ns, 0.25)::DOUBLE AS p25, quantile_disc(median_ns, 0.5)::DOUBLE AS median,
    quantile_disc(median_ns, 0.75)::DOUBLE AS p75, quantile_disc(median_ns, 0.99)::DOUBLE AS p99, max(median_ns) AS max, avg(median_ns) AS mean, stddev_pop(median_ns) AS stddev FROM f GROUP BY system""")(
    lambda f: measure.distribution(f, "median_ns", "system")
)


@analysis("store_view", """SELECT event_id, system || '|' || host AS cell, median_ns / n_values AS ns_per_value, median_ns / eval_domain AS ns_per_domain_value,
    n_values / eval_domain AS dedup_factor, raw_bytes / footprint_bytes AS compression_ratio FROM f WHERE status = 'ok'""")
def _(f: DataFrame) -> DataFrame:
    keyed = f.withColumns({"system_key": store.natural_key("system"), "platform_key": store.natural_key("host"), "run_key": store.natural_key("run_dir", "started_at")})
    plain = keyed.drop("system", "host", "run_dir", "started_at")
    joined = store.view(
        plain, (store.dimension(f, "system", "system"), "system_key"), (store.dimension(f, "platform", "host"), "platform_key"),
        (store.dimension(f, "run", "run_dir", "started_at"), "run_key"),
    )
    return joined.where(_ok()).select("event_id", F.concat_ws("|", "system", "host").alias("cell"), "ns_per_value", "ns_per_domain_value", "dedup_factor", "compression_ratio")


@analysis("store_is_latest", "SELECT DISTINCT run_dir, started_at, started_at = max(started_at) OVER (PARTITION BY run_dir) AS is_latest FROM f")
def _(f: DataFrame) -> DataFrame:
    return store.with_latest(f.select("run_dir", "started_at").distinct())


@analysis("store_upsert", """SELECT k, v FROM (SELECT event_id AS k, 'old' AS v FROM f WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'new' FROM f n WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.event_id = n.event_id AND o.event_id % 3 = 0))""")
def _(f: DataFrame) -> DataFrame:
    return store.upsert(
        f.where("event_id % 3 = 0").select(F.col("event_id").alias("k"), F.lit("old").alias("v")), f.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.lit("new").alias("v")), "k"
    )


@analysis("store_replace", """SELECT event_id AS k, CASE WHEN event_id % 4 = 0 THEN 'new' WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS v FROM f WHERE event_id % 3 = 0 OR event_id % 2 = 0""")
def _(f: DataFrame) -> DataFrame:
    old = f.where("event_id % 3 = 0").select(F.col("event_id").alias("k"), F.lit("old").alias("v"))
    new = f.where("event_id % 2 = 0").select(F.col("event_id").alias("k"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 4 != 0), "old").otherwise("new").alias("v"))
    return store.replace_changed(old, new, "k", "v")


analysis("an_two_axis", """SELECT system, round(median(median_ns / n_values), 2) AS ns_value, round(max(raw_bytes / footprint_bytes), 2) AS ratio FROM f WHERE status = 'ok' GROUP BY system""")(
    lambda f: f.where(_ok()).groupBy("system").agg(F.round(F.median(_ns()), 2).alias("ns_value"), F.round(F.max(F.col("raw_bytes") / F.col("footprint_bytes")), 2).alias("ratio"))
)
_FOUR = "CASE WHEN selectivity = 0 THEN 'no match' WHEN selectivity < 1e-3 THEN '<1e-3' WHEN selectivity < 1e-2 THEN '<1e-2' ELSE '>=1e-2' END"
analysis("an_band_latency", f"""SELECT {_FOUR} AS band, round(median(median_ns / n_values) FILTER (WHERE system = 'click'), 2) AS click,
    round(median(median_ns / n_values) FILTER (WHERE system = 'view'), 2) AS "view" FROM f WHERE status = 'ok' GROUP BY 1""")(
    lambda f: f.where(_ok()).groupBy(F.expr(_FOUR).alias("band")).agg(
        *[F.round(F.median(F.when(F.col("system") == s, _ns())), 2).alias(s) for s in ("click", "view")]
    )
)
analysis("an_length_sweep", "SELECT system, needle_len, round(median(median_ns / n_values), 2) AS ns_value, count(*) AS n FROM f WHERE status = 'ok' GROUP BY system, needle_len")(
    lambda f: f.where(_ok()).groupBy("system", "needle_len").agg(F.round(F.median(_ns()), 2).alias("ns_value"), F.count("*").alias("n"))
)
analysis("an_by_machine", "SELECT host, round(median(median_ns / n_values), 2) AS ns_value, count(*) AS n FROM f WHERE status = 'ok' AND system = (SELECT min(system) FROM f) GROUP BY host")(
    lambda f: f.where(_ok()).join(f.agg(F.min("system").alias("system")), "system", "left_semi").groupBy("host").agg(F.round(F.median(_ns()), 2).alias("ns_value"), F.count("*").alias("n"))
)
analysis("an_prefilter", "SELECT system, round(avg(prune_rate), 3) AS prune, median(median_ns) AS scan_ns FROM f WHERE status = 'ok' AND prune_rate IS NOT NULL GROUP BY system")(
    lambda f: f.where(_ok() & F.col("prune_rate").isNotNull()).groupBy("system").agg(F.round(analytics.mean(F.col("prune_rate")), 3).alias("prune"), F.median("median_ns").alias("scan_ns"))
)
analysis("an_dedup_speedup", """SELECT system, round(median(median_ns / n_values), 2) AS ns_value, round(median(median_ns / eval_domain), 2) AS ns_domain_value,
    round(median(n_values / eval_domain), 1) AS dedup FROM f WHERE status = 'ok' GROUP BY system""")(
    lambda f: f.where(_ok()).groupBy("system").agg(
        F.round(F.median(_ns()), 2).alias("ns_value"), F.round(F.median(F.col("median_ns") / F.col("eval_domain")), 2).alias("ns_domain_value"),
        F.round(F.median(F.col("n_values") / F.col("eval_domain")), 1).alias("dedup"),
    )
)
analysis("an_run_health", """SELECT run_dir, host, count(*) AS n, count(*) FILTER (WHERE status = 'ok' AND NOT gate_passed) AS gate_fail, count(*) FILTER (WHERE status <> 'ok') AS not_run,
    round(max(abs(median_ns - 50000) / nullif(median_ns, 0)), 3) AS worst FROM f GROUP BY ALL""")(
    lambda f: f.groupBy("run_dir", "host").agg(
        F.count("*").alias("n"), F.count_if(_ok() & ~F.col("gate_passed")).alias("gate_fail"), F.count_if(~_ok()).alias("not_run"),
        F.round(F.max(F.abs(F.col("median_ns") - 50000) / F.nullif(F.col("median_ns"), F.lit(0))), 3).alias("worst"),
    )
)
analysis("an_decade_bins", """SELECT cast(floor(log10(median_ns) * 3) AS BIGINT) AS bin, count(*) AS n, quantile_cont(n_values, 0.25) AS q25, quantile_cont(n_values, 0.5) AS q50,
    quantile_cont(n_values, 0.75) AS q75, pow(10.0, (cast(floor(log10(median_ns) * 3) AS BIGINT) + 0.5) / 3) AS center FROM f WHERE median_ns > 0 GROUP BY 1""")(
    lambda f: analytics.decade_bins(f, "median_ns", "n_values")
)
analysis("an_len_buckets", """SELECT CASE WHEN needle_len <= 2 THEN '1-2' WHEN needle_len <= 4 THEN '3-4' WHEN needle_len <= 8 THEN '5-8' WHEN needle_len <= 16 THEN '9-16'
    WHEN needle_len <= 32 THEN '17-32' ELSE '33+' END AS bucket, count(*) AS n FROM f GROUP BY 1""")(lambda f: f.groupBy(analytics.length_bucket(F.col("needle_len")).alias("bucket")).agg(F.count("*").alias("n")))
analysis("an_sel_bands", """SELECT CASE WHEN selectivity = 0 THEN '0' WHEN selectivity < 1e-4 THEN '<1e-4' WHEN selectivity < 1e-3 THEN '<1e-3' WHEN selectivity < 1e-2 THEN '<1e-2'
    WHEN selectivity < 1e-1 THEN '<1e-1' ELSE '>=1e-1' END AS band, count(*) AS n FROM f GROUP BY 1""")(lambda f: f.groupBy(analytics.selectivity_band(F.col("selectivity")).alias("band")).agg(F.count("*").alias("n")))
_MEDIANS = "m AS (SELECT needle_len, system, median(median_ns) AS median FROM f GROUP BY ALL)"
analysis("an_winner_map", f", {_MEDIANS} SELECT needle_len, system, median, row_number() OVER (PARTITION BY needle_len ORDER BY median, system)::INT AS rank FROM m")(
    lambda f: analytics.winners(f, ["needle_len"], "system", "median_ns")
)
analysis("an_ratio_grid", f", {_MEDIANS} SELECT a.needle_len, a.system, a.median / b.median AS ratio FROM m a JOIN m b ON a.needle_len = b.needle_len AND b.system = 'view' AND a.system <> 'view'")(
    lambda f: analytics.ratios(f, ["needle_len"], "system", "median_ns", "view")
)
analysis("an_pareto", """, p AS (SELECT host || system AS name, avg(raw_bytes / footprint_bytes) AS ratio, median(median_ns) AS ns FROM f GROUP BY 1)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.ratio >= p.ratio AND o.ns <= p.ns AND (o.ratio > p.ratio OR o.ns < p.ns))""")(
    lambda f: analytics.pareto(f.groupBy(F.concat("host", "system").alias("name")).agg(analytics.mean(F.col("raw_bytes") / F.col("footprint_bytes")).alias("ratio"), F.median("median_ns").alias("ns")), "name", "ratio", "ns")
)
_LENGTHS = [1, 2, 4, 8, 16, 32, 64]
analysis("an_pivot_len", "SELECT system, " + ", ".join(f"median(median_ns) FILTER (WHERE needle_len = {n}) AS len_{n}" for n in _LENGTHS) + " FROM f GROUP BY system")(
    lambda f: analytics.pivot_medians(f, "system", "needle_len", "median_ns", _LENGTHS)
)
analysis("an_generic_bin", """, e AS (SELECT min(median_ns) AS lo, max(median_ns) AS hi FROM f)
    SELECT least(floor((median_ns - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n, median(median_ns) AS x, median(n_values) AS y FROM f, e GROUP BY 1""")(
    lambda f: analytics.equal_bins(f, "median_ns", "n_values", 20)
)
analysis("an_upper_median", "SELECT system, list_sort(list(median_ns))[len(list(median_ns)) // 2 + 1] AS upper FROM f GROUP BY system")(
    lambda f: f.groupBy("system").agg(analytics.upper_median("median_ns").cast("long").alias("upper"))
)
analysis("an_candidate_matrix", "SELECT system, array_to_string(list_sort(list(DISTINCT run_dir)), ',') AS runs, count(*) AS n, max(raw_bytes / footprint_bytes) AS best_ratio FROM f GROUP BY system")(
    lambda f: f.groupBy("system").agg(F.array_join(F.sort_array(F.collect_set("run_dir")), ",").alias("runs"), F.count("*").alias("n"), F.max(F.col("raw_bytes") / F.col("footprint_bytes")).alias("best_ratio"))
)

# More of the store: keys, labels, needles, runs; and more analyses.
analysis("store_labels", """SELECT event_id, system || '/' || CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'decode' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE '+scan' || (event_id % 3) END
    || CASE WHEN event_id % 5 = 0 THEN '' ELSE '@bits=' || (event_id % 5) || ',level=' || needle_len END AS label FROM f""")(
    lambda f: f.select("event_id", "system", F.when(F.col("event_id") % 2 == 0, "direct").otherwise("decode").alias("strategy"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("scan"), F.col("event_id") % 3)).alias("scanner"),
        F.when(F.col("event_id") % 5 == 0, F.create_map().cast("map<string,string>")).otherwise(
            F.create_map(F.lit("level"), F.col("needle_len").cast("string"), F.lit("bits"), (F.col("event_id") % 5).cast("string"))).alias("config"),
    ).select("event_id", store.label("system", "strategy", "scanner", "config").alias("label"))
)
analysis("store_gate_ok", """SELECT event_id, coalesce(status = 'ok' AND event_id % 7 = CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_part END AND n_values = eval_domain * 10, false) AS gate_ok
    FROM (SELECT *, event_id % 7 AS user_part FROM f)""")(
    lambda f: f.select("event_id", "status", (F.col("event_id") % 7).cast("string").alias("h"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 7).cast("string")).alias("th"),
        (F.col("eval_domain") * 10).alias("tc"), F.col("n_values").alias("c")).select("event_id", store.gate_ok("status", "th", "h", "tc", "c").alias("gate_ok"))
)


@register("store_needles", "documents", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '\\xC3' ELSE substr(text, 1, 4) END || ' | ' || substr(text, 5, 2) AS needles, doc_id % 4 <> 0 AS is_text
    FROM documents WHERE length(text) >= 6""")
def _(t: DataFrame) -> DataFrame:
    needles = F.array(F.when(F.col("doc_id") % 4 == 0, F.lit(bytearray(b"\xc3"))).otherwise(F.encode(F.substring("text", 1, 4), "UTF-8")), F.encode(F.substring("text", 5, 2), "UTF-8"))
    rows = t.where(F.length("text") >= 6).select("doc_id", needles.alias("n"))
    return rows.select("doc_id", store.needle_text(F.col("n")).alias("needles"), store.is_text(F.col("n")).alias("is_text"))


analysis("store_spec_key", "SELECT DISTINCT substr(sha256(array_to_string(list_sort([system, run_dir]), ',') || '|' || array_to_string(list_sort([host, 'a']), ',')), 1, 16) AS spec_key FROM f")(
    lambda f: f.select(F.array("system", "run_dir").alias("a"), F.array("host", F.lit("a")).alias("b")).select(store.spec_key("a", "b").alias("spec_key")).distinct()
)
analysis("store_view_domain", """SELECT event_id, eval_domain_matches / eval_domain AS selectivity_domain, raw_bytes / median_ns AS gbps_raw, system, host, run_dir, 'd' || bucket AS dataset
    FROM (SELECT *, eval_domain // 7 AS eval_domain_matches, needle_len % 3 AS bucket FROM f)""")(
    lambda f: _five_dimensions(f.withColumns({"eval_domain_matches": F.floor(F.col("eval_domain") / 7), "dataset": F.concat(F.lit("d"), F.col("needle_len") % 3)}))
)


def _five_dimensions(f: DataFrame) -> DataFrame:
    parts = {"system": ["system"], "platform": ["host"], "run": ["run_dir", "started_at"], "dataset": ["dataset"], "query": ["needle_len", "selectivity"]}
    keyed = f.withColumns({f"{n}_key": store.natural_key(*c) for n, c in parts.items()})
    plain = keyed.drop(*[c for cs in parts.values() for c in cs])
    whole = store.view(plain, *[(store.dimension(f, n, *c), f"{n}_key") for n, c in parts.items()])
    return whole.select("event_id", "selectivity_domain", "gbps_raw", "system", "host", "run_dir", "dataset")


analysis("store_runs_with_results", "SELECT DISTINCT run_dir || '|' || started_at AS run_key, started_at FROM f WHERE status = 'ok' AND needle_len < 9")(
    lambda f: loader.with_results(
        f.select(store.natural_key("run_dir", "started_at").alias("run_key"), "started_at").distinct(),
        f.where(_ok() & (F.col("needle_len") < 9)).select(store.natural_key("run_dir", "started_at").alias("run_key")),
    )
)
analysis("store_run_platform", "SELECT DISTINCT run_dir, host || '|linux|x86|-|' || length(host) AS platform_key, length(host)::BIGINT AS cores FROM f")(
    lambda f: loader.with_platform(
        f.select("run_dir", F.concat_ws("|", "host", F.lit("linux"), F.lit("x86"), F.lit("-"), F.length("host")).alias("platform_key")).distinct(),
        f.select("host", F.lit("linux").alias("os"), F.lit("x86").alias("arch"), F.lit(None).cast("string").alias("cpu"), F.length("host").cast("long").alias("cores")).distinct()
        .select(store.natural_key("host", "os", "arch", "cpu", "cores").alias("platform_key"), "cores"),
    ).select("run_dir", "platform_key", "cores")
)
analysis("store_one_suite", "SELECT DISTINCT system AS dataset, 'suite-' || system AS suite FROM f")(
    lambda f: loader.single_suites(f.select(F.col("system").alias("dataset"), F.concat(F.lit("suite-"), "system").alias("suite")))
)
analysis("store_seconds", """SELECT event_id, (epoch(('2026-01-0' || (1 + event_id % 9) || 'T10:00:00+02:00')::TIMESTAMPTZ) - epoch('2026-01-01T00:00:00Z'::TIMESTAMPTZ))::BIGINT AS seconds FROM f""")(
    lambda f: f.select("event_id", loader.seconds_between(F.lit("2026-01-01T00:00:00Z"), F.concat(F.lit("2026-01-0"), 1 + F.col("event_id") % 9, F.lit("T10:00:00+02:00"))).alias("seconds"))
)
analysis("an_single_shot", "SELECT system, median(v) AS median_ns FROM (SELECT system, run_dir, max(median_ns) AS v FROM f GROUP BY ALL) GROUP BY system")(
    lambda f: analytics.single_shot(f, ["system"], ["run_dir"], "median_ns", ["system"])
)
for _how, _sql in {"mean": "avg(median_ns)", "median": "median(median_ns)"}.items():
    analysis(f"an_collapse_{_how}", f"SELECT system, needle_len, {_sql} AS median_ns FROM f GROUP BY ALL")(lambda f, how=_how: analytics.collapse(f, "needle_len", "median_ns", how, "system"))
analysis("an_collapse_none", "SELECT system, needle_len, median_ns FROM f")(lambda f: analytics.collapse(f, "needle_len", "median_ns", "none", "system"))
analysis("an_compression", """SELECT system, sum(raw_bytes) / sum(footprint_bytes) AS ratio_total, sum(raw_bytes) / sum(footprint_bytes - 800) AS ratio_payload,
    sum(raw_bytes) * 1000 / nullif(sum(median_ns), 0) AS build_mb_s, sum(raw_bytes) * 1000 / nullif(sum(n_values), 0) AS decode_mb_s FROM f GROUP BY system""")(
    lambda f: analytics.compression(f.withColumns({"payload_bytes": F.col("footprint_bytes") - 800, "build_ns": F.col("median_ns"), "decode_ns": F.col("n_values")}), "system")
)
analysis("an_default_chunk", "SELECT CASE WHEN min(c) = 0 THEN 0 ELSE min(c) END::BIGINT AS chunk FROM (SELECT event_id % 5 * 64 AS c FROM f)")(
    lambda f: analytics.default_chunk(f.select((F.col("event_id") % 5 * 64).alias("chunk")), "chunk")
)
analysis("an_decode_speed", "SELECT event_id, (raw_bytes / median_ns) * median_ns / nullif(event_id % 6, 0) AS decode_gbps FROM f")(
    lambda f: analytics.decode_speed(f.withColumns({"gbps": F.col("raw_bytes") / F.col("median_ns"), "decode_ns": F.col("event_id") % 6}), "gbps", "median_ns", "decode_ns").select("event_id", "decode_gbps")
)
analysis("an_takeaways", f""", {_MEDIANS}, r AS (SELECT a.system, a.median / b.median AS ratio FROM m a JOIN m b ON a.needle_len = b.needle_len AND b.system = 'view' AND a.system <> 'view')
    SELECT system, count(*) FILTER (WHERE ratio < 0.95) AS wins, count(*) FILTER (WHERE abs(ratio - 1) <= 0.05) AS ties, count(*) FILTER (WHERE ratio > 1.05) AS losses,
    median(1 / ratio) AS median_speedup, max(1 / ratio) AS best_speedup FROM r GROUP BY system""")(
    lambda f: analytics.takeaways(f, ["needle_len"], "system", "median_ns", "view")
)
analysis("an_decade_filled", """, b AS (SELECT floor(log10(n_values * n_values * n_values) * 3)::BIGINT AS bin, count(*) AS n, quantile_cont(median_ns, 0.25) AS q25, quantile_cont(median_ns, 0.5) AS q50,
    quantile_cont(median_ns, 0.75) AS q75 FROM f GROUP BY 1), e AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM b)
    SELECT e.bin, coalesce(n, 0) AS n, q25, q50, q75, pow(10.0, (e.bin + 0.5) / 3) AS center, pow(10.0, e.bin / 3) AS low, pow(10.0, (e.bin + 1) / 3) AS high FROM e LEFT JOIN b ON b.bin = e.bin""")(
    lambda f: analytics.decade_bins(f.withColumn("cube", F.col("n_values") * F.col("n_values") * F.col("n_values")), "cube", "median_ns", filled=True)
)
analysis("an_log_bin", """, e AS (SELECT min(log10(median_ns)) AS lo, max(log10(median_ns)) AS hi FROM f)
    SELECT least(floor((log10(median_ns) - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n, median(median_ns) AS x, median(n_values) AS y FROM f, e GROUP BY 1""")(
    lambda f: analytics.equal_bins(f, "median_ns", "n_values", 20, log=True)
)
analysis("an_any_value", "SELECT host, max(system) AS system, count(*) AS n FROM f WHERE system = 'view' GROUP BY host")(
    lambda f: f.where("system = 'view'").groupBy("host").agg(F.any_value("system").alias("system"), F.count("*").alias("n"))
)
analysis("an_numeric_order", "SELECT row_number() OVER (ORDER BY try_cast(k AS DOUBLE) NULLS LAST, k)::INT AS place, k FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN system ELSE (event_id % 12)::VARCHAR END AS k FROM f)")(
    lambda f: _placed(f.select(F.when(F.col("event_id") % 3 == 0, F.col("system")).otherwise((F.col("event_id") % 12).cast("string")).alias("k")).distinct())
)
analysis("an_dataset_union", "SELECT run_dir AS id FROM f UNION SELECT host FROM f")(lambda f: f.select(F.col("run_dir").alias("id")).union(f.select("host")).distinct())


def _placed(keys: DataFrame) -> DataFrame:
    """Few names in their order: those of series, not of rows."""
    return keys.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*analytics.numeric_first("k")))).select("place", "k")


# Composed plans of the registry, each by the same SQL.
_ANY9 = ["example", "/de/", "feed", "blog.", "?id", "shop", "news", "xyz", "utm"]
_ANY9_SQL = "SELECT page_id FROM pages WHERE " + " OR ".join(f"contains(url, '{n}')" for n in _ANY9)
for _label in ("uncompressed/direct+prefilter", "uncompressed_prefilter/prefilter", "dict_uncompressed_prefilter/dict+prefilter", "dict_decode_prefilter/dict+decode+prefilter", "gram_prefilter/gram-prefilter", "dict_gram_prefilter/dict+gram-prefilter", "uncompressed/direct+teddy", "uncompressed/direct+aho_corasick", "token_automaton/compressed"):
    register("plan_" + re.sub(r"\W+", "_", _label), "pages", _ANY9_SQL)(lambda t, label=_label: registry.system(label).run(t, "page_id", "url", query("contains_any", *_ANY9)).select("page_id"))
for _label in ("dict_like/dict+like", "dict_contains/dict+contains", "token_cover/cover", "like/interp", "like_contains/interp", "uncompressed/direct+bndm", "uncompressed/direct+kmp", "uncompressed/direct+bmh", "uncompressed/direct+libc-memmem", "uncompressed/direct+stringzilla", "uncompressed/direct+pf-rare-pair", "decode_prefilter/decode+prefilter"):
    register("plan_" + re.sub(r"\W+", "_", _label), "documents", "SELECT doc_id FROM documents WHERE contains(text, 'tion the')")(
        lambda t, label=_label: registry.system(label).run(t, "doc_id", "text", query("contains", "tion the")).select("doc_id")
    )
register("pf_any_pairs", "pages", """SELECT sum(a + CASE WHEN ha THEN 0 ELSE b + CASE WHEN hb THEN 0 ELSE c END END)::BIGINT AS candidates FROM (
    SELECT contains(url, 'mple')::INT AS a, contains(url, '/de/')::INT AS b, contains(url, 'feed')::INT AS c, contains(url, 'example') AS ha, contains(url, '/de/') AS hb FROM pages)""")(
    lambda t: t.agg(F.sum(prefilters.pairs_tested(F.col("url"), query("contains_any", "example", "/de/", "source=feed"))).alias("candidates"))
)
register("pf_any_grouped", "documents", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(text, '{n}')" for n in _SIXTEEN))(
    lambda t: t.where(physical.grouped_any(F.col("text"), query("contains_any", *_SIXTEEN))).select("doc_id")
)
_PROBE_QUERIES = [query("prefix", "http", id="prefix"), query("suffix", "e", id="suffix"), query("contains", "tion", id="contains"), query("contains", "x" * 70, id="long"), query("multi_contains", "a", "b", id="multi"), query("contains_any", "a", "b", id="any"), query("contains_any", "a", "", id="any_empty")]
#: Which queries each scanner takes, stated for the oracle apart from the registry.
_TAKES = {"memmem": "1111111", "memmem-hay": "0011000", "std_find": "1111111", "prefilter": "0011011", "bndm": "1110000", "kmp": "1111000", "bmh": "1111000", "aho_corasick": "0011011", "teddy": "0011010", "libc-memmem": "1111000",
    "stringzilla": "1111000", "pf-none": "0011000", "pf-first-byte": "0011000", "pf-rare-byte": "0011000", "pf-first-last": "0011000", "pf-rare-pair": "0011000"}
QUERIES["registry_support"] = lambda spark, sf_dir: spark.createDataFrame(
    [(s.name, q.id, s.reason(q) is None) for s in registry.SCANNERS.values() for q in _PROBE_QUERIES], "scanner string, query_id string, supported boolean")
ORACLES["registry_support"] = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{q.id}', {'true' if bit == '1' else 'false'})" for s, bits in _TAKES.items() for q, bit in zip(_PROBE_QUERIES, bits, strict=True)) + ") t(scanner, query_id, supported)"
QUERIES["registry_systems"] = lambda spark, sf_dir: spark.createDataFrame([(s.scheme.name, s.strategy) for s in registry.systems()], "scheme string, strategy string").groupBy("scheme", "strategy").agg(F.count("*").alias("n"))
ORACLES["registry_systems"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n}::BIGINT)" for a, b, n in (
    ("uncompressed", "direct", 16), ("uncompressed_memmem", "memmem", 1), ("uncompressed_prefilter", "prefilter", 1), ("dict_uncompressed_prefilter", "dict+prefilter", 1), ("dict_like", "dict+like", 1),
    ("decode_prefilter", "decode+prefilter", 1), ("dict_decode_prefilter", "dict+decode+prefilter", 1), ("gram_prefilter", "gram-prefilter", 1), ("dict_gram_prefilter", "dict+gram-prefilter", 1), ("dict_contains", "dict+contains", 1),
    ("token_automaton", "compressed", 1), ("token_automaton", "decode", 16), ("token_cover", "cover", 1), ("like", "interp", 1), ("like_contains", "interp", 1), ("identity", "decode", 16), ("lz4", "decode", 16), ("zstd", "decode", 16),
    ("gate_canary", "ok", 1), ("gate_canary", "wrong", 1))) + ") t(scheme, strategy, n)"
register("token_places", "documents", """WITH t AS (SELECT unnest(string_split(text, ' ')) AS token, doc_id FROM documents), c AS (
    SELECT token, count(*) AS term_freq, count(DISTINCT doc_id) AS row_freq FROM t WHERE token <> '' GROUP BY token),
    p AS (SELECT token, term_freq, row_freq, coalesce(sum(term_freq) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM c)
    SELECT * FROM p WHERE row_freq >= 20""")(lambda t: physical.token_statistics(t, "doc_id", "text").where("row_freq >= 20"))
register("gate_explain", "documents", """SELECT count(*) FILTER (WHERE m) AS expected, count(*) FILTER (WHERE m <> (doc_id = 0)) AS actual, 0::BIGINT AS first_divergent, false AS gate_ok,
    (SELECT substr(text, 1, 40) FROM documents WHERE doc_id = 0) AS divergent_text FROM (SELECT doc_id, contains(text, 'the') AS m FROM documents)""")(
    lambda t: gate.explain(physical.direct(t, "text", _THE), gate.canary(t, "doc_id", "text", _THE), t, "doc_id", "text").withColumn("divergent_text", F.substring("divergent_text", 1, 40))
)


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder where all executors write: that of spark.checkpoint.dir; the driver's own only where a local master has none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gramward-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _codec(codec: str, level: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: physical.codec_round_trip(_table(spark, sf_dir, "pages").select("page_id", "url"), _scratch(spark, codec), codec, level)


for _name, _codec_name, _level in (("codec_roundtrip", "zstd", 3), ("codec_roundtrip_lz4", "lz4_raw", None), ("codec_roundtrip_none", "none", None)):
    QUERIES[_name] = _codec(_codec_name, _level)
    ORACLES[_name] = "SELECT page_id, url FROM pages"


def _csv_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_name through CSV and back; every seventh empty, which stays empty and is no null."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit('a,"b" '), "p_name")).alias("p_name"))
    folder = _scratch(spark, "csv")
    rows.select("p_name").write.option("header", True).option("escape", '"').option("emptyValue", "").option("quoteAll", True).csv(folder)
    return columns.read_delimited(spark, folder, "p_name").groupBy("data").agg(F.count("*").alias("n"))


QUERIES["ingest_csv_like"] = _csv_like
ORACLES["ingest_csv_like"] = """SELECT CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'a,"b" ' || p_name END AS data, count(*) AS n FROM part GROUP BY 1"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a column numbered from 0 without gaps, in order of the text: their number, least, largest and how many differ."""
    rows = columns.ingest(_table(spark, sf_dir, "pages").select(F.col("url").alias("data")), F.col("data"))
    return rows.agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("ids"), F.min_by("data", "row_id").alias("first"))


QUERIES["ingest_numbered"] = _numbered
ORACLES["ingest_numbered"] = "SELECT count(url) AS n, 0::BIGINT AS low, count(url) - 1 AS high, count(url) AS ids, min(url) AS first FROM pages"


def _extracted(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """Lines written as gzip text, then read by a source."""
    folder = _scratch(spark, name)
    rows.write.option("compression", "gzip").text(folder)
    return read(folder).groupBy("data").agg(F.count("*").alias("n"))


QUERIES["extract_jsonl_source"] = lambda spark, sf_dir: _extracted(
    spark, sf_dir, "jsonl", _table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, "{bad").otherwise(F.to_json(F.struct(F.concat(F.lit(" "), "event_type").alias("t")))).alias("value")),
    lambda folder: columns.extract_json_field(spark, folder, "t"))
ORACLES["extract_jsonl_source"] = "SELECT event_type AS data, count(*) AS n FROM events WHERE event_id % 11 <> 0 GROUP BY 1"
QUERIES["extract_tsv_source"] = lambda spark, sf_dir: _extracted(
    spark, sf_dir, "tsv", _table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit("\t "), "url").alias("value")), lambda folder: columns.extract_tsv_field(spark, folder, 1, "https://"))
ORACLES["extract_tsv_source"] = "SELECT url AS data, count(*) AS n FROM pages WHERE starts_with(url, 'https://') GROUP BY 1"

# Extraction.
register("extract_json_field", "events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda t: t.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
)
register("extract_url_filter", "pages", "SELECT page_id, split_part(url, '/', 3) AS host FROM pages WHERE starts_with(url, 'https://')")(
    lambda t: t.where(F.startswith("url", F.lit("https://"))).select("page_id", F.split("url", "/")[2].alias("host"))
)


@register("flagship", "documents", """SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE contains(text, 'the')) AS matches,
    count(*) FILTER (WHERE contains(text, 'the')) / count(*) AS selectivity FROM documents GROUP BY lang""")
def flagship(t: DataFrame) -> DataFrame:
    hit = F.count_if(matches(F.col("text"), _THE))
    return t.groupBy("lang").agg(F.count("*").alias("n_rows"), hit.alias("matches"), (hit / F.count("*")).alias("selectivity"))
