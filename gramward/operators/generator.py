"""Seeded workloads over selectivity bands: grid, sampled needles, probes and acceptance.

Draws are hashes of (seed, length, row), so that sampling is one distributed pass and gives the
same workload at any partitioning. All needles are probed together in one pass over the rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramward.functions.predicates import SINGLE, Query, query
from gramward.operators import physical

# Decades by their centre (accepted within a quarter of a decade) and dense bands (within a fifth).
DECADES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
DENSE = (0.3, 0.5, 0.8)
SINGLE_LENGTHS = (1, 2, 4, 8, 16, 32, 64)
SAMPLE_ROWS = 65_536
#: Characters between the fragments of an ordered query at most; needles of the pool of unordered ones.
GAP, POOL = 32, 256
SINGLE_OPS = ("prefix", "suffix", "contains")


@dataclass(frozen=True)
class Point:
    op: str
    band: float
    length: int
    k: int = 0
    mix: str = ""
    fragments: int = 0
    replicates: int = 0


def grid(quick: bool = False) -> list[Point]:
    """Every point of the sweep: 308 in full, 1,320 queries with replicates."""
    bands = (0.0, *DECADES) if quick else (0.0, *DECADES, *DENSE)
    lengths = (2, 8, 32) if quick else SINGLE_LENGTHS
    each = 2 if quick else 5
    out = []
    for op in ("prefix", "suffix", "contains"):
        own = (*lengths, 128) if op == "prefix" and not quick else lengths
        out += [Point(op, band, n, replicates=each) for n in own for band in bands]
    each = 2 if quick else 3
    fragments, totals, bands = ((2, 3), (8,), DECADES[3:]) if quick else ((2, 3, 4, 8), (8, 16, 32), DECADES)
    out += [Point("multi_contains", b, t, fragments=f, replicates=each) for f in fragments for t in totals for b in bands]
    ks, bands = ((2, 8), DECADES[3:]) if quick else ((2, 4, 8, 16, 64), (*DECADES[1:], DENSE[1]))
    out += [Point("contains_any", b, 8, k=k, mix=m, replicates=each) for k in ks for b in bands for m in ("balanced", "skewed")]
    return out


def grid_frame(spark: SparkSession, quick: bool = False) -> DataFrame:
    rows = [(p.op, p.band, p.length, p.k, p.mix, p.fragments, p.replicates) for p in grid(quick)]
    return spark.createDataFrame(rows, "op string, band double, length int, k int, mix string, fragments int, replicates int")


def band_of(selectivity: Column) -> Column:
    """The band that accepts a selectivity; NULL between bands."""
    out = F.when(selectivity == 0, F.lit(0.0))
    for b in DECADES:
        out = out.when(F.abs(F.log10(selectivity) - F.log10(F.lit(b))) <= 0.25, F.lit(b))
    for b in DENSE:
        out = out.when(F.abs(selectivity - b) <= 0.2 * b, F.lit(b))
    return out


def plausible(estimate: Column, band: Column) -> Column:
    """Whether a sampled selectivity makes an exact probe worthwhile."""
    decade = F.abs(F.log10(estimate) - F.log10(band)) <= 0.75
    return (
        F.when(band == 0, estimate == 0).when(estimate == 0, band <= 3e-5)
        .when(band >= 0.3, (estimate >= 0.5 * band) & (estimate <= 1.5 * band)).otherwise(decade)
    )


def eligible(rows: DataFrame, column: str, lengths: tuple[int, ...]) -> DataFrame:
    """``length, n``: rows with at least so many bytes, for all lengths in one scan."""
    size = F.octet_length(column)
    counts = rows.agg(*[F.count_if(size >= n).alias(f"n{n}") for n in lengths])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"n{n}").alias("n")) for n in lengths])).alias("x")).select("x.*")


def _draw(seed: int, op: str, length: int, id_column: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(op), F.lit(length), id_column)


def sample_windows(rows: DataFrame, id_column: str, column: str, op: str, length: int, draws: int, seed: int = 42, more: int = 0) -> DataFrame:
    """``k, window``: windows of ``length`` characters (and up to ``more`` behind) of the rows with the least draws."""
    draw = _draw(seed, op, length, id_column)
    room = F.length(column) - length + 1
    start = {"prefix": F.lit(1), "suffix": room}.get(op, F.pmod(F.xxhash64(draw, F.lit("start")), F.greatest(room, F.lit(1))).cast("int") + 1)
    picked = rows.where(F.length(column) >= length).orderBy(draw, id_column).limit(draws)
    return picked.select(draw.alias("k"), F.substring(F.col(column), start, F.lit(length + more)).alias("window"))


def sample_needles(rows: DataFrame, id_column: str, column: str, op: str, length: int, draws: int, seed: int = 42) -> DataFrame:
    """``needle``: distinct windows of ``length`` characters of the rows with the least draws."""
    return sample_windows(rows, id_column, column, op, length, draws, seed).select(F.col("window").alias("needle")).distinct()


TESTS = {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}


def test_of(op: str, text: Column, needle: Column) -> Column:
    return TESTS[op](text, needle)


def probe(rows: DataFrame, column: str, needles: list[str], op: str = "contains", stride: int = 1, id_column: str | None = None) -> DataFrame:
    """``needle, match_count, selectivity``: all needles against all rows (or each ``stride``-th id) in one scan.

    Needles are conditional counts of one aggregate, so rows are neither multiplied nor shuffled.
    """
    kept = rows if stride == 1 else rows.where(F.col(id_column) % stride == 0)
    out = None
    for at in range(0, len(needles), 64):  # few enough for one generated method
        part = needles[at : at + 64]
        counts = kept.agg(F.count(column).alias("n"), *[F.count_if(test_of(op, F.col(column), F.lit(x))).alias(f"c{k}") for k, x in enumerate(part)])
        listed = F.array(*[F.struct(F.lit(x).alias("needle"), F.col(f"c{k}").alias("match_count")) for k, x in enumerate(part)])
        flat = counts.select("n", F.explode(listed).alias("x")).select("x.*", (F.col("x.match_count") / F.col("n")).alias("selectivity"))
        out = flat if out is None else out.union(flat)
    return out


def dedupe(queries: DataFrame) -> DataFrame:
    """Queries ``op, needles`` that differ; the order of needles counts but for contains_any."""
    key = F.when(F.col("op") == "contains_any", F.sort_array("needles")).otherwise(F.col("needles"))
    return queries.select("op", key.alias("needles")).distinct()


#: Rows that are held against the queries at once, so that a needle's hits are a few bits in cache.
ROWS_AT_ONCE = 8192


def _pattern(needles: list[bytes]) -> str:
    """Needles in order as a regular expression over bytes; RE2 takes the same time for each byte, whatever the needles."""
    return "(?s)" + ".*".join("".join(f"\\x{b:02x}" for b in n) for n in needles)


def _match_counts(texts: pa.Array, queries: list[tuple[str, tuple[bytes, ...]]]) -> np.ndarray:
    """Of each query (operator, needles) the rows of ``texts`` (bytes, none NULL) that match."""
    hits: dict[bytes, np.ndarray] = {}

    def packed(needle: bytes) -> np.ndarray:
        if needle not in hits:
            hits[needle] = np.packbits(pc.match_substring(texts, needle).to_numpy(zero_copy_only=False))
        return hits[needle]

    out = np.zeros(len(queries), np.int64)
    for k, (op, all_needles) in enumerate(queries):
        needles = [n for n in all_needles if n]
        if not needles or (op == "contains_any" and len(needles) < len(all_needles)):
            out[k] = len(texts)  # an empty needle is in every row
        elif op in ("prefix", "suffix"):
            out[k] = pc.sum((pc.starts_with if op == "prefix" else pc.ends_with)(texts, needles[0])).as_py() or 0
        elif op == "contains_any":
            out[k] = np.bitwise_count(reduce(np.bitwise_or, map(packed, needles))).sum()
        elif len(needles) == 1:
            out[k] = np.bitwise_count(packed(needles[0])).sum()
        else:
            held = np.unpackbits(packed(max(needles, key=len)), count=len(texts)).view(bool)
            out[k] = pc.sum(pc.match_substring_regex(texts.filter(pa.array(held)), _pattern(needles))).as_py() or 0
    return out


def count_queries(rows: DataFrame, column: str, queries: list[Query]) -> dict[Query, int]:
    """Matches of queries, all in one scan: a task holds its rows against each query and gives one count of each.

    Arrow's substring kernels do it, not conditions of a plan: those of thousands of queries are too much code to compile, which took minutes over the smallest table.
    """
    queries = list(dict.fromkeys(queries))
    asked = [(q.op, q.needles) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), ROWS_AT_ONCE):
                total += _match_counts(texts.slice(at, ROWS_AT_ONCE), asked)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["k", "n"])

    counts = dict.fromkeys(queries, 0)
    if queries:
        texts = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("binary").alias("text"))
        met = physical.spread(texts).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        counts.update({queries[r["k"]]: r["n"] for r in met.collect()})  # one for each query asked for
    return counts


def count_needles(rows: DataFrame, column: str, needles: dict[str, list[str]]) -> dict[tuple[str, str], int]:
    """Matches of each (op, needle), all in one scan."""
    asked = {(op, n): query(op, n) for op, own in needles.items() for n in own}
    counts = count_queries(rows, column, list(asked.values()))
    return {key: counts[q] for key, q in asked.items()}


def mutations(needle: str, draw: random.Random, tries: int = 8) -> list[str]:
    """The needle with one or two characters changed, ``tries`` times."""
    out = []
    for _ in range(tries):
        text = list(needle)
        for at in draw.sample(range(len(text)), min(len(text), draw.choice((1, 2)))):
            text[at] = chr(draw.choice([c for c in range(33, 127) if chr(c) != text[at]]))
        out.append("".join(text))
    return out


def fragments_of(window: str, count: int, total: int, draw: random.Random) -> list[str] | None:
    """``count`` fragments of ``total`` characters together, in order, with gaps of ``GAP`` at most; None where the window is too short."""
    if len(window) < total or total < count:
        return None
    cuts = sorted(draw.sample(range(1, total), count - 1))
    sizes = [b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True)]
    slack, at, out = min(GAP, len(window) - total), 0, []
    for size in sizes:
        out.append(window[at : at + size])
        gap = draw.randint(0, slack)
        slack, at = slack - gap, at + size + gap
    return out


def picks(pool: dict[str, float], point: Point, draw: random.Random) -> list[str] | None:
    """``k`` needles of the pool that may reach the point's band together: alike in share, or one with it all; None if there are too few."""
    k, band = point.k, point.band
    if point.mix == "balanced":
        near = [n for n, p in pool.items() if band / (3 * k) <= p <= 3 * band / k]
        return draw.sample(sorted(near), k) if len(near) >= k else None
    high = [n for n, p in pool.items() if 0.5 * band <= p <= 1.5 * band]
    low = [n for n, p in pool.items() if p <= max(band / (10 * k), 1e-6) and n not in high]
    return [draw.choice(sorted(high)), *draw.sample(sorted(low), k - 1)] if high and len(low) >= k - 1 else None


def accepts(band: float, selectivity: float) -> bool:
    """``band_of`` for one number."""
    if band == 0 or selectivity == 0:
        return band == selectivity
    if band in DENSE:
        return abs(selectivity - band) <= 0.2 * band
    return abs(math.log10(selectivity) - math.log10(band)) <= 0.25


def hopeful(band: float, estimate: float) -> bool:
    """``plausible`` for one number."""
    if band == 0:
        return estimate == 0
    if estimate == 0:
        return band <= 3e-5
    if band >= 0.3:
        return 0.5 * band <= estimate <= 1.5 * band
    return abs(math.log10(estimate) - math.log10(band)) <= 0.75


def query_id(point: Point, number: int) -> str:
    extra = f"-f{point.fragments}" if point.fragments else f"-k{point.k}-{point.mix}" if point.k else ""
    return f"{point.op}-b{point.band:g}-l{point.length}{extra}-{number:02d}"


@dataclass(frozen=True)
class Made:
    """A generated query with its point, matches and selectivity."""

    id: str
    point: Point
    needles: tuple[str, ...]
    match_count: int
    selectivity: float


def workload(rows: DataFrame, id_column: str, column: str, quick: bool = False, seed: int = 42, budget: int | None = None) -> tuple[list[Made], list[dict]]:
    """The queries of every point of the grid, its replicates chosen, and a report of the points.

    Candidates are drawn (``budget`` of each operator and length, or point), estimated on every so many-th row, and those that are
    plausible for some band are counted over all rows. Of a point the first that its band accepts are taken, no two alike. What reaches the driver are needles and
    counts: as many as the grid asks for, whatever the table's size. Report: point fields, made, status (filled, partial, empty) and reason.
    """
    budget = budget or (12 if quick else 32)
    points = grid(quick)
    rows = rows.where(F.col(column).isNotNull())
    n_rows = rows.count()
    stride = max(1, math.ceil(n_rows / SAMPLE_ROWS))
    sample = rows.where(F.pmod(F.col(id_column), F.lit(stride)) == 0)
    n_sample = n_rows if stride == 1 else sample.count()
    singles = sorted({(p.op, p.length) for p in points if p.op in SINGLE})
    multis = sorted({(p.fragments, p.length) for p in points if p.op == "multi_contains"})
    asked = [(op, length, 0, budget) for op, length in singles] + [("multi_contains", total, GAP, budget * len(multis)) for total in sorted({t for _, t in multis})]
    asked += [("contains_any", 8, 0, POOL)] if any(p.op == "contains_any" for p in points) else []
    drawn: dict[tuple[str, int], list[str]] = {}
    union = None
    for op, length, more, count in asked:
        own = sample_windows(rows, id_column, column, op, length, count, seed, more).select(F.lit(op).alias("op"), F.lit(length).alias("length"), "k", "window")
        union = own if union is None else union.union(own)
    for r in union.orderBy("op", "length", "k", "window").collect() if n_rows else []:
        drawn.setdefault((r["op"], r["length"]), []).append(r["window"])

    # Operators of one needle, and mutations of theirs that match nothing.
    candidates = {key: list(dict.fromkeys(drawn.get(key, []))) for key in singles}
    changed = {key: {n: mutations(n, random.Random(f"{seed}|{key}|{n}")) for n in own} for key, own in candidates.items()}
    pool = list(dict.fromkeys(drawn.get(("contains_any", 8), [])))
    by_op: dict[str, list[str]] = {op: [] for op in SINGLE_OPS}
    for (op, length), own in candidates.items():
        by_op[op] += own + [m for n in own for m in changed[op, length][n]]
    estimates = count_needles(sample, column, by_op) if n_sample else {}
    bands = {key: sorted({p.band for p in points if (p.op, p.length) == key}) for key in singles}
    exact: dict[str, list[str]] = {op: [] for op in SINGLE_OPS}
    no_match: dict[tuple[str, int], list[str]] = {}
    for (op, length), own in candidates.items():
        for n in own:
            share = estimates[op, n] / n_sample
            if any(hopeful(b, share) for b in bands[op, length] if b > 0):
                exact[op].append(n)
            fresh = next((m for m in changed[op, length][n] if estimates[op, m] == 0), None)
            if fresh is not None:
                no_match.setdefault((op, length), []).append(fresh)
                exact[op].append(fresh)
    exact["contains"] += pool
    counts = count_needles(rows, column, exact) if n_rows else {}

    made: list[Made] = []
    tried: dict[Point, tuple[int, int]] = {}
    several: dict[Point, list[Query]] = {}
    shares = {n: counts.get(("contains", n), 0) / max(1, n_rows) for n in pool}
    for p in points:
        draw = random.Random(f"{seed}|{p}")
        if p.op == "multi_contains":
            windows = drawn.get((p.op, p.length), [])
            options = [fragments_of(w, p.fragments, p.length, draw) for w in draw.sample(windows, min(len(windows), budget))]
        elif p.op == "contains_any":
            options = [picks(shares, p, draw) for _ in range(budget)]
        else:
            continue
        several[p] = list(dict.fromkeys(query(p.op, *x) for x in options if x and all(x)))
    together = list(dict.fromkeys(q for own in several.values() for q in own))
    rough = count_queries(sample, column, together) if stride > 1 else {}
    likely = [q for q in together if not rough or any(q in own and hopeful(p.band, rough[q] / n_sample) for p, own in several.items())]
    totals = count_queries(rows, column, likely) if n_rows else {}
    for p in points:
        if p.op in SINGLE_OPS:
            own = no_match.get((p.op, p.length), []) if p.band == 0 else [n for n in candidates[p.op, p.length] if n in exact[p.op]]
            found = [((n,), counts[p.op, n]) for n in dict.fromkeys(own)]
        else:
            found = [(tuple(n.decode() for n in q.needles), totals[q]) for q in several[p] if q in totals]
        seen, taken = set(), 0
        for needles, matched in found:
            key = tuple(sorted(needles)) if p.op == "contains_any" else needles
            if taken < p.replicates and key not in seen and accepts(p.band, matched / n_rows):
                seen.add(key)
                made.append(Made(query_id(p, taken), p, needles, matched, matched / n_rows))
                taken += 1
        tried[p] = len(found), taken
    report = []
    for p in points:
        options, taken = tried[p]
        status = "filled" if taken == p.replicates else "partial" if taken else "empty"
        reason = None if status == "filled" else "no candidate" if not options else "none in the band" if not taken else "too few in the band"
        report.append(asdict(p) | {"candidates": options, "made": taken, "status": status, "reason": reason})
    return made, report


def generate(rows: DataFrame, id_column: str, column: str, quick: bool = False, seed: int = 42) -> DataFrame:
    """``id, op, length, band, fragments, k, mix, needles, match_count, selectivity`` of a whole workload."""
    made, _ = workload(rows, id_column, column, quick, seed)
    out = [(m.id, m.point.op, m.point.length, m.point.band, m.point.fragments, m.point.k, m.point.mix, list(m.needles), m.match_count, m.selectivity) for m in made]
    return rows.sparkSession.createDataFrame(out, "id string, op string, length int, band double, fragments int, k int, mix string, needles array<string>, match_count long, selectivity double")


def report_frame(spark: SparkSession, report: list[dict]) -> DataFrame:
    names = "op string, band double, length int, k int, mix string, fragments int, replicates int, candidates int, made int, status string, reason string"
    return spark.createDataFrame([tuple(r.values()) for r in report], names)
