"""Embedding near-dedup (spherical k-means cells) and exact search by an int8 block matrix join."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramward.llm.common import components, materialise, slices

#: k-means is fitted on about so many classes, chosen by a hash, and on fewer where they hold more bytes; from LEAST_CELLS to MAX_CELLS cells.
SAMPLE, SAMPLE_BYTES, ROUNDS, LEAST_CELLS, MAX_CELLS = 20_000, 64 << 20, 8, 4, 1024
#: Classes of a cell (for one label) aimed at, and rows of a block within a cell at most.
CELL_ROWS, BLOCK_ROWS = 4096, 4096
#: Rows of a tile's sides in the search at most, and int8 products made at once.
QUERY_ROWS, CANDIDATE_ROWS, AT_ONCE = 8192, 32_768, 256
#: Bytes of doubles that a side of a block or tile holds at most.
SIDE_BYTES = 16 << 20


def rows_of(most: int, length: int) -> int:
    """Rows of a block's side: ``most``, or fewer where vectors of this length would fill it."""
    return max(1, min(most, SIDE_BYTES // (8 * max(1, length))))


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows: assign by largest cosine, then normalised means."""
    draw = np.random.default_rng(seed)
    centres = rows[np.sort(draw.choice(len(rows), min(cells, len(rows)), replace=False))]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return np.unique(centres, axis=0)


def fit_cells(classes: DataFrame, total: int, largest: int, length: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from a bounded sample by hash; as many as the ``largest`` label needs, ``LEAST_CELLS`` at least."""
    cells = min(MAX_CELLS, max(LEAST_CELLS, math.ceil(largest / CELL_ROWS)))
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, length))) / max(1, total))
    picked = classes.where(F.pmod(F.xxhash64("rep", F.lit("cells")), F.lit(1 << 30)) < int(share * (1 << 30)))
    frame = picked.select("vector").toPandas()
    found = {}
    for size, part in frame.groupby(frame["vector"].map(len)):
        found[int(size)] = spherical_kmeans(_unit(_matrix(part["vector"])), cells)
    return found


def place(unit: np.ndarray, centres: np.ndarray | None, alike: float) -> list[list[int]]:
    """The cells of each row, its own first, then every one of a lower number that may hold a row with cosine >= ``alike``.

    Between the centroids a (own) and b the border is the plane (a - b) . x = 0. A row beyond it
    is at an angle of at least asin((a - b) . x / |a - b|), so only cells nearer than the angle
    of ``alike`` count. No link is lost, whatever the cells: of two rows the one in the cell of the higher number visits the other's.
    """
    if centres is None or len(centres) < 2:
        return [[0]] * len(unit)
    near = unit @ centres.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[own]
    reach = (near[np.arange(len(unit)), own][:, None] - near) <= math.sqrt(1 - alike * alike) * apart + 1e-9
    reach &= np.arange(len(centres))[None, :] < own[:, None]
    return [[int(o), *np.flatnonzero(r).tolist()] for o, r in zip(own, reach, strict=True)]


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` (left x right) connects, one fewer than the ids of each group."""
    edges, seen_left, seen_right = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen_left[start]:
            continue
        seen_left[start] = True
        root, front = int(left[start]), np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & ~seen_right
            seen_right |= reached
            edges += [(root, int(x)) for x in right[reached]]
            if not reached.any():
                break
            front = np.flatnonzero(linked[:, reached].any(axis=1) & ~seen_left)
            seen_left[front] = True
            edges += [(root, int(x)) for x in left[front]]
    return edges


def compare_block(frame: pd.DataFrame, alike: float) -> pd.DataFrame:
    """``a, b, links``: for each row of a pair of blocks the vectors it links to, with a = b, and edges of a spanning forest.

    Two visitors of a cell meet elsewhere, or not at all; they are not compared here.
    """
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    out = {"a": [], "b": [], "links": []}
    first, other = frame[frame["own"] == i], frame[frame["own"] == j]
    if len(first) and len(other):
        left, right = first["rep"].to_numpy(), other["rep"].to_numpy()
        x, y = _matrix(first["unit"]), _matrix(other["unit"])
        linked = np.concatenate([x[k : k + 512] @ y.T >= alike for k in range(0, len(x), 512)])
        linked &= first["home"].to_numpy()[:, None] | other["home"].to_numpy()[None, :]
        if i == j:
            np.fill_diagonal(linked, False)
        sides = [(left, linked @ other["n"].to_numpy())]
        if i != j:
            sides.append((right, first["n"].to_numpy() @ linked))
        for ids, links in sides:
            some = np.flatnonzero(links)
            out["a"] += ids[some].tolist()
            out["b"] += ids[some].tolist()
            out["links"] += links[some].tolist()
        edges = _forest(linked, left, right)
        out["a"] += [u for u, _ in edges]
        out["b"] += [v for _, v in edges]
        out["links"] += [0] * len(edges)
    return pd.DataFrame(out).astype({"a": "int64", "b": "int64", "links": "int64"})


def near_vectors(rows: DataFrame, alike: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``rows(vec_id, embedding, label)``.

    Rows link where labels are equal and not null and the cosine in double precision is at least
    ``alike``. Vectors that are null, empty, zero or not finite, or have a null label or vec_id, link with
    nothing: 0 links, their own component, kept. Vectors of different lengths never link, however long they are.
    Rows with one label and vector are a class, compared once; a repeated vec_id is a row like
    any other. Each class lies in its own cell and visits cells of lower numbers that may hold a link (see
    ``place``), so that every two that may link meet in one cell, once, block by block; blocks give counts
    and a spanning forest, never pairs. An empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    plus_zero = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one
    # A class is known by 128 bits of its label and vector, so that vectors move for the grouping alone.
    keys = [F.xxhash64("label", "vector").alias("key"), F.xxhash64(F.lit("class"), "vector", "label").alias("key2")]
    classes = rows.where(fit).groupBy("label", plus_zero.alias("vector")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialise(classes.select("label", "vector", "rep", "n", *keys), "classes")
    sizes = classes.groupBy("label").agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("length"))
    total, largest, length = sizes.agg(*[F.coalesce(F.expr(x), F.lit(0)) for x in ("sum(rows)", "max(rows)", "max(length)")]).first()
    shared = spark.sparkContext.broadcast(fit_cells(classes, total, largest, length))

    def assign(frames):
        for whole in frames:
            for start in range(0, len(whole), 1024):
                frame = whole.iloc[start : start + 1024].reset_index(drop=True)
                unit_rows, cells = [None] * len(frame), [None] * len(frame)
                for size, at in frame.groupby(frame["vector"].map(len)).indices.items():
                    unit = _unit(_matrix(frame["vector"].iloc[at]))
                    for k, u, c in zip(at, unit, place(unit, shared.value.get(int(size)), alike), strict=True):
                        unit_rows[k], cells[k] = u, c
                yield pd.DataFrame({"label": frame["label"], "rep": frame["rep"], "n": frame["n"], "unit": unit_rows, "cells": cells})

    kind = dict(rows.dtypes)
    placed = classes.select("label", "rep", "n", "vector").mapInPandas(assign, f"label {kind['label']}, rep {kind['vec_id']}, n long, unit array<double>, cells array<int>")
    placed = materialise(placed.withColumn("size", F.size("unit")), "cells")
    cell = ["label", "size", "cell"]
    counts = placed.select("label", "size", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.count("*").alias("rows"))
    blocks = materialise(counts.where("rows > 1").select(*cell, F.ceil(F.col("rows") / rows_of(BLOCK_ROWS, length)).cast("int").alias("blocks")), "blocks")
    # A cell's rows are dealt to blocks by hash, and every two of its blocks are one bounded group.
    at = placed.select("label", "rep", "n", "unit", "size", F.posexplode("cells").alias("visit", "cell")).join(blocks, cell)
    at = at.withColumn("own", F.pmod(F.xxhash64("rep", F.lit("block")), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = at.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "unit", (F.col("visit") == 0).alias("home"))
    found = dealt.groupBy(*cell, "i", "j").applyInPandas(lambda frame: compare_block(frame, alike), "a long, b long, links long")
    found = materialise(found, "vector-links")
    roots = materialise(components(found.where("a != b").select("a", "b")), "roots")
    links = materialise(found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links")), "links")
    named = (
        classes.select("key", "key2", "rep", "n").join(links, classes.rep == links.a, "left").drop("a").join(roots, classes.rep == roots.node, "left")
        .select("key", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    named = materialise(named, "named")
    keyed = rows.select("vec_id", "label", F.when(fit, plus_zero).alias("vector")).select("vec_id", *[F.when(F.col("vector").isNotNull(), k).alias(n) for k, n in zip(keys, ("key", "key2"), strict=True)])
    joined = keyed.join(named, ["key", "key2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, whose products of codes are exact), scales, norms of the rest, and norms."""
    scale = np.abs(rows).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    codes = np.rint(rows / scale[:, None])
    rest = np.sqrt(((rows - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, rest, np.sqrt((rows * rows).sum(axis=1))


def tile_best(query_ids, queries, ids, rows, count: int):
    """(query_id, vec_id, score) of the ``count`` best of a tile for each query, exactly.

    The int8 product is off by at most |rest_q| |y| + |x_codes| |rest_y|; what cannot reach the
    count-th best lower bound goes, the others are recomputed in double precision.
    """
    qc, qs, qr, qn = quantise(queries)
    yc, ys, yr, yn = quantise(rows)
    wide = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
    yt = yc.astype(wide).T
    for k in range(0, len(queries), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        about = (qc[part].astype(wide) @ yt).astype(np.float64) * qs[part, None] * ys
        slack = (qr[part, None] * yn + (qn[part] + qr[part])[:, None] * yr) * (1 + 1e-9) + 1e-12 * qn[part, None] * yn
        same = query_ids[part][:, None] == ids[None, :]
        low = np.where(same, -np.inf, about - slack)
        if low.shape[1] > count:
            bar = np.partition(low, low.shape[1] - count, axis=1)[:, low.shape[1] - count]
        else:
            bar = np.full(len(low), -np.inf)
        alive = (about + slack >= bar[:, None]) & ~same
        for q, live in enumerate(alive):
            at = np.flatnonzero(live)
            scores = (rows[at] * queries[k + q]).sum(axis=1)
            best = heapq.nsmallest(count, zip((-scores).tolist(), ids[at].tolist(), strict=True))
            yield from ((query_ids[k + q], v, -s) for s, v in best)


def merged(found: DataFrame, count: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` best of all tiles, by one heap for each query; a tile gives ``count`` rows of it at most."""
    schema = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []  # the worst on top

        def best() -> list[tuple]:
            return [(now, k + 1, -v, x) for k, (x, v) in enumerate(sorted(heap, reverse=True))]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.values(), strict=True)], names=[*schema])

        for batch in slices(batches, 4096):
            rows = []
            for query, vector, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if query != now:
                    rows += best()
                    now, heap = query, []
                if len(heap) < count:
                    heapq.heappush(heap, (score, -vector))
                elif heap and (score, -vector) > heap[0]:
                    heapq.heapreplace(heap, (score, -vector))
            yield out(rows)
        yield out(best())

    rows = found.select("query_id", "vec_id", "score").repartition("query_id").sortWithinPartitions("query_id")
    return rows.mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, count: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row that ``is_query``, the ``count`` largest inner products.

    Exact, over all other rows of the same length, however long; ties go to the smaller vec_id. Vectors that
    are null, empty, zero or not finite, and null ids, take no part. Rows of a repeated vec_id
    are candidates each, but never of their own id; a repeated query counts once. Queries and
    candidates are dealt into blocks, each pair of blocks is one tile of bounded bytes, and a tile gives
    ``count`` rows for each of its queries, which heaps merge. An empty table gives no rows; other columns are ignored.
    """
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks"))
    good = good.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("size", F.size("vector"))
    good = materialise(good, "vectors")
    total, asked, length = good.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("size"), F.lit(1))).first()
    across, down = max(1, math.ceil(total / rows_of(CANDIDATE_ROWS, length))), max(1, math.ceil(asked / rows_of(QUERY_ROWS, length)))
    across = max(across, min(8, math.ceil(total / 1024)))  # enough tiles for a few tasks on small tables
    deal = F.xxhash64("vec_id", F.lit("tile"))
    asks = good.where("asks").dropDuplicates(["vec_id", "size"]).select("size", "vec_id", "vector", F.pmod(deal, F.lit(down)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("j"), F.lit(True).alias("asks"))
    spread = F.xxhash64("vec_id", "vector", F.lit("offer"))
    offers = good.select("size", "vec_id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("i"), F.pmod(spread, F.lit(across)).alias("j"), F.lit(False).alias("asks"))

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["asks"]], frame[~frame["asks"]]
        got = []
        if len(a) and len(b):
            got = list(tile_best(a["vec_id"].to_numpy(), _matrix(a["vector"]), b["vec_id"].to_numpy(), _matrix(b["vector"]), count))
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asks.unionByName(offers).groupBy("size", "i", "j").applyInPandas(tile, "query_id long, vec_id long, score double")
    return merged(found, count)
