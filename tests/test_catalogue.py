"""Each registered query against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gramward.plans import analytics, catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, list | tuple):
            return tuple(map(value, x))
        return None if math.isnan(float(x)) else float(f"{float(x):.9g}")

    return sorted(columns), sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA)
    theirs = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in theirs.description]
    assert plain(ours.columns, [tuple(r) for r in ours.collect()]) == plain(names, theirs.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("most", [4096, 3])
def test_minimum_cut_loses_no_rows(spark, tmp_path, monkeypatch, most):
    """Thousands of other tokens that end in "t" or begin with "r" crowd out none, nor does a bound on them; matches within a token and over several."""
    monkeypatch.setattr(catalogue, "CUT_TOKENS", most)
    rows = [(k, f"w{k}t rb{k}ot") for k in range(3000)] + [(10_000 + k, f"x{k}ot r{k} y") for k in range(200)] + [(20_000, "ot r"), (20_001, "ot  r"), (20_002, None), (20_003, "")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = sorted(r[0] for r in catalogue.QUERIES["cover_min_cut"](spark, str(tmp_path)).collect())
    assert found == [*range(10_000, 10_200), 20_000]


def test_pareto_of_equal_means(spark, tmp_path):
    """Two systems of the same ratios in another order have one mean, so that the slower is beaten: sums of doubles in row order differ in the last digit."""
    orders = {"click": ([28, 20, 8, 16, 24, 0, 32, 4, 12], 1.0), "view": ([20, 24, 28, 16, 12, 0, 32, 4, 8], 2.0)}
    rows = [(u, u, system, value, "{}") for system, (users, value) in orders.items() for u in users]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue.QUERIES["an_pareto"](spark, str(tmp_path)).collect()
    assert [(r["name"], r["ns"]) for r in found] == [("host0click", 1001.0)] and found[0]["ratio"] == pytest.approx(sum(64000 / (8000 + u % 9 * 4000) for u in range(9)) / 9, rel=1e-15)


def test_mean_of_any_values(spark):
    rows = [("a", 0.1), ("a", None), ("b", None), ("c", float("nan")), ("c", 1.0), ("d", float("inf")), ("e", 1e300), ("e", 1e300), ("f", -2.0), ("f", 3.0)]
    found = dict(spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(analytics.mean(F.col("v"))).collect())
    assert math.isnan(found.pop("c")) and found == {"a": 0.1, "b": None, "d": math.inf, "e": 1e300, "f": 0.5}
