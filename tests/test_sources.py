import gzip
import hashlib
import io
import json
import random
import tarfile
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramward.functions.predicates import query
from gramward.functions.truth import column_checksum, row_matches
from gramward.operators import generator, physical
from gramward.plans import analytics, store
from gramward.sources import columns
from gramward.streaming.results import load_stream
from tests.fixture_rows import CHECKSUM, golden_rows


def test_csv_ingest_keeps_empties_and_order(spark, tmp_path):
    lines = ["data"] + ['"' + r.decode().replace('"', '""') + '"' for r in golden_rows()]
    (tmp_path / "mini.csv").write_text("\n".join(lines) + "\n")
    rows = columns.ingest(columns.read_delimited(spark, str(tmp_path / "mini.csv"), "data"))
    manifest = columns.write_column(rows, str(tmp_path), "mini", {"format": "csv"})
    assert manifest["num_rows"] == 200 and manifest["payload_bytes"] == 6682 and manifest["max_len"] == 500
    assert manifest["checksum"] == CHECKSUM and sum(manifest["byte_freq"]) == 6682
    assert json.loads((tmp_path / "manifest.json").read_text())["id"] == "mini"


def test_tsv_and_columns_by_number(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('k\tdata\n1\t"x\ty"\n2\t\n')
    assert [r[0] for r in columns.read_delimited(spark, str(tmp_path / "a.tsv"), 1, "\t").collect()] == ["x\ty", ""]
    (tmp_path / "b.csv").write_text("k,data\n1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        columns.read_delimited(spark, str(tmp_path / "b.csv"), "data").collect()


def test_ingest_rejects(spark, tmp_path):
    with pytest.raises(TypeError):
        columns._text_or_bytes(spark.range(3), "id")
    with pytest.raises(ValueError):
        columns._text_or_bytes(spark.range(3), "data")
    with pytest.raises(ValueError):
        columns.write_column(spark.createDataFrame([], "row_id long, data string"), str(tmp_path), "none", {})
    rows = columns.ingest(spark.createDataFrame([("b",), (None,), ("a",)], "data string"), F.col("data"))
    assert [tuple(r) for r in rows.sort("row_id").collect()] == [(0, "a"), (1, "b")]


def test_extractors(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\thttp://a \n2\t\n3\tftp://b\n")
    assert [r[0] for r in columns.extract_tsv_field(spark, str(tmp_path / "a.tsv"), 1, "http").collect()] == ["http://a"]
    (tmp_path / "a.jsonl").write_text('{"t": " x "}\nbad\n{"t": ""}\n')
    assert [r[0] for r in columns.extract_json_field(spark, str(tmp_path / "a.jsonl"), "t").collect()] == ["x"]
    (tmp_path / "a.nt").write_text('# no\n<s> <p> "one \\"two\\" three"@en .\n\n')
    assert [r[0] for r in columns.extract_english_literals(spark, str(tmp_path / "a.nt")).collect()] == ['one \\"two\\" three']
    (tmp_path / "a.xml").write_text("<r><d><abstract> hi </abstract></d><d><abstract></abstract></d></r>")
    assert [r[0] for r in columns.extract_xml_element(spark, str(tmp_path / "a.xml"), "d", "abstract").collect()] == ["hi"]


def test_tar_and_gzip_sources(spark, tmp_path):
    """Every .tsv member of archives; lines of gzip files; literals in the order of the file, up to a count."""
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, body in (("x/one.tsv", "1\ta \n2\t\nshort\n"), ("two.tsv", "3\tb"), ("no.txt", "4\tc")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body.encode()))
    assert sorted(r[0] for r in columns.extract_tar_tsv(spark, str(tmp_path / "a.tar.gz"), 1).collect()) == ["a", "b"]
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as file:
        file.write("1\thttps://a\n2\thttp://b\n")
    assert [r[0] for r in columns.extract_tsv_field(spark, str(tmp_path / "a.tsv.gz"), 1, "https").collect()] == ["https://a"]
    with gzip.open(tmp_path / "a.nt.gz", "wt") as file:
        file.write("".join(f'<s> <p> "t{k}"@en .\n' for k in range(50)))
    assert [r[0] for r in columns.extract_english_literals(spark, str(tmp_path / "a.nt.gz"), 3).collect()] == ["t0", "t1", "t2"]


def test_written_columns_are_checked(spark, tmp_path):
    rows = columns.ingest(spark.createDataFrame([("b",), (None,), ("",)], "data string").repartition(3), F.col("data"))
    columns.write_column(rows, str(tmp_path), "few", {})
    assert columns.load_column(spark, str(tmp_path), verify=True)[0].count() == 2
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    for change in ({"num_rows": 3}, {"payload_bytes": 9}, {"checksum": "xxh3:0"}):
        (tmp_path / "manifest.json").write_text(json.dumps(manifest | change))
        with pytest.raises(ValueError):
            columns.load_column(spark, str(tmp_path), verify=True)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "f").write_bytes(b"x")
    columns.check_files(spark, str(tmp_path / "raw"), {"f": hashlib.sha256(b"x").hexdigest()})
    with pytest.raises(ValueError, match="'f'"):
        columns.check_files(spark, str(tmp_path / "raw"), {"f": "0"})


def test_result_lines(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text('{"k": "a", "v": 1}\n\n{"k": "b"\n{"k": "c", "v": 3, "more": 1}\n')
    with pytest.warns(UserWarning, match="1 malformed"):
        assert sorted(map(tuple, columns.read_results(spark, path, "k string, v int").collect())) == [("a", 1), ("c", 3)]
    with pytest.raises(ValueError, match="line 3"):
        columns.read_results(spark, path, "k string, v int", strict=True)


def test_tables_of_any_kind(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    for name, text in (("t.csv", "a,b\n1,x\n2,y\n"), ("t.jsonl", "\n".join(map(json.dumps, rows))), ("list.json", json.dumps(rows)), ("t.json", json.dumps({"rows": rows}))):
        (tmp_path / name).write_text(text)
        assert sorted((r.a, r.b) for r in columns.read_table(spark, str(tmp_path / name)).collect()) == [(1, "x"), (2, "y")]


def test_workload_against_plain_python(spark):
    """Each query's count by the trust root, its band, no two alike, and the report's sums; the same at any partitioning."""
    draw = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "http://", "zeta", "x", "yy"]
    texts = ["/".join(draw.choice(words) for _ in range(draw.randint(1, 14))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "row_id long, data string")
    made, report = generator.workload(table.repartition(3), "row_id", "data", quick=True)
    assert made == generator.workload(table.repartition(2), "row_id", "data", quick=True)[0] and len(made) > 40
    for m in made:
        q = query(m.point.op, *m.needles)
        assert m.match_count == sum(row_matches(q, t.encode()) for t in texts) and generator.accepts(m.point.band, m.match_count / 400)
        assert sum(map(len, m.needles)) == (8 * m.point.k if m.point.k else m.point.length)
    assert len({m.id for m in made}) == len(made) and {m.point.op for m in made} >= {"prefix", "suffix", "contains", "multi_contains"}
    assert sum(r["made"] for r in report) == len(made) and all((r["status"] == "filled") == (r["reason"] is None) for r in report)
    assert any(m.point.band == 0 for m in made)
    bands = spark.createDataFrame([(b, e) for b in (0.0, 1e-3, 0.3) for e in (0.0, 2e-3, 0.4)], "b double, e double")
    for b, e, p in bands.select("b", "e", generator.plausible(F.col("e"), F.col("b"))).collect():
        assert p == generator.hopeful(b, e)
    assert generator.workload(table.limit(0), "row_id", "data", quick=True)[0] == []
    assert generator.report_frame(spark, report).count() == 66 and generator.generate(table, "row_id", "data", quick=True).count() == len(made)


def test_pool_picks():
    pool = {f"n{k:03d}": k / 1000 for k in range(200)}
    for mix in ("balanced", "skewed"):
        own = generator.picks(pool, generator.Point("contains_any", 0.1, 8, k=4, mix=mix), random.Random(1))
        shares = sorted(pool[n] for n in own)
        assert len(own) == 4 and (all(0.1 / 12 <= p <= 0.075 for p in shares) if mix == "balanced" else 0.05 <= shares[-1] <= 0.15 and shares[-2] <= 0.0025)
    assert generator.picks({"a": 0.5}, generator.Point("contains_any", 0.1, 8, k=4, mix="balanced"), random.Random(1)) is None


def test_grid_and_bands(spark):
    points = generator.grid()
    assert len(points) == 308 and sum(p.replicates for p in points) == 1320 and len(generator.grid(quick=True)) == 66
    frame = spark.createDataFrame([(0.0,), (1e-3,), (5e-3,), (0.31,), (0.42,)], "s double")
    assert [r[0] for r in frame.select(generator.band_of(F.col("s"))).collect()] == [0.0, 1e-3, None, 0.3, 0.5]


def test_store_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    once = store.replace_changed(old, new, "k", "v")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, store.replace_changed(once, new, "k", "v").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    missing = store.attach_builds(new, old.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(Exception, match="without build row"):
        missing.collect()


def test_stream_load(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for k, keys in enumerate((["a", "b"], ["b", "c"])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"k": x, "v": k}) for x in keys))
        load_stream(spark, str(source), out, str(tmp_path / "check"), "k string, v int", "k").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 0), ("b", 0), ("c", 1)]


def test_pareto_equals_all_pairs(spark):
    draw = random.Random(3)
    rows = [(k, float(draw.randint(1, 9)), float(draw.randint(1, 9))) for k in range(60)] + [(90, None, 1.0), (91, 9.0, None)]
    found = {r[0] for r in analytics.pareto(spark.createDataFrame(rows, "n int, h double, l double"), "n", "h", "l").collect()}
    beaten = {a for a, h, l in rows[:60] for _, x, y in rows[:60] if x >= h and y <= l and (x > h or y < l)}
    assert found == {k for k, _, _ in rows} - beaten and 60 > len(found) > 2


def test_checksum_depends_on_order():
    assert column_checksum([b"a", b"b"]) != column_checksum([b"b", b"a"])


def test_thousands_of_queries_in_one_scan(spark):
    """Counts by the trust root of all operators, on odd rows; and not as conditions of a plan, which take minutes to compile for a whole grid."""
    draw = random.Random(6)
    letters = ["a", "b", ".", "\\", "é", "\n", "x{2}", "\x00", "𝄞"]
    text = lambda n: "".join(draw.choice(letters) for _ in range(draw.randint(1, n)))
    texts = ["", *[text(30) for _ in range(300)]]
    table = spark.createDataFrame([*enumerate(texts), (999, None)], "row_id long, data string").repartition(3)
    queries = [query(op, text(3)) for op in generator.SINGLE_OPS for _ in range(300)] + [query(op, "") for op in generator.SINGLE_OPS]
    queries += [query(op, *[text(2) for _ in range(draw.choice((1, 2, 4, 8, 64)))]) for op in ("multi_contains", "contains_any") for _ in range(900)]
    queries += [query("multi_contains", "", "a", ""), query("multi_contains", ""), query("contains_any", "zzz", ""), query("contains_any", "zzz", "zzz")]
    started = time.monotonic()
    found = generator.count_queries(table, "data", queries)
    assert time.monotonic() - started < 60
    assert found == {q: sum(row_matches(q, t.encode()) for t in texts) for q in queries}
    assert generator.count_queries(table.limit(0), "data", queries[:3]) == dict.fromkeys(queries[:3], 0) and generator.count_queries(table, "data", []) == {}


def test_tokens_are_counted_once(spark, monkeypatch):
    """Statistics by plain Python with ids that are shared or NULL (which count for no row), in a plan that counts tokens once; and tasks that give their counts early."""
    draw = random.Random(8)
    words = ["a", "ab", "b", "é", "𝄞x", "the", "then", "x\n", ""]
    rows = [(draw.choice([k, k // 2, 7, None]), None if k % 9 == 0 else " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))) for k in range(200)]
    for own in (rows, [(k, text) for k, (_, text) in enumerate(rows)]):
        tokens = [(t, k) for k, text in own if text is not None for t in text.split(" ") if t]
        expected, place = [], 0
        for t in sorted({t for t, _ in tokens}):
            n = sum(x == t for x, _ in tokens)
            expected.append((t, n, len({k for x, k in tokens if x == t and k is not None}), place))
            place += n
        found = physical.token_statistics(spark.createDataFrame(own, "doc_id long, text string").repartition(3), "doc_id", "text")
        assert sorted(map(tuple, found.collect())) == expected
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(physical, "TOKENS_HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b a", b"c  d", b"a"], pa.binary())], names=["text"])
    given = [tuple(r.values()) for b in physical._row_token_counts(iter([batch])) for r in b.to_pylist()]
    assert sorted(given) == [(b"", 1, 1), (b"a", 1, 1), (b"a", 2, 1), (b"b", 1, 1), (b"c", 1, 1), (b"d", 1, 1)]
