import json
from pathlib import Path

import pytest

from gramward import cli
from gramward.functions import registry
from gramward.operators import suite
from gramward.plans import loader, spec
from tests.fixture_rows import CHECKSUM, GOLDEN, golden_rows


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dataset")
    spark.createDataFrame([(k, r.decode()) for k, r in enumerate(golden_rows())], "k int, data string").coalesce(1).write.parquet(f"{folder}/source")
    assert cli.main(["ingest", f"{folder}/source", f"{folder}/data", "mini", "data"]) == 0
    return folder


def test_bless_check_run(dataset):
    queries = [suite.Query(f"{op}.{k}", op, tuple(n.encode() for n in needles)) for k, (op, needles, _, _) in enumerate(GOLDEN)]
    suite.write(f"{dataset}/suite", "mini", CHECKSUM, queries[:12])
    data, where = f"{dataset}/data", f"{dataset}/suite"
    assert cli.main(["run", data, where, f"{dataset}/out"]) == 2  # no truths yet
    assert cli.main(["bless", data, where]) == 0 and cli.main(["check", data, where]) == 0
    for line, (_, _, count, digest) in zip(Path(where, "queries.jsonl").read_text().splitlines(), GOLDEN, strict=False):
        assert (json.loads(line)["truth"]["count"], json.loads(line)["truth"]["hash"]) == (count, digest)
    assert cli.main(["run", data, where, f"{dataset}/out", "--variants", "dict_like", "uncompressed/direct+teddy"]) == 0
    rows = [json.loads(x) for x in Path(dataset, "out", "results.jsonl").read_text().splitlines()]
    assert {r["status"] for r in rows} == {"ok", "unsupported"} and all("latency_ns" in r for r in rows if r["status"] == "ok")
    assert all(r["error"] for r in rows if r["status"] == "unsupported")
    assert cli.main(["run", data, where, f"{dataset}/out", "--variants", "gate_canary/wrong"]) == cli.GATE_FAILED
    rows = [json.loads(x) for x in Path(dataset, "out", "results.jsonl").read_text().splitlines()]
    assert all(r["status"] == "gate_failed" and "latency_ns" not in r for r in rows)
    assert all(r["gate"]["first_divergent"] == 0 and r["gate"]["text"] == golden_rows()[0].decode() for r in rows)


def test_spec_run_and_store(spark, dataset, monkeypatch):
    """A specification's run with a failing build, a missing module and an error; then the store: new, same, changed, another start."""
    registry.add(registry.Scheme("broken", {"direct": (registry.ALL, lambda *a: 1 / 0)}, build=lambda rows, folder: 1 / 0))
    registry.add(registry.Scheme("absent", {"direct": (registry.ALL, lambda *a: None)}, module="no_such_module"))
    registry.add(registry.Scheme("raises", {"own": (registry.ALL, lambda *a: 1 / 0)}))
    queries = [suite.Query("a", "contains", (b"google",)), suite.Query("b", "multi_contains", (b"http", b"html"))]
    suite.write(f"{dataset}/few", "mini", CHECKSUM, queries)
    assert cli.main(["bless", f"{dataset}/data", f"{dataset}/few"]) == 0
    (dataset / "run.toml").write_text("""name = "few"
systems = ["broken/direct+memmem", "absent/direct+memmem", "raises/own", "zstd/decode+memmem", "uncompressed", "token_cover"]
scanners = ["memmem", "bndm"]
datasets = ["data"]
suites = ["few"]
chunk_rows = [0, 128]
[measurement]
warmup = 0
iterations = 1
least_ms = 0
""")
    found = spec.load(f"{dataset}/run.toml")
    assert [s.label for s in found.chosen()][-4:] == ["zstd/decode+memmem", "uncompressed/direct+memmem", "uncompressed/direct+bndm", "token_cover/cover"]
    matrix = spec.run_matrix(spark, found, {found.datasets[0]: queries})
    assert matrix.count() == 7 * 2 * 2 and matrix.where("not supported and reason is null").isEmpty()
    assert cli.main(["run", f"{dataset}/run.toml", f"{dataset}/few-out"]) == 0
    rows = [json.loads(x) for x in Path(dataset, "few-out", "results.jsonl").read_text().splitlines()]
    status = {(r["system"], r.get("query_id")): r["status"] for r in rows}
    assert status["broken/direct+memmem", None] == "build_failed" and status["absent/direct+memmem", None] == "module_unavailable"
    assert status["raises/own", "a"] == "error" and status["uncompressed/direct+bndm", "b"] == "unsupported" and status["zstd/decode+memmem", "b"] == "ok"
    store = loader.Store(spark, f"{dataset}/store")
    run = f"{dataset}/few-out"
    assert [store.load(run), store.load(run)] == ["new", "same"]
    lines = Path(run, "results.jsonl").read_text().splitlines()
    Path(run, "results.jsonl").write_text("\n".join(lines[:-1]) + "\nnot json\n")
    with pytest.warns(UserWarning, match="1 malformed"):
        assert store.load(run) == "changed"
    assert store.results().count() == len(rows) - 1 and store.runs().count() == 1
    about = json.loads(Path(run, "run.json").read_text()) | {"started_at": "2999-01-01T00:00:00+00:00"}
    Path(run, "run.json").write_text(json.dumps(about))
    with pytest.warns(UserWarning):
        assert store.load(run) == "new"
    assert sorted((r.started_at[:4], r.is_latest) for r in store.runs().collect())[-1] == ("2999", True) and store.runs().where("is_latest").count() == 1
    assert store.view().where("ns_per_value > 0").count() == store.results().where("status = 'ok'").count() > 0
    Path(run, "run.json").write_text(json.dumps(about | {"started_at": "3000", "datasets": [about["datasets"][0], about["datasets"][0] | {"suite": "other"}]}))
    with pytest.raises(Exception, match="more than one suite"):
        with pytest.warns(UserWarning):
            store.load(run)


@pytest.mark.parametrize("change", ["extra = 1", "chunk_rows = [100]", "systems = []", "systems = ['nothing/direct']"])
def test_bad_specs_are_refused(tmp_path, change):
    lines = {"systems": "systems = ['uncompressed']", "datasets": "datasets = ['d']", "suites": "suites = ['s']"} | {change.split(" ")[0]: change}
    (tmp_path / "x.toml").write_text("\n".join(lines.values()))
    with pytest.raises(ValueError):
        spec.load(str(tmp_path / "x.toml"))
    plain = spec.Spec("x", ("b", "a"), ("/p/d1", "/q/d2"), ("s",))
    assert plain.key() == spec.Spec("x", ("a", "b"), ("/z/d2", "d1"), ("/s",)).key() != spec.Spec("x", ("a", "c"), ("d1", "d2"), ("s",)).key()


def test_stale_suite_is_refused(dataset):
    manifest = json.loads(Path(dataset, "data", "manifest.json").read_text())
    suite.write(f"{dataset}/stale", "mini", "xxh3:0", [suite.Query("a", "contains", (b"a",))])
    with pytest.raises(ValueError):
        suite.read(f"{dataset}/stale", manifest)
    assert suite.decode_needle(suite.encode_needle(b"\xff\x00")) == b"\xff\x00"
    for bad in ("", '{"id": "a", "op": "contains", "needles": []}', '{"id": "a", "op": "x", "needles": ["a"]}'):
        with pytest.raises(ValueError):
            suite.parse(bad)


def test_gen(dataset):
    assert cli.main(["gen", f"{dataset}/data", f"{dataset}/made", "--quick"]) == 0
    report = json.loads(Path(dataset, "made", "gen-report.json").read_text())
    assert len(report["points"]) == 66 and report["filled"] + report["partial"] + report["empty"] == 66 and report["queries"] == sum(p["made"] for p in report["points"])
    assert cli.main(["gen", f"{dataset}/data", f"{dataset}/made", "--quick"]) == 2 and cli.main(["list"]) == 0
    assert len(suite.parse(Path(dataset, "made", "queries.jsonl").read_text())) > 5
