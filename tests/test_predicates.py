import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramward.functions import prefilters, registry, truth
from gramward.functions.predicates import matches, query
from gramward.functions.truth import row_matches
from gramward.operators import gate, physical
from gramward.plans import cover
from tests.fixture_rows import CHECKSUM, GOLDEN, golden_rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, r) for k, r in enumerate(map(bytearray, golden_rows()))], "row_id long, data binary").cache()


def test_golden_truths(rows):
    assert truth.column_checksum(golden_rows()) == CHECKSUM
    queries = [query(op, *needles) for op, needles, _, _ in GOLDEN]
    flags = rows.select("row_id", *[matches(F.col("data"), q, binary=True).alias(f"q{k}") for k, q in enumerate(queries)]).collect()
    for k, (_, _, count, digest) in enumerate(GOLDEN):
        ids = [r["row_id"] for r in flags if r[f"q{k}"]]
        assert (len(ids), truth.bitmap_hash(ids, 200)) == (count, digest), GOLDEN[k]


def test_differential(spark):
    draw, alphabet = random.Random(5), [b"a", b"b", b"A", b"\x00", b"\xff", b"%", b"_", b"\\", b"\n"]
    cut = lambda n: b"".join(draw.choice(alphabet) for _ in range(draw.randint(0, n)))
    data = [cut(24) for _ in range(300)]
    frame = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(data)], "row_id long, data binary")
    queries = [query(op, *[cut(6) for _ in range(1 if op in ("prefix", "suffix", "contains") else draw.randint(1, 4))]) for op in ("prefix", "suffix", "contains", "multi_contains", "contains_any") for _ in range(10)]
    flags = frame.select("row_id", *[matches(F.col("data"), q, binary=True).alias(f"q{k}") for k, q in enumerate(queries)]).collect()
    for k, q in enumerate(queries):
        assert [r[f"q{k}"] for r in sorted(flags)] == [truth.row_matches(q, r) for r in data], q


def test_null_and_validation(spark):
    frame = spark.createDataFrame([(None,), ("",), ("a%b\\",)], "data string")
    for q in (query("contains", ""), query("multi_contains", "", ""), query("contains_any", "", "x"), query("prefix", "")):
        assert [r[0] for r in frame.select(matches(F.col("data"), q)).collect()] == [None, True, True]
    assert frame.where(matches(F.col("data"), query("multi_contains", "%", "\\"))).count() == 1
    for bad in (lambda: query("contains", "a", "b"), lambda: query("multi_contains"), lambda: query("like", "a")):
        with pytest.raises(ValueError):
            bad()


def test_prefilters_are_sound(rows):
    text = rows.select("row_id", F.col("data").cast("string").alias("t"))
    assert prefilters.rare_offsets(b"the")[0] == 1
    for needle in (b"google", b"htt", b"ab", b"a", b"x" * 32):
        for kernel in prefilters.KERNELS:
            if kernel == "tail_code" and not prefilters.tail_code(needle):
                continue
            lost = text.where(matches(F.col("t"), query("contains", needle)) & ~prefilters.survives(F.col("t"), needle, kernel))
            assert lost.isEmpty(), (needle, kernel)


def test_variants_and_gate(rows):
    text = rows.select("row_id", F.col("data").cast("string").alias("t"))
    index = physical.gram_index(text, "row_id", "t")
    for q in (query("contains", "google"), query("contains_any", "search", "img"), query("contains", "a"), query("multi_contains", "http", "com")):
        right = physical.direct(text, "t", q)
        for other in (physical.dictionary(text, "t", q), physical.gram_lookup(index, text, "row_id", "t", q)):
            assert gate.gate(right, other, "row_id").first()["gate_ok"]
        wrong = gate.gate(right, gate.canary(text, "row_id", "t", q), "row_id").first()
        assert not wrong["gate_ok"] and wrong["first_divergent"] == 0
    one = [physical.dictionary_stats(text, "t", query("contains", "a"), "row_id", c).first() for c in (0, 64, 128)]
    assert one[0]["eval_domain"] == 152 and one[1]["eval_domain"] >= one[2]["eval_domain"] >= 152
    with pytest.raises(ValueError):
        physical.dictionary_stats(text, "t", query("contains", "a"), "row_id", 100)


def test_codecs(rows, tmp_path):
    for codec, level in (("none", None), ("lz4_raw", None), ("zstd", 9)):
        back = physical.codec_round_trip(rows, str(tmp_path / codec), codec, level)
        assert gate.gate(rows, back, "row_id").first()["gate_ok"] and back.exceptAll(rows).isEmpty()
    many = rows.crossJoin(rows.sparkSession.range(200)).select("row_id", "data")  # enough bytes for codecs to differ
    folders = {"none": None, "zstd1": 1, "zstd19": 19}
    for name, level in folders.items():
        physical.codec_round_trip(many, str(tmp_path / f"sized-{name}"), "zstd" if level else "none", level)
    sizes = {r.codec: r.bytes for r in physical.codec_sizes({n: str(tmp_path / f"sized-{n}") for n in folders}, rows.sparkSession).collect()}
    assert 0 < sizes["zstd19"] <= sizes["zstd1"] < sizes["none"]


def test_cover_is_sound():
    tokens = {"ab": 5, "abc": 2, "bc": 7, "c": 9, "d": 3, "cd": 1, "xab": 4}
    found = cover.cover("abcd", tokens)
    draw = random.Random(2)
    for _ in range(3000):
        row = [draw.choice(list(tokens)) for _ in range(5)]
        assert "abcd" not in "".join(row) or found & set(row)
    assert cover.cover("zzz", tokens) == set()


QUERIES = [
    query("prefix", "http", id="prefix"), query("suffix", ".html", id="suffix"), query("contains", "google", id="contains"), query("contains", "x" * 70, id="long"),
    query("multi_contains", "http", "com", id="multi"), query("contains_any", "google", "yandex", "q.php", id="any"), query("contains_any", "google", "", id="any_empty"), query("contains", "", id="empty"),
]


def test_every_system_agrees_or_declines(spark):
    """All that the registry composes to, against the trust root; outside an envelope it says why."""
    rows = golden_rows()
    text = spark.createDataFrame([(k, r.decode()) for k, r in enumerate(rows)], "row_id long, data string").cache()
    seen = set()
    for system in registry.systems(scanners=["memmem", "prefilter", "bndm", "teddy", "pf-rare-pair"]):
        if system.scheme.name in ("identity", "lz4", "zstd", "broken", "absent", "raises") or system.label == "gate_canary/wrong":
            continue
        for q in QUERIES:
            if system.reason(q):
                with pytest.raises(NotImplementedError):
                    system.run(text, "row_id", "data", q)
            elif (system.label, q.op) not in seen or q.id in ("any_empty", "long"):
                seen.add((system.label, q.op))
                found = sorted(r[0] for r in system.run(text, "row_id", "data", q).select("row_id").collect())
                assert found == [k for k, r in enumerate(rows) if row_matches(q, r)], (system.label, q.id)
    assert registry.system("uncompressed/direct+teddy").reason(QUERIES[6]) == "empty needle" and registry.system("uncompressed/direct+bndm").reason(QUERIES[3])
    assert len(registry.support_rows(QUERIES)) == len(QUERIES) * len(registry.systems())
    for label in ("nothing/direct", "uncompressed/decode", "uncompressed/direct+nothing"):
        with pytest.raises(ValueError):
            registry.system(label)
    with pytest.raises(ValueError):
        registry.add(registry.SCANNERS["memmem"])


def test_bitmap_hash_of_words_in_order():
    ids = [0, 63, 64, 700, 701, 8000]
    state = truth.Bitmap(9000)
    for word in sorted({k // 64 for k in ids}):
        state.add(word, sum(1 << k % 64 for k in ids if k // 64 == word))
    assert state.digest() == truth.bitmap_hash(ids, 9000) and truth.Bitmap(9000).digest() == truth.bitmap_hash([], 9000)


def test_ordered_matches_take_time_in_proportion(spark):
    """Hundreds of thousands of places of the first needles and none of the last: a pattern would try them all with each other."""
    text = "the of " * 200_000
    rows = spark.createDataFrame([(text,), (text + "zq",), (None,), ("",), ("of the zq",)], "t string")
    began = time.perf_counter()
    found = [r[0] for r in rows.select(matches(F.col("t"), query("multi_contains", "the", "of", "zq"))).collect()]
    assert found == [False, True, None, False, False] and time.perf_counter() - began < 20
    assert rows.where(matches(F.col("t"), query("multi_contains", "é", "of"))).count() == 0


def test_a_scheme_of_ones_own(spark):
    """The way out where no native expression will do: an Arrow UDF over bytes, under a name of its own, gated like any other."""

    def plan(rows, id_column, column, q, scanner):
        needle = bytes(q.needles[0])

        @F.pandas_udf("boolean")
        def holds(values: pd.Series) -> pd.Series:
            return values.map(lambda v: needle in bytes(v))

        return rows.where(holds(F.col(column)))

    registry.add(registry.Scheme("own_find", {"udf": (frozenset(["contains"]), plan)}))
    raw = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(golden_rows())], "row_id long, data binary")
    own = registry.system("own_find/udf")
    q = query("contains", b"\x7f\x01")
    assert gate.gate(registry.system("uncompressed/direct").run(raw, "row_id", "data", q), own.run(raw, "row_id", "data", q), "row_id").first()["gate_ok"]
    assert own.reason(query("prefix", "a")) and own.label in {s.label for s in registry.systems()}
    del registry.SCHEMES["own_find"]
