import os
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gramward.llm.common import shared_dir
from gramward.llm.queries import QUERIES

VOCABULARY = {"en": "the of and water house is not with", "de": "der die und wasser haus ist nicht mit"}


def fixture_rows():
    draw, filler, rows = random.Random(7), None, []
    filler = ["".join(draw.choice("aeioutnshr") for _ in range(6)) for _ in range(3000)]
    sentence = lambda lang: " ".join(draw.choice(VOCABULARY[lang].split()) if draw.random() < 0.5 else draw.choice(filler) for _ in range(draw.randint(8, 14))) + "."
    passage = " ".join(sentence("en") for _ in range(5))
    for k in range(60):
        lang = "en" if k % 2 else "de"
        body = [sentence(lang) for _ in range(14)]
        if k % 10 == 5:
            body.insert(draw.randint(0, 14), passage)
        text = " ".join(body)
        rows.append((k, text, lang if k % 7 else None, "s", len(text)))
    for k in range(10):  # near copies: a few words changed
        words = rows[k][1].split()
        for _ in range(k // 2):
            words[draw.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), None, "s", 1))
    rows += [(200, None, "en", "s", 0), (201, "123 !", "en", "s", 5), rows[0], (None, rows[3][1], None, None, None), (202, "", None, "s", 0)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(fixture_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_pipeline(rows):
    """ids and texts that the first three stages leave, by plain loops over all pairs and all runs."""
    known = {lang: set(v.split()) for lang, v in VOCABULARY.items()}
    rows = [(k, t) for k, t, *_ in rows if t and re.search(r"[^\W\d_]", t) and any(w in known[x] for x in known for w in t.split())]
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [{tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for _, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 25 * len(sets[a] & sets[b]) ** 2 >= 16 * len(sets[a]) * len(sets[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    kept = [r for k, r in enumerate(rows) if up[k] == k]
    seen, left = [], {}
    for doc, text in kept:
        own = re.findall(r"\S[^.]*\.|\S[^.]*$", text)
        gone = set()
        for i in range(len(own) - 2):
            if own[i : i + 3] in seen:
                gone |= {i, i + 1, i + 2}
            seen.append(own[i : i + 3])
        left[doc] = " ".join(s for k, s in enumerate(own) if k not in gone)
    return left


def test_the_whole_pipeline_equals_brute_force(spark, sf_dir):
    left = brute_pipeline(fixture_rows())
    assert 50 < len(left) < 68 and sum(len(t) for t in left.values()) < sum(len(r[1]) for r in fixture_rows()[:60])
    library, by, seq = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(left)
    for doc, text in left.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in seq.values():
        assert sum(r.length for r in own) <= 1024


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_spans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns


def test_stages_take_any_rows_and_columns(spark):
    """Empty tables, nulls in each column, clashing names; a long text; each stage by itself."""
    clash = ["_own", "own", "_lang_pred", "lang_pred", "_lang_score", "row", "key", "firsts", "a.b", "c0"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in clash)
    long = ". ".join(f"the house {k} is of water and not {k + 1}" for k in range(20_000))
    rows = [(1, "the water is of the house and not with it", "en", "s", 1), (1, "the water is of the house and not with it", "en", "s", 1), (2, "der wasser ist nicht mit haus", "de", None, None), (3, long, None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0)]
    table = spark.createDataFrame([(*r, *clash) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, table, "")
        assert stage(spark, table.limit(0), "").count() == 0
        if stage is not corpus_pipeline.pack:
            assert found.columns == table.columns
            assert all(tuple(r)[5:] == tuple(clash) for r in found.collect())
            assert found.where("doc_id = 3").first().text.startswith("the house 0 is of water")
        else:
            assert found.selectExpr("sum(length)").first()[0] > 100_000 and found.where("doc_id is null").count() == 1


def test_settings_stay(spark, sf_dir):
    """And nothing but the stages' results is left in the shared folder by a run."""
    kept = set(os.listdir(f"{shared_dir(spark)}/gramward"))
    before = {x: spark.conf.get(x) for x in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")}
    corpus_pipeline.run(spark, sf_dir).count()
    assert before == {x: spark.conf.get(x) for x in before} and shared_dir(spark)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(f"{shared_dir(spark)}/gramward")) - kept} == {f"stage-{n}" for n, _ in corpus_pipeline.STAGES}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
