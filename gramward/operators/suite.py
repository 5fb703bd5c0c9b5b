"""Suites: queries of a dataset with their truths; reading, writing, blessing, checking."""

from __future__ import annotations

import base64
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramward.functions import truth as root
from gramward.functions.predicates import Query, matches
from gramward.sources.columns import write_json

ALGO = "xxh3"
#: First matching ids that a truth holds.
SAMPLE = 8
#: Queries whose truths are computed in one scan.
TOGETHER = 64


def encode_needle(needle: bytes) -> str | dict:
    try:
        return needle.decode()
    except UnicodeDecodeError:
        return {"b64": base64.b64encode(needle).decode()}


def decode_needle(value: str | dict) -> bytes:
    return value.encode() if isinstance(value, str) else base64.b64decode(value["b64"], validate=True)


def parse(lines: str) -> list[tuple[Query, dict | None]]:
    """Queries of JSON lines with their truths: blank lines go; at least one query, each id once, ops and arity valid."""
    out = []
    for line in filter(str.strip, lines.splitlines()):
        row = json.loads(line)
        out.append((Query(row["id"], row["op"], tuple(map(decode_needle, row["needles"]))), row.get("truth")))
    ids = [q.id for q, _ in out]
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("a suite needs queries, each with an id of its own")
    return out


def write(folder: str, dataset: str, checksum: str, queries: list[Query], truths: dict[str, dict] | None = None, force: bool = False) -> None:
    path = Path(folder)
    if not queries:
        raise ValueError("no queries")
    if (path / "queries.jsonl").exists() and not force:
        raise ValueError(f"{folder} has a suite already")
    path.mkdir(parents=True, exist_ok=True)
    rows = [{"id": q.id, "op": q.op, "needles": list(map(encode_needle, q.needles))} | ({"truth": truths[q.id]} if truths else {}) for q in queries]
    draft = path / "queries.jsonl.draft"
    draft.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    draft.replace(path / "queries.jsonl")
    write_json(str(path / "suite.json"), {"format_version": 1, "dataset": {"id": dataset, "checksum": checksum}, "truth_algo": ALGO if truths else None})


def read(folder: str, manifest: dict, blessed: bool = True) -> tuple[dict, list[Query], dict[str, dict]]:
    """The suite of a dataset; refuses another dataset's, a stale one's and one without truths."""
    about = json.loads(Path(folder, "suite.json").read_text())
    found = parse(Path(folder, "queries.jsonl").read_text())
    if about["dataset"] != {"id": manifest["id"], "checksum": manifest["checksum"]}:
        raise ValueError(f"suite is for {about['dataset']}, the dataset is {manifest['id']} {manifest['checksum']}")
    if blessed and (about.get("truth_algo") != ALGO or any(t is None for _, t in found)):
        raise ValueError("suite has no truths of this version; bless it")
    return about, [q for q, _ in found], {q.id: t for q, t in found if t}


def _words(matched: DataFrame, *keys: str) -> DataFrame:
    word = F.floor(F.col("row_id") / 64).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("row_id", F.lit(64)).cast("int"))
    return matched.groupBy(*keys, word.alias("word")).agg(F.bit_or(bit).alias("bits")).orderBy(*keys, "word")


class _Truth:
    """A truth from bitmap words that come in order."""

    def __init__(self, rows: int):
        self.state, self.count, self.first = root.Bitmap(rows), 0, []

    def add(self, word: int, bits: int) -> None:
        self.count += self.state.add(word, bits)
        if len(self.first) < SAMPLE:
            self.first += [word * 64 + b for b in range(64) if bits >> b & 1]

    def done(self) -> dict:
        return {"count": self.count, "hash": self.state.digest(), "algo": ALGO, "sample_indices": self.first[:SAMPLE]}


def truth(matched: DataFrame, rows: int) -> dict:
    """Count, hash and first ids of a matched set. Bitmap words are made in Spark and pass in order through the hash, which is one of their sequence."""
    found = _Truth(rows)
    for word, bits in _words(matched).toLocalIterator():
        found.add(word, bits)
    return found.done()


def _truths(rows: DataFrame, manifest: dict, queries: list[Query]) -> dict[str, dict]:
    """Truths of all queries, ``TOGETHER`` of them in one scan."""
    binary = dict(rows.dtypes)["data"] == "binary"
    out = {q.id: _Truth(manifest["num_rows"]) for q in queries}
    for at in range(0, len(queries), TOGETHER):
        part = queries[at : at + TOGETHER]
        hit = F.filter(F.array(*[F.when(matches(F.col("data"), q, binary), F.lit(k)) for k, q in enumerate(part)]), lambda k: k.isNotNull())
        for k, word, bits in _words(rows.select("row_id", F.explode(hit).alias("k")), "k").toLocalIterator():
            out[part[k].id].add(word, bits)
    return {k: t.done() for k, t in out.items()}


def bless(rows: DataFrame, manifest: dict, folder: str, force: bool = False) -> None:
    """Compute the truths; those that are there must agree, unless forced."""
    _, queries, old = read(folder, manifest, blessed=False)
    new = _truths(rows, manifest, queries)
    wrong = [k for k in old if old[k] != new[k]]
    if wrong and not force:
        raise ValueError(f"truths differ: {wrong}")
    write(folder, manifest["id"], manifest["checksum"], queries, new, force=True)


def check(rows: DataFrame, manifest: dict, folder: str) -> list[str]:
    """Ids of queries whose truth is wrong."""
    _, queries, old = read(folder, manifest)
    new = _truths(rows, manifest, queries)
    return [k for k in new if new[k] != old[k]]
