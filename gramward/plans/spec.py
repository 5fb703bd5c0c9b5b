"""Run specifications: a closed TOML schema, its content key, and the run matrix it spans."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gramward.functions.predicates import Query
from gramward.functions.registry import System, system, systems


@dataclass(frozen=True)
class Measurement:
    """How a query is timed: warm-up runs, and runs until both a number and a time are reached. Fixed default values."""

    warmup: int = 3
    iterations: int = 10
    least_ms: float = 200.0


@dataclass(frozen=True)
class Spec:
    name: str
    systems: tuple[str, ...]
    datasets: tuple[str, ...]
    suites: tuple[str, ...]
    scanners: tuple[str, ...] = ()
    chunk_rows: tuple[int, ...] = (0,)
    measurement: Measurement = field(default_factory=Measurement)

    def key(self) -> str:
        """16 hex digits of the content, where neither the order of lists nor the place of files counts."""
        content = asdict(self) | {
            "datasets": sorted(Path(x).name for x in self.datasets), "suites": sorted(Path(x).name for x in self.suites),
            "systems": sorted(self.systems), "scanners": sorted(self.scanners), "chunk_rows": sorted(self.chunk_rows),
        }
        return hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:16]

    def chosen(self) -> list[System]:
        """Systems named in full, or all that a scheme's name composes to with the scanners allowed."""
        out = []
        for name in self.systems:
            out += [system(name)] if "/" in name else systems([name], self.scanners or None)
        return list({s.label: s for s in out}.values())


def _strings(table: dict, name: str, what: str, required: bool = True) -> tuple[str, ...]:
    value = table.pop(name, [])
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value) or (required and not value):
        raise ValueError(f"{what}: {name} must be a list of strings" + (", one at least" if required else ""))
    return tuple(value)


def load(path: str) -> Spec:
    """A specification file. Unknown keys are refused; relative paths are taken from the file's folder; chunks are multiples of 64."""
    place = Path(path)
    table = tomllib.loads(place.read_text())
    name = table.pop("name", place.stem)
    rebased = {k: tuple(str(place.parent / x) if not Path(x).is_absolute() else x for x in _strings(table, k, path)) for k in ("datasets", "suites")}
    chosen, scanners = _strings(table, "systems", path), _strings(table, "scanners", path, required=False)
    chunks = table.pop("chunk_rows", [0])
    if not isinstance(chunks, list) or not chunks or any(not isinstance(c, int) or isinstance(c, bool) or c < 0 or c % 64 for c in chunks):
        raise ValueError(f"{path}: chunk_rows must be multiples of 64")
    timing = table.pop("measurement", {})
    extra = [*table, *(f"measurement.{k}" for k in timing if k not in Measurement.__dataclass_fields__)]
    if extra:
        raise ValueError(f"{path}: unknown keys {sorted(extra)}")
    spec = Spec(name, chosen, rebased["datasets"], rebased["suites"], scanners, tuple(chunks), Measurement(**timing))
    spec.chosen()
    return spec


def run_matrix(spark: SparkSession, spec: Spec, queries: dict[str, list[Query]]) -> DataFrame:
    """``system, dataset, chunk_rows, query_id, op, supported, reason``: all that a run of the specification tries.

    ``queries`` by dataset. The matrix is as large as the specification says, whatever the data's size.
    """
    rows = [
        (s.label, dataset, chunk, q.id, q.op, s.reason(q) is None, s.reason(q))
        for s in spec.chosen() for dataset in spec.datasets for chunk in spec.chunk_rows for q in queries[dataset]
    ]
    return spark.createDataFrame(rows, "system string, dataset string, chunk_rows int, query_id string, op string, supported boolean, reason string")
