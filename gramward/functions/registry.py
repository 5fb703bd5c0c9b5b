"""Registries of scanners and storage schemes: operators, envelope and plan of each, and what they compose to.

An entry declines a query outside its envelope with a reason; that is ``unsupported``, never an error. Entries that need
a Python module which is not there are ``module_unavailable``. Users may add entries of their own with ``add``.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramward.functions import prefilters
from gramward.functions.predicates import OPS, Query, matches
from gramward.operators import gate, physical

SINGLE_NEEDLE = ("prefix", "suffix", "contains")
#: Longest needle, in bytes, of the bit-parallel scanner and of the token automata. Fixed values.
WORD_BYTES, AUTOMATON_BYTES = 64, 255


def _no_limit(q: Query) -> str | None:
    return None


def _longest(limit: int) -> Callable[[Query], str | None]:
    def declines(q: Query) -> str | None:
        return f"needle of more than {limit} bytes" if q.op == "contains" and len(q.needles[0]) > limit else None

    return declines


def _no_empty(q: Query) -> str | None:
    return "empty needle" if b"" in q.needles else None


@dataclass(frozen=True)
class Scanner:
    """A way to test rows: the operators it takes, what it declines, and its first check, if it has one."""

    name: str
    ops: frozenset[str]
    declines: Callable[[Query], str | None] = _no_limit
    kernel: str | None = None

    def reason(self, q: Query) -> str | None:
        """Why a query is not taken; None if it is."""
        return f"{self.name} has no {q.op}" if q.op not in self.ops else self.declines(q)

    def condition(self, column: Column, q: Query, binary: bool = False) -> Column:
        exact = matches(column, q, binary)
        if self.kernel is None or binary:
            return exact
        return prefilters.survives_any(column, q, self.kernel) & exact


Plan = Callable[[DataFrame, str, str, Query, Scanner], DataFrame]


@dataclass(frozen=True)
class Scheme:
    """A storage scheme with its strategies; ``direct`` and ``decode`` are composed with every scanner, others stand alone."""

    name: str
    strategies: dict[str, tuple[frozenset[str], Plan]]
    declines: Callable[[Query], str | None] = _no_limit
    module: str | None = None
    build: Callable[[DataFrame, str], DataFrame] | None = None

    def available(self) -> bool:
        return self.module is None or importlib.util.find_spec(self.module) is not None


@dataclass(frozen=True)
class System:
    """A scheme, a strategy of it and, for composed ones, a scanner."""

    scheme: Scheme
    strategy: str
    scanner: Scanner | None = None

    @property
    def label(self) -> str:
        return f"{self.scheme.name}/{self.strategy}" + (f"+{self.scanner.name}" if self.scanner else "")

    def reason(self, q: Query) -> str | None:
        ops, _ = self.scheme.strategies[self.strategy]
        if q.op not in ops:
            return f"{self.scheme.name}/{self.strategy} has no {q.op}"
        return self.scheme.declines(q) or (self.scanner.reason(q) if self.scanner else None)

    def run(self, rows: DataFrame, id_column: str, column: str, q: Query) -> DataFrame:
        """The matching rows; NotImplementedError, with the reason, outside the envelope."""
        why = self.reason(q)
        if why:
            raise NotImplementedError(why)
        return self.scheme.strategies[self.strategy][1](rows, id_column, column, q, self.scanner or SCANNERS["memmem"])


ALL = frozenset(OPS)
SCANNERS: dict[str, Scanner] = {}
SCHEMES: dict[str, Scheme] = {}
COMPOSED = ("direct", "decode")


def add(entry: Scanner | Scheme) -> None:
    """Register; a name is taken once."""
    where = SCANNERS if isinstance(entry, Scanner) else SCHEMES
    if entry.name in where:
        raise ValueError(f"{entry.name} is registered already")
    where[entry.name] = entry


for _scanner in (
    Scanner("memmem", ALL), Scanner("memmem-hay", frozenset(["contains"])), Scanner("std_find", ALL),
    Scanner("prefilter", frozenset(["contains", "contains_any"]), kernel="tail_code"),
    Scanner("bndm", frozenset(SINGLE_NEEDLE), _longest(WORD_BYTES)), Scanner("kmp", frozenset(SINGLE_NEEDLE)), Scanner("bmh", frozenset(SINGLE_NEEDLE)),
    Scanner("aho_corasick", frozenset(["contains", "contains_any"])), Scanner("teddy", frozenset(["contains", "contains_any"]), _no_empty),
    Scanner("libc-memmem", frozenset(SINGLE_NEEDLE)), Scanner("stringzilla", frozenset(SINGLE_NEEDLE)),
    *(Scanner(f"pf-{k.replace('_', '-')}", frozenset(["contains"]), kernel=k) for k in prefilters.KERNELS if k != "tail_code"),
):
    add(_scanner)


def _scan(rows: DataFrame, id_column: str, column: str, q: Query, scanner: Scanner) -> DataFrame:
    return rows.where(scanner.condition(F.col(column), q, dict(rows.dtypes)[column] == "binary"))


def _distinct(rows: DataFrame, id_column: str, column: str, q: Query, scanner: Scanner) -> DataFrame:
    return physical.dictionary(rows, column, q, scanner.condition)


def _grams(rows: DataFrame, id_column: str, column: str, q: Query, scanner: Scanner) -> DataFrame:
    return rows.where(physical.mandatory(F.col(column), q) & matches(F.col(column), q))


def _distinct_grams(rows: DataFrame, id_column: str, column: str, q: Query, scanner: Scanner) -> DataFrame:
    return physical.dictionary(rows, column, q, lambda c, x: physical.mandatory(c, x) & matches(c, x))


def _tokens(rows: DataFrame, id_column: str, column: str, q: Query, scanner: Scanner) -> DataFrame:
    cover = physical.token_cover(rows, id_column, column, q.needles[0].decode())
    return rows.join(cover, id_column, "left_semi").where(matches(F.col(column), q))


_ONE, _TWO, _LIKE = frozenset(["contains"]), frozenset(["contains", "contains_any"]), frozenset(OPS[:4])
_FIRST = SCANNERS["prefilter"]


def _with(plan: Plan, scanner: Scanner) -> Plan:
    return lambda rows, id_column, column, q, _: plan(rows, id_column, column, q, scanner)


for _scheme in (
    Scheme("uncompressed", {"direct": (ALL, _scan)}),
    Scheme("uncompressed_memmem", {"memmem": (ALL, _scan)}),
    Scheme("uncompressed_prefilter", {"prefilter": (_TWO, _with(_scan, _FIRST))}),
    Scheme("dict_uncompressed_prefilter", {"dict+prefilter": (_TWO, _with(_distinct, _FIRST))}),
    Scheme("dict_like", {"dict+like": (_LIKE, _distinct)}),
    Scheme("decode_prefilter", {"decode+prefilter": (_TWO, _with(_scan, _FIRST))}),
    Scheme("dict_decode_prefilter", {"dict+decode+prefilter": (_TWO, _with(_distinct, _FIRST))}),
    Scheme("gram_prefilter", {"gram-prefilter": (_TWO, _grams)}),
    Scheme("dict_gram_prefilter", {"dict+gram-prefilter": (_TWO, _distinct_grams)}),
    Scheme("dict_contains", {"dict+contains": (_ONE, _distinct)}),
    Scheme("token_automaton", {"compressed": (frozenset(["prefix", "contains", "contains_any"]), _scan), "decode": (ALL, _scan)}, _longest(AUTOMATON_BYTES)),
    Scheme("token_cover", {"cover": (_ONE, _tokens)}, _no_empty),
    Scheme("like", {"interp": (_LIKE, _scan)}),
    Scheme("like_contains", {"interp": (frozenset(["contains", "multi_contains"]), _scan)}),
    Scheme("identity", {"decode": (ALL, _scan)}, build=lambda rows, folder: physical.codec_round_trip(rows, folder, "none")),
    Scheme("lz4", {"decode": (ALL, _scan)}, build=lambda rows, folder: physical.codec_round_trip(rows, folder, "lz4_raw")),
    Scheme("zstd", {"decode": (ALL, _scan)}, build=lambda rows, folder: physical.codec_round_trip(rows, folder, "zstd", 3)),
    Scheme("gate_canary", {
        "ok": (ALL, _scan), "wrong": (ALL, lambda rows, id_column, column, q, scanner: gate.canary(rows, id_column, column, q)),
    }),
):
    add(_scheme)


def systems(names: Iterable[str] | None = None, scanners: Iterable[str] | None = None) -> list[System]:
    """What the registered schemes compose to: strategies by themselves, ``direct`` and ``decode`` with every scanner allowed."""
    out = []
    for scheme in SCHEMES.values():
        if names is None or scheme.name in names:
            for strategy in scheme.strategies:
                if strategy in COMPOSED:
                    out += [System(scheme, strategy, s) for s in SCANNERS.values() if scanners is None or s.name in scanners]
                else:
                    out.append(System(scheme, strategy))
    return out


def system(label: str) -> System:
    """By its label, as ``scheme/strategy`` or ``scheme/strategy+scanner``; a composed one without a scanner takes the first."""
    name, _, strategy = label.partition("/")
    scheme = SCHEMES.get(name)
    if scheme is None:
        raise ValueError(f"no scheme {name!r}; there are {sorted(SCHEMES)}")
    strategy = strategy or next(iter(scheme.strategies))
    if strategy in scheme.strategies:
        return System(scheme, strategy, SCANNERS["memmem"] if strategy in COMPOSED else None)
    strategy, _, scanner = strategy.rpartition("+")
    if strategy not in COMPOSED or strategy not in scheme.strategies or scanner not in SCANNERS:
        raise ValueError(f"no strategy {label!r}")
    return System(scheme, strategy, SCANNERS[scanner])


def support_rows(queries: list[Query]) -> list[tuple[str, str, bool, str | None]]:
    """(system, query id, supported, reason) of every system and query."""
    return [(s.label, q.id, s.reason(q) is None, s.reason(q)) for s in systems() for q in queries]
