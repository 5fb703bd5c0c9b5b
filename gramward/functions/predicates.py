"""The five substring predicates as native columns, exact in bytes.

Needles are bytes. On a string column they must be UTF-8; on a binary column any bytes go.
Nothing here is a UDF: Catalyst sees plain StartsWith, EndsWith, Contains and StringLocate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("prefix", "suffix", "contains", "multi_contains", "contains_any")
SINGLE = frozenset(OPS[:3])


@dataclass(frozen=True)
class Query:
    """An operator with its ordered needles; validated on creation."""

    id: str
    op: str
    needles: tuple[bytes, ...]

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"{self.id}: unknown op {self.op!r}")
        if self.op in SINGLE and len(self.needles) != 1:
            raise ValueError(f"{self.id}: {self.op} takes 1 needle, got {len(self.needles)}")
        if not self.needles:
            raise ValueError(f"{self.id}: {self.op} takes at least 1 needle")


def query(op: str, *needles: str | bytes, id: str = "") -> Query:
    return Query(id or op, op, tuple(n.encode() if isinstance(n, str) else bytes(n) for n in needles))


def like_escape(text: str) -> str:
    """``text`` as a literal within a LIKE pattern with escape character backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def _literal(needle: bytes, binary: bool) -> Column:
    return F.lit(bytearray(needle)) if binary else F.lit(needle.decode())


def latin1(column: Column) -> Column:
    """Bytes as characters, one for one, so that character functions are exact on bytes."""
    return F.decode(column, "ISO-8859-1")


def ordered(text: Column, needles: list[str]) -> Column:
    """Whether the needles occur in order, none over another: each is looked for from where the leftmost place of the one before ends.

    A LIKE pattern of them says the same, but runs as a regular expression that tries every place of the first with every
    one of the second, and so on: of the square or cube of a long text's length where the last is missing.
    """
    out, at = None, F.lit(1)
    for needle in needles:
        place = F.call_function("locate", F.lit(needle), text, at)
        out = place > 0 if out is None else out & (place > 0)
        at = place + len(needle)
    return F.when(text.isNotNull(), out)  # an unknown start alone would say no


def matches(column: Column, q: Query, binary: bool = False) -> Column:
    """Whether a row matches; NULL for a NULL row.

    Empty needles match every row, so they are folded here (Catalyst does not). An ordered
    match of several needles (see ``ordered``) also states its longest needle as ``contains``, which
    ends the search early.
    """
    everything = F.when(column.isNotNull(), F.lit(True))
    if q.op == "prefix":
        return F.startswith(column, _literal(q.needles[0], binary)) if q.needles[0] else everything
    if q.op == "suffix":
        return F.endswith(column, _literal(q.needles[0], binary)) if q.needles[0] else everything
    if q.op == "contains_any":
        if b"" in q.needles:
            return everything
        return reduce(Column.__or__, [F.contains(column, _literal(n, binary)) for n in dict.fromkeys(q.needles)])
    needles = [n for n in q.needles if n]
    if not needles:
        return everything
    longest = F.contains(column, _literal(max(needles, key=len), binary))
    if len(needles) == 1:
        return longest
    text, decoding = (latin1(column), "latin-1") if binary else (column, "utf-8")
    return longest & ordered(text, [n.decode(decoding) for n in needles])
