"""Necessary conditions that cheap kernels check first, as columns, and their counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramward.functions.predicates import Query, latin1, like_escape, matches, query

# How common a byte is taken to be, the larger the commoner.
LETTERS = {
    "e": 1200, "t": 900, "a": 800, "o": 750, " ": 700, "i": 700, "n": 670, "s": 630, "h": 610, "r": 600, "d": 430, "l": 400,
    "c": 280, "u": 276, "m": 241, "w": 236, "f": 223, "g": 202, "y": 197, "p": 193, "b": 149, "v": 98, "k": 77, "j": 15,
    "x": 15, "q": 10, "z": 7,
}
CLASSES = {"0123456789": 120, "/.-_:": 150, ",;'\"": 80, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 60}
OTHER = 5

KERNELS = ("tail_code", "none", "first_byte", "rare_byte", "first_last", "rare_pair")


def commonness(byte: int) -> int:
    char = chr(byte)
    return LETTERS.get(char) or next((v for k, v in CLASSES.items() if char in k), OTHER)


def rare_offsets(needle: bytes) -> tuple[int, int]:
    """Offsets of the rarest byte and of the rarest among the others; the first of equals."""
    order = sorted(range(len(needle)), key=lambda k: (commonness(needle[k]), k))
    return order[0], order[1] if len(order) > 1 else order[0]


def tail_code(needle: bytes) -> bytes:
    """The last 4 bytes, or the last 2 of a needle of 2 or 3; none of a shorter one."""
    return needle[-4:] if len(needle) >= 4 else needle[-2:] if len(needle) >= 2 else b""


def _window(text: Column, needle: bytes, offsets: tuple[int, ...]) -> Column:
    """Whether some window of the needle's length has its bytes at these offsets."""
    pattern = "".join(like_escape(chr(needle[k])) if k in offsets else "_" for k in range(len(needle)))
    return text.like(f"%{pattern}%")


def survives(column: Column, needle: bytes, kernel: str) -> Column:
    """Whether a row of a string column passes the kernel's first check for ``contains``."""
    if not needle:
        return F.when(column.isNotNull(), F.lit(True))
    if kernel == "tail_code":
        return matches(column, query("contains", tail_code(needle)))
    long_enough = F.octet_length(column) >= len(needle)
    if kernel == "none":
        return long_enough
    text = latin1(F.encode(column, "UTF-8"))
    first, second = rare_offsets(needle)
    offsets = {"first_byte": (0,), "rare_byte": (first,), "first_last": (0, len(needle) - 1), "rare_pair": (first, second)}
    if kernel not in offsets:
        raise ValueError(f"unknown kernel {kernel!r}")
    return long_enough & _window(text, needle, offsets[kernel])


def survives_any(column: Column, q: Query, kernel: str) -> Column:
    """Whether a row passes the first check for some needle."""
    return reduce(Column.__or__, [survives(column, n, kernel) for n in dict.fromkeys(q.needles)])


def pairs_tested(column: Column, q: Query, kernel: str = "tail_code") -> Column:
    """How many needles, in order, pass the first check up to the first that matches."""
    counted, found = F.lit(0), F.lit(False)
    for needle in q.needles:
        counted = counted + F.when(~found & survives(column, needle, kernel), 1).otherwise(0)
        found = found | matches(column, query("contains", needle))
    return counted


def attribution(rows: DataFrame, column: str, needle: bytes, kernel: str) -> DataFrame:
    """One row: rows, survivors, matches, prune_rate and fp_rate of a kernel, in one scan."""
    if not isinstance(needle, bytes) or kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} and a needle of bytes are needed; there are {KERNELS}")
    col = F.col(column)
    counted = rows.agg(
        F.count(col).alias("n_rows"), F.count_if(survives(col, needle, kernel)).alias("survivors"),
        F.count_if(matches(col, query("contains", needle))).alias("matches"),
    )
    return counted.select(
        F.lit(kernel).alias("kernel"), "*", (1 - F.col("survivors") / F.col("n_rows")).alias("prune_rate"),
        F.when(F.col("survivors") > 0, (F.col("survivors") - F.col("matches")) / F.col("survivors")).alias("fp_rate"),
    )
