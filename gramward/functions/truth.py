"""The trust root in plain Python: row matching, bitmaps and their hashes. No Spark."""

from __future__ import annotations

from collections.abc import Iterable

import xxhash

from gramward.functions.predicates import Query


def row_matches(q: Query, row: bytes) -> bool:
    if q.op == "prefix":
        return row.startswith(q.needles[0])
    if q.op == "suffix":
        return row.endswith(q.needles[0])
    if q.op == "multi_contains":
        at = 0
        for needle in q.needles:
            at = row.find(needle, at)
            if at < 0:
                return False
            at += len(needle)
        return True
    return any(n in row for n in q.needles)


def words(ids: Iterable[int], rows: int) -> list[int]:
    """The bitmap of row ids, least significant bit first, in 64-bit words; padding stays 0."""
    out = [0] * ((rows + 63) // 64)
    for k in ids:
        out[k // 64] |= 1 << k % 64
    return out


def bitmap_hash(ids: Iterable[int], rows: int) -> str:
    return xxhash.xxh3_64_hexdigest(b"".join(w.to_bytes(8, "little") for w in words(ids, rows)))


class Bitmap:
    """The same hash from words that come in order, without those between that are 0."""

    def __init__(self, rows: int):
        self.words, self.at, self.state = (rows + 63) // 64, 0, xxhash.xxh3_64()

    def _zeros(self, to: int) -> None:
        while self.at < to:
            some = min(to - self.at, 1 << 16)
            self.state.update(bytes(8 * some))
            self.at += some

    def add(self, word: int, bits: int) -> int:
        """Add a word, as signed or unsigned 64 bits; the number of its bits."""
        self._zeros(word)
        bits &= (1 << 64) - 1
        self.state.update(bits.to_bytes(8, "little"))
        self.at += 1
        return bits.bit_count()

    def digest(self) -> str:
        self._zeros(self.words)
        return self.state.hexdigest()


def column_checksum(rows: Iterable[bytes]) -> str:
    """Order-dependent: over the length and the bytes of each row."""
    state = xxhash.xxh3_64()
    for row in rows:
        state.update(len(row).to_bytes(8, "little"))
        state.update(row)
    return f"xxh3:{state.hexdigest()}"
