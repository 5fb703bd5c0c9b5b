"""Sequence packing: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.bpe import json_codec, packed, stitched
from gramward.llm.common import slices, spread

END_OF_DOCUMENT = 0
#: Sequences of one partition: ids of sequences are partition * this + a running number.
SEQUENCES_PER_TASK = 1 << 32
#: Characters encoded at once.
LONG_CHARS = 1 << 18


class OpenWindows:
    """Windows by remaining capacity; a segment tree finds the tightest that holds a piece."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: tuple[int, int]) -> None:
        if room > 0:
            self.stacks[room].append(window)
            self._change(room, 1)

    def take(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """The window with the least room of at least ``need``, and its room."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        room = node - self.leaves
        self._change(room, -1)
        return room, self.stacks[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray | list[int], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows. Longest first, ties in the given order."""
    lengths = np.asarray(lengths, np.int64)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, tree = 0, OpenWindows(size)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = tree.take(need)
        if found is None:
            room, (at, used) = size, (windows, 0)
            windows += 1
        else:
            room, (at, used) = found
        window[k], offset[k] = at, used
        tree.add(room - need, (at, used + need))
    return window, offset, windows


class DocumentEncoder:
    """Texts to ids as little-endian 32-bit bytes, equal to the tokenizer library's without added special tokens."""

    def __init__(self, path: str, pattern: str):
        self.codec, self.pattern = json_codec(path, pattern), regex.compile(pattern)
        added = sorted(self.codec.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        added = self.codec.added
        if any(x in text for x in added):
            return b"".join(packed([added[x]]) if x in added else self._plain(x) for x in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """Piece by piece, so that a very long text is never a list of all its ids."""
        if len(text) <= LONG_CHARS:
            return packed(self.codec.encode(text))
        return b"".join(packed(self.codec.encode(x)) for x in stitched(self.pattern, text, LONG_CHARS))


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document is the ids of its text (null: empty) and then id 0. One beyond ``size`` tokens is
    first cut into full windows; what is left over is packed by best-fit decreasing among the
    rest of its partition, so no row leaves its task and padding is that of a few windows for
    each partition. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the piece's ids. Repeated rows are packed each; a null doc_id is kept;
    other columns are ignored; an empty table gives no rows.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType)]
    fields += [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [("ids", T.BinaryType())] * with_ids
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = DocumentEncoder(tokenizer_path, pattern)
        base = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        end = packed([END_OF_DOCUMENT])
        full, window = 0, 4 * size
        # What is left over of each document: compact columns, as the partition's tails are packed together.
        docs_of, numbers, kept_ids = [], array("q"), []

        def out(ids: pa.Array, columns: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
            arrays = [ids, *(pa.array(c) for c in columns), *[pa.array(pieces, pa.binary())] * with_ids]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in slices(batches, 512):
            place, rows, tails, pieces = [], array("q"), [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = encode(text or "") + end
                total = len(raw) // 4
                for at in range(0, len(raw), window):
                    piece = raw[at : at + window]
                    if len(piece) == window:
                        place.append(k)
                        rows.extend((at // 4, size, zlib.crc32(piece), total, base + full, 0))
                        full += 1
                        if with_ids:
                            pieces.append(piece)
                    else:
                        tails.append(k)
                        numbers.extend((at // 4, len(piece) // 4, zlib.crc32(piece), total))
                        if with_ids:
                            kept_ids.append(piece)
            docs_of.append(batch.column(0).take(pa.array(tails, pa.int64())))
            if place:
                yield out(batch.column(0).take(pa.array(place, pa.int64())), np.array(rows).reshape(-1, 6).T.copy(), pieces)
        if numbers:
            rows, whole = np.array(numbers).reshape(-1, 4), pa.chunked_array(docs_of).combine_chunks()
            windows, offsets, _ = best_fit_decreasing(rows[:, 1], size)
            for at in range(0, len(rows), 8192):
                part = slice(at, at + 8192)
                columns = np.column_stack([rows[part], base + full + windows[part], offsets[part]]).T.copy()
                yield out(whole.slice(at, 8192), columns, kept_ids[part])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``: ``sequence_id, ids binary, length``.

    A sequence holds at most ``size`` pieces, so its group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
