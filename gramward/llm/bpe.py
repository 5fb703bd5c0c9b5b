"""Byte-level BPE: overlapping chunk encoding, exact decoding.

A text is cut into chunks that overlap, each a row of its own, so that the chunks of a long text are pre-tokenised in
parallel. Chunks are stitched at the first place in the overlap where both have a pre-token boundary (from there
on they agree, since the pattern never looks back); the pieces between are then encoded, in parallel too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.common import materialise, slices, spread

#: Characters of a chunk and of its overlap with the next one; a text of one chunk needs no stitching.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: The pattern looks at most this far beyond a match ('re, 've, 'll and one character after white space).
LOOKAHEAD = 3
_RUN = re.compile(r"\s\s")


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Codec:
    """Texts to ids, each match of the pattern separately, and back."""

    #: The only part of the public pattern that looks ahead: it keeps the last of a run of white space for what follows.
    RUNS = r"|\s+(?!\S)|\s+"

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
        self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Equal where no two white-space characters meet, and much faster without the look-ahead.
        plain = pattern.replace(self.RUNS, r"|\s+") if pattern.endswith(self.RUNS) else pattern
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        self.top = max(ranks.values(), default=0)

    def encode(self, text: str) -> list[int]:
        return (self.whole if _RUN.search(text) else self.plain).encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.whole.decode_bytes(ids)


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str) -> Codec:
    """The codec of a file of base64 tokens and ranks; no special tokens."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)


@lru_cache(maxsize=4)
def json_codec(path: str, pattern: str) -> Codec:
    """The codec of a byte-level BPE tokenizer.json, with the added tokens that its library finds in any text.

    In such a file ids follow the order of the merges, so that they serve as ranks.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    return Codec({bytes(shown[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}, pattern, added)


def meeting(chain: list[int], own: list[int], text: str, after: int) -> int | None:
    """The first boundary beyond ``after`` that both have, after a character other than white space (an end of text there changes no match before it)."""
    known = set(own)
    return next((e for e in chain if e > after and e in known and not text[e - 1].isspace()), None)


def stitched(pattern: regex.Pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """``text`` cut into pieces at pre-token boundaries, found chunk by chunk within one task.

    Where two chunks have no boundary in common, as in a long run of one class, the earlier chain goes on from its last
    boundary, over twice as much text each time, so that the work stays in proportion to the text.
    """
    stop, size = min(chunk, len(text)), len(text)
    if stop == size:
        return [text]
    cuts, chain = [0], _boundaries(pattern, text, 0, stop)
    while stop < size:
        start, following = stop - overlap, min(stop - overlap + chunk, size)
        own = _boundaries(pattern, text, start, following)
        met = meeting(chain, own, text, start)
        if met is None:
            last = chain[-1] if chain else cuts[-1]
            stop = min(size, max(following, last + 2 * (stop - last)))
            chain = _boundaries(pattern, text, last, stop) or chain[-1:]
        else:
            cuts.append(met)
            chain, stop = [e for e in own if e >= met], following
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], size], strict=True)]


def _boundaries(pattern: regex.Pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the matches in text[start:stop] that what follows ``stop`` cannot change."""
    ends = [m.end() for m in pattern.finditer(text, start, stop)]
    return [e for e in ends[:-1] if e <= stop - LOOKAHEAD]


def _stitches(long: DataFrame, pattern: str) -> DataFrame:
    """``key, cut``: where neighbouring chunks of the texts of ``long(key, text)`` meet, from 0 on; none where they have no boundary in common.

    A chunk sees the overlap with the next one, and finds the boundaries of both there. Its own are true from where it
    meets the chunk before, which is earlier.
    """
    chunks = long.select("key", F.length("text").alias("size"), "text").select(
        "key", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CHUNK_CHARS).cast("int"))).alias("k"), "text"
    )
    chunks = chunks.select("key", "k", F.substring("text", F.col("k") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS + OVERLAP_CHARS)).alias("text")).repartition("key", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(pattern)
        for batch in batches:
            keys, cuts = [], []
            for key, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) > CHUNK_CHARS:
                    chain, own = (_boundaries(words, text, start, len(text)) for start in (0, CHUNK_CHARS))
                    met = meeting(chain, own, text, CHUNK_CHARS)
                    if met is not None:
                        keys.append(key)
                        cuts.append(k * CHUNK_CHARS + met)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cuts, pa.int64())], names=["key", "cut"])

    return chunks.mapInArrow(run, "key long, cut long")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of each row of ``docs``; a null text is empty and gives no ids.

    One row out for each row in, repeated rows included; other columns are ignored; an empty table gives no rows. A text
    of one chunk is encoded where it is read. Longer ones are dealt out by chunks, stitched, and dealt out again
    by pieces; a piece without a boundary that its chunks have in common spans them all. Of a long text
    only its cuts, a number for each chunk, and its ids meet in one task.
    """
    kind, size = docs.schema[id_col].dataType, F.coalesce(F.length(text_col), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), size.alias("size"))
    few = spread(rows)

    def encoded(columns: int, names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = rank_codec(ranks_path, pattern)
            for batch in slices(batches):
                raw = [packed(codec.encode(t or "")) for t in batch.column(columns).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.ListArray.from_arrays(pa.array(offsets), flat)], names=names)

        return run

    array_of_ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    short = few.where(F.col("size") <= CHUNK_CHARS).select("id", "text").mapInArrow(encoded(1, ["id", "ids"]), T.StructType([T.StructField("id", kind), array_of_ids]))
    keyed = rows.where(F.col("size") > CHUNK_CHARS).withColumn("key", F.xxhash64("id", "text"))
    long = materialise(keyed.groupBy("key").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies")), "long-texts")
    cuts = _stitches(long, pattern).groupBy("key").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    bounds = long.join(cuts, "key", "left").withColumn("cuts", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<long>")), F.array(F.length("text").cast("long"))))
    span = F.struct(F.element_at("cuts", F.col("k") + 1).alias("a"), F.element_at("cuts", F.col("k") + 2).alias("b"))
    pieces = bounds.select("key", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)).alias("k"), "text").select("key", "k", span.alias("at"), "text")
    pieces = pieces.select("key", "k", F.substring("text", F.col("at.a") + 1, F.col("at.b") - F.col("at.a")).alias("text")).repartition("key", "k")
    done = pieces.mapInArrow(encoded(2, ["key", "k", "ids"]), T.StructType([T.StructField("key", T.LongType()), T.StructField("k", T.IntegerType()), array_of_ids]))
    whole = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = long.select("key", "id", "copies").join(whole, "key").select("id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), "copies")
    joined = joined.select("id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("id", "ids")
    return short.union(joined).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, decoded binary)``: the raw bytes of the ids, concatenated. Null ids are empty."""
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks_path, pattern)
        for batch in slices(batches):
            out = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, by encoding and then decoding its ids.

    A null text is empty: no tokens, and the digests of nothing. One row out for each row in, repeated rows and null ids
    included; whole texts, however long; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    encoded = encode_documents(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(ranks_path, pattern)
        shown = [str(i) for i in range(codec.top + 1)]
        for batch in slices(batches):
            counts, sums, back = [], [], []
            for ids in batch.column(1).to_pylist():
                counts.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)], names=schema.names)

    return encoded.mapInArrow(run, schema)
