"""Substring dedup over sliding sentence spans.

A text is cut into sentences. Every run of ``RUN`` consecutive sentences is hashed (a text of fewer, but two at least, is one
run) and the runs meet globally; every run but the first is a repeat, and the sentences it covers go.

A sentence ends at a line's end, or at a sentence mark followed by white space whose two words before end in none, so
that initials, numbers and words with a mark each make no sentences of a word or two. A stretch of more than ``LONG`` words
without such an end has no sentences: it is cut where its own words say so, so that copies are cut alike whatever stands around them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.common import free_names, numbered_columns, slices, spread

#: Sentences of a run; words beyond which a stretch is cut by content.
RUN, LONG = 3, 30
#: Of so many places in a row between the words of a long stretch, one at least is a cut.
CUT_WINDOW = 8
#: Characters in which the words before a mark are looked for.
LOOK_BACK = 200
#: Runs that a task remembers, about.
MET_RUNS = 200_000
_MARKS, _WIDE_MARKS = ".!?", "\u3002\uff01\uff0e\uff1f\uff61"
#: Scripts without spaces (Thai to Khmer, kana, ideographs): each character counts as a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_ALONE}]")
_END, _WIDE_END, _WORD = re.compile(r"[.!?]\s+(?=\S)"), re.compile(f"[{_WIDE_MARKS}]\\s*(?=\\S)"), re.compile(r"\S+")
_ANY_WORD = re.compile(f"[{_ALONE}][{_WIDE_MARKS}]*|[^\\s{_ALONE}]+")


def _cuts(words: list[str]) -> list[int]:
    """Words before which a long stretch is cut: where the hash of a word and the one before is least of ``CUT_WINDOW`` in a row.

    This depends on the words of the window only, so that copies are cut alike but for the window at each edge.
    """
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:], strict=False)]
    waiting, found = deque(), []
    for k, x in enumerate(hashes):
        while waiting and hashes[waiting[-1]] >= x:
            waiting.pop()
        waiting.append(k)
        if waiting[0] <= k - CUT_WINDOW:
            waiting.popleft()
        if k >= CUT_WINDOW - 1 and (not found or found[-1] != waiting[0] + 1):
            found.append(waiting[0] + 1)
    return found


def _starts(line: str) -> list[int]:
    """Where the sentences of a line of words between spaces begin. What is before a mark is read back ``LOOK_BACK`` characters at most."""
    found = [len(line) - len(line.lstrip())]
    for m in _END.finditer(line):
        before = line[max(0, m.start() - LOOK_BACK) : m.start() + 1].split()
        if len(before) >= 3 and before[-2][-1] not in _MARKS and before[-3][-1] not in _MARKS:
            found.append(m.end())
    return found


def _pieces(text: str) -> tuple[list[int], list[str]]:
    """Where each sentence begins, and its words joined by one space; the text before a start belongs to the sentence before."""
    starts, plain = [], []
    unspaced = not text.isascii() and _UNSPACED.search(text) is not None
    word, at = _ANY_WORD if unspaced else _WORD, 0
    for line in text.split("\n"):
        if line and not line.isspace():
            own_starts = [*_starts(line), *(m.end() for m in _WIDE_END.finditer(line))] if unspaced else _starts(line)
            if unspaced:
                own_starts = sorted(set(own_starts))
            for a, b in zip(own_starts, [*own_starts[1:], len(line)], strict=True):
                own = word.findall(line, a, b) if unspaced else line[a:b].split()
                if len(own) <= LONG:
                    starts.append(at + a)
                    plain.append(" ".join(own))
                    continue
                places = [m.start() for m in word.finditer(line, a, b)]
                cuts = [0, *_cuts(own), len(own)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    starts.append(at + places[x])
                    plain.append(" ".join(own[x:y]))
        at += len(line) + 1
    return starts, plain


def parts(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, with the white space around it; together the whole text."""
    starts = _pieces(text)[0]
    return list(zip([0, *starts[1:]], [*starts[1:], len(text)], strict=True)) if starts else []


def runs(text: str) -> list[int]:
    """The hash, as signed 64 bits, of each run: that of sentences k to k + RUN - 1 is number k."""
    return _runs(_pieces(text)[1])


def _runs(plain: list[str]) -> list[int]:
    size = RUN if len(plain) >= RUN else len(plain)
    if size < 2:
        return []
    out = []
    for k in range(len(plain) - size + 1):
        x = xxhash.xxh3_64_intdigest("\n".join(plain[k : k + size]).encode("utf-8", "surrogatepass"))
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _row_key() -> list:
    return [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row_key")]


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, firsts``: the first sentences of the runs of a row that occur before, in (doc_id, place) order.

    Each task combines its own rows first: of runs it has met in an earlier place only that one meets
    the others, so that a run in a third of all rows is a few rows for each task. What it remembers is bounded by ``MET_RUNS``.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("row_key", T.LongType()), T.StructField("hash", T.LongType()),
        T.StructField("first", T.IntegerType()), T.StructField("sure", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, tuple] = {}  # the earliest place of a run so far
        for batch in slices(batches, 1024):
            ids, keys, texts = (c.to_pylist() for c in batch.columns)
            order = sorted((i is None, i or 0, key, k) for k, (i, key) in enumerate(zip(ids, keys, strict=True)))
            rows, hashes, firsts, sure, last = [], [], [], [], None
            for *document, k in order:
                if document == last:  # a repeated row
                    continue
                last = document
                for i, x in enumerate(runs(texts[k] or "")):
                    place, before = (*document, i), met.get(x)
                    if before == place:  # a repeated row of another batch
                        continue
                    rows.append(k)
                    hashes.append(x)
                    firsts.append(i)
                    sure.append(before is not None and before < place)
                    if before is None or place < before:
                        met[x] = place
            taken = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(hashes, pa.int64()), pa.array(firsts, pa.int32()), pa.array(sure, pa.bool_())],
                names=schema.names,
            )
            if len(met) > MET_RUNS:
                met = {}

    found = spread(docs.select(*_row_key(), "text")).mapInArrow(run, schema)
    # What is sure needs no meeting: it is spread by its row.
    met = Window.partitionBy("hash", F.when(F.col("sure"), F.xxhash64("row_key", "first"))).orderBy(
        F.asc_nulls_last("doc_id"), "row_key", "first"
    )
    other = (F.col("doc_id").eqNullSafe(F.col("head.doc_id"))) & (F.col("row_key") == F.col("head.row_key")) & (F.col("first") == F.col("head.first"))
    ranked = found.withColumn("head", F.first(F.struct("doc_id", "row_key", "first")).over(met))
    return ranked.where(F.col("sure") | ~other).groupBy("doc_id", "row_key").agg(F.collect_set("first").alias("firsts"))


def remove(text: str, firsts: set[int]) -> tuple[str, int, int]:
    """The text without the sentences of the runs that begin at ``firsts``; sentences removed, and sentences."""
    starts, plain = _pieces(text)
    size, gone = min(RUN, len(plain)), set()
    for k in firsts:
        gone.update(range(k, k + size))
    if not gone:
        return text, 0, len(plain)
    spans = zip([0, *starts[1:]], [*starts[1:], len(text)], strict=True)
    return "".join(text[a:b] for k, (a, b) in enumerate(spans) if k not in gone).rstrip(), len(gone), len(plain)


def drop_repeats(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``; n_chars, where there is one, follows the text.

    The first place of a span, by (doc_id, place in the text), stays; a null doc_id comes last.
    Rows of one doc_id and text are one document and are treated alike. A null text stays null, one that is all
    repeats becomes empty; no row goes; no rows in, no rows out. Texts are read whole. Other columns pass, whatever their
    names. With ``counts`` two more columns, which replace any of those names: n_removed and n_parts, of sentences.
    """
    if counts:
        docs = docs.drop("n_removed", "n_parts")
    own, key, gone_at = free_names(docs.columns, "own", "key", "firsts")
    found = repeats(docs.select("doc_id", "text")).select(F.col("row_key").alias(key), F.col("firsts").alias(gone_at))
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    joined = keyed.join(found, F.col(own) == F.col(key), "left").drop(own, key)
    extra = [T.StructField("n_removed", T.LongType()), T.StructField("n_parts", T.LongType())] if counts else []
    schema = T.StructType([*docs.schema.fields, *extra])
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, gone, total = batch.column(at).to_pylist(), [], []
            for k, firsts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if texts[k] is not None and firsts:
                    texts[k], removed, whole = remove(texts[k], set(firsts))
                else:
                    removed, whole = 0, len(parts(texts[k] or "")) if counts else 0
                gone.append(removed)
                total.append(whole)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], columns[length].type)
            if counts:
                columns += [pa.array(gone, pa.int64()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return numbered_columns(joined).mapInArrow(run, schema)
