"""Language identification: word-first backoff.

A word that the sample has is scored by its log frequency in each language; an unseen word
falls back to its character n-grams, the longest length that has a known one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.common import materialise, numbered_columns, slices, spread

UNDETERMINED = "und"
#: The bound of the fitted model: about so many labelled rows of each language are learned from.
SAMPLE_ROWS = 1000
GRAM_LENGTHS = (4, 3, 2, 1)
#: Evidence counts as that of at most so many words, so that the score is not 1 for every long text.
EVIDENCE = 16
CACHE = 200_000
WORD = r"\p{L}[\p{L}\p{M}]*"


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """langs in alphabetical order; tables of words (0) and of n-grams (by n): the entries, joined by line ends, and a row of log frequencies for each."""

    langs: list[str]
    tables: dict[int, tuple[str, np.ndarray]]
    ready: Scorer | None = field(default=None, repr=False)

    def scorer(self) -> Scorer:
        """One for each worker process, whose cache goes on from task to task."""
        if self.ready is None:
            self.ready = Scorer(self)
        return self.ready


def _cut(word: Column) -> Column:
    """(length, piece) of the word itself, as length 0, and of each of its n-grams."""

    def pieces(length: int) -> Column:
        marked = F.concat(F.lit("_"), word, F.lit("_")) if length > 1 else word
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - length + 1))
        found = F.transform(starts, lambda at: F.struct(F.lit(length).alias("kind"), F.substring(marked, at, F.lit(length)).alias("item")))
        return F.filter(found, lambda x: F.length(x["item"]) == length)

    return F.concat(F.array(F.struct(F.lit(0).alias("kind"), word.alias("item"))), *map(pieces, GRAM_LENGTHS))


def _tables(counts: DataFrame, langs: list[str]) -> dict[int, tuple[str, np.ndarray]]:
    """Of each kind every entry, with smoothed log frequencies in all languages. What comes is bounded by the sample."""
    found: dict[int, tuple[str, np.ndarray]] = {}
    for kind in (0, *GRAM_LENGTHS):
        frame = counts.where(F.col("kind") == kind).select("lang", "item", "n").toPandas()
        if len(frame):
            codes, items = frame["item"].factorize(sort=True)
            table = np.full((len(items), len(langs)), 0.5)
            table[codes, np.searchsorted(langs, frame["lang"].to_numpy(str))] += frame["n"].to_numpy(float)
            found[kind] = "\n".join(items), np.log(table / table.sum(0))
    return found


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows that are not held out.

    The sample is bounded: of each language about ``sample_rows`` rows, by a hash of doc_id,
    whatever the table's size. All their words and n-grams are kept, so the model is bounded by the sample and may go to every task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    within = F.lit(False)
    for lang, size in sizes.items():
        share = int(min(1.0, sample_rows / size) * 1_000_000)
        within |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share)
    sample = rows.where(within)
    words = spread(sample.select("lang", "text")).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"))).alias("item"))
    counts = words.groupBy("lang", "item").agg(F.count("*").alias("n"))
    cut = counts.select("lang", F.explode(_cut(F.col("item"))).alias("x"), "n").select("lang", "x.kind", "x.item", "n")
    counted = materialise(cut.groupBy("kind", "lang", "item").agg(F.sum("n").alias("n")), "word-counts")
    return Model(langs, _tables(counted, langs))


class Scorer:
    """Scores tokens (runs without white space) through a bounded cache of their score rows.

    The tables are one matrix; a text's new words are looked up one by one, and their rows are
    averaged in one step.
    """

    def __init__(self, model: Model):
        self.langs, self.word = model.langs, regex.compile(WORD)
        first, parts = 0, []

        def indexed(kind: int) -> dict[str, int]:
            nonlocal first
            if kind not in model.tables:
                return {}
            items, rows = model.tables[kind]
            parts.append(rows)
            first += len(rows)
            return dict(zip(items.split("\n"), range(first - len(rows), first), strict=True))

        self.words = indexed(0)
        self.grams = [(length, indexed(length)) for length in GRAM_LENGTHS]
        self.table = np.concatenate([*parts, np.zeros((1, len(model.langs)))])  # the last row: of a word with no known n-gram
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1))

    def _entries(self, word: str) -> list[int]:
        """The rows whose mean is the word's score."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        marked = f"_{word}_"
        for length, table in self.grams:
            cut = marked if length > 1 else word
            found = [k for k in [table.get(cut[i : i + length]) for i in range(len(cut) - length + 1)] if k is not None]
            if found:
                return found
        return [len(self.table) - 1]

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """Score rows of new tokens: sums over their words, and the number of words."""
        flat, sizes, owner = [], [], []
        for k, token in enumerate(tokens):
            word = token.strip(".,;:!?\"'()")
            for w in (word,) if word.isalpha() else self.word.findall(token):
                entries = self._entries(w)
                flat += entries
                sizes.append(len(entries))
                owner.append(k)
        out = np.zeros((len(tokens), len(self.langs) + 1))
        if sizes:
            starts = np.cumsum([0, *sizes[:-1]])
            means = np.add.reduceat(self.table[flat], starts) / np.array(sizes)[:, None]
            np.add.at(out[:, :-1], owner, means)
            np.add.at(out[:, -1], owner, 1)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter((text or "").lower().split())
        if len(self.at) + len(counts) > CACHE:
            self._reset()
        places = [self.at.get(t) for t in counts]
        if None in places:
            new = [t for t, k in zip(counts, places, strict=True) if k is None]
            first = len(self.at)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self._learn(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            fresh = iter(range(first, first + len(new)))
            places = [next(fresh) if k is None else k for k in places]
        total = np.array([*counts.values()], float) @ self.rows[places] if places else np.zeros(len(self.langs) + 1)
        if not total[-1] or not self.langs:
            return UNDETERMINED, 0.0
        logs = total[:-1] / total[-1] * min(total[-1], EVIDENCE)
        best = int(logs.argmax())
        return self.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def label(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more, which replace any of those names: the language and its posterior.

    A null text and one without letters are ``und`` with score 0; ties go to the first language
    in alphabetical order, as they do with a model that knows no language (then ``und``). Whole texts are read. Rows
    stay, repeated ones too; no rows in, no rows out; nothing is shuffled, but for a table of fewer partitions than cores.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in slices(batches):
            found = [scorer.predict(t) for t in batch.column(text).to_pylist()]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return spread(numbered_columns(docs)).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row. Inputs of a prediction: the text alone.

    A null doc_id keeps its row and is not learned from; a table without a label gives ``und`` for all, an empty one no rows;
    other columns are ignored.
    """
    named = label(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
