"""Preference formatting: a shared prompt once, and two masked completions. DataFrame functions only.

Turns are numbered, paired and compared as light rows (ids, positions, hashes); texts meet them at the end. A
conversation is never gathered whole into a row or a task: one that holds a third of all turns is dealt by ranges, and comes
out in segments of a bounded number of turns, of which an ordinary conversation has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramward.llm.common import materialise

#: Turns of a segment: a pair of up to so many turns is one row.
SEGMENT = 256
#: Characters of a text that help to deal rows by ranges.
PREFIX = 32

PAIR = ["kind", "chosen_id", "rejected_id"]


def render(role: Column, text: Column) -> tuple[Column, Column]:
    """The header and the body of a turn; a null role is ``user``, a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n")), F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _in_order(rows: DataFrame, dealt: list[Column], order: list[Column], name: str) -> DataFrame:
    """``rows`` written in the global order, with ``at``: ascending, and without gaps within a partition (``part``). ``order`` refines ``dealt``."""
    ranged = rows.repartitionByRange(*dealt).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialise(ranged.withColumn("part", F.shiftright("at", 33)), name)


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns numbered from 0 by (turn, role, text) in each conversation, nulls last: light rows and texts.

    The first are ``conv_id, pos, at, role, h, h2`` (128 bits of role and text), the second ``at, role, text``. Rows are
    dealt by ranges of that order, so that a position is a row's place in its partition, less that of the conversation's first row
    there, and the conversation's rows in earlier partitions.
    """
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    first = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role")]
    texts = _in_order(rows, [*first, F.substring("text", 1, PREFIX).asc()], [*first, F.asc("text")], "turns")
    light = texts.select("conv_id", "at", "part", "role", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit("turn"), "text", "role").alias("h2"))
    light = materialise(light, "light-turns")
    spans = light.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(spans.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "starts")
    placed = light.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "at", "role", "h", "h2")
    return materialise(placed, "positions"), texts.select("at", "role", "text")


def neighbours(rows: DataFrame, key: list[str]) -> DataFrame:
    """``chosen_id, rejected_id``: each conv_id of ``rows(conv_id, *key)`` and the next one with an equal key.

    Rows are dealt by ranges of (key, conv_id), so a key that a third of all conversations share, and sparse ids, make no
    large group: the next row is that of the next place, and a partition's last row meets the first of the next one. A
    conversation is chosen once and rejected once at most, so work is in proportion to turns.
    """
    order = [F.asc(k) for k in [*key, "conv_id"]]
    rows = _in_order(rows.select("conv_id", *key), order, order, "in-order")
    ends = rows.groupBy("part").agg(F.min("at").alias("low"), F.max("at").alias("high"))  # a row for each partition
    following = F.lead("low").over(Window.partitionBy(F.lit(0)).orderBy("part"))
    ends = ends.select("part", "high", following.alias("after"))
    placed = rows.join(F.broadcast(ends), "part")
    after = F.when(F.col("at") < F.col("high"), F.col("at") + 1).otherwise(F.col("after"))
    left = placed.select(F.col("conv_id").alias("chosen_id"), after.alias("at"), *[F.col(k).alias(f"{k}_") for k in key])
    met = left.join(rows.select(F.col("conv_id").alias("rejected_id"), "at", *key), "at")
    for k in key:
        met = met.where(F.col(k) == F.col(f"{k}_"))
    return met.select("chosen_id", "rejected_id")


def _side(pairs: DataFrame, turns: DataFrame, of: str, part: str) -> DataFrame:
    """The turns, as light rows, of one side of each pair; with ``last`` in pairs, up to there."""
    met = pairs.join(turns, F.col(of) == F.col("conv_id"))
    return (met.where("pos <= last") if "last" in pairs.columns else met).select(*PAIR, F.lit(part).alias("part"), "pos", "at", "h", "h2")


def first_turn_pairs(turns: DataFrame) -> DataFrame:
    """Both sides of each pair of neighbouring conversations with an equal first turn."""
    pairs = materialise(neighbours(turns.where("pos = 0"), ["h", "h2"]).select(F.lit("first_turn").alias("kind"), "chosen_id", "rejected_id"), "pairs")
    return _side(pairs, turns, "chosen_id", "chosen").union(_side(pairs, turns, "rejected_id", "rejected"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Both sides of each conversation, up to its last answer, and itself with the next one's last answer instead."""
    answers = materialise(turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("pos", "at", "h", "h2")).alias("x")), "answers")
    pairs = neighbours(answers, []).join(answers, F.col("chosen_id") == F.col("conv_id"))
    pairs = materialise(pairs.select(F.lit("swapped").alias("kind"), "chosen_id", "rejected_id", F.col("x.pos").alias("last")), "pairs")
    chosen = materialise(_side(pairs, turns, "chosen_id", "chosen"), "chosen")
    kept = chosen.join(pairs, PAIR).where("pos < last").select(*PAIR, F.lit("rejected").alias("part"), "pos", "at", "h", "h2")
    swapped = pairs.join(answers, F.col("rejected_id") == F.col("conv_id")).select(*PAIR, F.lit("rejected").alias("part"), F.col("last").alias("pos"), "x.at", "x.h", "x.h2")
    return chosen.union(kept).union(swapped)


def format_preferences(sides: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each pair and segment: the longest common turn prefix once as ``prompt``, and both completions with their masks.

    ``sides``: kind, chosen_id, rejected_id, part (chosen or rejected), pos, at, h, h2; ``texts``: at, role, text. Out come the ids,
    segment (pos // SEGMENT), prompt, chosen, rejected, and of each completion its mask: ``start:length`` of what is learned,
    in characters of that text, joined by commas. Learned are the bodies of an assistant's turns in a completion; a prompt has
    no mask. Turns are common if role and text are equal. If one conversation is a prefix of the other, its
    completion is empty.
    """
    sides = materialise(sides, "sides")
    same = (F.min("h") == F.max("h")) & (F.min("h2") == F.max("h2")) & (F.count("*") == 2)
    at = sides.groupBy(*PAIR, "pos").agg(same.alias("same"))
    common = at.groupBy(*PAIR).agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("pos"))), F.max("pos") + 1).alias("common"))
    placed = sides.join(materialise(common, "common"), PAIR).where((F.col("pos") >= F.col("common")) | (F.col("part") == "chosen"))
    part = F.when(F.col("pos") < F.col("common"), F.lit("prompt")).otherwise(F.col("part"))
    light = materialise(placed.select(*PAIR, part.alias("part"), "pos", "at"), "pieces")
    head, body = render(F.col("role"), F.col("text"))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    pieces = light.join(texts, "at").select(
        *PAIR, F.floor(F.col("pos") / SEGMENT).alias("segment"), "part", "pos", F.concat(head, body).alias("rendered"),
        F.when(learned, F.length(head)).otherwise(0).alias("start"), F.when(learned, F.length(body)).otherwise(0).alias("length"),
    )
    names = ("prompt", "chosen", "rejected")
    listed = [F.array_sort(F.collect_list(F.when(F.col("part") == n, F.struct("pos", "rendered", "start", "length")))).alias(n) for n in names]
    grouped = pieces.groupBy(*PAIR, "segment").agg(*listed)
    whole = [F.array_join(F.transform(n, lambda x: x["rendered"]), "").alias(n) for n in names]
    return grouped.select(*PAIR, "segment", *whole, *[_mask(F.col(n)).alias(f"{n}_mask") for n in names[1:]])


def _mask(pieces: Column) -> Column:
    """``start:length`` of the learned parts of the joined pieces."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(so_far: Column, piece: Column) -> Column:
        span = F.array(F.concat((so_far["at"] + piece["start"]).cast("string"), F.lit(":"), piece["length"].cast("string")))
        spans = F.when(piece["length"] > 0, F.concat(so_far["spans"], span)).otherwise(so_far["spans"])
        return F.struct((so_far["at"] + F.length(piece["rendered"])).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(pieces, zero, add)["spans"], ",")


def preferences(turns: DataFrame) -> DataFrame:
    """Preference pairs of ``turns(conv_id, turn, role, text)``, as ``format_preferences`` gives them.

    Two kinds of pairs: neighbouring conversations with an equal first turn, and each conversation
    with an answer against itself with the next one's answer (the last one has no next).
    Rows with a null conv_id belong to no conversation and give nothing; null roles are ``user``,
    null texts empty, null turns last; ties go by role and text. Repeated rows are turns each. Texts are taken whole, however
    long, and a conversation of more than ``SEGMENT`` turns comes out in several rows. An empty table gives no rows; other
    columns are ignored.
    """
    rows, texts = numbered(turns)
    return format_preferences(first_turn_pairs(rows).union(swapped_answers(rows)), texts)


#: The same in SQL.
PREFERENCES_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
f AS (
  SELECT conv_id AS chosen_id, lead(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS rejected_id FROM t WHERE pos = 0),
l AS (SELECT conv_id, max(pos) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
n AS (SELECT conv_id AS chosen_id, lead(conv_id) OVER (ORDER BY conv_id) AS rejected_id, last FROM l),
s AS (
  SELECT 'first_turn' AS kind, chosen_id, rejected_id, 'chosen' AS part, pos, role, text FROM f JOIN t ON t.conv_id = chosen_id WHERE rejected_id IS NOT NULL
  UNION ALL SELECT 'first_turn', chosen_id, rejected_id, 'rejected', pos, role, text FROM f JOIN t ON t.conv_id = rejected_id
  UNION ALL SELECT 'swapped', chosen_id, rejected_id, 'chosen', pos, role, text FROM n JOIN t ON t.conv_id = chosen_id WHERE rejected_id IS NOT NULL AND pos <= last
  UNION ALL SELECT 'swapped', chosen_id, rejected_id, 'rejected', pos, role, text FROM n JOIN t ON t.conv_id = chosen_id WHERE rejected_id IS NOT NULL AND pos < last
  UNION ALL SELECT 'swapped', chosen_id, rejected_id, 'rejected', n.last, 'assistant', t.text FROM n JOIN l ON l.conv_id = rejected_id JOIN t ON t.conv_id = rejected_id AND t.pos = l.last),
a AS (
  SELECT kind, chosen_id, rejected_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
  FROM s GROUP BY ALL),
c AS (SELECT kind, chosen_id, rejected_id, coalesce(min(CASE WHEN NOT same THEN pos END), max(pos) + 1) AS common FROM a GROUP BY ALL),
p AS (
  SELECT kind, s.chosen_id, s.rejected_id, s.pos // {SEGMENT} AS segment, CASE WHEN s.pos < common THEN 'prompt' ELSE part END AS part, s.pos,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, role = 'assistant' AND s.pos >= common AS learned,
         length(role) + 5 AS start, length(text) + 8 AS size
  FROM s JOIN c USING (kind, chosen_id, rejected_id) WHERE s.pos >= common OR part = 'chosen'),
o AS (
  SELECT *, start + coalesce(sum(length(rendered)) OVER (PARTITION BY kind, chosen_id, rejected_id, segment, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM p)
SELECT kind, chosen_id, rejected_id, segment,
       coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY pos) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(place::BIGINT || ':' || size, ',' ORDER BY pos) FILTER (WHERE part = 'chosen' AND learned), '') AS chosen_mask,
       coalesce(string_agg(place::BIGINT || ':' || size, ',' ORDER BY pos) FILTER (WHERE part = 'rejected' AND learned), '') AS rejected_mask
FROM o GROUP BY kind, chosen_id, rejected_id, segment
"""
