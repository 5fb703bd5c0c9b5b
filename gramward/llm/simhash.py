"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most ``t`` of
64 bits over ``m`` segments, some start on the ring has, for every chain length ``l``, at most
``floor(l * t / m)`` differing bits in its first ``l`` segments. For t = 2 and m = 5 the budgets
are 0, 0, 1, 1, 2, so a pair must share two neighbouring segments (25 or 26 bits) exactly:
that is the equi-join key, and the longer chains prune before the full Hamming check.

A similarity of 0.8 leaves one bit in five free, and no segment must be equal there. Its keys come from the ring of
the shingles themselves (see ``sketch``); what meets is held against the chains of a fingerprint of four words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramward.llm.common import components, free_names, materialise, slices, spread

SEED = 42
BITS = 64
#: Buckets beyond this are cut again by a longer chain.
HOT_BUCKET = 2048

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; the whole sequence if shorter."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    count = len(words) - width + 1
    if count < 2:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, count)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes. Zero for no hashes."""
    return int(_majority(hashes.reshape(-1, 1))[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of 64-bit words: the words whose bits are 1 if set in over half the rows."""
    bits = hashes.shape[1] * BITS
    total = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255  # counts of up to 255 fit in a byte
        total += part[:whole].reshape(-1, 255, bits).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += part[whole:].sum(0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


def wide_fold(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint in ``WORDS`` words: of the hashes, and of the hashes mixed again for each further word (splitmix64)."""
    words = [hashes]
    for k in range(1, WORDS):
        z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        words.append(z ^ (z >> np.uint64(31)))
    return _majority(np.stack(words, axis=1))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of each row; fp is the fingerprint as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fold(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[id_col, "fp"]
            )

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])
    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def _segments(count: int) -> list[int]:
    """Bit masks of ``count`` neighbouring segments of near-equal width."""
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Ring:
    """Chains of segments: from each start, their masks and the bits that may differ in the first one, two, ... of them."""

    def __init__(self, max_bits: int, segments: int):
        masks = _segments(segments)
        self.budget = [length * max_bits // segments for length in range(1, segments + 1)]
        equal = sum(1 for x in self.budget if x == 0)
        if equal == 0:
            raise ValueError("too few segments: no chain of the ring must be equal")
        starts = [[masks[(i + k) % segments] for k in range(segments)] for i in range(segments)]
        self.chains = np.array([[sum(s[: k + 1]) for k in range(segments)] for s in starts], np.uint64)
        self.keyed = [sum(s[:equal]) for s in starts]
        once = sum(1 for x in self.budget if x == 1)
        #: Keys of a chain one longer: of two segments or more with one differing bit at most, all but one are equal, so one of any two is.
        self.further = [[sum(s[:equal]) + s[equal + k] for k in range(2)] for s in starts] if once >= 2 else []

    def holds(self, start: np.ndarray, differing: np.ndarray) -> np.ndarray:
        """True where the chain from ``start`` keeps within every budget; the last of them is the check of all bits."""
        found = np.ones(len(differing), bool)
        for k, most in enumerate(self.budget):
            found[found] = np.bitwise_count(differing[found] & self.chains[start[found], k]) <= most
        return found

    def rows(self, values: np.ndarray) -> Chained:
        return Chained(values.reshape(-1, 2), self)


class Chained:
    """Rows of (ring start, fingerprint); alike are those whose chain from there holds."""

    def __init__(self, lanes: np.ndarray, ring: Ring):
        self.start, self.fp, self.ring = lanes[:, 0].astype(np.int64), lanes[:, 1], ring

    def alike(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return self.ring.holds(self.start[a], self.fp[a] ^ self.fp[b])


class WordRing:
    """Chains of whole words of a fingerprint of several; from which word a chain must start is not known beforehand."""

    def __init__(self, max_bits: int, words: int):
        self.words = words
        self.budget = [length * max_bits // words for length in range(1, words + 1)]

    def holds(self, apart: np.ndarray) -> np.ndarray:
        """Of rows of differing bits by word, those where all chains from some word keep their budgets; the last is that of all bits."""
        found = np.zeros(len(apart), bool)
        for start in range(self.words):
            rest = np.flatnonzero(~found & (apart[:, start] <= self.budget[0]))
            for k in range(1, self.words):
                chain = [(start + i) % self.words for i in range(k + 1)]
                rest = rest[apart[rest][:, chain].sum(axis=1, dtype=np.int64) <= self.budget[k]]
            found[rest] = True
        return found

    def rows(self, values: np.ndarray) -> Worded:
        return Worded(values.reshape(-1, self.words), self)


class Worded:
    """Rows of fingerprints of several words; alike are those for which a chain of the ring holds."""

    def __init__(self, fps: np.ndarray, ring: WordRing):
        self.fps, self.ring = fps, ring

    def alike(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return self.ring.holds(np.bitwise_count(self.fps[a] ^ self.fps[b]))


def links(fps: DataFrame, max_bits: int = 2, segments: int = 5) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct ``fp`` values within ``max_bits`` of another.

    Rows meet by the segments that their ring's chain must have equal. A bucket beyond ``HOT_BUCKET`` is cut by the next
    chain: where its next segments hold one differing bit together, any two of them have one that is equal, and so on
    with the key of one segment more. What meets is held against the whole chain, then all 64 bits, in blocks that give a forest.
    """
    ring = Ring(max_bits, segments)
    keys = F.array(*[
        F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("part"), F.lit(_signed(m)).cast("long").alias("mask"))
        for i, m in enumerate(ring.keyed)
    ])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("s")).select("s.ring", "s.part", "s.mask", "fp")
    rows = materialise(rows, "segments")
    sizes = materialise(rows.groupBy("ring", "mask", "part").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    met = rows.join(sizes, ["ring", "mask", "part"])
    if ring.further:
        hot = met.where(F.col("rows") > HOT_BUCKET)
        longer = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
        for i, masks in enumerate(ring.further):
            longer = longer.when(F.col("ring") == i, F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
        hot = hot.select("ring", F.explode(longer).alias("mask"), "fp").withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        hot = materialise(hot, "longer-chains")
        again = materialise(hot.groupBy("ring", "mask", "part").agg(F.count("*").alias("rows")).where("rows > 1"), "longer-buckets")
        met = met.where(F.col("rows") <= HOT_BUCKET).unionByName(hot.join(again, ["ring", "mask", "part"]), allowMissingColumns=True)
    met = met.withColumn("key", F.xxhash64("ring", "mask", "part")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
    met = met.select(F.col("fp").alias("node"), "key", "blocks", F.array(F.col("ring").cast("long"), "fp").alias("lanes"))
    return bucket_links(met, None, ring).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row of ``docs(doc_id, text)``.

    Null or empty texts have the fingerprint zero and link like any other. Repeated rows give
    repeated results. A null doc_id keeps its row, and counts as a component's id only where
    no other is there (the id is then null). No rows in, no rows out; other columns are ignored.
    Texts that share a fingerprint collapse to one node before any comparison, so a group of
    copies costs one node.
    """
    found = materialise(fingerprints(docs, width), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = materialise(components(links(nodes, max_bits)), "roots")
    placed = materialise(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "placed")
    heads = materialise(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "heads")
    named = materialise(placed.join(heads, "root").select("fp", "component_id"), "named")
    return (
        found.join(named, "fp")  # rows of 16 bytes; AQE splits a fingerprint with many copies
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


#: For similar texts: words of a fingerprint, and bits of it that may differ. At a cosine of 0.8 a bit differs in 0.25 of cases
#: at most (sets of 2 and 3 shingles; 0.205 for large ones), so that more than 104 of 256 do in 1.4e-8 of cases.
WORDS, WORD_BITS = 4, 104
#: Starts on the ring of a set's shingles, and shingles that the longest key looks beyond its start.
STARTS, AHEAD = 40, 4
#: Words of 64 bits of a set's parities.
LANES = 12
#: Rows and shingles of a block of a bucket; buckets of up to SMALL_BUCKET rows are compared many at a time.
BLOCK_ROWS, BLOCK_SHINGLES, SMALL_BUCKET = 2048, 1 << 20, 9


def sketch(text: str | None, width: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Of a text's distinct shingles: a hash of them all, their number, the fingerprint, and the ring's least shingles.

    Two sets' shingles lie on one ring, in order of their hashes. At a cosine of 0.8 or more the shingles of but one set are
    at most 9 for each 16 shared ones, so pigeonring says: from some start, every chain holds at most 9/16 as many of
    the former as of the latter. Its first two are hence shared, and neighbours in both sets: that is the key. Then comes a shared
    one, or one of but one set and two shared (see ``longer_chains``). A set of up to ``STARTS`` shingles gives every start, with
    which no pair is lost; of larger ones the least ``STARTS`` do, among which under one pair in a million has no two such neighbours.
    """
    own = np.unique(shingle_hashes(text, width))
    whole = xxhash.xxh3_64_intdigest(own.tobytes())
    # one shingle alone is like no other set
    low = own[np.arange(min(len(own), STARTS) + AHEAD) % len(own)] if len(own) > 1 else own[:0]
    return whole, len(own), wide_fold(own), low


class Shingles:
    """Sorted sets of shingles, none empty; alike are those with a cosine of 0.8 or more, exactly.

    That is 25 * shared ** 2 >= 16 * (product of the sizes). The sets' symmetric difference is then bounded, and it is
    never less than that of their parities on a few bits, so most pairs need no more than these.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        bits, parities = LANES * 64, []
        for at in range(0, len(sizes), 512):  # bounded memory
            some = sizes[at : at + 512]
            own = values[self.starts[at] : self.stops[at + len(some) - 1]] % np.uint32(bits)
            counts = np.bincount(np.repeat(np.arange(len(some)) * bits, some) + own.astype(np.int64), minlength=len(some) * bits)
            parities.append(np.packbits((counts & 1).astype(np.uint8).reshape(-1, bits), axis=1).view(np.uint64))
        self.parity = np.concatenate(parities) if parities else np.empty((0, LANES), np.uint64)

    def _set(self, at: int) -> np.ndarray:
        return self.values[self.starts[at] : self.stops[at]]

    def alike(self, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        x, y = self.sizes[a], self.sizes[b]
        apart = np.bitwise_count(self.parity[a] ^ self.parity[b]).sum(axis=-1, dtype=np.int64)
        found = (apart <= x + y - 1.6 * np.sqrt(x * y) + 1e-6) & (25 * np.minimum(x, y) >= 16 * np.maximum(x, y))
        for k in np.flatnonzero(found):
            one, other = self._set(a[k]), self._set(b if np.ndim(b) == 0 else b[k])
            if len(one) > len(other):
                one, other = other, one
            shared = int(np.count_nonzero(other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one))
            found[k] = 25 * shared * shared >= 16 * len(one) * len(other)
        return found


def forest(left: np.ndarray, right: np.ndarray, rows: Chained | Worded | Shingles) -> list[tuple[int, int]]:
    """Edges that connect what alike pairs of ``left`` x ``right`` connect.

    What is reached once is not compared again, so that a bucket of near copies costs a few passes.
    """
    edges = []
    rest = [left, right]
    while len(rest[0]) and len(rest[1]):
        root, rest[0] = rest[0][0], rest[0][1:]
        front, side = [root], 1
        while front:
            reached = []
            for at in front:
                if not len(rest[side]):
                    break
                near = rows.alike(rest[side], at)
                found = rest[side][near].tolist()
                edges += [(int(at), x) for x in found]
                reached += found
                rest[side] = rest[side][~near]
            front, side = reached, 1 - side
    return edges


def _group_links(ids: np.ndarray, rows: Chained | Worded | Shingles, group: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole groups, given in order of ``group``; ``blocks`` holds i, j and the row's own block."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat((sizes <= SMALL_BUCKET) & (blocks[starts, 0] == blocks[starts, 1]), sizes)
    a, b = [], []
    for lag in range(1, SMALL_BUCKET):
        at = np.flatnonzero(small[:-lag] & (group[lag:] == group[:-lag]))
        at = at[rows.alike(at, at + lag)]
        a.append(ids[at])
        b.append(ids[at + lag])
    for start, size in zip(starts, sizes, strict=True):
        if not small[start]:
            i, j, own = blocks[start : start + size].T
            at = np.arange(start, start + size)
            edges = np.array(forest(at[own == i], at[own == j], rows), np.int64).reshape(-1, 2)
            a.append(ids[edges[:, 0]])
            b.append(ids[edges[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def met_rows(spread: DataFrame) -> DataFrame:
    """``spread(node, key[, size])`` with the number of blocks and of rows, of rows whose key another has.

    Of keys that the very same nodes have, one stays; beyond ``HOT_BUCKET`` rows all do, since what a longer chain finds differs by its start.
    """
    sized = "size" in spread.columns
    members = F.bit_xor(F.xxhash64("node")).alias("members")
    counts = spread.groupBy("key").agg(F.count("*").alias("rows"), members, *([F.sum("size").alias("total")] if sized else []))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS)
    if sized:
        blocks = F.greatest(blocks, F.ceil(F.col("total") / BLOCK_SHINGLES))
    hot = F.when(F.col("rows") > HOT_BUCKET, F.col("key")).alias("hot")
    counts = counts.where("rows > 1").groupBy("rows", "members", blocks.cast("int").alias("blocks"), hot).agg(F.min("key").alias("key"))
    return spread.join(counts, "key").select("node", "key", *(["size"] if sized else []), "blocks", "rows")


def chain_rows(nodes: DataFrame) -> DataFrame:
    """``node, key, blocks, rows`` of ``nodes(node, low)`` that meet by the first chain of the ring, or by longer ones in hot buckets."""
    starts = f"sequence(0, size(low) - {AHEAD + 1})"
    first = f"explode(transform({starts}, i -> xxhash64(low[i], low[i + 1]))) AS key"
    met = materialise(met_rows(nodes.where("size(low) > 0").selectExpr("node", first)), "met")
    hot = met.where(F.col("rows") > HOT_BUCKET).join(nodes.select("node", "low"), "node")
    hot = materialise(hot.select("node", longer_chains(starts).alias("key")), "longer-chains")
    return met.where(F.col("rows") <= HOT_BUCKET).unionByName(met_rows(hot))


def fewest_rows(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, key`` of ``nodes(node, size)`` that the links ``near(a, b, key)`` of fingerprints leave to be held against each other.

    A connected group of them is one bucket, or its buckets by key where those are fewer rows: so near copies that share
    many keys meet once, and a long chain of loosely linked texts is not held against itself as a whole.
    """
    groups = materialise(components(near), "near-roots")
    rows = near.select("key", F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node")
    rows = materialise(rows.join(nodes.select("node", "size"), "node"), "passed")
    dealt = F.sum(F.col("count") * F.ceil(F.col("count") / BLOCK_ROWS))
    apart = rows.groupBy("root", "key").count().groupBy("root").agg(dealt.alias("apart"))
    whole = groups.groupBy("root").count().groupBy("root").agg(dealt.alias("whole"))
    how = materialise(apart.join(whole, "root").select("root", (F.col("whole") <= F.col("apart")).alias("one")), "one-bucket")
    key = F.when(F.col("one"), F.xxhash64("root")).otherwise(F.xxhash64("root", "key"))
    return rows.join(how, "root").select("node", "size", key.alias("key")).distinct()


def longer_chains(starts: str) -> F.Column:
    """Keys of the chains that may follow the one of ``key`` in ``low``.

    Three shared; or two, one of but one set, which the other does not have, and two shared: both ways to read the row.
    """
    chains = ["low[i + 2]", "low[i + 2], low[i + 3]", "low[i + 3], low[i + 4]"]
    own = f"filter({starts}, i -> xxhash64(low[i], low[i + 1]) = key)"
    return F.expr(f"explode(flatten(transform({own}, i -> array({', '.join(f'xxhash64(low[i], low[i + 1], {c})' for c in chains)}))))")


def bucket_links(spread: DataFrame, sketches: DataFrame | None, ring: Ring | WordRing | None = None) -> DataFrame:
    """Links ``(a, b, key)`` that connect all nodes with a common key that are alike.

    ``spread(node, key)``, or what ``met_rows`` makes of it, with ``sketches(node, shingles)``, which are held against each
    other exactly; or ``spread(node, key, blocks, lanes)``, where lanes are a start of ``ring`` and a fingerprint, or one of several words. A bucket is
    dealt to blocks by hash, and each pair of blocks is one bounded group, whatever the size of the bucket. Keys are
    counted first, so that only rows that meet another take their sketches along.
    """
    if sketches is not None:
        spread = (spread if "blocks" in spread.columns else met_rows(spread)).join(sketches, "node")
    carried = "lanes" if ring else "shingles"
    met = spread.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", carried)
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x, values = np.concatenate([x for x, _ in parts]), np.concatenate([v for _, v in parts])
            rows = ring.rows(values.view(np.uint64)) if ring else Shingles(values.view(np.uint32), x[:, 5])
            group = np.cumsum(np.r_[False, (x[1:, :3] != x[:-1, :3]).any(axis=1)])
            at, b = _group_links(np.arange(len(x)), rows, group, x[:, 1:4])
            a, b, key = x[at, 4], x[b, 4], x[at, 0]
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(key[keep])], names=["a", "b", "key"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, 8192):
            columns = batch.columns
            values = columns[-1].flatten().to_numpy(zero_copy_only=False)
            columns[-1] = columns[-1].value_lengths()
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
            last = np.flatnonzero((x[:, :3] != x[-1, :3]).any(axis=1))
            if len(last) or (held and (held[-1][0][-1, :3] != x[-1, :3]).any()):
                cut = int(last[-1]) + 1 if len(last) else 0
                at = int(x[:cut, 5].sum())
                yield linked([*held, (x[:cut], values[:at])])
                held = []
                x, values = x[cut:], values[at:]
            held.append((x, values))
        if held:
            yield linked(held)

    return dealt.mapInArrow(run, "a long, b long, key long")


def shingle_sets(heads: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node, shingles``: the sorted distinct shingle hashes, in their low 32 bits, of the rows ``heads(node, row_key)`` of ``docs(doc_id, text)``.

    Of two sets of a thousand shingles that share none, 32 bits make one look shared in four thousand cases.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    texts = keyed.join(heads, "row_key").dropDuplicates(["row_key"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width).astype(np.uint32)).view(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<int>")


def similar_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, row_key, node, root, head``: groups of the texts of ``docs(doc_id, text)`` with a similarity of 0.8 or more on shingles.

    The similarity is the cosine of the sets of shingles, which is what SimHash estimates. Candidates meet by the chains of
    their shingles' ring (see ``sketch``), are held against each other by the chains of their fingerprints' words, and
    what passes is linked by the whole shingle sets. Every two texts of a bucket are held against each other, in blocks that give
    a forest. Texts with equal shingles are one node; only nodes that pass with another get their sets, from the texts once more.
    ``head`` is true for the one row that stays: the least (doc_id, row_key), null ids last.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("size", T.LongType()), T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [sketch(t, width) for t in batch.column(2).to_pylist()]
            whole = pa.array(np.array([x for x, *_ in got], np.uint64).view(np.int64))
            fp, low = (pa.array([x[k].view(np.int64) for x in got], pa.list_(pa.int64())) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole, pa.array([n for _, n, *_ in got], pa.int64()), fp, low], names=schema.names)

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = materialise(spread(rows).mapInArrow(run, schema), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    nodes = found.groupBy("node").agg(F.min(order).alias("head"), *[F.first(c).alias(c) for c in ("size", "fp", "low")])
    nodes = materialise(nodes, "nodes")
    lanes = nodes.select("node", F.col("fp").alias("lanes"))
    near = bucket_links(chain_rows(nodes).join(lanes, "node"), None, WordRing(WORD_BITS, WORDS))
    met = materialise(met_rows(fewest_rows(materialise(near, "near"), nodes)), "held")
    heads = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", F.col("head.row_key").alias("row_key"))
    edges = bucket_links(met, materialise(shingle_sets(heads, docs, width), "shingles"))
    roots = materialise(components(edges).withColumnRenamed("node", "n"), "roots")
    placed = materialise(nodes.join(roots, nodes.node == roots.n, "left").select("node", F.coalesce("root", "node").alias("root"), "head"), "placed")
    heads = materialise(placed.groupBy("root").agg(F.min("head").alias("least")), "heads")
    named = materialise(placed.join(heads, "root").select("node", "root", "least"), "named")
    return found.join(named, "node").select("doc_id", "row_key", "node", "root", order.eqNullSafe(F.col("least")).alias("head"))


def keep_one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of similar texts; columns as they are, whatever their names.

    Empty and null texts are one group. Rows of one doc_id and text count once. No rows in, no rows out.
    """
    own, key = free_names(docs.columns, "own", "key")
    heads = similar_groups(docs.select("doc_id", "text"), width).where("head").select(F.col("row_key").alias(key)).distinct()
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    once = keyed.join(heads, F.col(own) == F.col(key), "left_semi").groupBy(own).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return once.select("row.*")
