import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gramward.llm import bpe, langid, packing, simhash, substring

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, head long, hash string, fp string, n_removed string, row_key string"
ALPHABET = "ab  \n\t'rse1é.,!  日x́"


def words(draw, n):
    return " ".join("".join(draw.choice("aeioutnshr") for _ in range(draw.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    base = [words(draw, 300) + "." for _ in range(6)]
    texts = [None, "", " ", "a", *base, base[0], base[1].replace(" ", "  "), base[2][:-30] + "zzz", "x" * 30_000, "Hi. " * 400, words(draw, 20_000), "\U0001f600 é", base[0]]
    rows = [(k, t, "en" if k % 2 else None, None, None if t is None else len(t), "?", 7, "h", "f", "r", "k") for k, t in enumerate(texts)]
    rows += [rows[4], (None, base[3], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def codec():
    return bpe.rank_codec(RANKS, P.PATTERN).whole


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=200), st.integers(12, 40), st.integers(4, 10))
def test_stitching_gives_the_same_pretokens(text, chunk, overlap):
    pattern = regex.compile(P.PATTERN)
    pieces = bpe.stitched(pattern, text, chunk, overlap)
    assert "".join(pieces) == text and [w for x in pieces for w in pattern.findall(x)] == pattern.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_encoder_equals_the_library(text):
    ids = np.frombuffer(packing.DocumentEncoder(JSON, P.PATTERN)(text), "<u4").tolist()
    assert ids == codec().encode_ordinary(text)
    assert bpe.rank_codec(RANKS, P.PATTERN).encode(text) == codec().encode_ordinary(text)


def test_encoder_equals_the_library_on_long_texts():
    library, own, draw = Tokenizer.from_file(JSON), packing.DocumentEncoder(JSON, P.PATTERN), random.Random(8)
    for _ in range(200):
        text = "".join(draw.choice([*ALPHABET, "<|endoftext|>", " word"]) for _ in range(200))
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_runs_take_time_in_proportion():
    """A text of one class has no boundary at all; ten million characters of it are cut and encoded in seconds."""
    pattern = regex.compile(P.PATTERN)
    for text in ("a" * 10_000_000, "ab " * 10 + "x" * 5_000_000 + " cd" * 20_000):
        began = time.perf_counter()
        pieces = bpe.stitched(pattern, text)
        assert time.perf_counter() - began < 5 and "".join(pieces) == text
        assert sum(len(pattern.findall(x)) for x in pieces) == len(pattern.findall(text))


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (200, 30)])
def test_chunks_of_long_texts_are_rows(spark, monkeypatch, chunk, overlap):
    """Texts of many chunks, some without a common boundary, repeated rows, null ids: ids as the library gives them."""
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(bpe, "OVERLAP_CHARS", overlap)
    draw = random.Random(13)
    rows = [(k, "".join(draw.choice(ALPHABET + "ab" * 8) for _ in range(draw.randint(0, 900)))) for k in range(120)]
    rows += [(200, "a" * 700), (201, " " * 700), (202, "x" * 300 + " y" * 300), rows[7], (None, rows[8][1]), (None, None)]
    found = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), RANKS, P.PATTERN).collect()
    by_id = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in found)
    assert by_id == sorted((k is None, k or 0, codec().encode_ordinary(t or "")) for k, t in rows)


def test_bpe_digests(docs, empty):
    found = bpe.encoding_digests(docs, RANKS, P.PATTERN).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(found) == docs.count()
    for r in found:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            ids = codec().encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoding_digests(empty, RANKS, P.PATTERN).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in back if r.doc_id is not None)


def test_best_fit_decreasing():
    draw = random.Random(4)
    lengths = [draw.randint(1, 100) for _ in range(500)]
    window, offset, windows = packing.best_fit_decreasing(lengths, 100)
    used, rooms = {}, []
    for k in sorted(range(500), key=lambda k: -lengths[k]):  # the same, by looking at every window
        fits = [w for w, room in enumerate(rooms) if room >= lengths[k]]
        if fits:
            best = min(rooms[w] for w in fits)
            assert rooms[window[k]] == best
        else:
            rooms.append(100)
        rooms[window[k]] -= lengths[k]
        assert offset[k] == used.get(window[k], 0)
        used[window[k]] = offset[k] + lengths[k]
    assert windows == len(rooms) and packing.best_fit_decreasing([], 8)[2] == 0


def test_packing(docs, empty):
    pieces = packing.pack_documents(docs, JSON, P.PATTERN, 256, with_ids=True)
    rows = pieces.collect()
    library = Tokenizer.from_file(JSON)
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for text in docs.where("doc_id != 4 and doc_id is not null").collect():
        ids = [*library.encode(text.text or "", add_special_tokens=False).ids, 0]
        own = sorted(by[text.doc_id], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == struct.pack(f"<{len(ids)}I", *ids) and {r.doc_tokens for r in own} == {len(ids)}
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    whole = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(empty, JSON, P.PATTERN).count() == 0


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_groups(docs, empty):
    found = simhash.simhash_groups(docs).collect()
    assert len(found) == docs.count()
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).sort("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    own = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in found}
    for k, r in enumerate(rows):
        assert got[r.doc_id].fingerprint == f"{fps[k]:016x}" and got[r.doc_id].component_id == rows[own[k]].doc_id
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize(("hot", "block"), [(2048, 2048), (1, 2048), (1, 3)])
@pytest.mark.parametrize("ring", [(2, 5), (3, 7), (1, 2)])
def test_links_connect_as_brute_force(spark, hot, block, ring, monkeypatch):
    """With and without the longer chains of hot buckets, in one block and in many; chains of drifting fingerprints."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    draw, fps = random.Random(6), []
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(12):
            fps.append(centre)
            centre ^= 1 << draw.randrange(64) if draw.random() < 0.7 else (1 << draw.randrange(64) | 1 << draw.randrange(64) | 1 << draw.randrange(64))
    signed = np.unique(np.array(fps, np.uint64).view(np.int64)).tolist()
    unsigned = np.array(signed, np.int64).view(np.uint64).tolist()
    at = {x: k for k, x in enumerate(signed)}
    found = [(at[r.a], at[r.b]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), *ring).collect()]
    assert all((unsigned[a] ^ unsigned[b]).bit_count() <= ring[0] for a, b in found)
    exact = [(a, b) for a in range(len(signed)) for b in range(a) if (unsigned[a] ^ unsigned[b]).bit_count() <= ring[0]]
    assert len(exact) > 30 and roots(len(signed), found) == roots(len(signed), exact)


def test_every_pair_within_the_budget_has_a_chain():
    """The principle itself: for each pair some start keeps all budgets, and no start does beyond the last one."""
    draw, ring = random.Random(8), simhash.Ring(2, 5)
    for bits in (0, 1, 2, 3, 4):
        differing = np.array([sum(1 << b for b in draw.sample(range(64), bits)) for _ in range(200)], np.uint64)
        holds = np.array([ring.holds(np.full(200, start), differing) for start in range(5)])
        assert holds.any(axis=0).all() if bits <= 2 else not holds.any()


def test_near_copies_go_and_clean_documents_stay(spark):
    draw = random.Random(9)
    rows = []
    for k in range(40):
        text = words(draw, 200).split()
        rows.append((10 * k, " ".join(text)))
        for c in range(1, 4):
            copy = list(text)
            for _ in range(c):
                copy[draw.randrange(200)] = "changed"
            rows.append((10 * k + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one_of_each(docs.union(docs.limit(5)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [10 * k for k in range(40)]


def test_groups_are_those_of_exact_similarity(spark):
    """Pairs around 0.8 of any length are linked just if their shingle sets are that alike, and not by an estimate."""
    draw = random.Random(21)
    rows = []
    for k in range(400):
        text = [f"t{k}w{i}" for i in range(draw.choice([8, 8, 13, 30, 60, 120, 400]))]
        other = list(text)
        if len(text) < 14:
            other += [f"t{k}more{i}" for i in range(1 if len(text) == 8 else draw.choice([2, 3]))]
        else:
            for _ in range(max(1, round(len(text) * draw.uniform(0.01, 0.09)))):
                other[draw.randrange(len(text))] = f"t{k}x{draw.randrange(10**6)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]

    def shingles(text):
        found = text.split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}

    expected = set()
    for (_, one), (b, other) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(one), shingles(other)
        if len(x & y) ** 2 * 25 < 16 * len(x) * len(y):
            expected.add(b)
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 100 < len(expected) < 300 and kept == expected | set(range(0, 800, 2))


@pytest.mark.parametrize(("rows", "shingles"), [(3, 1 << 20), (2048, 64), (2048, 1 << 20)])
def test_shingle_links_connect_as_brute_force(spark, rows, shingles, monkeypatch):
    """A drifting chain, in one bucket and in many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
    draw = random.Random(22)
    sets, own = [], {draw.getrandbits(31) for _ in range(18)}
    for _ in range(60):
        sets.append(sorted(own))
        for gone in draw.sample(sorted(own), draw.choice([1, 1, 2, 3])):
            own.remove(gone)
            own.add(draw.getrandbits(31))
    spread = spark.createDataFrame([(k, len(x), key) for k, x in enumerate(sets) for key in ([1] if k % 3 else [1, 2])], "node long, size long, key long")
    found = [(r.a, r.b) for r in simhash.bucket_links(spread, spark.createDataFrame(list(enumerate(sets)), "node long, shingles array<int>")).collect()]
    alike = lambda a, b: 25 * len({*sets[a]} & {*sets[b]}) ** 2 >= 16 * len(sets[a]) * len(sets[b])
    near = [(a, b) for a in range(60) for b in range(a) if alike(a, b)]
    assert all(alike(a, b) for a, b in found) and 20 < len(near) < 200 and roots(60, found) == roots(60, near)


def test_links_by_similarity_band_and_length(spark):
    """Every pair at 0.8 or more is found at any length, and none below is linked; the README quotes it."""
    draw, rows, bands = random.Random(31), [], {}
    for length in (10, 30, 100, 300, 1000):
        for k in range(120):
            text = [f"{length}t{k}w{i}" for i in range(length)]
            other = list(text)
            for _ in range(draw.choice([0, 1, 1, 2, 3]) if length <= 30 else max(1, round(length * draw.uniform(0.005, 0.09)))):
                other[draw.randrange(length)] = f"x{draw.randrange(10**9)}"
            x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, other))
            bands[len(rows)] = length, len(x & y) / (len(x) * len(y)) ** 0.5
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for length in (10, 30, 100, 300, 1000):
        high = [k for k, (n, x) in bands.items() if n == length and x >= 0.8 - 1e-12]
        low = [k for k, (n, x) in bands.items() if n == length and x < 0.8 - 1e-12]
        assert len(high) > 15 and len(low) > 15
        assert not [k for k in high if k + 1 in kept] and all(k + 1 in kept for k in low)


def test_every_pair_of_words_within_the_bits_has_a_chain():
    draw, ring = random.Random(41), simhash.WordRing(simhash.WORD_BITS, simhash.WORDS)
    for bits in (0, 26, 90, 103, 104, 105, 150, 256):
        apart = [[sum(64 * w <= b < 64 * w + 64 for b in own) for w in range(4)] for own in (draw.sample(range(256), bits) for _ in range(300))]
        assert (ring.holds(np.array(apart, np.uint8)) == (bits <= 104)).all()


@pytest.mark.parametrize("hot", [2048, 1])
def test_sets_of_a_cosine_of_08_meet_by_the_ring(spark, hot, monkeypatch):
    """Every pair of sets of up to 40 shingles, by the first chain and by the longer ones of hot buckets."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    draw, sets = random.Random(42), []
    while len(sets) < 4000:
        one = {draw.getrandbits(63) for _ in range(draw.randint(2, 40))}
        other = {x for x in one if draw.random() < draw.choice([1, 0.8])} | {draw.getrandbits(63) for _ in range(draw.randint(0, 1 + len(one) // 2))}
        if one != other and 1 < len(other) <= 40 and 0.64 * len(one) * len(other) <= len(one & other) ** 2 < 0.72 * len(one) * len(other):
            sets += [one, other]
    rows = [(k, len(x), [*sorted(x), *(sorted(x) * 4)[:4]]) for k, x in enumerate(sets)]
    met = {}
    for r in simhash.chain_rows(spark.createDataFrame(rows, "node long, size long, low array<long>")).collect():
        met.setdefault(r.key, set()).add(r.node)
    pairs = {k // 2 for own in met.values() for k in own if k ^ 1 in own}
    assert pairs == set(range(2000))


def test_no_pair_near_the_limit_is_lost(spark):
    """Thousands of pairs of a cosine little over 0.8, of sets beyond the ring's starts: a text, and the text with more behind it."""
    draw, rows = random.Random(43), []
    while len(rows) < 8000:
        text = [f"{len(rows)}w{i}" for i in range(draw.randint(80, 200))]
        other = text + [f"{len(rows)}more{i}" for i in range(int((len(text) - 4) / 0.64) - (len(text) - 4) - draw.randint(0, 1))]
        assert 0.8 <= ((len(text) - 4) / (len(other) - 4)) ** 0.5 < 0.82
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 8000, 2))


def test_near_copies_pass_by_their_fingerprints(spark, monkeypatch):
    """The bits of SimHash decide which sets are held against each other: where none may differ, near copies do not meet."""
    text = words(random.Random(44), 200)
    near = spark.createDataFrame([(1, text), (2, text + " more"), (3, text.upper())], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one_of_each(near).collect()] == [1]
    monkeypatch.setattr(simhash, "WORD_BITS", 0)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(near).collect()) == [1, 2]


def test_near_copies_of_many_keys_are_held_once(spark, monkeypatch):
    """A group that meets under many keys is one bucket; a chain of loose links keeps its smaller buckets."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 256)
    dense = [(a, b, key) for key in range(40) for a in range(8) for b in range(a)]
    chain = [(100 + k, 101 + k, 1000 + k) for k in range(600)]
    near = spark.createDataFrame(dense + chain, "a long, b long, key long")
    nodes = spark.createDataFrame([(k, 9) for k in [*range(8), *range(100, 701)]], "node long, size long")
    met = {}
    for r in simhash.fewest_rows(near, nodes).collect():
        met.setdefault(r.key, []).append(r.node)
    assert sorted(map(sorted, met.values())) == [list(range(8)), *[[100 + k, 101 + k] for k in range(600)]]


def test_names_of_other_columns_do_not_matter(spark):
    names = ["_own", "own", "_id", "id", "_key", "key", "_firsts", "firsts", "row", "row_key", "head", "_lang_pred", "a.b"]
    text = "One two three four. Five six seven eight. Nine ten eleven twelve. "
    rows = [(k, text * 2, *[f"{n}{k}" for n in names]) for k in range(3)]
    other = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one_of_each(other).collect()
    assert [tuple(r) for r in kept] == rows[:1]
    cut = sorted(substring.drop_repeats(other).collect())
    assert [tuple(r)[2:] for r in cut] == [r[2:] for r in rows] and [bool(r.text) for r in cut] == [True, False, False]


def test_keep_one_edge_cases(docs, empty):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 1
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id in (10, 17) or doc_id is null").count() == 0
    assert simhash.keep_one_of_each(empty).count() == 0


def plain_sentences(text):
    """The sentences of a text of short ones, each with what follows it, by looking at words one by one."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        words, own = re.findall(r"\s*\S+\s*?(?=\S|\s*$)|\s+$", line), ""
        bare = [w.strip() for w in words]
        for k, w in enumerate(words):
            own += w
            marks = [x[-1:] in ("." , "!", "?") for x in bare[max(0, k - 2) : k + 1]]
            if marks == [False, False, True]:
                out.append(own)
                own = ""
        if own.strip():
            out.append(own)
        elif own and out:
            out[-1] += own
    return out


def brute_dedup(rows, size=3):
    """What is left of ``rows(id, text)``, in order, by comparing every run of ``size`` sentences with all earlier ones."""
    seen, left = [], {}
    for doc, text in rows:
        own = plain_sentences(text)
        bare = [" ".join(x.split()) for x in own]
        n = min(size, len(own))
        gone = set()
        for i in range(len(own) - n + 1 if n > 1 else 0):
            if bare[i : i + n] in seen:
                gone |= set(range(i, i + n))
            seen.append(bare[i : i + n])
        left[doc] = [x for k, x in enumerate(bare) if k not in gone]
    return left


@pytest.mark.parametrize("met", [200_000, 20])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, met):
    """No code in common but the fixture: repeated runs at any place, within a text too, short ones and marks in a row; rows in any order and repeated."""
    monkeypatch.setattr(substring, "MET_RUNS", met)
    draw = random.Random(17)
    pool = [words(draw, draw.randint(1, 6)).capitalize() + draw.choice([".", "!", "?", ".", ","]) for _ in range(9)]
    rows = [(k, draw.choice([" ", "\n", "  "]).join(draw.choice(pool) for _ in range(draw.randint(0, 9)))) for k in range(300)]
    rows = [(k, t) for k, t in rows if all(len(x.split()) <= substring.LONG for x in plain_sentences(t))]
    rows += [(400, "I agree with you. Thanks a lot."), (401, "I agree with you. Thanks a lot."), (402, "Alone here."), (403, "Alone here.")]
    long = " ".join(f"w{k}" for k in range(25)) + "."
    rows += [(410, f"This is mine only. {long} And that was it."), (411, f"That is yours then. {long} So it was over.")]
    mixed = rows + rows[::7]
    draw.shuffle(mixed)
    got = substring.drop_repeats(spark.createDataFrame(mixed, "doc_id long, text string").repartition(2)).collect()
    found = {r.doc_id: r.text for r in got}
    assert len(got) == len(mixed) and all(found[r.doc_id] == r.text for r in got)
    left = brute_dedup(rows)
    assert sum(" ".join(t.split()) != " ".join(left[k]) for k, t in rows) > 20
    assert {k: " ".join(t.split()) for k, t in found.items()} == {k: " ".join(x) for k, x in left.items()}
    assert found[401] == "" and found[403] == "Alone here." and long in found[411]


def test_substring_dedup(spark, docs, empty):
    draw = random.Random(11)
    passage = " ".join(words(draw, 14).capitalize() + "." for _ in range(5))
    rows = []
    for k in range(30):
        mine = [words(draw, draw.randint(3, 20)).capitalize() + "." for _ in range(12)]
        if k % 3 == 0:
            mine.insert(draw.randint(0, 12), passage)
        rows.append((k, " ".join(mine)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.text for r in substring.drop_repeats(table).collect()}
    assert passage in found[0] and all(passage[:60] not in found[k] for k in range(3, 30, 3))
    assert all(found[k] == t for k, t in rows if k % 3)
    left = substring.drop_repeats(docs, counts=True)
    assert left.count() == docs.count() and {"n_removed", "n_parts"} <= set(left.columns)
    assert left.where("text is null and n_removed = 0 and n_parts = 0").count() == docs.where("text is null").count()
    assert all(r.n_chars == len(r.text) for r in left.collect() if r.text is not None)
    assert substring.drop_repeats(empty).count() == 0


def windows(text, size=50):
    found = text.split()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def test_passages_without_marks(spark):
    """No 50-word window of an earlier text stays whole, whatever stands around it; texts of their own stay as they are."""
    draw = random.Random(31)
    token = lambda: "".join(draw.choice("abcdefghij|") for _ in range(draw.randint(2, 7)))
    passages = [" ".join(token() for _ in range(n)) for n in (51, 60, 80, 120) for _ in range(25)]
    rows = []
    for k in range(300):
        around = [" ".join(token() for _ in range(draw.randint(0, 60))) for _ in range(2)]
        rows.append((k, f"{around[0]} {passages[k % 100] if k < 200 else ''} {around[1]}"))
    found = {r.doc_id: r.text for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen = set()
    for k, text in rows:
        assert not windows(found[k]) & seen
        assert k in range(100, 200) or found[k] == text
        seen |= windows(text)
    kept = [len(found[k].split()) - len(rows[k][1].split()) + len(passages[k % 100].split()) for k in range(100, 200)]
    assert sum(kept) < 0.25 * sum(len(p.split()) for p in passages)


def test_unspaced_texts():
    draw = random.Random(32)
    glyphs = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "\u3002".join(glyphs(12) for _ in range(5))
    found = [substring.runs(glyphs(30) + passage + glyphs(30)) for _ in range(2)]
    assert len(set(found[0]) & set(found[1])) >= 1
    long = [glyphs(90) for _ in range(2)]
    assert len(set(substring.runs(long[0] + glyphs(40))) & set(substring.runs(glyphs(40) + long[0]))) >= 8


def test_parts_and_runs():
    for text in ("", "a", "One two.\n\nThree; four", " x. y ", " a b c. d ", "\n \n", "\u4e00\u3002\u4e01 x.\ny"):
        assert "".join(text[a:b] for a, b in substring.parts(text)) == (text if text.strip() else "")
    text = " ".join(f"w{k}" + ("." if k % 4 == 3 else "") for k in range(60))
    assert len(substring.parts(text)) == 15 and len(substring.runs(text)) == 13
    assert len(substring.runs("One two three. Four five six.")) == 1 and not substring.runs("One two three.")
    assert len(substring.parts("A. B. C. D e. F!! G!! H!!")) == 1  # marks in a row make no sentences


def test_language(spark, docs, empty):
    draw, langs = random.Random(12), {"en": "the and of water", "de": "der und nicht wasser", "fr": "le et pas eaux", "es": "el y agua para"}
    rows = []
    for k in range(400):
        lang = sorted(langs)[k % 4]
        rows.append((k, " ".join(draw.choice(langs[lang].split()) for _ in range(12)), lang if k % 7 else None))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(table).collect()}
    for k, _, _ in rows:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert found[k].lang_pred == sorted(langs)[k % 4] and 0 <= found[k].score <= 1
    model = langid.fit(table)
    scorer = langid.Scorer(model)
    assert scorer.predict(None) == ("und", 0.0) and scorer.predict(" 12 .!") == ("und", 0.0) and scorer.predict("wassers")[0] == "de"
    labelled = langid.label(docs, model)
    assert labelled.count() == docs.count() and labelled.columns[-2:] == ["lang_pred", "score"]
    assert labelled.where("text is null and lang_pred != 'und'").isEmpty()
    assert langid.identify(empty).count() == 0 and langid.Scorer(langid.fit(empty)).predict("a") == ("und", 0.0)


def test_language_scores_equal_plain_ones(spark):
    """Each score against word-first backoff written out: counts by dictionaries, words one by one, no cache."""
    draw = random.Random(14)
    letters = {"aa": "abcdefg", "bb": "defghij", "cc": "ghijklm"}
    word = lambda lang: "".join(draw.choice(letters[lang]) for _ in range(draw.randint(1, 7)))
    rows = [(k, " ".join(word(lang) for _ in range(draw.randint(1, 9))) + draw.choice([".", "!", ""]), lang if k % 5 else None) for k in range(300) for lang in [draw.choice([*letters])]]
    rows += [(900, "abc abc", "aa"), (901, "abc abc", "bb"), (902, "zzz", None), (903, "", "aa"), (None, "abcdef", "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(table).collect()}
    langs, words, grams = sorted(letters), {}, {n: {} for n in (1, 2, 3, 4)}
    totals = {0: dict.fromkeys(langs, 0.0), **{n: dict.fromkeys(langs, 0.0) for n in grams}}

    def pieces(w, n):
        w = f"_{w}_" if n > 1 else w
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    for k, text, lang in rows:
        if lang and text and k is not None and zlib.crc32(str(k).encode()) % 4 != 2:
            for w in re.findall(r"[a-z]+", text.lower()):
                words.setdefault(w, dict.fromkeys(langs, 0))[lang] += 1
                for n in grams:
                    for piece in pieces(w, n):
                        grams[n].setdefault(piece, dict.fromkeys(langs, 0))[lang] += 1
    for kind, table_ in ((0, words), *grams.items()):
        for lang in langs:
            totals[kind][lang] = sum(x[lang] + 0.5 for x in table_.values())
    log = lambda kind, entry, lang: math.log((entry[lang] + 0.5) / totals[kind][lang])
    backed = 0
    for k, text, _ in rows:
        if k is None:
            continue
        sums, count = dict.fromkeys(langs, 0.0), 0
        for w in re.findall(r"[a-z]+", (text or "").lower()):
            count += 1
            if w in words:
                kind, entries = 0, [words[w]]
            else:
                backed += 1
                kind, entries = next(((n, e) for n in (4, 3, 2, 1) if (e := [grams[n][x] for x in pieces(w, n) if x in grams[n]])), (1, []))
            for lang in langs:
                sums[lang] += sum(log(kind, e, lang) for e in entries) / max(1, len(entries))
        if not count:
            assert (found[k].lang_pred, found[k].score) == ("und", 0.0)
            continue
        logs = {lang: x / count * min(count, 16) for lang, x in sums.items()}
        best = max(langs, key=lambda lang: logs[lang])
        score = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        assert found[k].lang_pred == best or abs(logs[found[k].lang_pred] - logs[best]) < 1e-9
        assert abs(found[k].score - score) < 1e-9
    assert backed > 100
    assert langid.Scorer(langid.Model(["x", "y"], {0: ("w", np.array([[-1.0, -1.0]]))})).predict("w") == ("x", 0.5)  # a tie


def test_tiktoken_is_the_measure():
    assert isinstance(codec(), tiktoken.Encoding)
