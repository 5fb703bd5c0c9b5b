import hashlib
import random
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gramward.llm import chat, html, vectors, warc
from gramward.llm.common import components


def test_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(40), draw.randrange(40)) for _ in range(25)] + [(500, k) for k in range(501, 560)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    alone = {x for a, b in edges for x in (a, b) if a == b}
    assert all(found[x] == find(x) for x in up if x not in alone or x in found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def embeddings(spark, count=600, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, 16))
    rows = []
    for k in range(count):
        v = centres[draw.integers(60)] + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.4])
        rows.append((k, v.tolist(), int(draw.integers(2)), "x"))
    rows += [(900, None, 0, "x"), (901, [], 0, "x"), (902, [0.0] * 16, 0, "x"), (903, [float("nan")] * 16, 0, "x"), (904, [None, 1.0], 0, "x"), (905, rows[0][1], None, "x"), (906, [1.0, 2.0], 1, "x"), rows[5], (None, rows[5][1], rows[5][2], "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")


@pytest.mark.parametrize("cell_rows", [16, None])
def test_near_vectors(spark, monkeypatch, cell_rows):
    """Against all pairs; with many small cells and blocks, and as it stands, which is with several cells too."""
    rows, table = embeddings(spark)
    used, fit_cells = [], vectors.fit_cells
    monkeypatch.setattr(vectors, "fit_cells", lambda *a: used.append(fit_cells(*a)) or used[-1])
    if cell_rows:
        monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", cell_rows)
    found = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    good = [r for r in rows if r[0] is not None and (r[0] < 900 or r[0] == 906) and len(r[1]) == 16]
    x = np.array([np.array(r[1], np.float32) for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(linked, False)
    up = list(range(len(good)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in np.argwhere(linked):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    least = {}
    for k, r in enumerate(good):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    for k, r in enumerate(good):
        got = found[r[0]]
        assert (got.n_links, got.component_id, got.kept) == (linked[k].sum(), least[find(k)], r[0] == least[find(k)])
    for k in (900, 901, 902, 903, 904, 905, 906):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (0, k, True)
    assert len(used[0][16]) >= (15 if cell_rows else 4)
    centres = used[0][16]
    own = (x @ centres.T).argmax(axis=1)
    assert len({*own.tolist()}) >= 3  # the cells are in use
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_long_vectors_make_smaller_blocks(spark, monkeypatch):
    assert vectors.rows_of(4096, 64) == 4096 and vectors.rows_of(4096, 4096) == 512 and vectors.rows_of(4096, 10**9) == 1
    monkeypatch.setattr(vectors, "SIDE_BYTES", 8 * 16 * 10)
    rows, table = embeddings(spark)
    plain = {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()}
    monkeypatch.undo()
    assert plain == {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()}


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_ROWS", 8)
    monkeypatch.setattr(vectors, "CANDIDATE_ROWS", 100)
    rows, table = embeddings(spark)
    found = vectors.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    good = [r for r in rows if r[0] is not None and (r[0] < 900 or r[0] == 905)]  # labels do not matter here
    x, ids = np.array([np.array(r[1], np.float32) for r in good], float), np.array([r[0] for r in good])
    for q in range(0, 600, 20):
        score = x @ x[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -np.round(score, 9))) if ids[k] != q][:20]
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and np.allclose([r.score for r in got], score[order], atol=1e-9)
    assert len(found) == 30 * 20 and vectors.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark):
    long, short = "<p>" + "long é " * 40, "<p>short"
    rows = [(3, "http://a\r\nX: y", long, "?"), (1, None, long, "?"), (2, "u", short, "?"), (5, "u", short, "?"), (4, "u", None, "?"), (7, "u", long, "?"), (7, "u", long, "?"), (None, "u", long, "?"), (9, "u", "z" * 500_000, "?")]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    for k, _, body, _ in rows:
        raw = (body or "").encode()
        assert (by[k].payload_bytes, by[k].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: (by[k].record_type, by[k].refers_to) for k in (1, 3, 7, 2, 5, None)} == {
        1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 2: ("response", None), 5: ("response", None), None: ("response", None)
    }
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = []
    for k in range(12):
        body = (f"page {k} " * 30).encode()
        plain = warc.record(k, "u", body, hashlib.sha256(body).hexdigest(), None)
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        records.append(squeeze.compress(plain) + squeeze.flush() if packed else plain)
    draw = random.Random(3)
    whole = b"".join(records)
    assert [type(x) for x in warc.salvage(whole)] == [warc.Record] * 12 and not list(warc.salvage(b""))
    for _ in range(40):
        hurt = {draw.randrange(12) for _ in range(3)}
        parts = []
        for k, r in enumerate(records):
            if k in hurt:
                at = draw.randrange(len(r))
                r = r[:at] + draw.choice([b"", b"\x00garbage\xff", b"WARC/", b"\x1f\x8b\x08"]) + r[at + draw.randint(1, 20) :]
            parts.append(r)
        data = b"".join(parts)
        found = list(warc.salvage(data))
        assert sum(x.length for x in found) == len(data) and [x.offset for x in found] == list(np.cumsum([0, *(x.length for x in found[:-1])]))
        ids = {x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)}
        assert {f"<urn:page:{k}>" for k in set(range(12)) - hurt} <= ids


def test_read_warc_logs_gaps(spark, tmp_path):
    body = b"x" * 200
    plain = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    (tmp_path / "a.warc").write_bytes(b"junk" + plain + b"more junk")
    rows = warc.read_warc(spark, str(tmp_path)).sort("byte_offset").collect()
    assert [(r.byte_offset, r.byte_length, r.gap is None) for r in rows] == [(0, 4, False), (4, len(plain), True), (4 + len(plain), 9, False)]
    assert bytes(rows[1].payload) == body


def archive(bodies, packed=True):
    out = []
    for k, body in bodies:
        plain = warc.record(k, "u", body, hashlib.sha256(body).hexdigest(), None)
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        out.append(squeeze.compress(plain) + squeeze.flush() if packed else plain)
    return out


def test_salvage_takes_time_in_proportion():
    draw = random.Random(5)
    records = archive([(k, draw.randbytes(3000)) for k in range(2600)])
    records[5] = records[5][:-40] + records[5][-20:]  # damage, so that it searches too
    seconds = []
    for data in (b"".join(records[:1300]), b"".join(records), b"\x1f\x8b\x08WARC/1.0\r\n" * 200_000):
        best = min(_timed(lambda data=data: sum(1 for _ in warc.salvage(data))) for _ in range(3))
        seconds.append(best)
    assert len(b"".join(records)) > 7_500_000 and seconds[1] < 2.7 * seconds[0] + 0.1 and seconds[2] < 60


def _timed(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


@pytest.mark.parametrize("packed", [True, False])
def test_large_archives_are_read_by_ranges(spark, tmp_path, monkeypatch, packed):
    """Ranges that begin within records, within gaps and within a record that holds a whole archive give what one pass gives."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 1000)
    draw = random.Random(6)
    inner = b"".join(archive([(1000 + k, draw.randbytes(150)) for k in range(12)], packed))
    records = archive([(k, draw.randbytes(draw.randint(0, 900))) for k in range(30)] + [(99, inner)] + [(k, draw.randbytes(300)) for k in range(30, 40)], packed)
    records[3] = records[3][: len(records[3]) // 2]
    records.insert(20, draw.randbytes(2500))
    records.append(b"the end")
    data = b"".join(records)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(archive([(500, b"small")])[0])
    got = warc.read_warc(spark, str(tmp_path)).where("archive like '%a.warc'").sort("byte_offset").collect()
    expected = list(warc.salvage(data))
    assert [(r.byte_offset, r.byte_length, r.gap is None) for r in got] == [(x.offset, x.length, isinstance(x, warc.Record)) for x in expected]
    assert {r.page_id for r in got if r.page_id is not None} == {*range(40), 99} - {3}
    assert warc.read_warc(spark, str(tmp_path)).where("page_id = 500").count() == 1


def test_archives_of_lost_attempts_do_not_count(spark, tmp_path):
    pages = warc.with_revisits(spark.createDataFrame([(k, "u", f"page {k} " * 30, "?") for k in range(40)], PAGES).repartition(4))
    manifest = warc.write_warc(pages, f"file://{tmp_path}", archive_bytes=500).cache()
    listed = {r.archive.rsplit("/", 1)[1] for r in manifest.collect()}
    assert {p.name for p in tmp_path.iterdir()} == listed and len(listed) > 4
    (tmp_path / "part-000000-00000-999999.warc.gz").write_bytes((tmp_path / min(listed)).read_bytes())
    assert sorted(r.page_id for r in warc.read_back(manifest).collect()) == list(range(40))


def test_html_text(spark):
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
    <div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>First   part</b>ly, of the text that goes on for a while.<br>Then more, and more of it, as it should be.
    <p>Second paragraph, with caf&eacute; and so on, quite long too.</article><div class="comments"><div class="comment"><p>I liked this, it was good to read.</p></div></div><footer>&copy; me</footer>"""
    rows = [(1, "u", page, "?"), (2, None, None, "?"), (3, "u", "", "?"), (None, "u", page, "?"), (5, "u", "<", "?"), (6, "u", "<div <p a='", "?"), (7, "u", "<article>" + "<p>Some words, here. </p>" * 3000 + "</article>", "?"), (1, "u", page, "?")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = {r.page_id: r for r in found.collect()}
    assert found.count() == len(rows) and found.columns == ["page_id", "url", "text", "n_chars"]
    assert got[1].text == "A & B First partly, of the text that goes on for a while. Then more, and more of it, as it should be. Second paragraph, with café and so on, quite long too."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and got[7].text == " ".join(["Some words, here."] * 3000)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Plain(HTMLParser):
    """An independent reading of a page: (elements above, text) of each text, block edges as None. For tests only."""

    skipped, void, inline = {"script", "style", "title", "textarea", "noscript", "svg"}, {"br", "img", "input", "meta", "hr"}, {"a", "b", "i", "em", "span", "code", "label", "sup", "math", "mi"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.number = [("body", 0)], [], 0
        self.feed(page)
        self.close()

    def close_to(self, k):
        if any(name not in self.inline for name, _ in self.stack[k:]):
            self.found.append(None)
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        if tag in self.void:
            if tag in ("br", "hr"):
                self.found.append(None)
            return
        if tag in ("html", "head", "body"):
            return
        if tag not in self.inline and any(n == "p" for n, _ in self.stack) and tag not in ("option",):
            self.close_to(next(k for k, (n, _) in enumerate(self.stack) if n == "p"))
        if tag in ("li", "option") and self.stack[-1][0] == tag:
            self.close_to(len(self.stack) - 1)
        self.number += 1
        self.stack.append((tag, self.number))
        if tag not in self.inline:
            self.found.append(None)

    def handle_endtag(self, tag):
        at = [k for k, (n, _) in enumerate(self.stack) if n == tag and k]
        if at:
            self.close_to(at[-1])

    def handle_data(self, data):
        if not any(n in self.skipped for n, _ in self.stack):
            self.found.append(([k for n, k in self.stack if n not in self.inline], data))

    def text(self, keep=lambda above: True):
        return " ".join("".join(" " if x is None else x[1] for x in self.found if x is None or keep(x[0])).split())


def test_reading_equals_an_independent_parser():
    for page in html.training_pages(60, seed=77):
        page = page.replace("<option>", "<p>").replace("</select>", "</p></select>")
        nodes, pieces = html.read(page)
        assert html.main_text(nodes, pieces, [True] * len(nodes)) == Plain(page).text()


def test_html_held_out_layouts():
    """Gold texts come from another parser: what stands in the blocks that hold marked text."""
    extractor, right, tp, fp, fn = html.trained(), 0, 0, 0, 0
    for page in html.training_pages(120, seed=1234):
        plain = Plain(page)
        main = {k for x in plain.found if x and html.MARK in x[1] for k in x[0]}
        gold = plain.text(lambda above, main=main: above[-1] in main).replace(html.MARK, "").split()
        got = extractor.texts([page.replace(html.MARK, "")])[0].split()
        both = len(set(gold) & set(got))
        right, tp, fp, fn = right + (gold == got), tp + both, fp + len(set(got)) - both, fn + len(set(gold)) - both
    assert right >= 96 and tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


@pytest.mark.parametrize(("body", "text"), [
    ("<p>Intro of the article, which goes on.</p><pre><code class='language-comment'>a = b</code></pre>", "Intro of the article, which goes on. a = b"),
    ("<p>Before the <span class='ad'>word</span> and <i class=comment>note</i> after, we go on.</p>", "Before the word and note after, we go on."),
    ("<p>Text that goes on, and on.</p><script src=/a/>var leak=1;</script><p>More of it, here.</p>", "Text that goes on, and on. More of it, here."),
    ("<p>Text that goes on, and on.</p><svg><p>More of it, here, in full.</p>", "Text that goes on, and on. More of it, here, in full."),
    ("<p>Text that goes on, and on.</p><svg/><object><textarea><p>More of it, here, in full.</p>", "Text that goes on, and on. More of it, here, in full."),
    ("<p>Here x<sup>2</sup> is <math><mi>y</mi><mo>=</mo><mn>3</mn></math>, and so on.</p>", "Here x2 is y=3, and so on."),
    ("<p>Words <ruby>kan<rt>ji</rt></ruby> and <x-term>cust</x-term>om fo<font>nt</font>s no<nobr>br</nobr>eak, too.</p>", "Words kanji and custom fonts nobreak, too."),
    ("<p>Text that goes on, &lt;and on&gt; &amp;c.</p><xmp>a &lt; <b>b</b></xmp>", "Text that goes on, <and on> &c. a &lt; <b>b</b>"),
])
def test_malformed_and_odd_markup(body, text):
    page = f"<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>The head of it</h1>{body}</article>"
    assert html.trained().texts([page]) == [f"The head of it {text}"]


def test_decoding_has_no_kept_node_below_a_dropped_one():
    draw = random.Random(5)
    for _ in range(200):
        nodes = [html.Node("body", -1, 0, frozenset())] + [html.Node("div", draw.randrange(k), 1, frozenset()) for k in range(1, 9)]
        odds = np.array([draw.uniform(-3, 3) for _ in nodes])
        kept = html.decode(nodes, odds)
        score = lambda keep: sum(-np.logaddexp(0, -o if k else o) for k, o in zip(keep, odds, strict=True))
        legal = lambda keep: all(not keep[k] or keep[nodes[k].parent] for k in range(1, 9))
        best = max(score(keep) for keep in ([m >> k & 1 for k in range(9)] for m in range(512)) if legal(keep))
        assert legal(kept) and abs(score(kept) - best) < 1e-9


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(chat.PREFERENCES_SQL)
    return [c[0] for c in found.description], sorted(found.fetchall())


def test_preferences(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (5000, 0, "user", "q"), (5000, 1, "assistant", "b"),
        (7, None, None, None), (7, 0, "user", "alone"), (None, 0, "user", "q"), (9000, 3, "assistant", "only"), (9001, 0, "user", "q"), (9001, 1, "assistant", "a"), (9001, 2, "user", "r"),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos string, at string")
    ours = chat.preferences(table)
    names, theirs = by_sql(rows)
    assert ours.columns == names and sorted(map(tuple, ours.collect())) == theirs
    pair = next(r for r in ours.collect() if r[:3] == ("first_turn", 1, 2))
    assert pair.prompt == "<|user|>\nq<|end|>\n" and pair.chosen.startswith("<|assistant|>\na<|end|>") and pair.rejected == "<|assistant|>\nb<|end|>\n" * 2
    assert pair.chosen_mask == "14:9" and [pair.rejected[int(a) : int(a) + int(n)] for a, n in (x.split(":") for x in pair.rejected_mask.split(","))] == ["b<|end|>\n"] * 2
    assert chat.preferences(table.limit(0)).count() == 0
    assert all("Python" not in x and "Arrow" not in x for x in [ours._jdf.queryExecution().toString()])


def test_preferences_of_hot_and_sparse_conversations(spark):
    """One conversation with most turns, one without turn numbers, ids a million apart, a first turn that most share, very long texts."""
    draw = random.Random(9)
    rows = [(7, k, draw.choice(["user", "assistant"]), f"turn {k % 50}") for k in range(700)]
    rows += [(8, None, draw.choice(["user", "assistant", None]), f"{'same start ' * 5}{draw.randrange(99)}") for _ in range(400)]
    for k in range(150):
        rows += [(10**6 * (k + 1), 0, "user", "hello" if k % 3 else f"hi {k}"), (10**6 * (k + 1), 1, "assistant", f"answer {draw.randrange(3)}")]
        rows += [(10**6 * (k + 1), 2, "user", "more")] * (k % 2)
    rows += [(11, 0, "user", "hello"), (11, 1, "assistant", "x" * 3_000_000), (12, 0, "user", "hello"), (12, 1, "assistant", "x" * 3_000_000 + "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    names, theirs = by_sql(rows)
    ours = sorted(map(tuple, chat.preferences(table).select(*names).collect()))
    assert ours == theirs and len({r[3] for r in ours}) >= 3
