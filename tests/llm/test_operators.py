"""The ten operators on small fixtures: brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import gzip
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_codes, best_fit_packing, chat_format, html_text, jaccard_join, mixing, pitman_yor, quality_classifier, quality_rules, storage, warc
from tidemark.llm.components import connected_components
from tidemark.llm.textbatch import slices

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \t\n", "en", "s", 3), (4, "One two three four five six.", "en", "s", 1), (5, "one TWO three four five six.", "en", "s", 1), (5, "one TWO three four five six.", "en", "s", 1), (None, "lost row", "en", "s", 1), (6, "word " * 30000, "en", "s", 1), (7, "three only words", "en", "s", 1), (8, "Three only words", "en", "s", 1)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_batches():
    texts = ["A b\x0bC", None, "", "  ", "é\xa0x y"]
    found = []
    for _, x in slices(pa.array(texts)):
        found += [[bytes(x.data[a:b]).decode() for a, b in zip(x.starts[x.first[i] : x.first[i + 1]], x.ends[x.first[i] : x.first[i + 1]], strict=True)] for i in range(len(x))]
    assert found == [["A", "b", "C"], [], [], [], ["é\xa0x", "y"]]
    (_, x), (_, y) = next(iter(slices(pa.array(["Aa b"])))), next(iter(slices(pa.array(["q aA B"]))))
    assert (x.hashes() == y.hashes()[1:]).all()


# 1 HTML


def test_html_layout():
    assert html_text.html_to_text("<title>t</title><p>one<p>two &amp; <b>three</b><ul><li>a<li>b</ul><div hidden>x</div><script>'<p>'</script>end") == "one\n\ntwo & three\n\n- a\n- b\n\nend"
    assert html_text.html_to_text("<table><tr><th>Name<th>n<tr><td>pear<td>12</table>") == "Name  n\npear  12"
    assert html_text.html_to_text("<pre>  a\n b</pre>") == "  a\n b"
    assert html_text.html_to_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.html_to_text("a < b <unclosed") in ("a < b", "a < b <unclosed")


def test_html_spans_cells_and_visibility():
    to_text = html_text.html_to_text
    assert to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert to_text("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>") == "wide cell  z\na  b  c" or to_text("<table><tr><td colspan=2>wide<td>z<tr><td>aaa<td>b<td>c</table>") == "wide    z\naaa  b  c"
    assert to_text("<table><tr><td><ul><li>x<li>y</ul><td><p>one<p>two</table>") == "- x  one\n- y  two"
    assert to_text("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>end") == "yes\nend"
    assert to_text("<dialog>shut</dialog><dialog open>seen</dialog>") == "seen"
    assert to_text("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>") == "a        b\nin  ner"
    assert to_text("<ul><li>a<ul><li>b</ul><li>c</ul><ol start=3><li>x</ol>") == "- a\n  - b\n- c\n\n3. x"


def test_html_work_follows_the_length():
    import time

    def seconds(n):
        at = time.process_time()
        html_text.html_to_text("<div>" * n + "<li>x" * n + "<table><tr>" * (n // 10) + "<td>y" * n + "</b>" * n)
        return time.process_time() - at

    seconds(500)
    assert seconds(16000) < 8 * max(seconds(4000), 0.02) and html_text.html_to_text("<p>" * 20000 + "z") == "z"


@pytest.mark.parametrize(
    "page",
    [lambda n: "<a " * n + '"', lambda n: '<a ""' * n + '"', lambda n: "<a \"'" * n + '"', lambda n: "<table>" + "<tr><td colspan=1000 rowspan=1000>x" * (n // 8), lambda n: "<table><tr>" + "<td rowspan=1000>x" * (n // 4) + "<tr><td>y" * 500, lambda n: "<table><tr><td>x" * (n // 4), lambda n: "<p>x<b " * n + "'"],
)
def test_html_of_hostile_pages_takes_linear_time(page):
    import time

    def seconds(n):
        at = time.process_time()
        html_text.html_to_text(page(n))
        return time.process_time() - at

    seconds(500)
    assert seconds(32_000) < 14 * max(seconds(8_000), 0.02)


def test_html_quotes_that_stay_open_are_text():
    assert html_text.html_to_text('<p>one <a href="x>two <b>three</b>') == 'one <a href="x>two three'
    assert html_text.html_to_text("<p title='a>b'>x</p><i \"y\">z</i><i 'open>w") == "x\n\nz<i 'open>w"
    # The quote of the first tag closes in the second, whose own stays open.
    assert html_text.html_to_text("<a 'x <b 'y> z") == "z" and html_text.html_to_text("<a 'x> <b \"y' \"q\"> z") == "z"


def test_html_spans_take_no_room_where_no_cell_begins():
    assert html_text.html_to_text("<table><tr><td colspan=1000>a<td>b<tr><td colspan=1000>ccc<td>d</table>") == "a  b\nccc  d"
    deep = "<table><tr><td>" * 40 + "in" + "<td>side</table>" + "</table>" * 39
    assert html_text.html_to_text(deep) == "in side"
    wide = "<table>" + "<tr>" + "".join(f"<td>{'w' * 20}" for _ in range(80)) + "<tr><td>a<td>b</table>"
    assert html_text.html_to_text(wide).split("\n")[1] == "a  b"


def visible_words(html):
    """The words of a page by Python's own tokenizer and a plain stack: no layout, only what is shown."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in html_text.VOID:
                self.hidden.append((tag, tag in html_text.UNSEEN or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", "")))

        def handle_endtag(self, tag):
            names = [t for t, _ in self.hidden]
            if tag in names:
                del self.hidden[len(names) - 1 - names[::-1].index(tag) :]

        def handle_data(self, data):
            if not any(h for _, h in self.hidden):
                self.words += data.split()

    w = Words()
    w.feed(html)
    w.close()
    return w.words


def test_html_shows_the_words_that_a_plain_walk_finds():
    rng = random.Random(8)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return f" w{rng.randrange(1000)} &amp; "
        tag = rng.choice(["div", "p", "b", "span", "ul", "table", "section", "div hidden", "div style='display: none'", "script", "h2"])
        inside = "".join(element(depth - 1) for _ in range(rng.randrange(1, 4)))
        if tag == "p" or tag == "h2":
            inside = f" t{rng.randrange(1000)} "
        elif tag == "ul":
            inside = f"<li>{inside}</li><li>x</li>"
        elif tag == "table":
            inside = f"<tr><td>{inside}</td><td>c</td></tr>"
        elif tag == "script":
            inside = "s()"
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    for _ in range(300):
        html = element(5)
        marks = lambda words: sorted(w for w in words if w not in ("-", "&") and not re.fullmatch(r"\d+\.", w))
        assert marks(html_text.html_to_text(html).split()) == marks(visible_words(html)), html


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>hi", "x"), (3, "<p>hi", "x")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text or "") for r in html_text.extract_text(rows).collect()) == [(1, ""), (2, ""), (3, "hi"), (3, "hi")]
    assert html_text.extract_text(rows.limit(0)).count() == 0


# 2 mixing


def test_mixing_meets_targets(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    targets = {"clean": 0.8, "poor": 0.1, "toxic": 0.1}
    rows = mixing.mix_to_targets(docs, labels, domain, targets).collect()
    total = sum(r.n_tokens for r in rows)
    for k, t in enumerate(targets.values()):
        assert sum(r.n_tokens * r.posteriors[k] * r.rate for r in rows) / total == pytest.approx(t, abs=2e-3)
    assert all(r.rate >= 0 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in rows)
    assert mixing.mix_to_targets(odd, labels, domain, targets).count() == len(ODD)
    assert mixing.mix_to_targets(empty, labels, domain, targets).count() == 0
    assert mixing.mix_to_targets(odd, labels.limit(0), domain, targets).count() == len(ODD)


def test_rates_match_a_plain_least_squares_solver(spark):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.5, 0.5, 0.5], 60), rng.integers(5, 50, 60)
    targets = np.array([0.7, 0.2, 0.1])
    members = spark.createDataFrame([(int(t), [float(v) for v in row]) for t, row in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    misses, left = mixing.solve_rates(members, targets, iterations=400, tolerance=1e-7)
    got = mixing.replay(p, misses)[0]
    # The same objective by very many plain projected steps.
    w = n[:, None] * p / n.sum()
    rate = np.ones(60)
    for _ in range(60000):
        rate = np.maximum(0, rate - 0.9 * ((p @ (rate @ w - targets)) + mixing.PULL * (rate - 1)))
    # The pull towards 1 leaves a small miss to both.
    loss = lambda r: ((r @ w - targets) ** 2).sum() + mixing.PULL * (n / n.sum() * (r - 1) ** 2).sum()
    assert left < 2e-3 and loss(got) <= 1.02 * loss(rate) + 1e-9 and np.abs(got - rate).mean() < 0.05 and got.min() >= 0
    assert mixing.solve_rates(members, np.array([5.0, 0.0, 0.0]), iterations=5)[1] > 0.1


def test_replay_projects():
    p = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert mixing.replay(p, [np.array([3.0, -1.0])])[0].tolist() == pytest.approx([0.0, 2.0], abs=1e-3)


# 3 chat


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "b", 2, "add", '{"y":2,"x":1}', ["a"]), (1, "a", 1, "find", '{"q":"cat"}', []), (1, "c", 3, "find", '{"q":5}', ["d"]), (1, "d", 4, "find", "no json", ["c"]), (1, None, 9, "find", "{}", []), (2, "a", 1, "who", "{}", None)], CALLS
    )
    results = spark.createDataFrame([(1, "a", 5, "found"), (1, "z", 6, "late"), (1, "a", 7, "again"), (None, "a", 8, "nowhere"), (1, None, 9, "unnamed")], RESULTS).withColumn("status", F.lit("x"))
    schemas = (chat_format.Argument("find", "q", min_length=1), chat_format.Argument("add", "x", "number"), chat_format.Argument("add", "y", "number"))
    rows = chat_format.link_tool_calls(calls.withColumn("level", F.lit(9)), results, schemas).collect()
    got = {(r.conv_id, r.call_id): r for r in rows if r.status not in ("repeated", "unnamed")}
    assert {k: r.status for k, r in got.items()} == {(1, "a"): "linked", (1, "b"): "unanswered", (1, "c"): "unordered", (1, "d"): "unordered", (1, "z"): "orphan", (2, "a"): "unanswered", (None, "a"): "orphan"}
    assert got[1, "a"].position == 1 and got[1, "b"].position == 2 and got[1, "a"].valid and got[1, "b"].valid
    assert got[1, "c"].errors == ["q: not a string"] and got[1, "d"].errors[0] == "not an object" and got[2, "a"].errors == ["unknown tool"]
    assert got[1, "b"].message == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","result":null}'
    assert json.loads(got[1, "a"].message)["result"] == "found"
    # Every call and result is in some row.
    assert sorted(((r.status, json.loads(r.message)["result"]) for r in rows if r.status in ("repeated", "unnamed")), key=str) == [("repeated", "again"), ("unnamed", "unnamed"), ("unnamed", None)]
    assert len(rows) == 10 and sorted(r.position for r in rows if r.conv_id == 1) == list(range(1, 9))
    assert chat_format.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_levels_match_a_plain_topological_order(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "COMPACT", 3)
    rng, rows = random.Random(4), []
    for conv in range(3):
        for i in range(14):
            rows.append((conv, f"c{i}", i, "t", "x" * 3000, [f"c{j}" for j in range(i) if rng.random() < 0.25] + (["gone"] if i == 11 else []) + ([f"c{i}"] if i == 12 else [])))
    want = {}
    for _ in range(20):
        for conv, call, _, _, _, needs in rows:
            if all((conv, n) in want for n in needs):
                want[conv, call] = 1 + max([want[conv, n] for n in needs], default=-1)
    got = {(r.conv_id, r.call_id): r.level for r in chat_format.call_levels(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == want and max(want.values()) > 4


def test_every_turn_of_a_conversation_is_a_row(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS", 3)
    rng, rows = random.Random(6), [(None, 1, "user", "lost"), (1, None, "user", "no turn"), (1, 50, "tool", "output"), (1, 51, None, None)]
    for conv in range(4):
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "assistant"]), rng.choice(["hi", "", "long " * 2000, None])) for t in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))
    calls, results = chat_format.conversation_calls(turns)
    got = chat_format.link_tool_calls(calls, results, chat_format.CONVERSATION_TOOLS).collect()
    linked = sum(r.status in ("linked",) for r in got)
    both = sum(r.status == "unordered" and json.loads(r.message)["result"] is not None for r in got)
    assert len(got) + linked + both == len(rows)
    for conv in range(4):
        asked = setting = None
        answered = {}
        for _, t, role, text in sorted((r for r in rows if r[0] == conv and r[1] is not None and r[1] < 20), key=lambda r: r[1]):
            if role == "assistant":
                if asked is not None and asked not in answered:
                    answered[asked] = text or ""
            else:
                asked = t
        found = {r.call_id: json.loads(r.message)["result"] for r in got if r.conv_id == conv and r.status == "linked"}
        assert found == {f"t{t}": text for t, text in answered.items()}
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(1, 1 + sum(r.conv_id == conv for r in got)))
    assert chat_format.link_tool_calls(*chat_format.conversation_calls(turns.limit(0)), chat_format.CONVERSATION_TOOLS).count() == 0


# 4 nearest neighbours


def test_nearest_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 24))
    v[50:90] = v[50]  # ties
    wide = rng.standard_normal((30, 5))
    rows = [(i, [float(a) for a in v[i]], 0) for i in range(400)] + [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [1.0], 0), (1004, [None] * 24, 0), (7, [float(a) for a in v[7]], 0), (None, [1.0] * 24, 0)]
    rows += [(500 + i, [float(a) for a in wide[i]], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    monkeypatch.setattr(ann_codes, "SMALL_BLOCK", 100)
    monkeypatch.setattr(ann_codes, "QUERY_BLOCK", 7)
    got = {}
    for r in ann_codes.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20)) | {500, 520}
    ids, all_ = np.append(np.arange(400), 7), np.vstack([v, v[7]])
    for q, found in got.items():
        base, names = (all_, ids) if q < 400 else (wide, 500 + np.arange(30))
        own = q if q < 400 else q - 500
        s = np.array([sum(a * b for a, b in zip(x, base[own], strict=True)) for x in base])
        s[own] = -np.inf
        order = np.lexsort((names, -s))[:20]
        assert sorted(found) == [(k + 1, names[i], s[i]) for k, i in enumerate(order)]
    assert ann_codes.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann_codes.nearest(df.where("vec_id < 3 and vec_id <> 0"), F.lit(True)).count() == 2
    twice = ann_codes.nearest(df.where("vec_id = 7"), F.lit(True)).collect()
    assert [(r.query_id, r.vec_id) for r in twice] == [(7, 7), (7, 7)]


def test_few_rows_are_reranked_and_recall_is_high_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann_codes, "SMALL_BLOCK", 300)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    v, n = np.array([r.embedding for r in df.orderBy("vec_id").collect()]), df.count()
    rows = ann_codes.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, n, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.99 * len(rows) and len(rows) == 20 * -(-n // 20)
    assert np.mean([r.n_reranked for r in rows if r.rank == 1]) < n / 3


def test_code_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes, length, own = ann_codes.encode(v)
    value, bound = ann_codes.estimate(v[:1], codes, own)
    assert (np.abs(value[0] - v @ v[0])[1:] <= bound[1:]).mean() > 0.999 and codes.shape == (2000, 64) and length == pytest.approx(1)


# 5 trees


def test_trees_hold_out(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    forest = quality_classifier.fit_quality_classifier(docs, labels.where(~held))
    rows = quality_classifier.score_quality(docs, forest).join(labels, "doc_id").where(held).select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)
    scored = quality_classifier.score_quality(odd.withColumn("score", F.lit("x")), forest)
    assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
    assert quality_classifier.score_quality(empty, forest).count() == 0
    none = quality_classifier.fit_quality_classifier(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(odd, none).collect()} == {0.5}


def test_splits_and_traversal_match_plain_loops():
    rng = np.random.default_rng(6)
    rows = np.round(rng.standard_normal((300, 4)), 1)
    label = (rows[:, 2] + 0.3 * rng.standard_normal(300) > 0.2).astype(float)
    forest = quality_classifier.fit_forest(rows, label, trees=7, depth=3)
    # Traversal, row by row.
    for i in range(0, 300, 7):
        total = forest.prior
        for t in range(7):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(rows[i, forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - 7]
        assert total == pytest.approx(forest.margin(rows[i : i + 1])[0])
    # The first split: the best of all thresholds between values, by brute force.
    p = 1 / (1 + np.exp(-forest.prior))
    g, h = p - label, np.full(300, p * (1 - p))
    best = (-1.0, None)
    for j in range(4):
        for cut in np.unique(rows[:, j])[:-1]:
            left = rows[:, j] <= cut
            if min(h[left].sum(), h[~left].sum()) >= 2:
                gain = g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2) - g.sum() ** 2 / (h.sum() + 2)
                best = max(best, (gain, (j, cut)))
    left = rows[:, forest.feature[0, 0]] <= forest.threshold[0, 0]
    gain = g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2) - g.sum() ** 2 / (h.sum() + 2)
    assert forest.feature[0, 0] == best[1][0] and gain >= 0.97 * best[0]


def test_repeated_ids_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(i, f"good words number {i}", "x") for i in range(30)] + [(1, "another text", "x")] * 50, "doc_id long, text string, _label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    forests = [quality_classifier.fit_quality_classifier(docs.repartition(n), labels, max_rows=20) for n in (1, 5)]
    assert all((getattr(forests[0], c) == getattr(forests[1], c)).all() for c in ("feature", "threshold", "leaf"))


# 6 packing


def test_packing_round_trip(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd)
    rows = best_fit_packing.pack_documents(docs).collect()
    encoder = best_fit_packing.Encoder(best_fit_packing.default_tokenizer())
    want = []
    for d in docs.collect():
        ids = encoder.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        want += [(d.doc_id, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert best_fit_packing.pack_documents(empty).count() == 0


def test_encoder_agrees_on_odd_texts():
    e = best_fit_packing.Encoder(best_fit_packing.default_tokenizer())
    texts = ["a <|endoftext|> b", "don't they're We'LL 'sup it's.", "x…, .́ ≠ é,è 12ab34!! ab12", "", "ABCİß naïve—test ﬁ ①②", "a\x85b \x1cc d　e", "日本語。テスト! ½"]
    for _, x in slices(pa.array(texts)):
        ids, at = e.encode(x)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(x))] == [v.ids for v in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


# 7 Pitman-Yor


def test_scores_are_probabilities(spark, odd, empty):
    text = "a b a b a c b a"
    vocabulary = sorted(set(text.split())) + ["unseen"]
    rows = [(1, text)] + [(100 + i, w) for i, w in enumerate(vocabulary)] + [(200, "")]
    got = {r.id: r for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1).collect()}
    # After the start: one word or the end, and each word is followed by the end with a known share.
    end = lambda w: pitman_end(got, w)

    def pitman_end(found, w):
        return found[100 + vocabulary.index(w)].score

    assert got[1].n_tokens == 9 and got[1].n_known == 9 and got[1].train_tokens == 9 and got[1].train
    assert got[200].n_tokens == 1 and not got[200].train
    counts = {w: text.split().count(w) for w in vocabulary}
    base = math.log10((counts["a"] + 1) / (9 + 5)) + math.log10(2 / 14)
    assert got[100].base_score == pytest.approx(base)
    assert end("a") > end("unseen") and all(r.score <= 0 for r in got.values())
    assert pitman_yor.score_texts(odd, F.col("doc_id") != 4).count() == len(ODD)
    assert pitman_yor.score_texts(odd, F.lit(False)).where("score is null").count() == 0
    assert pitman_yor.score_texts(empty, F.lit(True)).count() == 0


def one_site(triples, vocabulary):
    """A site that holds all triples (word before, last word, next word, training tokens), and its words' order."""
    hashes = {w: np.uint64(pitman_yor.END if w == "</s>" else 1000 + i) for i, w in enumerate(["</s>", *vocabulary])}
    site = pitman_yor._Site.__new__(pitman_yor._Site)
    site.keys = site.before = np.array(list(hashes.values()), np.uint64)
    number = {w: i for i, w in enumerate(hashes)}
    mids = sorted({t[1] for t in triples})
    site.mids = np.array([hashes[v] for v in mids], np.uint64)
    rows = sorted((mids.index(v), number[u], number[w], n) for u, v, w, n in triples)
    site.m, site.u, site.w, site.count = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    site.context = np.cumsum(np.concatenate(([False], (site.m[1:] != site.m[:-1]) | (site.u[1:] != site.u[:-1]))))
    site.dish, name = np.unique(site.m * len(site.keys) + site.w, return_inverse=True)[::-1]
    site.dish_m, site.dish_w = np.divmod(name, len(site.keys))
    return site, rows


TOY = [("a", "b", "c", 5), ("a", "b", "d", 1), ("a", "b", "a", 0), ("a", "b", "b", 0), ("a", "b", "new", 0), ("a", "b", "</s>", 2), ("c", "b", "c", 3), ("c", "b", "d", 7), ("d", "b", "c", 40), ("a", "c", "b", 9), ("b", "c", "b", 2), ("b", "c", "</s>", 6)]


def test_next_words_sum_to_one():
    site, rows = one_site(TOY, ["a", "b", "c", "d", "new"])
    p, _ = site.sample(np.array([0.2, 0.1, 0.25, 0.25, 0.15, 0.05]), 6, 2)
    # One context with every word, the unknown one and the end.
    assert p[site.context == 0].sum() == pytest.approx(1, abs=1e-12) and (site.context == 0).sum() == 6


def plain_gibbs(triples, root, sweeps, seed):
    """Mean predictive probabilities, every customer taken out and seated again one at a time, with explicit tables."""
    rng, (d3, d2, _), (s3, s2, _) = random.Random(seed), pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    low, high = {}, {}  # restaurant -> dish -> customers of each table

    def p2(v, w):
        r = high.setdefault(v, {})
        n, t = sum(sum(x) for x in r.values()), sum(len(x) for x in r.values())
        return (sum(r.get(w, [])) - d2 * len(r.get(w, [])) + (s2 + d2 * t) * root[w]) / (s2 + n)

    def p3(u, v, w):
        r = low.setdefault((u, v), {})
        n, t = sum(sum(x) for x in r.values()), sum(len(x) for x in r.values())
        return (sum(r.get(w, [])) - d3 * len(r.get(w, [])) + (s3 + d3 * t) * p2(v, w)) / (s3 + n)

    def enter(r, w, d, s, p):
        tables = r.setdefault(w, [])
        at = rng.choices(range(len(tables) + 1), [x - d for x in tables] + [(s + d * sum(len(x) for x in r.values())) * p])[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(r, w):
        tables = r[w]
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        return not tables[at] and tables.pop(at) == 0

    def add(u, v, w):
        if enter(low.setdefault((u, v), {}), w, d3, s3, p2(v, w)):
            enter(high.setdefault(v, {}), w, d2, s2, root[w])

    people = [(u, v, w) for u, v, w, n in triples for _ in range(n)]
    for x in people:
        add(*x)
    mean = dict.fromkeys(((u, v, w) for u, v, w, _ in triples), 0.0)
    for sweep in range(sweeps):
        for u, v, w in people:
            if leave(low[u, v], w):
                leave(high[v], w)
            add(u, v, w)
        for x in mean if sweep >= sweeps // 5 else ():
            mean[x] += p3(*x) / (sweeps - sweeps // 5)
    return mean


def test_sampler_agrees_with_customer_by_customer_gibbs():
    root = {"</s>": 0.2, "a": 0.1, "b": 0.25, "c": 0.25, "d": 0.15, "new": 0.05}
    want = plain_gibbs(TOY, root, 1500, 1)
    site, rows = one_site(TOY, ["a", "b", "c", "d", "new"])
    got, _ = site.sample(np.array(list(root.values())), 1500, 2)
    names = list(root)
    mids = sorted({t[1] for t in TOY})
    for (m, u, w, _), p in zip(rows, got, strict=True):
        assert p == pytest.approx(want[names[u], mids[m], names[w]], rel=0.15, abs=0.02)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, rows in (("3", docs), ("16", docs.repartition(5))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((r.id, r.n_known, r.score) for r in pitman_yor.score_texts(rows, train).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert [x[2] for x in found[0]] == pytest.approx([x[2] for x in found[1]], rel=1e-6)


def test_words_split_among_restaurants_and_hot_triples(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "ROOM", 20)
    monkeypatch.setattr(pitman_yor, "HOT", 4)
    monkeypatch.setattr(pitman_yor, "ROUNDS", 3)
    docs = spark.createDataFrame([(i, "the " * 30 + f"x{i % 5} the y{i % 3}", 0) for i in range(20)] + [(None, "the end", 1)], "doc_id long, text string, word int")
    rows = pitman_yor.score_texts(docs, F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()
    assert len(rows) == 21 and all(r.score < 0 and r.n_known == r.n_tokens and r.score > r.base_score for r in rows)


def test_equal_texts_have_equal_scores_whatever_their_ids_and_parts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "ROOM", 20)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "a", f"x{i % 9}"]) for _ in range(12)) for i in range(60)]
    rows = spark.createDataFrame([(i + 1000 * k, t) for k in range(3) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: (r.score, r.base_score) for r in pitman_yor.score_texts(rows, F.col("doc_id") < 2000).collect()}
    # The last copies are held out.
    for i in range(60):
        assert got[i] == pytest.approx(got[i + 1000], rel=1e-6) and got[i] == pytest.approx(got[i + 2000], rel=1e-6)


def test_words_in_parts_share_their_restaurant():
    names = ["a", "b", "c", "d", "new"]
    site, rows = one_site(TOY, names)
    site.part, site.start = np.array([1, 0]), np.array([False, False])
    root = np.array([0.2, 0.1, 0.25, 0.25, 0.15, 0.05])
    alone, own = site.sample(root, 6, 2)
    new = (site.dish_m == 0) & (site.dish_w == 1 + names.index("new"))
    # Customers of parts go up, and what other parts have seen makes a word likelier that these never saw.
    assert own[site.dish_m == 0].sum() >= 7 and new.sum() == 1 and own[new] == 0
    more = np.where(new, 30.0, np.where(site.dish_m == 0, 3.0, 0.0))
    p, again = site.sample(root, 6, 2, (more, np.where(more > 0, 2.0, 0.0), np.zeros(2), np.zeros(2)))
    assert p[site.context == 0].sum() == pytest.approx(1, abs=1e-12) and again[new] == 0
    at = (site.context == 0) & (site.w == 1 + names.index("new"))
    assert p[at] > 3 * alone[at]


def test_repeated_texts_stand_out(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{int(4000 * rng.random() ** 2)}" for _ in range(120))
    once, twice = [text() for _ in range(120)], [text() for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(once + twice + twice)]
    got = {r.id: r.score / r.n_tokens for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()}
    bar = np.quantile([got[i] for i in range(120)], 0.95)
    assert np.mean([got[i] > bar for i in range(120, 144)]) > 0.8


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    r = pitman_yor.score_texts(docs, train).where("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_seating_has_the_right_mean():
    names = np.arange(20000, dtype=np.uint64)
    for n, others, p in ((5, 3.0, 0.2), (48, 3.0, 0.2), (60, 3.0, 0.2), (300, 3.0, 0.2), (300, 60.0, 0.3), (400, 0.0, 0.001)):
        got = pitman_yor.seat(np.full(20000, n), np.full(20000, others), (np.full(20000, p),), 0.5, 1.0, names, 1)
        t = np.arange(n)
        weight = pitman_yor.stirling(0.5, n) + np.cumsum(np.log(1 + 0.5 * (others + t)) + np.log(p))
        weight = np.exp(weight - weight.max())
        want = ((t + 1) * weight).sum() / weight.sum()
        assert got.mean() == pytest.approx(want, rel=0.02 if n <= pitman_yor.EXACT else 0.2) and got.min() >= 1 and got.max() <= n
    assert np.exp(pitman_yor.stirling(0.5, 3)) == pytest.approx([0.75, 1.5, 1.0])


# 8 rules


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_rules_match_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(odd)
    got = sorted(tuple(r) for r in quality_rules.apply_quality_rules(docs.where("doc_id is not null").withColumn("kept", F.lit(1))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for d in docs.where("doc_id is not null").collect():
        w, text = words_of(d.text), d.text or ""
        where = {}
        for i in range(len(w) - 2):
            where.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want.append((d.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want)
    assert quality_rules.apply_quality_rules(empty).count() == 0
    assert quality_rules.apply_quality_rules(docs).where("kept and base_failed").count() == 0


# 9 WARC


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 60
    pages = spark.createDataFrame([(1, "u1", long, 0), (2, "u\r\n2", long, 0), (3, None, "short", 0), (4, "u4", "short", 0), (5, "u5", None, 0), (None, "u", long, 0), (6, "u6", "x" * 100 + "\r\n\r\nWARC/1.1\r\n", 0)], "page_id long, url string, html string, refers_to int")
    for kind in ("gzip", "none"):
        path = f"file://{tmp_path}/{kind}"
        warc.write_warc(warc.payload_table(pages), path, kind)
        rows = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
        # A row without a page_id has a record too, under a random name.
        assert sorted(k for k in rows if k is not None) == [1, 2, 3, 4, 5, 6] and (rows[None].record_type, rows[None].refers_to) == ("revisit", 1) and rows[None].record_id.startswith("<urn:uuid:")
        assert (rows[2].record_type, rows[2].refers_to, rows[2].payload_bytes) == ("revisit", 1, 120)
        assert rows[1].payload.decode() == long and rows[6].payload_bytes == 114 and rows[4].record_type == rows[3].record_type == "response"
    warc.write_warc(warc.payload_table(pages.limit(0)), f"file://{tmp_path}/empty")
    assert warc.payload_table(pages.limit(0)).count() == 0


def test_warc_rows_without_ids(spark, tmp_path):
    """One record for every row; of payloads that only unnamed rows have none is another's original."""
    a, b, c = "a" * 120, "b" * 120, "c" * 120
    pages = spark.createDataFrame([(None, "u", a), (None, "u", a), (7, "u", a), (3, "u", a), (None, "u", b), (None, "u", b), (5, "u", c), (None, None, None)], "page_id long, url string, html string")
    warc.write_warc(warc.payload_table(pages), f"file://{tmp_path}/unnamed")
    rows = warc.read_warc(spark, f"file://{tmp_path}/unnamed").collect()
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows), key=str)
    assert found == sorted([(None, 120, "revisit", 3), (None, 120, "revisit", 3), (7, 120, "revisit", 3), (3, 120, "response", None), (None, 120, "response", None), (None, 120, "response", None), (5, 120, "response", None), (None, 0, "response", None)], key=str)
    assert len({r.record_id for r in rows}) == 8


def test_false_starts_are_passed_over_in_linear_time():
    import time

    def seconds(n):
        at = time.process_time()
        rows = list(warc.salvage(b"WARC/1.1\r\n" * n + one_record(1)))
        assert [r["record_type"] for r in rows] == ["gap", "response"]
        list(warc.salvage((b"WARC/1.1\r\n" + b"a: b\r\n" * 9) * (n // 7)))
        return time.process_time() - at

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(20_000), 0.02) and seconds(100_000) < 10


def one_record(k, body=b"payload"):
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    return head.encode() + http + body + b"\r\n\r\n"


def test_salvage_plain_and_members():
    a, b, c = (one_record(k) for k in (1, 2, 3))
    broken = b.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n")
    rows = list(warc.salvage(a + broken + b"junk" + c))
    assert [r.get("page_id") for r in rows if r["record_type"] != "gap"] == [1, 3]
    gap = next(r for r in rows if r["record_type"] == "gap")
    assert (gap["gap_start"], gap["gap_end"]) == (len(a), len(a) + len(broken) + 4) and "digest" in gap["reason"]
    za, zb, zc = (gzip.compress(x) for x in (a, b, c))
    hurt = zb[:40] + bytes([zb[40] ^ 255]) + zb[41:]
    rows = list(warc.salvage(za + hurt + zc))
    assert [r.get("page_id") for r in rows if r["record_type"] != "gap"][:: len(rows) - 2] == [1, 3]
    assert any(r["record_type"] == "gap" and r["gap_start"] == len(za) for r in rows)
    assert [r["record_type"] for r in warc.salvage(a[:-30])] == ["gap"] and list(warc.salvage(b"")) == []


def written(spark, path, n, kind):
    """The one file that write_warc makes of n pages with texts of their own."""
    from pathlib import Path

    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f" {k}")), 256) for k in range(8)]).alias("html"))
    warc.write_warc(warc.payload_table(pages).coalesce(1).sortWithinPartitions("page_id"), f"file://{path}", kind)
    (file,) = Path(path).glob("part-*")
    return file.read_bytes()


@pytest.mark.parametrize("kind", ["gzip", "none"])
def test_damage_in_the_middle_of_a_written_archive_costs_one_record(spark, tmp_path, kind):
    data = written(spark, f"{tmp_path}/{kind}", 60, kind)
    assert [r["page_id"] for r in warc.salvage(data)] == list(range(60))
    for part in (len(data) // 2, len(data) // 3):
        at = data.index(b"\x1f\x8b\x08" if kind == "gzip" else b"HTTP/1.1 200", part) + 100
        rows = list(warc.salvage(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]))
        gaps = [r for r in rows if r["record_type"] == "gap"]
        assert len(rows) == 60 and len(gaps) == 1 and gaps[0]["gap_start"] <= at < gaps[0]["gap_end"]
        assert gaps[0]["gap_end"] - gaps[0]["gap_start"] < len(data) / 50
    if kind == "gzip":
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 60


def test_drill_loses_only_damaged_records(spark, tmp_path):
    pages = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f" {k}")), 256) for k in range(4)]).alias("html"))
    warc.write_warc(warc.payload_table(pages), f"file://{tmp_path}/x", damaged=F.col("page_id") % 10 == 3)
    rows = warc.read_warc(spark, f"file://{tmp_path}/x").collect()
    assert sorted(r.page_id for r in rows if r.record_type != "gap") == [i for i in range(200) if i % 10 != 3]
    gaps = [r for r in rows if r.record_type == "gap"]
    assert 1 <= len(gaps) <= 20 and all(r.gap_end > r.gap_start and r.reason for r in gaps)


def test_drill_damages_members_that_bear_a_turned_byte(spark, tmp_path):
    rng = random.Random(1)
    # In long runs of a letter a match of another distance often copies the same bytes: some three of a hundred of these members do not mind.
    text = lambda: "".join("a" * 3000 + rng.choice("bc") * rng.randint(1025, 1500) + "a" * rng.randint(3, 200) for _ in range(30))
    pages = spark.createDataFrame([(i, "u", text()) for i in range(120)], "page_id long, url string, html string")
    warc.write_warc(warc.payload_table(pages), f"file://{tmp_path}/x", damaged=F.col("page_id") % 10 != 3)
    rows = warc.read_warc(spark, f"file://{tmp_path}/x", payloads=False).where("record_type <> 'gap'").collect()
    assert sorted(r.page_id for r in rows) == list(range(3, 120, 10))


def test_gaps_of_a_member_of_many_records_begin_after_what_was_recovered():
    import random

    rng = random.Random(1)
    data = gzip.compress(b"".join(one_record(k, rng.randbytes(2000)) for k in range(100)))
    at = len(data) // 2
    rows = list(warc.salvage(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]))
    assert len(rows) > 45 and [r["record_type"] for r in rows[-2:]] == ["response", "gap"]
    assert len(data) / 3 < rows[-1]["gap_start"] <= at and rows[-1]["gap_end"] == len(data)


def test_a_member_ends_in_a_zero_byte_whatever_its_length():
    big = one_record(1, b"x" * (1 << 24))[:-4]
    assert [r["page_id"] for r in warc.salvage(warc.member(big) + b"\0" + warc.member(one_record(2)[:-4]) + b"\0")] == [1, 2]


def test_records_of_other_writers_are_read():
    import base64
    import hashlib

    def other(kind, block, *more, content="application/http; msgtype=response"):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    sha1 = lambda x: "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n3;x=y\r\nped\r\n0\r\n\r\n"
    records = [
        other("warcinfo", b"software: x\r\n", content="application/warc-fields"),
        other("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", content="application/http; msgtype=request"),
        other("response", chunked, sha1(b"Wikiped")),
        other("metadata", b"fetchTimeMs: 1", "WARC-Payload-Digest: blake9:abc", content="application/warc-fields"),
        other("resource", b"bytes", sha1(b"bytes"), content="text/plain"),
        other("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", sha1(b"gone"), "WARC-Refers-To: <urn:uuid:response>"),
    ]
    kinds = ["warcinfo", "request", "response", "metadata", "resource", "revisit"]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), b"".join(records[:2]) + b"".join(map(gzip.compress, records[2:]))):
        rows = list(warc.salvage(data))
        assert [r["record_type"] for r in rows] == kinds
        assert [r["record_id"] for r in rows] == [f"<urn:uuid:{k}>" for k in kinds] and all(r["page_id"] is None for r in rows)
        assert rows[2]["payload"] == b"Wikiped" and rows[4]["payload"] == b"bytes" and rows[5]["refers_to_id"] == "<urn:uuid:response>"
    broken = records[4].replace(b"\r\n\r\nbytes", b"\r\n\r\nbytEs")
    rows = list(warc.salvage(records[0] + broken + gzip.compress(records[5])))
    assert [r["record_type"] for r in rows] == ["warcinfo", "gap", "revisit"] and rows[1]["gap_end"] == len(records[0] + broken)


# 10 near duplicates


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [(d, len(sets[i]), names.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_jaccard_components_match_brute_force(spark, empty):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(rng.randint(0, 40)) for _ in range(90)]
    rows = [(i, t) for i, (_, t, *_) in enumerate(ODD)] + [(None, "lost row"), (3, " \t\n")]
    for k in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((100 + k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    rows += [(300 + k, " ".join(base[:40] + [f"own{k}x{i}" for i in range(rng.randint(3, 60))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in jaccard_join.ngram_jaccard_components(df).collect()), key=key) == sorted(brute_components(rows), key=key)
    assert jaccard_join.ngram_jaccard_components(empty).count() == 0


def test_bitmap_bounds_overlap():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for _ in range(200):
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(2))
        assert jaccard_join.overlap_bound(len(a), jaccard_join.bitmap(a), len(b), jaccard_join.bitmap(b)) >= len(np.intersect1d(a, b))


def test_size_bands_hold_similar_sizes():
    edges = jaccard_join.size_band_edges(5000)
    band = np.searchsorted(edges, np.arange(5001), "right") - 1
    for n in range(1, 3700):
        assert band[min(4 * n // 3, 5000)] - band[n] <= 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} | {got[100]} == {0} and {got[i] for i in (200, 201, 202)} == {200} and 300 not in got


def test_mixing_of_the_given_tables_misses_little(spark):
    """Targets of the registered query on a given table: the miss is in each row and small, and is what the rates really leave."""
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    targets = {"clean": 0.94, "poor": 0.04, "toxic": 0.02}
    rows = mixing.mix_to_targets(docs, labels, domain, targets).collect()
    total = sum(r.n_tokens for r in rows)
    left = max(abs(sum(r.n_tokens * r.posteriors[k] * r.rate for r in rows) / total - t) for k, t in enumerate(targets.values()))
    assert left == pytest.approx(rows[0].remaining_miss, abs=1e-9) and left < 2e-3


def test_rates_of_targets_that_cannot_be_met(spark):
    """No document of the second domain: the rates are the least-squares ones, and the miss is what is missing."""
    members = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (30, [0.5, 0.0, 0.5]), (20, [0.0, 0.0, 1.0])], "n_tokens long, posteriors array<double>")
    steps, left = mixing.solve_rates(members, np.array([0.5, 0.3, 0.2]))
    rate = mixing.replay(np.array([[1.0, 0, 0], [0.5, 0, 0.5], [0, 0, 1.0]]), steps)[0]
    assert left == pytest.approx(0.3, abs=1e-3) and rate @ np.array([10 / 60, 15 / 60, 0]) == pytest.approx(0.5, abs=1e-3) and len(steps) < mixing.ITERATIONS
    assert mixing.solve_rates(members.limit(0), np.array([0.5, 0.3, 0.2])) == ([], 0.5)


def test_turns_of_no_conversation_have_no_place(spark):
    """Rows without conv_id have no place among each other, so no task has to order them; rows of conversations keep theirs."""
    turns = spark.range(4000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    turns = turns.unionByName(spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hello you"), (1, 2, "assistant", "yes")], "conv_id long, turn long, role string, text string"))
    out = chat_format.link_tool_calls(*chat_format.conversation_calls(turns), chat_format.CONVERSATION_TOOLS)
    assert out.where("conv_id is null").count() == 4000 and out.where("conv_id is null and position is not null").count() == 0
    assert sorted(r.position for r in out.where("conv_id = 1").collect()) == [1, 2]


def test_whole_texts_come_to_python_in_small_batches(spark):
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("some words "), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    got = storage.settle(docs.mapInArrow(sizes, "rows long, size long"), "sizes", texts=True).collect()
    assert sum(r.rows for r in got) == 400 and max(r["size"] for r in got) < 2 * storage.TEXT_BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == limit
