"""Importance resampling, segment search and ranked lexical search against plain loops, and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, ranked_search, segment_search
from tidemark.llm.textbatch import Terms, slices

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, n_words string, score string, _row int, bucket string"
ODD = [(1, None), (2, ""), (3, " \t\n,;"), (4, "One two, three-four five six."), (5, "one TWO three four five six"), (5, "one TWO three four five six"), (None, "lost row of seven or more words here"), (None, "lost row of seven or more words here"), (6, "word " * 30000), (7, "ÄÖ é x naïve 東京 " * 9), (8, "a" * 5000 + " " + "b" * 70 + " tail"), (9, "one two three four five six one two three four five six one two three four five six one two three")]


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", 0, "z") for i, t in pairs], TEXTS)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


# 11 Importance resampling


def features_of(text):
    w = terms_of(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain_resample(docs, target, percent, least_words):
    s, t = Counter(b for _, x in docs for b in features_of(x)), Counter(b for x in target for b in features_of(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc_id, text in docs:
        f = features_of(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms_of(text)) >= least_words])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): k for k, x in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted([(*x[:4], ranks.get(id(x))) for x in out], key=str)


def found_rows(df):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()], key=str)


def test_buckets_are_checksums_of_words_and_pairs():
    texts = [t for _, t in ODD]
    found = []
    for _, x in slices(pa.array(texts), made=Terms):
        one, head, two = importance.feature_buckets(x)
        for i in range(len(x)):
            inside = (head >= x.first[i]) & (head < x.first[i + 1])
            found.append(sorted([*one[x.first[i] : x.first[i + 1]].tolist(), *two[inside].tolist()]))
    assert found == [sorted(features_of(t)) for t in texts]


@pytest.mark.parametrize(("percent", "least"), [(25, 5), (100, 1), (60, 20)])
def test_resample_odd_rows(spark, percent, least):
    target = ["one two three", None, "naïve naïve", ""]
    df = importance.resample(rows_of(spark, ODD).repartition(3), rows_of(spark, [(0, t) for t in target]), percent=percent, least_words=least)
    assert found_rows(df) == plain_resample(ODD, target, percent, least)


def test_resample_of_a_table(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], 25, 20)
    assert found_rows(importance.resample(docs, target)) == plain


def test_resample_empty(spark):
    none = rows_of(spark, [])
    assert importance.resample(none, none).count() == 0
    assert found_rows(importance.resample(rows_of(spark, ODD), none, least_words=99999999)) == plain_resample(ODD, [], 25, 99999999)


@pytest.mark.parametrize("thin", [1, 16])
def test_cutoff_is_the_kth_key(spark, monkeypatch, thin):
    monkeypatch.setattr(importance, "THIN", thin)
    draw = random.Random(5)
    keys = [(draw.choice([0, 0, 0, draw.randrange(-50, 50)]), draw.choice([7, draw.randrange(9)]), i) for i in range(500)]
    df = spark.createDataFrame(keys, "score long, _doc long, _row long").repartition(5)
    order = sorted(keys, key=lambda x: (-x[0], x[1], x[2]))
    for k in (1, 2, 250, 499, 500):
        assert importance.cutoff_key(df, k) == order[k - 1]
    ranked = importance.ranked_winners(df, order[99], 100)
    assert [(r["score"], r["_doc"], r["_row"]) for r in ranked.orderBy("rank").collect()] == order[:100] and sorted(r["rank"] for r in ranked.collect()) == list(range(1, 101))


def test_cuts_discard_a_quarter():
    """Weighted medians of the medians of parts in the worst order still leave out a quarter of all keys."""
    draw = random.Random(3)
    for _ in range(50):
        parts = [sorted(draw.sample(range(10000), draw.randrange(1, 40))) for _ in range(draw.randrange(1, 9))]
        cut = -importance._weighted_median([(len(p), (-p[(len(p) - 1) // 2], 0, 0)) for p in parts])[0]
        every = [x for p in parts for x in p]
        low = sum(x <= cut for x in every)
        assert low >= len(every) / 4 and len(every) - low <= 3 * len(every) / 4 and sum(x >= cut for x in every) >= len(every) / 4


# 12 Segment search


def whole(v):
    return [math.floor(256 * x) for x in v]


def plain_top(rows, k, every):
    sound = [(r, i, whole(v)) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    edge = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    out = []
    for r, i, q in sound:
        if i % every == 0:
            near = sorted((-edge(sum(a * b for a, b in zip(q, v, strict=True))), j) for o, j, v in sound if o != r and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def check_top(spark, rows, every=2, k=3, parts=3):
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, b int").repartition(parts)
    found = segment_search.top_k(df, F.col("vec_id") % every == 0, k)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == plain_top(rows, k, every)


def test_segment_search_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [0.5, -0.001, 0.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [0.0, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (8, [1.0]), (10, []), (12, []), (14, [1.0, 2.0]), (16, [3e15, -3e15, 1.0]), (17, [3e15, 3e15, 3e15]), (18, [-0.001, 5.0, 0.25])]
    check_top(spark, rows)
    check_top(spark, [])
    check_top(spark, [(2, [1.0])])


def test_segment_search_blocks(spark, monkeypatch):
    monkeypatch.setattr(segment_search, "SMALL_BLOCK", 16)
    monkeypatch.setattr(segment_search, "QUERY_BLOCK", 40)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=9).round(1).tolist()) for i in range(150)] + [(i, [0.5] * 9) for i in range(150, 400)]
    check_top(spark, rows, parts=7)


def test_bounds_hold_and_tighten():
    draw = np.random.default_rng(2)
    for width in (1, 2, 5, 16, 33):
        x, y = np.floor(256 * draw.normal(size=(40, width))), np.floor(256 * draw.normal(size=(30, width)))
        true, before = x @ y.T, np.inf
        slack = segment_search.SLACK * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
        levels = segment_search.resolutions(width)
        assert levels == sorted(set(levels)) and levels[-1] == max(1, -(-width // 2))
        for s in levels:
            bound = segment_search.statistics(x, s) @ segment_search.statistics(y, s).T
            assert (bound + slack >= true).all()
            if width == 16:  # resolutions that divide each other
                assert (bound <= before + slack).all()
            before = bound


def test_smooth_vectors_leave_few_survivors(monkeypatch):
    """On vectors of smooth runs the coarse resolutions leave out nearly all pairs before any exact product."""
    draw, seen = np.random.default_rng(4), []
    level = np.repeat(draw.normal(size=(3000, 8)), 8, axis=1) + 0.05 * draw.normal(size=(3000, 64))
    v = np.floor(256 * level).astype(np.int64)
    monkeypatch.setattr(segment_search, "exact", lambda a, b, exact=segment_search.exact: (seen.append(len(a)), exact(a, b))[1])
    table = lambda at: pa.table({"row": at, "id": at, "v": pa.array(list(v[at])), "least": np.full(len(at), -np.inf)})
    out = segment_search._searched(5)(table(np.arange(3000)), table(np.arange(0, 3000, 50)))
    score = v[::50] @ v.T
    score[np.arange(60), np.arange(0, 3000, 50)] = -(1 << 60)
    assert sorted(out.column("score").to_pylist()) == sorted(np.sort(score, axis=1)[:, -5:].ravel().tolist()) and sum(seen) < 60 * 3000 / 20


# 13 Ranked lexical search


def plain_ranking(docs, items, k=50):
    held = [(r, i, Counter(terms_of(t))) for r, (i, t) in enumerate(docs)]
    held = [x for x in held if x[2]]
    n_docs, length = len(held), sum(sum(c.values()) for _, _, c in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item_id, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms_of(text)) if t in df}
        scores = []
        for _, i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            if (s := sum(w * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)) > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item_id, rank, None if unnamed else i, -s) for rank, (s, unnamed, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranking_rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


ITEMS = [(1, "one two three"), (1, "six"), (2, None), (3, ""), (None, "word lost"), (4, "absent terms only"), (5, "naïve 東京 a" + "a" * 4999), (6, "ONE one one, six!")]


@pytest.mark.parametrize("terms", [1 << 19, 3])
def test_ranking_of_odd_rows(spark, monkeypatch, terms):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", terms)
    docs = rows_of(spark, ODD).repartition(3)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, item int, doc string")
    assert ranking_rows(ranked_search.ranked_documents(docs, items, 3)) == plain_ranking(ODD, ITEMS, 3)


def test_ranking_empty(spark):
    none, items = rows_of(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.ranked_documents(none, items).count() == 0 and ranked_search.ranked_documents(rows_of(spark, ODD), items.limit(0)).count() == 0


def test_ranking_of_a_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = plain_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert ranking_rows(ranked_search.ranked_documents(docs, items)) == plain


def test_reads_end_with_members_ties_and_scores_resolved():
    """Lists of few values, so that scores tie, and of many; every answer equals the sums over whole lists."""
    draw = np.random.default_rng(6)
    for trial in range(60):
        n, v = int(draw.integers(1, 300)), int(draw.integers(1, 25))
        held = [np.sort(draw.choice(v, int(draw.integers(0, v + 1)), replace=False)) for _ in range(n)]
        terms = np.concatenate(held).astype(np.int64)
        counts = draw.integers(1, 3 if trial % 2 else 40, len(terms))
        weights = draw.integers(0, 9000, v)
        m = draw.choice([50, 100, 150], n)
        run = ranked_search._Run(np.arange(n) * 10, m, np.array([len(h) for h in held]), terms, counts, weights)
        asked = np.sort(draw.choice(v, int(draw.integers(1, v + 1)), replace=False))
        total = defaultdict(int)
        for d, t, c in zip(np.repeat(np.arange(n), [len(h) for h in held]).tolist(), terms.tolist(), counts.tolist(), strict=True):
            if t in asked:
                total[d] += int(weights[t]) * (1000000000 * c // (1000 * c + 20 * int(m[d])))
        for k, least in ((1, 1), (5, 1), (50, 1), (5, max(total.values(), default=1) // 2 + 1)):
            doc, score = run.search(asked, k, least)
            found = sorted(zip((-score).tolist(), doc.tolist(), strict=True))
            best = sorted((-s, d) for d, s in total.items() if s >= least)[:k]
            assert found[: len(best)] == best and all(total[d] == -s for s, d in found)
