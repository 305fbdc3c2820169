"""As-of joins against plain loops, and learnt hurdles over folds of planted buckets."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import hurdles as H
from tidemark.operators import learned as L

DAY = dt.date(2020, 1, 1)


def facts_and_cutoffs(seed, tangled):
    draw, facts, cutoffs = random.Random(seed), [], []
    for s in range(6):
        public = 0
        for order in range(draw.randrange(0, 25)):
            public += draw.choice([0, 3, 30])
            at = draw.randrange(600) if tangled and s % 2 else public
            facts.append((s, DAY + dt.timedelta(days=at), order, draw.choice([None, float(order), 5.0])))
        facts.append((s, None, 99, 1.0))
        cutoffs += [(s, y, DAY + dt.timedelta(days=draw.randrange(-10, 700))) for y in range(5)]
    return [*facts, (None, DAY, 0, 7.0)], [*cutoffs, (50, 0, DAY), (None, 1, DAY)]


@pytest.mark.parametrize("tangled", [False, True])
def test_histories_known_at_many_cutoffs(spark, tangled):
    for n in (1, 3, 12):
        facts, cutoffs = facts_and_cutoffs(n, tangled)
        f = spark.createDataFrame(facts, "stock_id long, public date, o int, v double")
        c = spark.createDataFrame(cutoffs, "stock_id long, target_year int, as_of date")
        found = {(r.stock_id, r.target_year): ([x["_value"] for x in r.history], r.known) for r in A.history_known(c, f, "stock_id", ["stock_id", "target_year", "as_of"], "as_of", "public", "o", "v", n).collect()}
        for s, y, at in cutoffs:
            seen = sorted(((o, v) for i, p, o, v in facts if i == s and s is not None and p is not None and p <= at and v is not None), reverse=True)
            assert found[s, y] == ([v for _, v in seen[:n]], len(seen))
        assert len(found) == len(cutoffs)


def test_latest_known_at_many_cutoffs(spark):
    facts, cutoffs = facts_and_cutoffs(5, True)
    f = spark.createDataFrame(facts, "stock_id long, public date, o int, v double").where("v is not null")
    c = spark.createDataFrame(cutoffs, "stock_id long, target_year int, as_of date")
    found = {(r.stock_id, r.target_year): r.latest for r in A.latest_known(c, f, ["stock_id"], "as_of", "public", F.col("v"), "latest").collect()}
    for s, y, at in cutoffs:
        seen = [(p, v) for i, p, _, v in facts if i == s and s is not None and p is not None and p <= at and v is not None]
        assert found[s, y] == (max(seen)[1] if seen else None)
    assert len(found) == len(cutoffs) and A.latest_known(c.limit(0), f, ["stock_id"], "as_of", "public", F.col("v"), "latest").count() == 0


def test_as_of_joins_shuffle_facts_and_cutoffs_once_and_join_nothing(spark):
    facts, cutoffs = facts_and_cutoffs(1, False)
    f = spark.createDataFrame(facts, "stock_id long, public date, o int, v double")
    c = spark.createDataFrame(cutoffs, "stock_id long, target_year int, as_of date")
    plan = A.history_known(c, f, "stock_id", ["stock_id", "target_year", "as_of"], "as_of", "public", "o", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def planted(spark, small=4):
    """Payers whose dividend is a third of their earnings, others who repeat the last one whatever they earn, and a bucket of few rows."""
    draw, rows = random.Random(2), []
    for year in range(1994, 2001):
        for s in range(60 + small):
            eps, last = draw.uniform(1, 9), draw.uniform(1, 9)
            if s < 30:
                bucket, actual, last = "earners", eps / 3, draw.uniform(0, 9)
            elif s < 60:
                bucket, actual = "repeaters", last
            else:
                bucket, actual = "rare", last * 2
            rows.append((s, year, bucket, float(actual), last, last, last, 1.0 if bucket != "earners" else 0.5, 3, eps if bucket == "earners" else 0.0, eps * 4 if bucket == "earners" else 0.0, 100.0, 0.0 if bucket == "earners" else 1.0))
    columns = ["stock_id long", "target_year int", f"{H.BUCKET} string", "actual_cash_dividend double", *[f"{c} {'int' if c == 'dividend_history_count' else 'double'}" for c in L.HURDLE_FEATURES]]
    return spark.createDataFrame([r[:-1] for r in rows], ", ".join(columns))


def test_folds_choose_by_bucket_with_support_and_fallback(spark):
    samples = planted(spark).cache()
    errors = H.hurdle_errors(samples, [1998, 1999, 2000], thresholds=(0.4, 0.5)).cache()
    assert errors.select("method").distinct().count() == 3 + 2 * 2 and errors.count() == 3 * 64 * 7
    out = H.chosen_strategies(errors, [1998, 1999], 2000, 2, 15)
    choices = {r.bucket: (r.method, r.source) for r in out["choices"].collect()}
    assert "ridge" in choices["earners"][0] or "elastic" in choices["earners"][0]
    assert choices["repeaters"][0] in ("direct_hurdle_last_known", "direct_hurdle_recent_median") and choices["repeaters"][1] == "bucket"
    mean = {}
    for r in errors.where("target_year < 2000").collect():
        mean.setdefault(r.method, []).append(r.cash_dividend_abs_error)
    assert choices["rare"] == (min((sum(x) / len(x), m) for m, x in mean.items())[1], "global fallback")
    maes = {r.strategy: r for r in out["strategies"].collect()}
    assert maes["hindsight"].dividend_mae <= maes["bucket"].dividend_mae < maes["global"].dividend_mae and maes["bucket"].stocks == 64 and maes["bucket"].improvement > 0
    wins = {(r.source, r.winner): r.stocks for r in out["winners"].collect()}
    assert sum(wins.values()) == 64 and wins.get(("global fallback", "tie")) == 4
    with pytest.raises(ValueError, match="folds"):
        H.chosen_strategies(errors, [1999, 2000], 2000)


def test_folds_do_not_look_ahead(spark):
    samples = planted(spark)
    poisoned = samples.withColumn("actual_cash_dividend", F.when(F.col("target_year") == 2000, 1e6).otherwise(F.col("actual_cash_dividend")))
    pick = lambda x: {(r.stock_id, r.target_year, r.method): r.estimated_cash_dividend for r in H.hurdle_estimates(x, [1999, 2000], thresholds=(0.5,)).collect()}
    before, after = pick(samples), pick(poisoned)
    assert before.keys() == after.keys() and all(after[k] == pytest.approx(v) for k, v in before.items())


def test_comparison_marks_the_best_of_each_year(spark):
    errors = H.hurdle_errors(planted(spark), [1999, 2000], thresholds=(0.5,))
    rows = H.fold_comparison(errors).collect()
    assert len(rows) == 2 * 5 and sum(r.is_best for r in rows) == 2
    for year in (1999, 2000):
        mine = [r for r in rows if r.target_year == year]
        assert min(mine, key=lambda r: (r.dividend_mae, r.method)).is_best and all(r.paid_found + r.paid_missed == 64 and r.paid_false == 0 for r in mine)


def test_trees_and_eps_fits_read_written_samples(spark):
    from tests.test_sequence import panels, written_by

    data = panels(spark, {s: [1000.0 + 10 * t + 50 * s + 20 * (t % 12) for t in range(60)] for s in range(4)}, start=2017 * 12)
    rows, tables = written_by(lambda: L.pooled_trees(data, 2022, depths=(2,)))
    assert len(rows) == 48 and tables == ["tidemark-yearly-samples"]
    history = spark.createDataFrame([(s, y, 100.0 * s + y, 2.0 * s, 0.02) for s in range(1, 6) for y in (2019, 2020, 2021)], "stock_id long, revenue_year int, annual_revenue double, annual_eps double, eps_to_revenue_ratio double")
    annual = spark.createDataFrame([("m", 1, 2022, 2200.0)], "model string, stock_id long, target_year int, predicted_annual_revenue double")
    rows, tables = written_by(lambda: L.eps_regression(history, annual))
    assert len(rows) == 1 and tables == ["tidemark-ratio-history"]
