"""Operators of the panel library on small fixtures: gaps, look-ahead, availability, metrics, selection."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import calendar as C
from tidemark.operators import cohorts as K
from tidemark.operators import finance as FI
from tidemark.operators import forecast as FC
from tidemark.operators import metrics as M
from tidemark.operators import quality as Q


def panel(spark, values, start=2019 * 12, stock=1, skip=()):
    rows = [(stock, (start + t) // 12, (start + t) % 12 + 1, float(v)) for t, v in enumerate(values) if t not in skip]
    return spark.createDataFrame(rows, "stock_id long, revenue_year int, revenue_month int, revenue double")


def wave(n=60):
    return [1000 + 8 * t + 80 * math.sin(2 * math.pi * t / 12) for t in range(n)]


def test_scalars(spark):
    row = spark.range(1).select(
        S.parse_percent(F.lit("12.5%")).alias("a"), S.parse_number(F.lit("1,234")).alias("b"), S.parse_local_year(F.lit("113年後半年度")).alias("c"), S.parse_local_year(F.lit("不適用")).alias("d"),
        S.statement_available_date(F.to_date(F.lit("2025-12-31"))).cast("string").alias("e"), S.revenue_available_date(F.lit(2025), F.lit(1)).cast("string").alias("f"),
        S.trailing_ones(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("g"), S.weighted_recent(F.array(F.lit(10.0), F.lit(20.0))).alias("h"), S.safe_round(F.lit(float("nan"))).alias("i"), S.percent_change(F.lit(1.0), F.lit(0.0)).alias("j"),
        S.method_threshold(F.lit("ridge_t045")).alias("k"), S.truth(F.lit(" TRUE ")).alias("l"), S.observed_price(F.lit("simulated close")).alias("m"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.i, row.j, row.k, row.l, row.m) == (0.125, 1234.0, 2024, None, "2026-03-31", "2025-02-10", 2, 0, None, 0.45, True, False)
    assert row.h == pytest.approx((10 * 0.5 + 20 * 0.3) / 0.8)


def test_growth_never_crosses_a_gap(spark):
    rows = C.revenue_features(panel(spark, [1000.0] * 12 + [1500.0] * 3, skip={11})).orderBy("month_index").collect()
    assert rows[11].mom is None and rows[11].calendar_segment == 2  # January after the missing December
    assert rows[11].yoy == pytest.approx(0.5) and rows[11].last_3m_revenue == 1500.0
    assert [r.consecutive_months for r in rows[10:13]] == [11, 1, 2]


def test_formula_does_not_look_ahead_and_marks_gaps(spark):
    values = wave()
    key = lambda r: (r.target_year, r.target_month)
    before = {key(r): r.formula_adjusted_revenue for r in FC.formula_forecast(panel(spark, values)).collect()}
    after = {key(r): r.formula_adjusted_revenue for r in FC.formula_forecast(panel(spark, values[:40] + [v * 100 for v in values[40:]])).collect()}
    cut = (2019 + 40 // 12, 40 % 12 + 1)
    assert all(before[k] == after[k] for k in before if k <= cut)
    gap = {key(r): r for r in FC.formula_forecast(panel(spark, values, skip={40})).collect()}
    assert gap[(2019 + 41 // 12, 41 % 12 + 1)].forecast_method == "missing_prediction"


def test_formula_matches_a_plain_loop(spark):
    values, config, state, want = wave(), FC.FormulaConfig(), 0.0, []
    for t, v in enumerate(values):
        h = values[:t]
        if t < 15:
            want.append(h[-12] if t >= 12 else h[-1] if h else None)
            continue
        g = sorted(math.log1p(h[-k]) - math.log1p(h[-k - 12]) for k in (1, 2, 3))[1]
        g = max(min(g, config.growth_log_cap), -config.growth_log_cap)
        base = math.expm1(0.75 * math.log1p(math.expm1(math.log1p(h[-12]) + g)) + 0.25 * math.log1p(h[-1]))
        want.append(math.expm1(math.log1p(base) + max(min(0.5 * state, 0.5), -0.5)))
        state = 0.2 * (math.log1p(v) - math.log1p(base)) + 0.8 * state
    got = [r.formula_adjusted_revenue for r in FC.formula_forecast(panel(spark, values)).orderBy("month_index").collect()]
    assert got == pytest.approx(want)


def test_collapse_is_a_structural_break(spark):
    rows = panel(spark, [1000.0] * 12 + [10.0, 8.0, 9.0])
    formula = FC.formula_forecast(rows).select("stock_id", "target_year", "target_month", "last_observed_revenue", "formula_adjusted_revenue")
    config = FC.BreakConfig(formula_retention=0.0)
    last = FC.apply_breaks(formula.join(FC.break_features(rows), ["stock_id", "target_year", "target_month"]), config).orderBy(F.desc("target_year"), F.desc("target_month")).first()
    assert last.structural_break_detected and last.formula_adjusted_revenue == 8.0


def test_recursive_and_arima_forecasts_are_sane(spark):
    rows = panel(spark, wave())
    path = [r.predicted_revenue for r in FC.recursive_forecast(rows, 6).orderBy("step").collect()]
    assert len(path) == 6 and all(1200 < p < 1800 for p in path)
    second = FC.seasonal_arima_forecast(rows).orderBy("target_year", "target_month").collect()
    assert {r.second_method for r in second} == {"seasonal_arima", "seasonal_naive", "missing_prediction"}
    assert second[-1].second_revenue == pytest.approx(wave()[-1], rel=0.05)


def test_arima_tries_all_nine_orders_on_the_whole_history(spark):
    import itertools
    import math
    import random

    rng = random.Random(5)
    w, e = [], []
    for t in range(115):
        at = lambda s, k, t=t: s[t - k] if t >= k else 0.0
        e.append(rng.gauss(0, 0.05))
        w.append(-0.6 * at(w, 1) + e[t] - 0.8 * at(e, 12))
    y = [6.0 + 0.01 * t for t in range(13)]
    for d in w:
        y.append(d + y[-1] + y[-12] - y[-13])
    rows = FC.seasonal_arima_forecast(panel(spark, [math.expm1(v) for v in y])).orderBy("target_year", "target_month").collect()
    last, t = rows[-1], len(y) - 1
    assert last.second_method == "seasonal_arima" and (last.arima_order, last.seasonal_order) == ("(1, 1, 0)", "(0, 1, 1, 12)")

    def sums(p, q, sp, sq, n):
        """Sum of squares of the first n residuals, and the step after them."""
        r, total = [], 0.0
        for k in range(n + 1):
            at = lambda s, j, k=k: s[k - j] if k >= j else 0.0
            step = p * at(w, 1) + sp * at(w, 12) - p * sp * at(w, 13) + q * at(r, 1) + sq * at(r, 12) + q * sq * at(r, 13)
            if k == n:
                return total, step
            r.append(w[k] - step)
            total += r[-1] ** 2

    n = t - 13
    total, p, sq, step = min((*sums(p, 0.0, 0.0, sq, n)[:1], p, sq, sums(p, 0.0, 0.0, sq, n)[1]) for p, sq in itertools.product(FC.ARIMA_GRID, FC.ARIMA_GRID))
    assert (last.phi, last.seasonal_theta, last.theta, last.seasonal_phi) == (p, sq, 0.0, 0.0) and p < 0 and sq < 0
    assert last.aic == pytest.approx(n * math.log(total / n) + 6.0)
    assert math.log1p(last.second_revenue) == pytest.approx(y[-2] + y[-12 - 1] - y[-13 - 1] + step)


def test_metrics(spark):
    rows = spark.createDataFrame([("m", 1, 100.0, 110.0, 90.0), ("m", 1, 200.0, 180.0, 190.0)], "model string, stock_id long, actual_revenue double, predicted_revenue double, last_observed_revenue double")
    r = M.accuracy(rows, "model").first()
    assert (r.MAE, r.WMAPE, r.Bias, r.UnderestimateRate, r.DirectionAccuracy) == (15.0, 10.0, -5.0, 50.0, 50.0)
    assert (r.MAPE, r.MedianAPE) == (pytest.approx(10.0), pytest.approx(10.0))


def test_only_published_evidence_counts(spark):
    revenue = panel(spark, [100.0] * 48, start=2021 * 12)
    eps = spark.createDataFrame([(1, y, q, 100.0 if y == 2024 else 3.0) for y in range(2021, 2025) for q in range(1, 5)], "stock_id long, eps_year int, eps_quarter int, EPS double")
    eps = eps.withColumn("date", F.last_day(F.make_date("eps_year", F.col("eps_quarter") * 3, F.lit(1)))).withColumn("statement_available_date", S.statement_available_date(F.col("date")))
    paid = spark.createDataFrame([(1, y, 99.0 if y == 2024 else 6.0, f"{y + 1}-06-01", f"{y + 1}-07-01") for y in range(2021, 2025)], "stock_id long, fiscal_year int, TotalCashDividend double, a string, x string")
    paid = paid.select("stock_id", "fiscal_year", "TotalCashDividend", F.to_date("a").alias("available_date"), F.to_date("x").alias("ex_dividend_date"))
    prices = spark.createDataFrame([(1, "2024-12-31", 80.0), (1, "2025-01-31", 100.0)], "stock_id long, d string, close double").select("stock_id", F.to_date("d").alias("date"), "close")
    predictions = spark.createDataFrame([("m", 1, 2025, m, 200.0) for m in range(1, 13)], "model string, stock_id long, target_year int, target_month int, predicted_revenue double")
    out = FI.financial_forecast(predictions, revenue, eps, paid, prices, 2025, "2025-01-10")
    e = out["eps"].where("eps_method = 'current_ratio'").first()
    assert e.estimated_eps == pytest.approx(24.0)  # 2400 of revenue at 12 / 1200
    d = out["dividends"].where("eps_method = 'current_ratio'").first()
    assert d.estimated_cash_dividend == pytest.approx(12.0) and d.actual_cash_dividend == 99.0
    y = {(r.yield_mode, r.target_month): r for r in out["yields"].where("eps_method = 'current_ratio'").collect()}
    assert y[("as_of_price", None)].estimated_yield_percent == pytest.approx(15.0) and y[("as_of_price", None)].actual_yield_percent is None
    assert y[("target_month_end", 12)].stock_price == 100.0
    failed = FI.annual_predictions(predictions.where("target_month < 12"))[1].first()
    assert failed.reason == "incomplete year"


def test_dividend_patterns(spark):
    years = range(2020, 2025)
    cases = {1: [10, 10.2, 9.9, 10, 10.1], 2: [0] * 5, 3: [1, 0, 5, 2, 3], 4: [1, None, None, None, 2], 5: [1, -1, 1, None, None]}
    rows = [(s, y, None if v is None else float(v)) for s, c in cases.items() for y, v in zip(years, c, strict=True)]
    paid = spark.createDataFrame(rows, "stock_id long, fiscal_year int, TotalCashDividend double").withColumn("available_date", F.make_date(F.col("fiscal_year") + 1, F.lit(6), F.lit(1))).where("fiscal_year < 2024 or stock_id > 0")
    paid = paid.withColumn("available_date", F.to_date(F.lit("2024-12-01")))
    eps = spark.createDataFrame([(s, y, 5.0) for s in cases for y in years], "stock_id long, eps_year int, annual_eps double").withColumn("latest_available_date", F.to_date(F.lit("2024-12-01")))
    history = FI.five_years(spark.createDataFrame([(s,) for s in cases], "stock_id long"), eps, paid, "2025-01-10")
    got = {r.stock_id: r.dividend_pattern for r in FI.dividend_patterns(history).collect()}
    assert got == {1: "fixed", 2: "none", 3: "normal", 4: "insufficient", 5: "insufficient"}


def test_audit_and_guards(spark):
    a = panel(spark, wave(24))
    checks = {r.check: r.rows for r in Q.panel_checks(panel(spark, wave(24), skip={5})).collect()}
    assert checks == {"null_key": 0, "month_out_of_range": 0, "duplicate_key": 0, "interior_gap": 1, "negative_value": 0}
    d = Q.numeric_diff(a, a.withColumn("revenue", F.when(F.col("revenue_month") == 1, F.col("revenue") + 1).otherwise(F.col("revenue"))), ["stock_id", "revenue_year", "revenue_month"], ["revenue"]).first()
    assert (d.compared, d.different) == (24, 2)
    with pytest.raises(Exception, match="repeated key"):
        Q.assert_unique(a.union(a), ["stock_id", "revenue_year", "revenue_month"]).collect()
    assert {r.issue for r in Q.validate({"revenue": a.drop("revenue")}, spark).collect()} >= {"missing column revenue", "missing dataset"}


def test_selection(spark):
    scores = spark.createDataFrame([("a", "x", 1.0, 9), ("a", "y", 2.0, 9), ("b", "x", 3.0, 2)], "bucket string, method string, mean_error double, rows int")
    got = {r.bucket: (r.method, r.source) for r in K.select_by_bucket(scores, "y").collect()}
    assert got == {"a": ("x", "bucket"), "b": ("y", "global fallback")}
    t = spark.createDataFrame([(0.3, 5.0), (0.6, 5.0), (0.9, 6.0)], "threshold double, WMAPE double")
    assert K.select_threshold(t, "WMAPE").first().threshold == 0.6
    p = spark.createDataFrame([("f", 1, 2000, 1, 1.0), ("g", 1, 2000, 1, 1.0), ("f", 1, 2000, 2, 1.0)], "model string, stock_id long, target_year int, target_month int, predicted_revenue double").withColumn("actual_revenue", F.lit(1.0))
    assert K.comparable_cohort(p, ["f", "g"]).count() == 2
    assert {r.issue for r in K.cohort_issues(p, ["f", "h"]).collect()} == {"missing model"}


def test_entry_and_catalog():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "flagship_industry_accuracy" in e.queries()


def _plain_states(values, alpha, config):
    """The formula's forecasts by a plain loop."""
    state, want = 0.0, []
    for t, v in enumerate(values):
        if t < 15:
            want.append(None)
            continue
        h = values[:t]
        growth = sorted(math.log1p(h[t - k]) - math.log1p(h[t - k - 12]) for k in (1, 2, 3))[1]
        growth = max(min(growth, config.growth_log_cap), -config.growth_log_cap)
        seasonal = max(math.expm1(math.log1p(h[t - 12]) + growth), 0.0)
        base = max(math.expm1(config.seasonal_weight * math.log1p(seasonal) + (1 - config.seasonal_weight) * math.log1p(h[t - 1])), 0.0)
        corr = max(min(config.residual_strength * state, config.correction_log_cap), -config.correction_log_cap)
        want.append(max(math.expm1(math.log1p(base) + corr), 0.0))
        state = (1 - alpha) * state + alpha * (math.log1p(v) - math.log1p(base))
    return want


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_formula_over_long_histories(spark, alpha):
    values = [v * (1.3 if t % 7 == 3 else 1.0) for t, v in enumerate(wave(480))]
    config = FC.FormulaConfig(residual_alpha=alpha)
    rows = FC.formula_forecast(panel(spark, values, start=1900 * 12), config).orderBy("month_index").collect()
    want = _plain_states(values, alpha, config)
    assert all(r.formula_adjusted_revenue == pytest.approx(x, rel=1e-9) for r, x in zip(rows, want, strict=True) if x is not None)


def test_formula_refuses_odd_alphas(spark):
    for alpha in (-0.1, 1.1):
        with pytest.raises(ValueError, match="residual_alpha"):
            FC.formula_forecast(panel(spark, wave()), FC.FormulaConfig(residual_alpha=alpha))


CONFIGS = [(0, 0.75, 0.2, 0.5, math.log(2.0), 0.5), (1, 1.0, 0.2, 0.0, math.log(2.0), 0.5), (2, 0.0, 0.2, 0.0, math.log(2.0), 0.5)]
CONFIG_COLUMNS = "config_id int, seasonal_weight double, residual_alpha double, residual_strength double, growth_log_cap double, correction_log_cap double"


def test_settings_tuned_for_each_entity(spark):
    """A seasonal entity takes the seasonal setting, a random walk the last value; the target year has no say."""
    import random

    draw, walk = random.Random(4), [1000.0]
    for _ in range(59):
        walk.append(walk[-1] * draw.uniform(0.7, 1.4))
    season = [1000.0 + 900 * math.sin(2 * math.pi * t / 12) for t in range(60)]
    both = panel(spark, season).unionByName(panel(spark, walk, stock=2)).unionByName(panel(spark, wave(20), start=2022 * 12 + 4, stock=3))
    configs = spark.createDataFrame(CONFIGS, CONFIG_COLUMNS)
    tuned = FC.tuned_formula(both, configs, 2022, 2023)
    chosen = {r.stock_id: r.config_id for r in tuned.select("stock_id", "config_id").distinct().collect()}
    assert chosen[1] == 1 and chosen[2] == 2 and chosen[3] in (0, 1, 2)
    each = {(r.config_id, r.stock_id, r.target_month): r.formula_adjusted_revenue for r in FC.formula_forecast(both, configs=configs).where("target_year = 2023").collect()}
    assert all(r.predicted_revenue == each[r.config_id, r.stock_id, r.target_month] and r.untuned_revenue == each[0, r.stock_id, r.target_month] for r in tuned.collect())
    changed = both.withColumn("revenue", F.when(F.col("revenue_year") == 2023, F.col("revenue") * 50).otherwise(F.col("revenue")))
    assert {r.stock_id: r.config_id for r in FC.tuned_formula(changed, configs, 2022, 2023).collect()} == chosen
    late = FC.tuned_formula(panel(spark, wave(14), start=2023 * 12 - 2), configs, 2021, 2023).collect()
    assert len(late) == 12 and all(r.config_id is None and r.predicted_revenue == r.untuned_revenue for r in late)
    with pytest.raises(ValueError, match="validation year"):
        FC.tuned_formula(both, configs, 2023, 2023)


def test_exact_quantiles_by_blocks(spark):
    import random

    import numpy as np

    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 0.0, draw.gauss(0, 100), float(draw.randrange(5)), -1e9])) for _ in range(3000)] + [("hot", 7.0)] * 2000 + [("hot", 1.0), ("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(5)
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)
    found = {r.kind: r.quantiles for r in M.exact_quantiles(df, "v", qs, "kind").collect()}
    assert set(found) == {"a", "b", None, "hot", "one"}
    for kind, got in found.items():
        assert got == pytest.approx(np.quantile([v for k, v in rows if k == kind and v is not None], qs).tolist(), rel=1e-12, abs=1e-9)
    same = df.where("kind = 'a'").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("q")).first().q
    assert found["a"] == same  # as Spark's own, to the last bit
    (everything,) = M.exact_quantiles(df, "v", (0.5,)).collect()
    assert everything.quantiles == pytest.approx([float(np.median([v for _, v in rows if v is not None]))])
    assert M.exact_quantiles(df.limit(0), "v", (0.5,)).count() == 0
    plan = M.exact_quantiles(df, "v", (0.5,), "kind")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "percentile(" not in plan
    # Without groups the blocks (at most 256 rows) meet in one task, and nothing else does.
    plan = M.exact_quantiles(df, "v", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2


#: Dates of the lunar new year.
LUNAR = "1985-02-20 1990-01-27 1991-02-15 1992-02-04 1993-01-23 1994-02-10 1995-01-31 1996-02-19 1997-02-07 1998-01-28 1999-02-16 2000-02-05 2001-01-24 2002-02-12 2003-02-01 2004-01-22 2005-02-09 2006-01-29 2007-02-18 2008-02-07 2009-01-26 2010-02-14 2011-02-03 2012-01-23 2013-02-10 2014-01-31 2015-02-19 2016-02-08 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 2022-02-01 2023-01-22 2024-02-10 2025-01-29 2026-02-17 2027-02-06 2028-01-26 2029-02-13 2030-02-03 2033-01-31"


def test_lunar_new_year_by_astronomy(spark):
    years = [(int(d[:4]),) for d in LUNAR.split()]
    rows = spark.createDataFrame(years, "y int").select("y", S.lunar_new_year_date(F.col("y")).cast("string").alias("d")).collect()
    assert [r.d for r in rows] == LUNAR.split()
    flags = spark.createDataFrame(years, "y int").select("y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")).select("y", "m", S.lunar_new_year_flag(F.col("y"), F.col("m")).alias("f")).where("f = 1").collect()
    assert sorted((r.y, r.m) for r in flags) == sorted((int(d[:4]), int(d[5:7])) for d in LUNAR.split())
    # The table's years agree with what is computed.
    assert all(S.LUNAR_NEW_YEAR_MONTH[int(d[:4])] == int(d[5:7]) for d in LUNAR.split() if int(d[:4]) in S.LUNAR_NEW_YEAR_MONTH)


def test_ranks_of_a_value_that_most_rows_share(spark):
    """Ranks are those of a sort, and no block holds more than a small part of the rows."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 < 7, 5.0).otherwise((F.col("id") * 7919 % 97).cast("double")).alias("v")).repartition(5)
    got = {r.id: (r["rank"], r["tile"]) for r in M.ranked(rows, "v", "id", 7).collect()}
    value = lambda i: 5.0 if i % 10 < 7 else float(i * 7919 % 97)
    order = sorted(range(4000), key=lambda i: (value(i), i))
    assert [got[i][0] for i in order] == list(range(1, 4001))
    assert [sum(t == k for _, t in got.values()) for k in range(1, 8)] == [572, 572, 572, 571, 571, 571, 571]
    named = rows.withColumn("id", F.col("id").cast("string"))
    assert sorted(r["rank"] for r in M.ranked(named, "v", "id", 7).collect()) == list(range(1, 4001))
    assert M.ranked(rows.limit(0), "v", "id", 7).count() == 0


def test_live_core_from_facts_and_forecasts(spark):
    """Ten months and three quarters of 2019 are known in mid November, nothing of 2020; dividends have been the same for five years."""
    import datetime as dt

    from tidemark.functions.scalars import statement_available_date
    from tidemark.operators import studies as ST

    months = spark.createDataFrame([(s, y, m, 100.0 * s) for s in (1, 2) for y in range(2014, 2020) for m in range(1, 13)], "stock_id long, revenue_year int, revenue_month int, revenue double")
    forecast = spark.createDataFrame([(s, y, m, 100.0 * s) for s in (1, 2) for y in (2019, 2020) for m in range(1, 13) if (s, y) != (2, 2020)], "stock_id long, target_year int, target_month int, predicted_revenue double")
    quarters = [(s, dt.date(y, 3 * q, 28), y, q, 30.0 * s) for s in (1, 2) for y in range(2014, 2020) for q in range(1, 5)]
    eps = spark.createDataFrame(quarters, "stock_id long, date date, eps_year int, eps_quarter int, EPS double").withColumn("statement_available_date", statement_available_date(F.last_day("date")))
    cash = spark.createDataFrame([(1, y, 20.0, dt.date(y + 1, 6, 10), dt.date(y + 1, 7, 2)) for y in range(2012, 2019)], "stock_id long, fiscal_year int, TotalCashDividend double, available_date date, ex_dividend_date date")
    prices = spark.createDataFrame([(1, dt.date(2019, 11, 14), 50.0), (1, dt.date(2019, 12, 1), 999.0)], "stock_id long, date date, close double")
    rows = ST.live_core(months, forecast, eps, cash, prices, months.select("stock_id").distinct(), "2019-11-15", (2019, 2020))
    got = {(r.stock_id, r.target_year): r for r in rows.collect()}
    assert set(got) == {(1, 2019), (1, 2020), (2, 2019)}  # no forecast for the second entity's 2020, so no whole year
    now, ahead, other = got[1, 2019], got[1, 2020], got[2, 2019]
    assert (now.known_months, now.known_quarters, ahead.known_months, ahead.known_quarters) == (10, 3, 0, 0)
    assert now.predicted_annual_revenue == 1200 and now.estimated_eps == pytest.approx(120) and ahead.estimated_eps == pytest.approx(120)
    assert now.dividend_pattern == "fixed" and now.estimated_cash_dividend == 20 and now.estimated_yield_percent == pytest.approx(40)
    assert other.dividend_pattern == "insufficient" and other.estimated_cash_dividend is None and other.estimated_yield_percent is None


def test_blend_weights_are_scored_on_rows_that_are_joined_once(spark):
    from tidemark.operators import studies as ST

    keys = "stock_id long, target_year int, target_month int"
    formula = spark.createDataFrame([(s, 2020, m, 100.0, 110.0, 100.0) for s in (1, 2) for m in range(1, 13)], f"{keys}, formula_adjusted_revenue double, actual_revenue double, last_observed_revenue double")
    second = spark.createDataFrame([(s, 2020, m, 120.0 if s == 1 else 5000.0, "other") for s in (1, 2) for m in range(1, 13)], f"{keys}, second_revenue double, second_method string")
    rows = {r.second_weight: r for r in ST.blend_scores(formula, second, (0.0, 0.5, 1.0), FC.HybridConfig(second_method="other")).collect()}
    # The second entity's forecast is out of bounds, so only the first has both.
    assert {r.observations for r in rows.values()} == {12} and [rows[w].WMAPE for w in (0.0, 0.5, 1.0)] == pytest.approx([100 / 11, 0, 100 / 11])
    assert ST.blend_scores(formula, second, (0.5,)).count() == 0  # of another method
    plan = ST.blend_scores(formula, second)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # exploded above the join


def test_sizes_that_only_the_order_of_rows_tells_apart_are_equal(spark):
    from tidemark.operators import reports as RP

    # In this order the doubles sum to 0.6000000000000001 and to 0.6.
    rows = [(1, "up", v) for v in (0.1, 0.2, 0.3)] + [(2, "up", v) for v in (0.3, 0.2, 0.1)]
    out = RP.dominant_category(spark.createDataFrame(rows, "stock_id long, kind string, value double").coalesce(1), "kind", ("up", "down"), "value")
    assert [(r.stock_id, r.total, r.size_quartile) for r in out.orderBy("stock_id").collect()] == [(1, 0.6, 1), (2, 0.6, 2)]


def test_break_sweep_sums_settings_where_entities_lie(spark):
    from tidemark.operators import studies as ST

    data = panel(spark, wave(72), start=2015 * 12).unionByName(panel(spark, [v * (0.1 if t > 55 else 2) for t, v in enumerate(wave(72))], start=2015 * 12, stock=2))
    keys = ["stock_id", "target_year", "target_month"]
    rows = FC.formula_forecast(data).where("target_year = 2020")
    second = rows.select(*keys, F.col("seasonal_naive_revenue").alias("second_revenue"), F.lit("seasonal_arima").alias("second_method"))
    featured = rows.select(*keys, "formula_adjusted_revenue", "actual_revenue", "last_observed_revenue").join(FC.break_features(data), keys)
    out = ST.break_sweep(featured, second)
    got = {(r.yoy_threshold, r.level_threshold, r.retention, r.second_weight): r for r in out.collect()}
    assert len(got) == 297
    # One setting by the plain operators: breaks replaced, blended, scored.
    broken = FC.apply_breaks(featured, FC.BreakConfig(0.2, 0.3, 0.1, 0.3))
    plain = M.balanced_score(FC.combine_forecasts(broken, second, FC.HybridConfig(second_weight=0.4)).where("both_models_valid").withColumn("k", F.lit(1)), "k", predicted="hybrid_predicted_revenue").first()
    r = got[0.2, 0.3, 0.1, 0.4]
    assert (r.observations, r.WMAPE, r.median_stock_WMAPE, r.balanced_score) == pytest.approx((plain.observations, plain.WMAPE, plain.median_stock_WMAPE, plain.balanced_score))
    # No shuffle lies between the exploded settings and the sums by entity.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(yoy_threshold" in line and "stock_id" in line for line in plan.splitlines())
