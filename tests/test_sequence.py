"""Sequence forecasts on planted panels: heads for regimes, direct targets, parts of a sine with trend, assembly, scenarios."""

from __future__ import annotations

import math
import random
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_panel import CONFIG_COLUMNS, CONFIGS, panel, wave
from tidemark.operators import sequence as SQ
from tidemark.sources import artifacts


def panels(spark, series, start=2015 * 12):
    rows = [(stock, (start + t) // 12, (start + t) % 12 + 1, float(v)) for stock, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "stock_id long, revenue_year int, revenue_month int, revenue double")


def test_pooled_fit_is_least_squares(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 2)) * [3, 40] + [5, -7]
    y = 2 + x @ [1.5, -0.25] + draw.normal(size=200)
    df = spark.createDataFrame([(float(c), float(a), float(b)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (1.0, None, 1.0)], "y double, a double, b double")
    line = SQ.pooled_fit(df, "y", "a", "b")
    assert (line.base, line.first, line.second) == pytest.approx(np.linalg.lstsq(np.column_stack((np.ones(200), x)), y, rcond=None)[0].tolist())
    twin = SQ.pooled_fit(df.withColumn("b", F.col("a") * 2), "y", "a", "b")
    assert twin.second == 0 and twin.first == pytest.approx(np.polyfit(x[:, 0], y, 1)[0], rel=1e-2)
    assert SQ.pooled_fit(df.limit(0), "y", "a", "b") == SQ.Line(0.0, 0.0, 0.0)


def two_regimes(seed=7, stocks=24, months=96):
    """Growing stocks whose next month is the last one times 1.04, and alternating ones that swing between two levels."""
    draw, out = random.Random(seed), {}
    for s in range(stocks):
        level, values = draw.uniform(500, 1500), []
        for t in range(months):
            values.append(level * (1.04 ** t if s % 2 else (1.6 if t % 2 else 1.0)) * draw.uniform(0.99, 1.01))
        out[s] = values
    return out


def error_of(df):
    return df.agg((F.sum(F.abs(F.col("predicted_revenue") - F.col("actual_revenue"))) / F.sum("actual_revenue")).alias("e")).first().e


def test_heads_for_clusters_beat_one_for_all(spark):
    """What follows a window depends on its regime in a way that no one line over levels holds: the cluster's own head has it."""
    data = panels(spark, two_regimes())
    # The same levels go up in one regime and down in the other: heads differ in sign.
    flip = data.where("stock_id % 2 = 0").withColumn("revenue", 1e6 / F.col("revenue")).withColumn("stock_id", F.col("stock_id") + 100)
    both = data.unionByName(flip).cache()
    none = spark.createDataFrame([], "stock_id long, month_index int, cluster int")
    heads = error_of(SQ.conditioned_sequence_regression(both, 2021, 2022, k=3))
    shared = error_of(SQ.conditioned_sequence_regression(both, 2021, 2022, k=0, clusters=none))
    assert heads < 0.8 * shared


def test_clusters_do_not_look_ahead(spark):
    data = panels(spark, two_regimes(months=90)).cache()
    later = data.withColumn("revenue", F.when((F.col("revenue_year") == 2022) & (F.col("revenue_month") >= 4), F.col("revenue") * F.when(F.col("revenue_month") % 3 == 0, 9).otherwise(0.1)).otherwise(F.col("revenue")))
    rows = lambda d: {(r.stock_id, r.target_month): (r.cluster, r.predicted_revenue) for r in SQ.conditioned_sequence_regression(d, 2021, 2022, k=3).where("target_month <= 4").collect()}
    before, after = rows(data), rows(later)
    assert len(before) == 96 and all(after[k][0] == c and after[k][1] == pytest.approx(p) for k, (c, p) in before.items())


def test_direct_target_learns_only_from_targets_that_ended(spark):
    data = panels(spark, {s: [v * (1 + s / 10) for v in wave(60)] for s in range(4)}, start=2019 * 12)
    found = {(r.stock_id, r.month_index): r for r in SQ.direct_horizon_forecast(data, 2023).collect()}
    assert len(found) == 4 * 10 and min(k[1] for k in found) == 2023 * 12
    assert all(r.predicted_3m == pytest.approx(r.actual_sum, rel=0.05) for r in found.values())
    changed = data.withColumn("revenue", F.when(F.col("revenue_year") == 2023, F.col("revenue") * 7).otherwise(F.col("revenue")))
    first = {k: r.predicted_3m for k, r in found.items() if k[1] == 2023 * 12}
    again = {(r.stock_id, r.month_index): r.predicted_3m for r in SQ.direct_horizon_forecast(changed, 2023).collect()}
    assert all(again[k] == pytest.approx(v) for k, v in first.items())
    # By numpy: windows whose three months end before 2023.
    x, y = [], []
    for s in range(4):
        v = [u * (1 + s / 10) for u in wave(60)]
        for t in range(11, 48 - 3):
            x.append([1, math.log1p(sum(v[t - 2 : t + 1])), math.log1p(sum(v[t - 11 : t - 8]))])
            y.append(math.log1p(sum(v[t + 1 : t + 4])))
    b = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
    v = wave(60)
    assert found[0, 2023 * 12].predicted_3m == pytest.approx(math.expm1(b @ [1, math.log1p(sum(v[45:48])), math.log1p(sum(v[36:39]))]), rel=1e-6)


def test_parts_of_a_sine_with_trend(spark):
    """Both parts are predicted within a few hundredths, and together they beat the last month by far."""
    data = panel(spark, wave(84), start=2016 * 12)
    rows = SQ.trend_cycle_forecasts(data, 2021, 2022).join(data.withColumn("month_index", F.col("revenue_year") * 12 + F.col("revenue_month") - 1), ["stock_id", "month_index"]).orderBy("month_index").collect()
    v = wave(84)
    assert len(rows) == 12
    for t, r in enumerate(rows, 72):
        trend = sum(v[t - 11 : t + 1]) / 12
        assert r.trend_prediction == pytest.approx(trend, rel=0.01) and r.cycle_prediction == pytest.approx(v[t] - trend, abs=12)
    summed = sum(abs(r.trend_prediction + r.cycle_prediction - r.revenue) for r in rows)
    assert summed < 0.35 * sum(abs(v[t] - v[t - 1]) for t in range(72, 84))
    assert SQ.trend_cycle_forecasts(panel(spark, wave(10), start=2022 * 12), 2021, 2022).count() == 0


def test_assembly_keeps_every_stage(spark):
    columns = "stock_id long, month_index int, predicted_revenue double, last_observed_revenue double, window_max double, growth_signal double, regime string, growth_phase boolean, high_growth boolean, growth_rate double, growth_ratio double, growth_streak int, trend_prediction double, cycle_prediction double, trend_slope_rate double, cycle_volatility_6m double"
    grown = (0.5, "growth", True, True, 0.2, 0.8, 5)
    rows = [
        (1, 0, 9000.0, 100.0, 200.0, *grown, 1.0, 1.0, 0.0, 1.0),  # cut to 800, boosted to 1120, cut to 800 again
        (2, 0, 150.0, 100.0, 200.0, 0.1, "decline", False, False, -0.1, 0.2, 0, 1.0, 1.0, 0.0, 1.0),  # capped at the last month
        (3, 0, 150.0, 100.0, 200.0, 0.1, "cycle", False, False, 0.1, 0.5, 1, 120.0, 0.0, 0.1, 1.0),  # trend times 1.035
        (4, 0, 150.0, 100.0, 200.0, 0.1, "cycle", False, False, 0.1, 0.5, 1, None, None, None, None),  # no parts: as guarded
        (5, 0, -5.0, 100.0, 200.0, *grown, 1.0, 0.0, 0.0, 1.0),
    ]
    out = {r.stock_id: r for r in SQ.assembled_forecast(spark.createDataFrame(rows, columns)).collect()}
    assert [out[k].raw_revenue for k in range(1, 6)] == [9000, 150, 150, 150, -5]
    assert [out[k].guarded_revenue for k in range(1, 6)] == [800, 150, 150, 150, 0]
    assert [out[k].adjusted_revenue for k in (1, 2)] == pytest.approx([1120, 100]) and out[4].predicted_revenue == 150
    assert out[3].recombined_revenue == pytest.approx(120 * 1.035, abs=0.01) and out[1].predicted_revenue == 800 and out[5].predicted_revenue == 0
    assert [(out[k].clipped_before, out[k].clipped_after) for k in range(1, 6)] == [(True, True), (False, False), (False, False), (False, False), (True, False)]
    plain = SQ.assembled_forecast(spark.createDataFrame(rows, columns).drop("trend_prediction", "cycle_prediction")).where("stock_id = 3").first()
    assert plain.recombined_revenue == 150


def test_scenarios_share_months_and_switch_one_thing_each(spark):
    data = panels(spark, {s: [v * (1 + s) * (1.2 if (t + s) % 5 == 0 else 1) for t, v in enumerate(wave(72))] for s in range(5)}, start=2017 * 12)
    out = {(r.growth, r.trend_cycle, r.auto_tune): r for r in SQ.scenario_grid(data, spark.createDataFrame(CONFIGS, CONFIG_COLUMNS), 2022).collect()}
    assert len(out) == 8 and len({r.observations for r in out.values()}) == 1 and out[False, False, False].improvement == 0
    assert all(r.improvement == pytest.approx(out[False, False, False].WMAPE - r.WMAPE) for r in out.values())
    assert len({round(r.WMAPE, 9) for r in out.values()}) > 3


def test_axes_agree_with_the_operator_they_vary(spark):
    from tidemark.operators import forecast as FC
    from tidemark.operators import metrics as M

    data = panels(spark, {s: [v * (1 + s) * 1.03 ** (t if s % 2 else -t) * (1.2 if (t + s) % 5 == 0 else 1) for t, v in enumerate(wave(72))] for s in range(6)}, start=2017 * 12)
    rows = FC.formula_forecast(data).where("target_year = 2022").withColumnRenamed("formula_adjusted_revenue", "predicted_revenue")
    rows = rows.join(SQ.month_before(data), ["stock_id", "month_index"]).join(SQ.trend_cycle_forecasts(data, 2021, 2022), ["stock_id", "month_index"]).cache()
    out = {(r.alpha, r.conditional, r.by_regime, r.components): r for r in SQ.adjustment_axes(rows).collect()}
    assert len(out) == 24 and {r.observations for r in out.values()} == {72}
    for alpha, conditional, by_regime in ((0.8, True, True), (0.4, False, True), (0.8, False, False), (0.0, True, False)):
        want = M.accuracy(FC.adjust_for_growth(rows, alpha, conditional, by_regime)).first().WMAPE
        assert out[alpha, conditional, by_regime, False].WMAPE == pytest.approx(want)
    plain = M.accuracy(rows).first().WMAPE
    assert all(r.WMAPE_change == pytest.approx(r.WMAPE - plain, abs=1e-9) and r.winner == ("variant" if r.WMAPE_change < 0 else "plain" if r.WMAPE_change > 0 else "tie") for r in out.values())
    assert out[0.0, False, False, False].winner == "tie" and len({round(r.WMAPE, 6) for r in out.values()}) > 6


def written_by(run):
    """The rows of what a call returns, and which tables it wrote to the shared folder."""
    with tempfile.TemporaryDirectory() as place, pytest.MonkeyPatch.context() as patch:
        patch.setattr(artifacts, "shared_dir", lambda spark: place)
        return run().collect(), sorted(p.name.rsplit("-", 1)[0] for p in Path(place).iterdir())


def test_fits_read_written_windows(spark):
    data = panels(spark, two_regimes(stocks=8))
    rows, tables = written_by(lambda: SQ.plain_and_conditioned(data, 2020, 2021))
    assert tables == ["tidemark-clustered-windows", "tidemark-panel"]
    # The head without clusters is the one of windows that are all in one cluster.
    none = spark.createDataFrame([], "stock_id long, month_index int, cluster int")
    shared = SQ.conditioned_sequence_regression(data, 2020, 2021, 0, clusters=none)
    heads = SQ.conditioned_sequence_regression(data, 2020, 2021)
    joined = heads.join(shared.select("stock_id", "target_month", F.col("predicted_revenue").alias("s")), ["stock_id", "target_month"])
    expected = {r.cluster: r.e for r in joined.groupBy("cluster").agg((F.sum(F.abs(F.col("s") - F.col("actual_revenue"))) / F.sum("actual_revenue") * 100).alias("e")).collect()}
    assert {r.cluster: r.shared_WMAPE for r in rows} == pytest.approx(expected)


def test_scenarios_read_written_months(spark):
    data = panels(spark, {s: [v * (1 + s) * (1.2 if (t + s) % 5 == 0 else 1) for t, v in enumerate(wave(72))] for s in range(3)}, start=2017 * 12)
    rows, tables = written_by(lambda: SQ.scenario_grid(data, spark.createDataFrame(CONFIGS, CONFIG_COLUMNS), 2022))
    assert len(rows) == 8 and tables == ["tidemark-panel", "tidemark-scenario-months", "tidemark-scenario-scores"]
