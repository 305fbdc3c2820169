"""Queries over sequence forecasts and scenarios; pooled fits have SQL twins, k-means and its heads none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forecast as FC
from tidemark.operators import learned as L
from tidemark.operators import metrics as M
from tidemark.operators import reports as RP
from tidemark.operators import sequence as SQ
from tidemark.operators.calendar import three_month_totals
from tidemark.plans import reports as RS
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.plans.evaluation import _GRID_SQL, grid
from tidemark.sources.adapters import TARGET_YEAR, monthly_revenue
from tidemark.sources.artifacts import settled

KEYS = ["stock_id", "month_index"]


def _fit(name: str, rows: str, y: str, a: str, b: str) -> str:
    """SQL of a pooled fit on two predictors: a row (b0, b1, b2)."""
    v = lambda x, z: f"covar_pop({x}, {z})"
    return f"""{name}_m AS (SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, {v(a, a)} AS aa, {v(b, b)} AS bb, {v(a, b)} AS ab, {v(a, y)} AS ay, {v(b, y)} AS yb FROM {rows} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL),
{name}_c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM {name}_m),
{name} AS (SELECT my - b1 * ma - b2 * mb AS b0, b1, b2 FROM {name}_c)"""


QUARTER_SQL = f"""WITH {S.full()}, f AS (SELECT *, sum(formula_adjusted_revenue) OVER w AS p3, sum(actual_revenue) OVER w AS a3, lead(month_index, 2) OVER (PARTITION BY stock_id ORDER BY month_index) - month_index AS span FROM formula WHERE target_year = 2000 WINDOW w AS (PARTITION BY stock_id ORDER BY month_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
w0 AS (SELECT stock_id, month_index + 1 AS month_index, consecutive_months, ln(1 + greatest(sum(revenue) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0)) AS x1, ln(1 + greatest(sum(revenue) OVER (w ROWS BETWEEN 11 PRECEDING AND 9 PRECEDING), 0)) AS x2,
  CASE WHEN count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 THEN ln(1 + greatest(sum(revenue) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0)) END AS y FROM seg WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
w1 AS (SELECT * FROM w0 WHERE consecutive_months >= 12 AND y IS NOT NULL), w2 AS (SELECT * FROM w1 WHERE month_index + 2 < 24000), {_fit('fit', 'w2', 'y', 'x1', 'x2')},
d AS (SELECT stock_id, month_index, greatest(exp(b0 + b1 * x1 + b2 * x2) - 1, 0) AS d3 FROM w1, fit WHERE month_index // 12 = 2000),
j AS (SELECT f.stock_id, p3, a3, d3 FROM f JOIN d ON f.stock_id = d.stock_id AND f.month_index = d.month_index WHERE span = 2 AND p3 IS NOT NULL), s AS (SELECT stock_id, count(*) AS windows, sum(abs(p3 - a3)) / nullif(sum(abs(a3)), 0) * 100 AS m, sum(abs(d3 - a3)) / nullif(sum(abs(a3)), 0) * 100 AS d FROM j GROUP BY 1)
SELECT stock_id, windows, round(m, 4) AS monthly_WMAPE, round(d, 4) AS direct_WMAPE, CASE WHEN d < m THEN 'direct' WHEN d > m THEN 'monthly' ELSE 'tie' END AS winner FROM s"""


def quarter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-35: three-month sums of monthly predictions against a direct three-month regression, learnt from targets that end before the year."""
    monthly = three_month_totals(predictions(spark, sf_dir).where("model = 'formula'"))
    return neat(RP.monthly_against_direct(monthly, SQ.direct_horizon_forecast(monthly_revenue(spark, sf_dir), TARGET_YEAR)), 4)


_TUNED = f"""sc AS (SELECT stock_id, config_id, sum(abs(formula_adjusted_revenue - actual_revenue)) AS e FROM formula WHERE target_year = 1999 AND formula_adjusted_revenue IS NOT NULL GROUP BY 1, 2),
bc AS (SELECT stock_id, config_id, e FROM sc QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY e, config_id) = 1),
tn AS (SELECT f.stock_id, f.target_year, f.target_month, f.month_index, f.actual_revenue, f.last_observed_revenue, bc.config_id, bc.e, f.formula_adjusted_revenue AS tuned, u.formula_adjusted_revenue AS untuned
  FROM formula AS f LEFT JOIN bc ON f.stock_id = bc.stock_id JOIN (SELECT * FROM formula WHERE config_id = 0) AS u ON f.stock_id = u.stock_id AND f.month_index = u.month_index
  WHERE f.target_year = {TARGET_YEAR} AND f.config_id = coalesce(bc.config_id, 0) AND f.formula_adjusted_revenue IS NOT NULL)"""
TUNED_SQL = f"WITH {S.panel()}, {S.SEGMENTS}, {S.BASELINES}, {S.formula(_GRID_SQL)}, {_TUNED} SELECT stock_id, target_year, target_month, config_id, round(e, 4) AS validation_error, round(tuned, 4) AS predicted_revenue, round(untuned, 4) AS untuned_revenue FROM tn"


def tuned_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-30: each entity's own setting of 27, chosen on the year before."""
    rows = FC.tuned_formula(monthly_revenue(spark, sf_dir), grid(spark), TARGET_YEAR - 1, TARGET_YEAR)
    return neat(rows.select("stock_id", "target_year", "target_month", "config_id", "validation_error", "predicted_revenue", "untuned_revenue"), 4)


#: Trend (mean of up to twelve months, from the third on), cycle, slope over three months; then both parts of each month from the month before.
_PARTS = f"""tc0 AS (SELECT *, greatest(CASE WHEN consecutive_months >= 3 THEN avg(revenue) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) ELSE revenue END, 0) AS trend FROM seg WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
tc1 AS (SELECT *, revenue - trend AS cycle, coalesce(trend - lag(trend, 3) OVER w, 0) AS slope, greatest(least(coalesce((trend - lag(trend, 3) OVER w) / nullif(lag(trend, 3) OVER w, 0), 0), 1), -1) AS rate FROM tc0 WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
tc2 AS (SELECT *, CASE WHEN count(cycle) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 3 THEN coalesce(stddev_samp(cycle) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0) ELSE 0 END AS vol FROM tc1 WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
tc3 AS (SELECT *, lag(trend) OVER w AS t1, lag(slope) OVER w AS s1, lag(cycle) OVER w AS c1, lag(cycle, 12) OVER w AS c12, lag(rate) OVER w AS r1, lag(vol) OVER w AS v1 FROM tc2 WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
tct AS (SELECT * FROM tc3 WHERE revenue_year <= {TARGET_YEAR - 1}), {_fit('ft', 'tct', 'trend', 't1', 's1')}, tcc AS (SELECT * FROM tct WHERE consecutive_months >= 24), {_fit('fc', 'tcc', 'cycle', 'c1', 'c12')},
tp AS (SELECT stock_id, month_index, greatest(ft.b0 + ft.b1 * t1 + ft.b2 * s1, 0) AS tp, fc.b0 + fc.b1 * c1 + fc.b2 * c12 AS cp, r1, v1 FROM tc3, ft, fc WHERE revenue_year = {TARGET_YEAR} AND t1 IS NOT NULL AND c12 IS NOT NULL)"""
PARTS_SQL = f"WITH {S.panel()}, {S.SEGMENTS}, {_PARTS} SELECT stock_id, month_index, round(tp, 4) AS trend_prediction, round(cp, 4) AS cycle_prediction, round(r1, 6) AS trend_slope_rate, round(v1, 4) AS cycle_volatility_6m FROM tp"


def trend_cycle_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-15: trend and cycle of each month of the target year, each by its own pooled fit."""
    rows = SQ.trend_cycle_forecasts(monthly_revenue(spark, sf_dir), TARGET_YEAR - 1, TARGET_YEAR)
    return rows.select(*KEYS, *[F.round(c, 4).alias(c) for c in ("trend_prediction", "cycle_prediction")], F.round("trend_slope_rate", 6).alias("trend_slope_rate"), F.round("cycle_volatility_6m", 4).alias("cycle_volatility_6m"))


_BOTH = "greatest(tp * least(greatest(CASE WHEN r1 > 0 THEN 1 + 0.35 * r1 ELSE 1.0 END, 1.0), 1.35) + cp * CASE WHEN sd > 1e-6 THEN greatest(least(coalesce(v1 / (sd + 1e-6), 1.0), 2.5), 0.4) ELSE 1.0 END, 0)"
_TOP = "wm AS (SELECT stock_id, month_index + 1 AS month_index, max(revenue) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS window_max FROM seg)"
ASSEMBLED_SQL = f"""WITH {S.full()}, {RS._REGIME}, {_PARTS}, {_TOP},
a0 AS (SELECT rg.*, window_max, tp, cp, r1, v1, stddev_pop(cp) OVER () AS sd, greatest(5 * last_observed_revenue, 4 * window_max, 1.0) AS lim FROM rg JOIN wm USING (stock_id, month_index) JOIN tp USING (stock_id, month_index)),
a1 AS (SELECT *, least(greatest(predicted_revenue, 0), lim) AS g FROM a0), a2 AS (SELECT *, CASE WHEN regime = 'cycle' THEN {_BOTH} ELSE g END AS r FROM a1),
a3 AS (SELECT *, regime = 'growth' AND growth_phase AND growth_rate > 0 AND growth_signal > 0 AS adj FROM a2), a4 AS (SELECT *, CASE WHEN adj THEN r * (1 + 0.8 * growth_signal) ELSE r END AS b FROM a3),
a5 AS (SELECT *, CASE WHEN regime = 'decline' AND b > last_observed_revenue THEN last_observed_revenue ELSE b END AS adjusted FROM a4)
SELECT stock_id, month_index, regime, round(predicted_revenue, 4) AS raw_revenue, round(g, 4) AS guarded_revenue, round(r, 4) AS recombined_revenue, round(adjusted, 4) AS adjusted_revenue, round(least(greatest(adjusted, 0), lim), 4) AS predicted_revenue, g <> predicted_revenue AS clipped_before, least(greatest(adjusted, 0), lim) <> adjusted AS clipped_after FROM a5"""


def assembled_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-19: the formula's predictions through guardrail, parts, growth adjustment and guardrail, every stage kept."""
    panel = monthly_revenue(spark, sf_dir)
    rows = predictions(spark, sf_dir).where("model = 'formula'").join(SQ.month_before(panel), KEYS).join(SQ.trend_cycle_forecasts(panel, TARGET_YEAR - 1, TARGET_YEAR), KEYS)
    return neat(SQ.assembled_forecast(rows).select(*KEYS, "regime", "raw_revenue", "guarded_revenue", "recombined_revenue", "adjusted_revenue", "predicted_revenue", "clipped_before", "clipped_after"), 4)


_ON = "CASE WHEN regime = 'growth' AND growth_phase AND growth_rate > 0 AND growth_signal > 0 THEN {p} * (1 + 0.8 * growth_signal) ELSE {p} END"
_P = "CASE WHEN trend_cycle AND regime = 'cycle' THEN both_parts WHEN auto_tune THEN tuned ELSE untuned END"
SCENARIO_SQL = f"""WITH {S.panel()}, {S.SEGMENTS}, {S.BASELINES}, {S.formula(_GRID_SQL)}, {_TUNED}, pred AS (SELECT 'formula' AS model, stock_id, month_index FROM tn), {RS._REGIME}, {_PARTS}, {_TOP},
n0 AS (SELECT tn.*, gs.* EXCLUDE (stock_id, month_index), tp, cp, r1, v1, stddev_pop(cp) OVER () AS sd FROM tn JOIN gs USING (stock_id, month_index) JOIN wm USING (stock_id, month_index) JOIN tp USING (stock_id, month_index)),
n1 AS (SELECT *, {_BOTH} AS both_parts FROM n0), n2 AS (SELECT *, unnest([false, true]) AS growth FROM n1), n3 AS (SELECT *, unnest([false, true]) AS trend_cycle FROM n2), n4 AS (SELECT *, unnest([false, true]) AS auto_tune FROM n3),
n5 AS (SELECT *, {_P} AS p FROM n4), n6 AS (SELECT *, CASE WHEN NOT growth THEN p WHEN regime = 'decline' THEN least({_ON.format(p='p')}, last_observed_revenue) ELSE {_ON.format(p='p')} END AS predicted_revenue FROM n5),
n7 AS (SELECT growth, trend_cycle, auto_tune, {S.metrics(digits=4)}, {RS._WMAPE} AS w FROM n6 GROUP BY 1, 2, 3)
SELECT * EXCLUDE (w, MSE), round((SELECT w FROM n7 WHERE NOT growth AND NOT trend_cycle AND NOT auto_tune) - w, 4) AS improvement FROM n7"""


def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-30: growth, trend and cycle, and tuned settings, on and off."""
    return neat(SQ.scenario_grid(monthly_revenue(spark, sf_dir), grid(spark), TARGET_YEAR).drop("MSE"), 4)


_VARIANT = "CASE WHEN growth_rate > 0 AND growth_signal > 0 AND (regime = 'growth' OR NOT by_regime) AND (growth_phase OR NOT conditional) THEN p * (1 + alpha * growth_signal) ELSE p END"
AXES_SQL = f"""WITH {S.full()}, {RS._REGIME}, {_PARTS}, {_TOP},
a0 AS (SELECT rg.*, tp, cp, r1, v1, stddev_pop(cp) OVER () AS sd FROM rg JOIN wm USING (stock_id, month_index) JOIN tp USING (stock_id, month_index)), a1 AS (SELECT *, {_BOTH} AS both_parts FROM a0),
a2 AS (SELECT *, unnest([0.0::DOUBLE, 0.4, 0.8]) AS alpha FROM a1), a3 AS (SELECT *, unnest([false, true]) AS conditional FROM a2), a4 AS (SELECT *, unnest([false, true]) AS by_regime FROM a3), a5 AS (SELECT *, unnest([false, true]) AS components FROM a4),
a6 AS (SELECT *, CASE WHEN components AND regime = 'cycle' THEN both_parts ELSE predicted_revenue END AS p FROM a5), a7 AS (SELECT *, {_VARIANT} AS b FROM a6),
a8 AS (SELECT * EXCLUDE predicted_revenue, CASE WHEN by_regime AND regime = 'decline' THEN least(b, last_observed_revenue) ELSE b END AS predicted_revenue FROM a7),
a9 AS (SELECT alpha, conditional, by_regime, components, {S.metrics(digits=4)}, {RS._WMAPE} AS w FROM a8 GROUP BY 1, 2, 3, 4),
c AS (SELECT *, CASE WHEN alpha = 0 AND NOT by_regime AND NOT components THEN 0 ELSE w - (SELECT w FROM a9 WHERE alpha = 0 AND NOT conditional AND NOT by_regime AND NOT components) END AS d FROM a9)
SELECT * EXCLUDE (w, d, MSE), round(d, 4) AS WMAPE_change, CASE WHEN d < 0 THEN 'variant' WHEN d > 0 THEN 'plain' ELSE 'tie' END AS winner FROM c"""


def adjustment_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-05: strength by condition by regime by components, against the plain formula."""
    panel = monthly_revenue(spark, sf_dir)
    rows = predictions(spark, sf_dir).where("model = 'formula'").join(SQ.month_before(panel), KEYS).join(SQ.trend_cycle_forecasts(panel, TARGET_YEAR - 1, TARGET_YEAR), KEYS)
    return neat(SQ.adjustment_axes(rows).drop("MSE"), 4)


def conditioned_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-14, FC-16: guarded one-step predictions of the target year with a head for each growth cluster."""
    rows = SQ.conditioned_sequence_regression(monthly_revenue(spark, sf_dir), TARGET_YEAR - 1, TARGET_YEAR)
    return neat(FC.guardrail(rows))


def conditioned_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-14: errors with heads for clusters and without, by cluster."""
    return neat(SQ.plain_and_conditioned(monthly_revenue(spark, sf_dir), TARGET_YEAR - 1, TARGET_YEAR))


def growth_cluster_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18 on FC-13's clusters: what the adjustment of the conditioned predictions does in each cluster of the month before."""
    panel = settled(monthly_revenue(spark, sf_dir), "panel")
    rows = SQ.conditioned_sequence_regression(panel, TARGET_YEAR - 1, TARGET_YEAR).withColumn("month_index", F.col("target_year") * 12 + F.col("target_month") - 1)
    rows = rows.drop("window_max").join(SQ.month_before(panel), KEYS).withColumn("plain_revenue", F.col("predicted_revenue"))
    return neat(L.cluster_effects(FC.adjust_for_growth(rows).withColumn("adjusted_revenue", F.col("predicted_revenue"))))


def conditioned_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-14 scored like every other model."""
    rows = SQ.conditioned_sequence_regression(monthly_revenue(spark, sf_dir), TARGET_YEAR - 1, TARGET_YEAR)
    return neat(M.accuracy(rows.withColumn("model", F.lit("conditioned_sequence")), "model"))


QUERIES = {
    "quarter_targets": quarter_targets,
    "tuned_formula": tuned_formula,
    "trend_cycle_forecasts": trend_cycle_forecasts,
    "assembled_forecast": assembled_forecast,
    "scenario_grid": scenario_grid,
    "adjustment_axes": adjustment_axes,
    "conditioned_sequence": conditioned_sequence,
    "conditioned_by_cluster": conditioned_by_cluster,
    "conditioned_accuracy": conditioned_accuracy,
    "growth_cluster_effects": growth_cluster_effects,
}
ORACLE_SQL = {"quarter_targets": QUARTER_SQL, "tuned_formula": TUNED_SQL, "trend_cycle_forecasts": PARTS_SQL, "assembled_forecast": ASSEMBLED_SQL, "scenario_grid": SCENARIO_SQL, "adjustment_axes": AXES_SQL}
