"""Queries over metrics, cohorts, selection and sweeps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cohorts as K
from tidemark.operators import forecast as FC
from tidemark.operators import metrics as M
from tidemark.plans import sql as S
from tidemark.plans.common import flagship, neat, predictions
from tidemark.sources.adapters import entity_master, monthly_revenue


def _with_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).join(entity_master(spark, sf_dir), "stock_id", "left")


FLAGSHIP_SQL = f"WITH {S.full()}, {S.MASTER} SELECT industry_category, {S.metrics()} FROM pred LEFT JOIN master ON pred.stock_id = master.stock_id WHERE model = 'formula' GROUP BY 1"


def accuracy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_industry(spark, sf_dir)
    return neat(M.accuracy_by_levels(rows, "model", "stock_id", "industry_category", "target_month"))


LEVELS_SQL = f"""WITH {S.full()}, {S.MASTER}, p AS (SELECT pred.*, industry_category FROM pred LEFT JOIN master ON pred.stock_id = master.stock_id)
{' UNION ALL '.join(f"SELECT model, '{name}' AS level, {key} AS group_key, {S.metrics()} FROM p GROUP BY 1, 2, 3" for name, key in (('overall', 'NULL'), ('stock_id', 'CAST(stock_id AS VARCHAR)'), ('industry_category', 'industry_category'), ('target_month', 'CAST(target_month AS VARCHAR)')))}"""


def extended_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.extended_accuracy(predictions(spark, sf_dir), "model"))


EXTENDED_SQL = f"""WITH {S.full()}
SELECT model, {S.metrics()}, round(quantile_cont(CASE WHEN actual_revenue <> 0 THEN abs(predicted_revenue - actual_revenue) / abs(actual_revenue) END, 0.9) * 100, 6) AS P90APE,
       round(avg(CASE WHEN mase_scale > 0 THEN abs(predicted_revenue - actual_revenue) / mase_scale END), 6) AS MASE, count(DISTINCT stock_id) AS stock_count
FROM pred GROUP BY 1"""

_STOCK = "sw AS (SELECT model, stock_id, count(*) AS n, sum(abs(predicted_revenue - actual_revenue)) / nullif(sum(abs(actual_revenue)), 0) * 100 AS w FROM pred GROUP BY 1, 2)"


def error_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.error_quantiles(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"), "WMAPE", "model"))


QUANTILES_SQL = f"WITH {S.full()}, {_STOCK} SELECT model, count(*) AS stock_count, {', '.join(f'round(quantile_cont(w, {q}), 6) AS P{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM sw GROUP BY 1"


def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.error_bands(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"), "WMAPE", "model"))


BANDS_SQL = f"""WITH {S.full()}, {_STOCK},
b AS (SELECT model, CASE WHEN w < 5 THEN 0 WHEN w < 10 THEN 1 WHEN w < 15 THEN 2 WHEN w < 20 THEN 3 WHEN w < 30 THEN 4 WHEN w < 50 THEN 5 ELSE 6 END AS band FROM sw WHERE w IS NOT NULL),
g AS (SELECT * FROM (SELECT DISTINCT model FROM b), (VALUES (0, '<5'), (1, '5-10'), (2, '10-15'), (3, '15-20'), (4, '20-30'), (5, '30-50'), (6, '>=50')) AS v(band, label)),
c AS (SELECT g.model, g.band, label, count(b.band) AS stocks FROM g LEFT JOIN b ON g.model = b.model AND g.band = b.band GROUP BY 1, 2, 3)
SELECT model, band, label, stocks, round(stocks * 100.0 / sum(stocks) OVER (PARTITION BY model), 6) AS share_percent FROM c"""


def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.size_buckets(predictions(spark, sf_dir)))


SIZE_SQL = f"""WITH {S.full()}, m AS (SELECT stock_id, avg(actual_revenue) AS a FROM pred GROUP BY 1), b AS (SELECT stock_id, CAST(ntile(4) OVER (ORDER BY a, stock_id) AS INTEGER) AS size_bucket FROM m)
SELECT model, size_bucket, {S.metrics()} FROM pred JOIN b ON pred.stock_id = b.stock_id GROUP BY 1, 2"""


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.winners(M.accuracy(predictions(spark, sf_dir), "model", "stock_id")))


WINNERS_SQL = f"""WITH {S.full()}, {_STOCK}, b AS (SELECT model, count(*) AS wins FROM (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY w, model) = 1) GROUP BY 1)
SELECT sw.model, count(*) AS stocks, round(avg(w), 6) AS mean_metric, round(quantile_cont(w, 0.5), 6) AS median_metric, coalesce(max(wins), 0) AS wins, round(coalesce(max(wins), 0) * 100.0 / count(*), 6) AS win_rate_percent
FROM sw LEFT JOIN b ON sw.model = b.model GROUP BY 1"""


def pairwise_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.pairwise_effects(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"), "seasonal_naive", "formula"))


PAIRWISE_SQL = f"""WITH {S.full()}, {_STOCK}, p AS (SELECT stock_id, max(w) FILTER (WHERE model = 'seasonal_naive') AS b, max(w) FILTER (WHERE model = 'formula') AS c FROM sw GROUP BY 1)
SELECT stock_id, round(b, 6) AS baseline_value, round(c, 6) AS challenger_value, round(c - b, 6) AS delta, CASE WHEN c < b THEN 'formula' WHEN c > b THEN 'seasonal_naive' ELSE 'tie' END AS winner FROM p WHERE b IS NOT NULL AND c IS NOT NULL"""


def month_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.month_extremes(M.accuracy(predictions(spark, sf_dir), "model", "target_month")))


EXTREMES_SQL = f"""WITH {S.full()}, mo AS (SELECT model, target_month, sum(abs(predicted_revenue - actual_revenue)) / nullif(sum(abs(actual_revenue)), 0) * 100 AS w FROM pred GROUP BY 1, 2)
SELECT model, arg_min(target_month, w) AS best_month, round(min(w), 6) AS best_value, arg_max(target_month, w) AS worst_month, round(max(w), 6) AS worst_value, round(avg(w), 6) AS mean_value FROM mo GROUP BY 1"""


def annual_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(M.annual_accuracy(predictions(spark, sf_dir)), 4)


ANNUAL_SQL = f"""WITH {S.full()} SELECT model, stock_id, count(*) AS months, round(sum(predicted_revenue), 4) AS predicted_annual, round(sum(actual_revenue), 4) AS actual_annual,
round((sum(predicted_revenue) - sum(actual_revenue)) / nullif(sum(actual_revenue), 0) * 100, 4) + 0.0 AS annual_bias_percent FROM pred GROUP BY 1, 2"""


def comparable_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete years on the months that every model has, scored."""
    rows = K.complete_years(K.comparable_cohort(predictions(spark, sf_dir), ["formula", "seasonal_naive", "last_observed"]))
    return neat(M.accuracy(rows, "model"))


COHORT_SQL = f"""WITH {S.full()},
k AS (SELECT stock_id, target_year, target_month FROM pred GROUP BY ALL HAVING count(DISTINCT model) = 3),
c AS (SELECT pred.* FROM pred SEMI JOIN k USING (stock_id, target_year, target_month)),
y AS (SELECT model, stock_id, target_year FROM c GROUP BY ALL HAVING count(DISTINCT target_month) = 12)
SELECT model, {S.metrics()} FROM c SEMI JOIN y USING (model, stock_id, target_year) GROUP BY 1"""


def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.accuracy(predictions(spark, sf_dir), "model", "stock_id").select("model", "stock_id", "WMAPE")
    return neat(K.best_and_worst(rows, "model", "WMAPE", "stock_id", 5))


WORST_SQL = f"""WITH {S.full()}, {_STOCK}, r AS (SELECT model, stock_id, w, row_number() OVER (PARTITION BY model ORDER BY w, stock_id) AS rank_best, row_number() OVER (PARTITION BY model ORDER BY w DESC, stock_id) AS rank_worst FROM sw WHERE w IS NOT NULL)
SELECT model, stock_id, round(w, 6) AS WMAPE, rank_best, rank_worst FROM r WHERE rank_best <= 5 OR rank_worst <= 5"""


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities side by side, one column a model."""
    rows = M.accuracy(predictions(spark, sf_dir), "model", "stock_id")
    return neat(K.to_wide(rows, ["stock_id"], "model", ["formula", "last_observed", "seasonal_naive"], "WMAPE"))


TABLE_SQL = f"WITH {S.full()}, {_STOCK} SELECT stock_id, {', '.join(f'round(max(w) FILTER (WHERE model = {m!r}), 6) AS {m}' for m in ('formula', 'last_observed', 'seasonal_naive'))} FROM sw GROUP BY 1"


def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen on the validation year 1999."""
    return neat(K.fallback_choice(M.accuracy(predictions(spark, sf_dir, 1999), "model", "stock_id"), "last_observed", "formula", least_gain=1.0))


FALLBACK_SQL = f"""WITH {S.full().replace(f'target_year = {S.TARGET}', 'target_year = 1999')}, {_STOCK},
p AS (SELECT stock_id, max(w) FILTER (WHERE model = 'last_observed') - max(w) FILTER (WHERE model = 'formula') AS g FROM sw GROUP BY 1)
SELECT stock_id, CASE WHEN g > 1 THEN 'formula' ELSE 'last_observed' END AS selected_model, round(g, 6) AS improvement, CASE WHEN g IS NULL THEN 'no validation' WHEN g > 1 THEN 'improved' ELSE 'not improved' END AS selection_reason FROM p"""


def grid(spark: SparkSession) -> DataFrame:
    """EVL-06: 27 configurations of the formula."""
    rows = [(i, w, a, s, math.log(2.0), 0.5) for i, (w, a, s) in enumerate((w, a, s) for w in (0.6, 0.75, 0.9) for a in (0.1, 0.2, 0.3) for s in (0.25, 0.5, 0.75))]
    return spark.createDataFrame(rows, "config_id int, seasonal_weight double, residual_alpha double, residual_strength double, growth_log_cap double, correction_log_cap double")


def formula_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-06, AGG-28: every configuration on the validation years, one plan."""
    rows = FC.formula_forecast(monthly_revenue(spark, sf_dir), configs=grid(spark)).where("target_year in (1998, 1999)").withColumnRenamed("formula_adjusted_revenue", "predicted_revenue")
    return neat(M.balanced_score(rows, "config_id", "seasonal_weight", "residual_alpha", "residual_strength"))


_GRID_SQL = "SELECT CAST(row_number() OVER (ORDER BY seasonal_weight, residual_alpha, residual_strength) - 1 AS INTEGER) AS config_id, *, ln(2.0) AS growth_log_cap, 0.5 AS correction_log_cap FROM (SELECT unnest([0.6::DOUBLE, 0.75, 0.9]) AS seasonal_weight), (SELECT unnest([0.1::DOUBLE, 0.2, 0.3]) AS residual_alpha), (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS residual_strength)"
SWEEP_SQL = f"""WITH {S.panel()}, {S.SEGMENTS}, {S.BASELINES}, {S.formula(_GRID_SQL)},
v AS (SELECT config_id, seasonal_weight, residual_alpha, residual_strength, stock_id, sum(abs(formula_adjusted_revenue - actual_revenue)) AS e, sum(abs(actual_revenue)) AS a, count(*) AS n FROM formula WHERE target_year IN (1998, 1999) AND formula_adjusted_revenue IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT config_id, seasonal_weight, residual_alpha, residual_strength, sum(n) AS observations, sum(e) / sum(a) * 100 AS w, quantile_cont(e / a, 0.5) * 100 AS m FROM v GROUP BY 1, 2, 3, 4)
SELECT config_id, seasonal_weight, residual_alpha, residual_strength, CAST(observations AS BIGINT) AS observations, round(w, 6) AS WMAPE, round(m, 6) AS median_stock_WMAPE, round(0.5 * w + 0.5 * m, 6) AS balanced_score FROM t"""


def underestimate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.underestimate_risk(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"))
    return neat(rows.select("model", "stock_id", "risk_score", "risk_level"))


RISK_SQL = f"""WITH {S.full()},
a AS (SELECT model, stock_id, avg(CAST(predicted_revenue < actual_revenue AS INTEGER)) * 100 AS u, avg(predicted_revenue - actual_revenue) AS b, avg(abs(predicted_revenue - actual_revenue)) AS m FROM pred GROUP BY 1, 2),
r AS (SELECT *, u * 0.7 + least(greatest(-(b / nullif(m, 0)), 0), 1) * 30 AS s FROM a)
SELECT model, stock_id, round(s, 6) AS risk_score, CASE WHEN s >= 70 THEN 'high' WHEN s >= 45 THEN 'medium' ELSE 'low' END AS risk_level FROM r"""

QUERIES = {
    "flagship_industry_accuracy": flagship,
    "accuracy_levels": accuracy_levels,
    "extended_accuracy": extended_accuracy,
    "error_quantiles": error_quantiles,
    "error_bands": error_bands,
    "size_buckets": size_buckets,
    "winners": winners,
    "pairwise_effects": pairwise_effects,
    "month_extremes": month_extremes,
    "annual_accuracy": annual_accuracy,
    "comparable_cohort": comparable_cohort,
    "best_and_worst": best_and_worst,
    "model_table": model_table,
    "fallback_choice": fallback_choice,
    "formula_sweep": formula_sweep,
    "underestimate_risk": underestimate_risk,
}
ORACLE_SQL = {
    "flagship_industry_accuracy": FLAGSHIP_SQL,
    "accuracy_levels": LEVELS_SQL,
    "extended_accuracy": EXTENDED_SQL,
    "error_quantiles": QUANTILES_SQL,
    "error_bands": BANDS_SQL,
    "size_buckets": SIZE_SQL,
    "winners": WINNERS_SQL,
    "pairwise_effects": PAIRWISE_SQL,
    "month_extremes": EXTREMES_SQL,
    "annual_accuracy": ANNUAL_SQL,
    "comparable_cohort": COHORT_SQL,
    "best_and_worst": WORST_SQL,
    "model_table": TABLE_SQL,
    "fallback_choice": FALLBACK_SQL,
    "formula_sweep": SWEEP_SQL,
    "underestimate_risk": RISK_SQL,
}
