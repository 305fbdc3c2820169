"""Queries over the calendar and feature operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calendar as C
from tidemark.operators import forecast as FC
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.sources.adapters import monthly_revenue, quarterly_eps, table
from tidemark.sources.artifacts import shared_dir
from tidemark.streaming.month_to_date import daily_totals, run_month_to_date
from tidemark.streaming.month_to_date import month_to_date as mtd

_FEATURES = ["stock_id", "revenue_year", "revenue_month", "revenue", "calendar_segment", "consecutive_months", "mom", "last_year_revenue", "yoy", "last_3m_revenue", "last_3m_revenue_yoy", "last_12m_revenue", "last_12m_revenue_yoy", "acc_revenue", "acc_revenue_yoy"]


def revenue_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(C.revenue_features(monthly_revenue(spark, sf_dir)).select(_FEATURES))


def revenue_features_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(C.revenue_features(monthly_revenue(spark, sf_dir, "l_partkey")).select(_FEATURES))


def _features_sql(key: str) -> str:
    year = "(PARTITION BY stock_id ORDER BY month_index RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)"
    return f"""WITH {S.panel(key)}, {S.SEGMENTS},
a AS (
  SELECT *, lag(revenue) OVER s AS prev, first(revenue) OVER {year} AS last_year_revenue,
         sum(revenue) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 2 PRECEDING) AS last_3m_revenue,
         sum(revenue) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 11 PRECEDING) AS last_12m_revenue,
         sum(revenue) OVER (PARTITION BY stock_id, revenue_year ORDER BY month_index ROWS UNBOUNDED PRECEDING) AS acc_revenue
  FROM seg WINDOW s AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
b AS (SELECT *, first(last_3m_revenue) OVER {year} AS y3, first(last_12m_revenue) OVER {year} AS y12, first(acc_revenue) OVER {year} AS ya FROM a)
SELECT stock_id, revenue_year, revenue_month, round(revenue, 6) AS revenue, calendar_segment, consecutive_months,
       round(revenue / nullif(prev, 0) - 1, 6) AS mom, round(last_year_revenue, 6) AS last_year_revenue, round(revenue / nullif(last_year_revenue, 0) - 1, 6) AS yoy,
       round(last_3m_revenue, 6) AS last_3m_revenue, round(last_3m_revenue / nullif(y3, 0) - 1, 6) AS last_3m_revenue_yoy,
       round(last_12m_revenue, 6) AS last_12m_revenue, round(last_12m_revenue / nullif(y12, 0) - 1, 6) AS last_12m_revenue_yoy,
       round(acc_revenue, 6) AS acc_revenue, round(acc_revenue / nullif(ya, 0) - 1, 6) AS acc_revenue_yoy
FROM b"""


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.model_features(monthly_revenue(spark, sf_dir, "l_partkey"))
    return neat(rows.select("stock_id", "revenue_year", "revenue_month", "log_revenue", "lag_1", "log_mom", "log_mom_3m", "time_index", "last_year_revenue", "next_year_revenue", "history_12m_complete", "log_mom_filled", "lunar_new_year"))


#: Months of the lunar new year in the years of the given tables.
_LUNAR = "CASE WHEN revenue_year IN (1993, 1995, 1998, 2001) THEN 1 WHEN revenue_year IN (1991, 1992, 1994, 1996, 1997, 1999, 2000, 2002) THEN 2 END"
MODEL_SQL = f"""WITH {S.panel('l_partkey')}, {S.SEGMENTS},
a AS (SELECT *, ln(1 + greatest(revenue, 0)) AS log_revenue FROM seg),
b AS (SELECT *, lag(log_revenue) OVER s AS lag_1 FROM a WINDOW s AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
c AS (SELECT *, log_revenue - lag_1 AS log_mom FROM b)
SELECT stock_id, revenue_year, revenue_month, round(log_revenue, 6) AS log_revenue, round(lag_1, 6) AS lag_1, round(log_mom, 6) AS log_mom,
       round(avg(log_mom) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 2 PRECEDING), 6) AS log_mom_3m,
       round((row_number() OVER (PARTITION BY stock_id ORDER BY month_index) - 1) / nullif(count(*) OVER (PARTITION BY stock_id) - 1, 0), 6) AS time_index,
       round(first(revenue) OVER (PARTITION BY stock_id ORDER BY month_index RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING), 6) AS last_year_revenue,
       round(first(revenue) OVER (PARTITION BY stock_id ORDER BY month_index RANGE BETWEEN 12 FOLLOWING AND 12 FOLLOWING), 6) AS next_year_revenue,
       consecutive_months >= 12 AS history_12m_complete, CAST({_LUNAR} = revenue_month AS INTEGER) AS lunar_new_year,
       round(coalesce(log_mom, median(log_mom) OVER (PARTITION BY stock_id ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS log_mom_filled
FROM c"""


def growth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.growth_windows(monthly_revenue(spark, sf_dir))
    bits = F.array_join(F.transform("growth_vector", lambda b: b.cast("string")), "")
    return neat(rows.select("stock_id", "revenue_year", "revenue_month", bits.alias("growth_bits"), "growth_ratio", "growth_streak", "growth_rate", "momentum_3m", "momentum_6m", "trend_component", "cycle_component", "cycle_volatility_6m", "trend_slope", "trend_slope_rate"))


GROWTH_SQL = f"""WITH {S.panel()}, {S.SEGMENTS},
a AS (
  SELECT *, lag(revenue) OVER s AS prev, greatest(coalesce(CASE WHEN count(revenue) OVER t >= 3 THEN avg(revenue) OVER t END, revenue), 0) AS trend_component
  FROM seg WINDOW s AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index), t AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 11 PRECEDING)),
b AS (SELECT *, greatest(least(coalesce(revenue / nullif(prev, 0) - 1, 0), 5.0), -0.95) AS growth_rate, coalesce(CAST(revenue > prev AS INTEGER), 0) AS d, revenue - trend_component AS cycle_component,
             coalesce(trend_component - lag(trend_component, 3) OVER s, 0) AS trend_slope, lag(trend_component, 3) OVER s AS tb FROM a WINDOW s AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
c AS (
  SELECT *, avg(growth_rate) OVER m3 AS momentum_3m, avg(growth_rate) OVER x AS momentum_6m, coalesce(CASE WHEN count(cycle_component) OVER x >= 3 THEN stddev_samp(cycle_component) OVER x END, 0) AS cycle_volatility_6m,
         greatest(least(coalesce(trend_slope / nullif(tb, 0), 0), 1.0), -1.0) AS trend_slope_rate
  FROM b WINDOW m3 AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 2 PRECEDING), x AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 5 PRECEDING)),
e AS (SELECT *, list(d) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 11 PRECEDING) AS v FROM c)
SELECT stock_id, revenue_year, revenue_month, array_to_string(v, '') AS growth_bits, round(list_sum(v) / 12.0, 6) AS growth_ratio,
       CAST(length(array_to_string(v, '')) - length(rtrim(array_to_string(v, ''), '1')) AS INTEGER) AS growth_streak,
       round(growth_rate, 6) AS growth_rate, round(momentum_3m, 6) AS momentum_3m, round(momentum_6m, 6) AS momentum_6m, round(trend_component, 6) AS trend_component,
       round(cycle_component, 6) AS cycle_component, round(cycle_volatility_6m, 6) AS cycle_volatility_6m, round(trend_slope, 6) AS trend_slope, round(trend_slope_rate, 6) AS trend_slope_rate
FROM e WHERE consecutive_months >= 12"""


def sequence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.sequence_samples(monthly_revenue(spark, sf_dir, "l_partkey"), 6, 3)
    total = F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)
    return neat(rows.select("stock_id", "month_index", F.size("inputs").alias("months"), total.alias("input_total"), "target", "trailing_sum", "window_max", "target_year"), 4)


SEQUENCE_SQL = f"""WITH {S.panel('l_partkey')}, {S.SEGMENTS},
a AS (
  SELECT *, count(revenue) OVER f AS nf, sum(revenue) OVER f AS target, sum(revenue) OVER b3 AS trailing_sum, max(revenue) OVER b6 AS window_max, sum(revenue) OVER b6 AS input_total, count(*) OVER b6 AS months
  FROM seg WINDOW f AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
       b3 AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 2 PRECEDING), b6 AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS 5 PRECEDING))
SELECT stock_id, month_index, months, round(input_total, 4) AS input_total, round(target, 4) AS target, round(trailing_sum, 4) AS trailing_sum, round(window_max, 4) AS window_max,
       CAST((month_index + 1) // 12 AS INTEGER) AS target_year
FROM a WHERE consecutive_months >= 6 AND nf = 3"""


def eps_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(C.eps_features(quarterly_eps(spark, sf_dir)).select("stock_id", "eps_year", "eps_quarter", "EPS", "eps_ttm", "eps_yoy", "eps_ttm_yoy", "statement_available_date"), 9)


EPS_SQL = f"""WITH {S.EPS},
a AS (SELECT *, eps_year * 4 + eps_quarter - 1 AS qi FROM eps),
b AS (SELECT *, CASE WHEN count(EPS) OVER t = 4 THEN sum(EPS) OVER t END AS eps_ttm, first(EPS) OVER (PARTITION BY stock_id ORDER BY qi RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS ly
      FROM a WINDOW t AS (PARTITION BY stock_id ORDER BY qi RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, first(eps_ttm) OVER (PARTITION BY stock_id ORDER BY qi RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS tl FROM b)
SELECT stock_id, eps_year, eps_quarter, round(EPS, 9) AS EPS, round(eps_ttm, 9) AS eps_ttm, round(EPS / nullif(ly, 0) - 1, 9) AS eps_yoy, round(eps_ttm / nullif(tl, 0) - 1, 9) AS eps_ttm_yoy, statement_available_date
FROM c"""


def formula_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FC.formula_forecast(monthly_revenue(spark, sf_dir, "l_partkey"))
    return neat(rows.select("stock_id", "target_year", "target_month", "history_months", "actual_revenue", "last_observed_revenue", "seasonal_naive_revenue", "formula_base_revenue", "formula_adjusted_revenue", "growth_log", "residual_state", (F.col("mase_scale") + 1e-7).alias("mase_scale"), "forecast_method"), 4)


FORMULA_SQL = f"""WITH {S.panel('l_partkey')}, {S.SEGMENTS}, {S.BASELINES}, {S.formula()}
SELECT stock_id, target_year, target_month, history_months, {', '.join(f'round({c}, 4) AS {c}' for c in ('actual_revenue', 'last_observed_revenue', 'seasonal_naive_revenue', 'formula_base_revenue', 'formula_adjusted_revenue', 'growth_log', 'residual_state'))}, round(mase_scale + 1e-7, 4) AS mase_scale, forecast_method
FROM formula"""


def three_month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.three_month_totals(predictions(spark, sf_dir))
    return neat(rows.select("model", "stock_id", "target_year", "target_month", "predicted_3m", "actual_3m", "error_cancellation_percent"), 4)


THREE_SQL = f"""WITH {S.full()},
a AS (SELECT *, sum(predicted_revenue) OVER f AS predicted_3m, sum(actual_revenue) OVER f AS actual_3m, sum(abs(predicted_revenue - actual_revenue)) OVER f AS t, lead(month_index, 2) OVER o - month_index AS span
      FROM pred WINDOW o AS (PARTITION BY model, stock_id ORDER BY month_index), f AS (PARTITION BY model, stock_id ORDER BY month_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT model, stock_id, target_year, target_month, round(predicted_3m, 4) AS predicted_3m, round(actual_3m, 4) AS actual_3m, round((1 - abs(predicted_3m - actual_3m) / nullif(t, 0)) * 100, 4) + 0.0 AS error_cancellation_percent
FROM a WHERE span = 2"""


def structural_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = monthly_revenue(spark, sf_dir)
    formula = FC.formula_forecast(panel).select("stock_id", "target_year", "target_month", "last_observed_revenue", "formula_adjusted_revenue")
    rows = FC.apply_breaks(formula.join(FC.break_features(panel), ["stock_id", "target_year", "target_month"]), FC.BreakConfig(0.5, 0.6, 0.1, 0.6, 2))
    return neat(rows.select("stock_id", "target_year", "target_month", "break_last_yoy_ratio", "break_level_ratio", "break_recent_ratio_2", "break_recent_ratio_3", "recent_break_count", "structural_break_detected", "formula_adjusted_revenue"), 4)


def _at(k: int) -> str:
    return f"first(revenue) OVER (PARTITION BY stock_id ORDER BY month_index RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


BREAK_SQL = f"""WITH {S.panel()}, {S.SEGMENTS}, {S.BASELINES}, {S.formula()},
a AS (SELECT *, {', '.join(f'{_at(k)} AS r{k}' for k in (1, 2, 3, 13, 14, 15))},
             median(revenue) OVER (PARTITION BY stock_id ORDER BY month_index RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS med FROM formula),
b AS (SELECT *, (greatest(r1, 0) + 1e-9) / (greatest(r13, 0) + 1e-9) AS q1, (greatest(r2, 0) + 1e-9) / (greatest(r14, 0) + 1e-9) AS q2, (greatest(r3, 0) + 1e-9) / (greatest(r15, 0) + 1e-9) AS q3,
             (greatest(r1, 0) + 1e-9) / (greatest(med, 0) + 1e-9) AS lv FROM a),
b2 AS (SELECT * REPLACE (CASE WHEN r1 IS NOT NULL AND r13 IS NOT NULL THEN q1 END AS q1, CASE WHEN r2 IS NOT NULL AND r14 IS NOT NULL THEN q2 END AS q2, CASE WHEN r3 IS NOT NULL AND r15 IS NOT NULL THEN q3 END AS q3, CASE WHEN r1 IS NOT NULL AND med IS NOT NULL THEN lv END AS lv) FROM b),
c AS (SELECT *, CAST(coalesce(q1 < 0.6, false) AS INTEGER) + CAST(coalesce(q2 < 0.6, false) AS INTEGER) + CAST(coalesce(q3 < 0.6, false) AS INTEGER) AS n FROM b2),
d AS (SELECT *, coalesce(q1 < 0.5, false) AND (coalesce(lv < 0.6, false) OR n >= 2) AND coalesce(last_observed_revenue >= 0, false) AS hit FROM c)
SELECT stock_id, target_year, target_month, round(q1, 4) AS break_last_yoy_ratio, round(lv, 4) AS break_level_ratio, round(q2, 4) AS break_recent_ratio_2, round(q3, 4) AS break_recent_ratio_3, n AS recent_break_count, hit AS structural_break_detected,
       round(CASE WHEN hit THEN greatest(0.1 * formula_adjusted_revenue + 0.9 * last_observed_revenue, 0) ELSE formula_adjusted_revenue END, 4) AS formula_adjusted_revenue
FROM d"""


def month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01 as a batch."""
    return neat(mtd(daily_totals(table(spark, sf_dir, "events"))), 4)


def month_to_date_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01 as a stream over the event files (a pattern, so that one file is a source too): the days that the watermark has closed."""
    at = f"{shared_dir(spark)}/tidemark-month-to-date-{uuid.uuid4().hex}"
    return neat(run_month_to_date(spark, f"{sf_dir}/event[s].parquet", "event_id long, ts timestamp, user_id long, value double", f"{at}/days", f"{at}/mark"), 4)


MTD_SQL = """WITH d AS (SELECT user_id AS stock_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS events FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1) GROUP BY 1, 2)
SELECT stock_id, day, round(revenue, 4) AS revenue, events, round(sum(revenue) OVER (PARTITION BY stock_id, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING), 4) AS month_to_date FROM d"""

#: All files come in one batch, so nothing is late; days are closed up to two days before the newest event.
MTD_STREAM_SQL = f"SELECT * FROM ({MTD_SQL}) WHERE day + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 DAY"

QUERIES = {
    "month_to_date": month_to_date,
    "month_to_date_stream": month_to_date_stream,
    "revenue_features": revenue_features,
    "revenue_features_gappy": revenue_features_gappy,
    "model_features": model_features,
    "growth_windows": growth_windows,
    "sequence_samples": sequence_samples,
    "eps_features": eps_features,
    "formula_forecast": formula_forecast,
    "three_month_totals": three_month_totals,
    "structural_breaks": structural_breaks,
}
ORACLE_SQL = {
    "month_to_date": MTD_SQL,
    "month_to_date_stream": MTD_STREAM_SQL,
    "revenue_features": _features_sql("l_suppkey"),
    "revenue_features_gappy": _features_sql("l_partkey"),
    "model_features": MODEL_SQL,
    "growth_windows": GROWTH_SQL,
    "sequence_samples": SEQUENCE_SQL,
    "eps_features": EPS_SQL,
    "formula_forecast": FORMULA_SQL,
    "three_month_totals": THREE_SQL,
    "structural_breaks": BREAK_SQL,
}
