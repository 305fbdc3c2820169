"""Building blocks of the DuckDB twins of the registered queries, as named common table expressions."""

from __future__ import annotations

TARGET = 2000
AS_OF = "DATE '2000-01-10'"


def panel(key: str = "l_suppkey") -> str:
    return f"""panel AS (
  SELECT {key} AS stock_id, CAST(year(l_shipdate) AS INTEGER) AS revenue_year, CAST(month(l_shipdate) AS INTEGER) AS revenue_month,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM lineitem GROUP BY 1, 2, 3)"""


SEGMENTS = """mi AS (SELECT *, revenue_year * 12 + revenue_month - 1 AS month_index FROM panel),
st AS (SELECT *, CASE WHEN month_index - lag(month_index) OVER (PARTITION BY stock_id ORDER BY month_index) = 1 THEN 0 ELSE 1 END AS s FROM mi),
sg AS (SELECT * EXCLUDE s, sum(s) OVER (PARTITION BY stock_id ORDER BY month_index ROWS UNBOUNDED PRECEDING) AS calendar_segment FROM st),
seg AS (SELECT *, row_number() OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index) AS consecutive_months FROM sg)"""

BASELINES = """bl0 AS (
  SELECT *, consecutive_months - 1 AS history_months, lag(revenue) OVER w AS last_observed_revenue, lag(revenue, 12) OVER w AS seasonal_naive_revenue,
         abs(revenue - lag(revenue, 12) OVER w) AS d12, abs(revenue - lag(revenue) OVER w) AS d1
  FROM seg WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
bl1 AS (
  SELECT *, CASE WHEN history_months >= 24 THEN avg(d12) OVER p WHEN history_months >= 2 THEN avg(d1) OVER p END AS ms
  FROM bl0 WINDOW p AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bl AS (SELECT * EXCLUDE (d12, d1, ms), CASE WHEN ms > 0 THEN ms END AS mase_scale FROM bl1)"""


def formula(grid: str | None = None) -> str:
    """The revenue formula over ``bl``; ``grid`` is a table of parameters, else the standard ones."""
    grid = grid or "SELECT 0 AS config_id, 0.75 AS seasonal_weight, 0.2 AS residual_alpha, 0.5 AS residual_strength, ln(2.0) AS growth_log_cap, 0.5 AS correction_log_cap"
    return f"""grid AS ({grid}),
g0 AS (
  SELECT *, ln(1 + lag(revenue, 1) OVER w) - ln(1 + lag(revenue, 13) OVER w) AS g1, ln(1 + lag(revenue, 2) OVER w) - ln(1 + lag(revenue, 14) OVER w) AS g2,
         ln(1 + lag(revenue, 3) OVER w) - ln(1 + lag(revenue, 15) OVER w) AS g3
  FROM bl WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
f1 AS (
  SELECT g0.*, grid.*, history_months >= 15 AS known,
         CASE WHEN history_months >= 15 THEN greatest(least(g1 + g2 + g3 - greatest(g1, g2, g3) - least(g1, g2, g3), growth_log_cap), -growth_log_cap) END AS growth_log
  FROM g0 CROSS JOIN grid),
f2 AS (
  SELECT *, exp(ln(1 + seasonal_naive_revenue) + growth_log) - 1 AS seasonal_growth_forecast FROM f1),
f3 AS (
  SELECT *, CASE WHEN known THEN greatest(exp(seasonal_weight * ln(1 + greatest(seasonal_growth_forecast, 0)) + (1 - seasonal_weight) * ln(1 + last_observed_revenue)) - 1, 0) END AS base FROM f2),
f4 AS (
  SELECT *, CASE WHEN known THEN coalesce(residual_alpha * pow(1 - residual_alpha, consecutive_months - 1)
           * sum((ln(1 + revenue) - ln(1 + base)) * pow(1 - residual_alpha, -consecutive_months)) OVER (PARTITION BY config_id, stock_id, calendar_segment ORDER BY month_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS residual_state
  FROM f3),
f5 AS (
  SELECT *, greatest(least(residual_strength * residual_state, correction_log_cap), -correction_log_cap) AS corr,
         CASE WHEN history_months >= 12 THEN seasonal_naive_revenue WHEN history_months > 0 THEN last_observed_revenue END AS plain FROM f4),
formula AS (
  SELECT *, revenue AS actual_revenue, revenue_year AS target_year, revenue_month AS target_month, coalesce(base, plain) AS formula_base_revenue,
         CASE WHEN known THEN greatest(exp(ln(1 + base) + corr) - 1, 0) ELSE plain END AS formula_adjusted_revenue,
         CASE WHEN known THEN 'revenue_adjustment_formula' WHEN history_months >= 12 THEN 'seasonal_naive_fallback' WHEN history_months > 0 THEN 'last_observed_fallback' ELSE 'missing_prediction' END AS forecast_method
  FROM f5)"""


PREDICTIONS = f"""pred AS (
  SELECT stock_id, target_year, target_month, month_index, actual_revenue, last_observed_revenue, mase_scale, m.model, m.p AS predicted_revenue
  FROM (SELECT *, unnest([{{'model': 'formula', 'p': formula_adjusted_revenue}}, {{'model': 'seasonal_naive', 'p': seasonal_naive_revenue}}, {{'model': 'last_observed', 'p': last_observed_revenue}}]) AS m
        FROM formula WHERE target_year = {TARGET}) WHERE m.p IS NOT NULL)"""


def full(key: str = "l_suppkey") -> str:
    """Everything up to the predictions of the target year."""
    return ",\n".join([panel(key), SEGMENTS, BASELINES, formula(), PREDICTIONS])


def metrics(p: str = "predicted_revenue", a: str = "actual_revenue", digits: int = 6) -> str:
    """The metric vector as select items."""
    e = f"({p} - {a})"
    items = {
        "MSE": f"avg({e} * {e})",
        "RMSE": f"sqrt(avg({e} * {e}))",
        "MAE": f"avg(abs{e})",
        "MAPE": f"avg(CASE WHEN {a} <> 0 THEN abs{e} / abs({a}) END) * 100",
        "MedianAPE": f"quantile_cont(CASE WHEN {a} <> 0 THEN abs{e} / abs({a}) END, 0.5) * 100",
        "WMAPE": f"sum(abs{e}) / nullif(sum(abs({a})), 0) * 100",
        "SMAPE": f"avg(CASE WHEN abs({a}) + abs({p}) <> 0 THEN 2 * abs{e} / (abs({a}) + abs({p})) END) * 100",
        "Bias": f"avg{e}",
        "UnderestimateRate": f"avg(CAST({p} < {a} AS INTEGER)) * 100",
        "DirectionAccuracy": f"avg(CASE WHEN last_observed_revenue IS NOT NULL THEN CAST(sign({p} - last_observed_revenue) = sign({a} - last_observed_revenue) AS INTEGER) END) * 100",
    }
    return "count(*) AS observations, " + ", ".join(f"round({v}, {digits}) AS {k}" for k, v in items.items())


EPS = """q AS (
  SELECT l_suppkey AS stock_id, CAST(year(l_shipdate) AS INTEGER) AS eps_year, CAST(quarter(l_shipdate) AS INTEGER) AS eps_quarter,
         CAST(sum(CAST(l_extendedprice * (l_discount - l_tax) AS DECIMAL(18,4))) AS DOUBLE) / 1e4 AS EPS
  FROM lineitem GROUP BY 1, 2, 3),
eps AS (
  SELECT *, CASE eps_quarter WHEN 1 THEN make_date(eps_year, 5, 15) WHEN 2 THEN make_date(eps_year, 8, 14) WHEN 3 THEN make_date(eps_year, 11, 14) ELSE make_date(eps_year + 1, 3, 31) END AS statement_available_date FROM q)"""

DIVIDENDS = """dv AS (
  SELECT *, make_date(fiscal_year + 1, 6, 10) AS available_date, make_date(fiscal_year + 1, 7, 2) AS ex_dividend_date
  FROM (SELECT l_suppkey AS stock_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) / 1e5 AS TotalCashDividend
        FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2))"""

PRICES = """px AS (
  SELECT l_suppkey AS stock_id, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) / 100 AS close
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""

MASTER = """master AS (SELECT s_suppkey AS stock_id, s_name AS stock_name, n_name AS industry_category FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

#: Annual revenue of the formula, EPS ratios known at the cut-off, and the estimates built on them.
FINANCE = f"""monthly AS (SELECT 'formula' AS model, stock_id, target_year, target_month, predicted_revenue FROM pred WHERE model = 'formula'),
annual AS (SELECT model, stock_id, target_year, sum(greatest(predicted_revenue, 0)) AS predicted_annual_revenue FROM monthly GROUP BY 1, 2, 3 HAVING count(DISTINCT target_month) = 12),
past AS (SELECT * FROM panel WHERE make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= {AS_OF}),
ek AS (SELECT * FROM eps WHERE statement_available_date <= {AS_OF}),
ae AS (SELECT stock_id, eps_year, sum(EPS) AS annual_eps, max(statement_available_date) AS latest_available_date FROM ek GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4),
ar AS (SELECT stock_id, revenue_year, sum(revenue) AS annual_revenue FROM past GROUP BY 1, 2 HAVING count(DISTINCT revenue_month) >= 12),
hist AS (SELECT ar.stock_id, revenue_year, annual_revenue, annual_eps, annual_eps / annual_revenue AS r FROM ar JOIN ae ON ar.stock_id = ae.stock_id AND revenue_year = eps_year WHERE annual_revenue > 0),
h3 AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY revenue_year DESC) <= 3),
rr AS (SELECT stock_id, quantile_cont(r, 0.5) AS ratio, max(revenue_year) AS eps_reference_year FROM h3 GROUP BY 1)"""
