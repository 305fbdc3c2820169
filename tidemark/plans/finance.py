"""Queries from predictions to earnings, dividends and yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cohorts as K
from tidemark.operators import finance as FI
from tidemark.operators import forecast as FC
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.sources.adapters import AS_OF, TARGET_YEAR, daily_prices, dividends, entity_master, monthly_revenue, quarterly_eps, written_facts


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    facts = written_facts(spark, sf_dir)
    revenue, quarterly = facts["revenue"], facts["quarterly"]
    monthly = predictions(spark, sf_dir, panel=revenue).where("model = 'formula'").select("model", "stock_id", "target_year", "target_month", "predicted_revenue")
    public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(AS_OF).cast("date")
    past = revenue.where(public)
    eps = FI.annual_eps(quarterly, AS_OF)
    annual, failures = FI.annual_predictions(monthly)
    return {"monthly": monthly, "past": past, "quarterly": quarterly, "known": FI.available(quarterly, "statement_available_date", AS_OF), "eps": eps, "annual": annual, "failures": failures, "history": FI.ratio_history(past, eps), "dividends": facts["dividends"], "prices": daily_prices(spark, sf_dir)}


_BASE = f"WITH {S.full()}, {S.EPS}, {S.DIVIDENDS}, {S.PRICES}, {S.MASTER}, {S.FINANCE}"


def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-03: complete years of revenue beside complete years of EPS."""
    revenue = FI.annual_revenue(monthly_revenue(spark, sf_dir)).select("stock_id", F.col("revenue_year").alias("year"), "annual_revenue")
    eps = FI.annual_eps(quarterly_eps(spark, sf_dir)).select("stock_id", F.col("eps_year").alias("year"), "annual_eps", "latest_available_date")
    return neat(revenue.join(eps, ["stock_id", "year"], "full"), 9)


ANNUAL_SQL = f"""WITH {S.panel()}, {S.EPS},
a AS (SELECT stock_id, revenue_year AS year, sum(revenue) AS annual_revenue FROM panel GROUP BY 1, 2 HAVING count(DISTINCT revenue_month) >= 12),
b AS (SELECT stock_id, eps_year AS year, sum(EPS) AS annual_eps, max(statement_available_date) AS latest_available_date FROM eps GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4)
SELECT stock_id, year, round(annual_revenue, 9) AS annual_revenue, round(annual_eps, 9) AS annual_eps, latest_available_date FROM a FULL JOIN b USING (stock_id, year)"""


def prediction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05: entities whose year cannot be summed, with the reason."""
    return _inputs(spark, sf_dir)["failures"]


FAILURES_SQL = f"{_BASE} SELECT model, stock_id, target_year, 'incomplete year' AS reason, count(DISTINCT target_month) AS months FROM monthly GROUP BY 1, 2, 3 HAVING count(DISTINCT target_month) < 12"


def eps_current_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return neat(FI.eps_by_ratio(x["annual"], x["history"]).select("model", "stock_id", "target_year", "predicted_annual_revenue", "eps_to_revenue_ratio", "eps_reference_year", "estimated_eps", "status"))


RATIO_SQL = f"""{_BASE}
SELECT model, annual.stock_id, target_year, round(predicted_annual_revenue, 6) AS predicted_annual_revenue, round(ratio, 6) AS eps_to_revenue_ratio, eps_reference_year,
       round(predicted_annual_revenue * ratio, 6) AS estimated_eps, CASE WHEN ratio IS NULL THEN 'EPS unavailable' ELSE 'ok' END AS status
FROM annual LEFT JOIN rr ON annual.stock_id = rr.stock_id"""

_QUARTERS = """qr AS (SELECT stock_id, revenue_year, (revenue_month - 1) // 3 + 1 AS eps_quarter, sum(revenue) AS qrev FROM past GROUP BY 1, 2, 3 HAVING count(DISTINCT revenue_month) >= 3),
qh AS (SELECT qr.stock_id, qr.eps_quarter, revenue_year, EPS / qrev AS r FROM qr JOIN ek ON qr.stock_id = ek.stock_id AND revenue_year = eps_year AND qr.eps_quarter = ek.eps_quarter WHERE qrev > 0
       QUALIFY row_number() OVER (PARTITION BY qr.stock_id, qr.eps_quarter ORDER BY revenue_year DESC) <= 3),
qm AS (SELECT stock_id, eps_quarter, quantile_cont(r, 0.5) AS r, max(revenue_year) AS y FROM qh GROUP BY 1, 2),
tq AS (SELECT model, stock_id, target_year, (target_month - 1) // 3 + 1 AS eps_quarter, sum(predicted_revenue) AS q FROM monthly GROUP BY 1, 2, 3, 4)"""


def eps_seasonal_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    rows = FI.eps_by_quarter(x["annual"], x["monthly"], x["past"], x["known"], x["history"])
    return neat(rows.select("model", "stock_id", "target_year", "estimated_eps", "used_quarters", "fallback_quarters", "eps_reference_year", "status"))


SEASONAL_SQL = f"""{_BASE}, {_QUARTERS},
u AS (SELECT tq.*, qm.r AS r, qm.y, coalesce(qm.r, rr.ratio) AS x FROM tq LEFT JOIN qm ON tq.stock_id = qm.stock_id AND tq.eps_quarter = qm.eps_quarter LEFT JOIN rr ON tq.stock_id = rr.stock_id),
t AS (SELECT model, stock_id, target_year, sum(q * x) AS e, count(x) AS used_quarters, count(*) FILTER (WHERE r IS NULL) AS fallback_quarters, max(y) AS eps_reference_year FROM u GROUP BY 1, 2, 3)
SELECT annual.model, annual.stock_id, annual.target_year, round(CASE WHEN used_quarters >= 4 THEN e END, 6) AS estimated_eps, used_quarters, fallback_quarters, eps_reference_year, CASE WHEN used_quarters >= 4 THEN 'ok' ELSE 'EPS unavailable' END AS status
FROM annual LEFT JOIN t ON annual.model = t.model AND annual.stock_id = t.stock_id AND annual.target_year = t.target_year"""


def eps_known_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return neat(FI.eps_known_quarters(x["annual"], x["monthly"], x["past"], x["quarterly"], x["history"], TARGET_YEAR, "2000-06-01"))


_KNOWN_BASE = _BASE.replace(f"ek AS (SELECT * FROM eps WHERE statement_available_date <= {S.AS_OF})", f"ek AS (SELECT * FROM eps WHERE statement_available_date <= {S.AS_OF}), e6 AS (SELECT * FROM eps WHERE statement_available_date <= DATE '2000-06-01')")
KNOWN_SQL = f"""{_KNOWN_BASE}, {_QUARTERS.replace('JOIN ek ', 'JOIN e6 ').replace('ek.', 'e6.')},
g AS (SELECT model, stock_id, target_year, unnest([1, 2, 3, 4]) AS eps_quarter FROM annual),
j AS (SELECT g.*, k.EPS AS a, tq.q * qm.r AS s, tq.q * rr.ratio AS f FROM g LEFT JOIN (SELECT * FROM e6 WHERE eps_year = 2000) k ON g.stock_id = k.stock_id AND g.eps_quarter = k.eps_quarter
      LEFT JOIN tq ON g.model = tq.model AND g.stock_id = tq.stock_id AND g.target_year = tq.target_year AND g.eps_quarter = tq.eps_quarter
      LEFT JOIN qm ON g.stock_id = qm.stock_id AND g.eps_quarter = qm.eps_quarter LEFT JOIN rr ON g.stock_id = rr.stock_id)
SELECT model, stock_id, target_year, eps_quarter, round(coalesce(a, s, f), 6) AS estimated_eps, CASE WHEN a IS NOT NULL THEN 'actual' WHEN s IS NOT NULL THEN 'seasonal' WHEN f IS NOT NULL THEN 'annual' ELSE 'unavailable' END AS basis FROM j"""


def dividend_payout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    rows = FI.dividend_by_payout(FI.eps_by_ratio(x["annual"], x["history"]), FI.payout_history(x["dividends"], x["eps"], AS_OF)).join(FI.actual_dividend(x["dividends"], TARGET_YEAR), "stock_id", "left")
    return neat(K.paid_outcomes(rows).select("stock_id", "estimated_eps", "payout_ratio", "dividend_reference_year", "estimated_cash_dividend", "dividend_source", "actual_cash_dividend", "outcome"))


_PAYOUT = f"""cash AS (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c FROM dv WHERE available_date <= {S.AS_OF} GROUP BY 1, 2),
ph AS (SELECT cash.stock_id, fiscal_year, least(greatest(c / annual_eps, 0), 1.5) AS p FROM cash JOIN ae ON cash.stock_id = ae.stock_id AND fiscal_year = eps_year WHERE annual_eps > 0 AND c >= 0),
own AS (SELECT stock_id, quantile_cont(p, 0.5) AS p, max(fiscal_year) AS y FROM (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY fiscal_year DESC) <= 3) GROUP BY 1),
cs AS (SELECT quantile_cont(m, 0.5) AS p FROM (SELECT quantile_cont(p, 0.5) AS m FROM ph GROUP BY stock_id)),
est AS (SELECT annual.model, annual.stock_id, annual.target_year, predicted_annual_revenue * ratio AS estimated_eps FROM annual LEFT JOIN rr ON annual.stock_id = rr.stock_id),
act AS (SELECT stock_id, sum(TotalCashDividend) AS actual FROM dv WHERE year(ex_dividend_date) = 2000 GROUP BY 1),
dd AS (SELECT est.*, coalesce(own.p, cs.p) AS payout_ratio, own.y, own.p AS op, cs.p AS cp, CASE WHEN estimated_eps IS NOT NULL AND coalesce(own.p, cs.p) IS NOT NULL THEN greatest(estimated_eps * coalesce(own.p, cs.p), 0) END AS cash, actual
       FROM est LEFT JOIN own ON est.stock_id = own.stock_id CROSS JOIN cs LEFT JOIN act ON est.stock_id = act.stock_id)"""
PAYOUT_SQL = f"""{_BASE}, {_PAYOUT}
SELECT stock_id, round(estimated_eps, 6) AS estimated_eps, round(payout_ratio, 6) AS payout_ratio, y AS dividend_reference_year, round(cash, 6) AS estimated_cash_dividend,
       CASE WHEN op IS NOT NULL THEN 'own payout' WHEN cp IS NOT NULL THEN 'cross-sectional payout' ELSE 'unavailable' END AS dividend_source, round(actual, 6) AS actual_cash_dividend,
       CASE WHEN actual IS NULL OR cash IS NULL THEN 'unknown' WHEN actual > 0 AND cash > 0 THEN 'true_positive' WHEN cash > 0 THEN 'false_positive' WHEN actual > 0 THEN 'false_negative' ELSE 'true_negative' END AS outcome
FROM dd"""


def dividend_cash_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(FI.cash_history_dividends(dividends(spark, sf_dir), AS_OF), 7)


CASH_SQL = f"""WITH {S.DIVIDENDS},
c AS (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c, row_number() OVER (PARTITION BY stock_id ORDER BY fiscal_year DESC) AS n FROM dv WHERE available_date <= {S.AS_OF} GROUP BY 1, 2),
w AS (SELECT stock_id, max(fiscal_year) AS dividend_reference_year, max(c) FILTER (WHERE n = 1) AS l, quantile_cont(c, 0.5) AS m, sum(c * CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) / sum(CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) AS s FROM c WHERE n <= 3 GROUP BY 1),
u AS (SELECT stock_id, dividend_reference_year, unnest([{{'k': 'announcement_safe_last', 'v': l}}, {{'k': 'announcement_safe_median', 'v': m}}, {{'k': 'announcement_safe_smoothed', 'v': s}}]) AS u FROM w)
SELECT stock_id, dividend_reference_year, u.k AS dividend_method, round(u.v, 7) AS estimated_cash_dividend FROM u"""


def dividend_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    history = FI.five_years(entity_master(spark, sf_dir), x["eps"], x["dividends"], AS_OF)
    rows = FI.dividend_by_pattern(FI.eps_by_ratio(x["annual"], x["history"]), FI.dividend_patterns(history, 0.6)).select("stock_id", "estimated_cash_dividend")
    return neat(FI.dividend_patterns(history, 0.6).join(rows, "stock_id", "left"))


PATTERNS_SQL = f"""{_BASE},
g AS (SELECT stock_id, unnest([1995, 1996, 1997, 1998, 1999]) AS fiscal_year FROM master),
c AS (SELECT stock_id, fiscal_year, CASE WHEN bool_and(TotalCashDividend >= 0) THEN sum(TotalCashDividend) END AS c FROM dv WHERE available_date <= {S.AS_OF} GROUP BY 1, 2),
k AS (SELECT * FROM ae WHERE latest_available_date <= {S.AS_OF}),
h AS (SELECT g.stock_id, g.fiscal_year, c, CASE WHEN annual_eps > 0 AND c IS NOT NULL THEN c / annual_eps END AS p FROM g LEFT JOIN c ON g.stock_id = c.stock_id AND g.fiscal_year = c.fiscal_year LEFT JOIN k ON g.stock_id = k.stock_id AND g.fiscal_year = k.eps_year),
s AS (SELECT stock_id, count(c) AS cash_history_years, count(*) FILTER (WHERE c > 0) AS positive_cash_years, count(*) FILTER (WHERE c = 0) AS zero_cash_years, quantile_cont(c, 0.5) AS m, max(c) AS mx, min(c) AS mn,
             avg(p) AS payout_ratio, count(p) AS payout_valid_years, max(fiscal_year) FILTER (WHERE c IS NOT NULL) AS dividend_reference_year FROM h GROUP BY 1),
d AS (SELECT *, CASE WHEN m > 0 THEN greatest(abs(mx / m - 1), abs(mn / m - 1)) END AS dev FROM s),
f AS (SELECT *, CASE WHEN zero_cash_years = 5 THEN 'none' WHEN positive_cash_years = 5 AND dev <= 0.6 + 1e-12 THEN 'fixed' WHEN cash_history_years >= 3 AND positive_cash_years > 0 THEN 'normal' ELSE 'insufficient' END AS dividend_pattern FROM d),
est AS (SELECT annual.stock_id, predicted_annual_revenue * ratio AS e FROM annual LEFT JOIN rr ON annual.stock_id = rr.stock_id)
SELECT f.stock_id, cash_history_years, positive_cash_years, zero_cash_years, round(payout_ratio, 6) AS payout_ratio, payout_valid_years, dividend_reference_year, round(dev, 6) AS cash_max_deviation, dividend_pattern,
       round(CASE WHEN dividend_pattern = 'fixed' THEN m END, 6) AS fixed_cash_dividend,
       round(CASE WHEN est.stock_id IS NULL THEN NULL WHEN dividend_pattern = 'none' THEN 0 WHEN dividend_pattern = 'fixed' THEN m WHEN dividend_pattern = 'normal' AND e * payout_ratio IS NOT NULL THEN greatest(e * payout_ratio, 0) END, 6) AS estimated_cash_dividend
FROM f LEFT JOIN est ON f.stock_id = est.stock_id"""


def dividend_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(FI.dividend_chain(entity_master(spark, sf_dir), dividends(spark, sf_dir), TARGET_YEAR), 7)


CHAIN_SQL = f"""WITH {S.DIVIDENDS}, {S.MASTER},
e AS (SELECT stock_id, year(ex_dividend_date) AS y, sum(TotalCashDividend) AS v FROM dv GROUP BY 1, 2),
c AS (SELECT stock_id, 1 AS p, v, y FROM e WHERE y = 2000 UNION ALL SELECT stock_id, 2, sum(TotalCashDividend), 1999 FROM dv WHERE fiscal_year = 1999 GROUP BY 1 UNION ALL SELECT stock_id, 3, v, y FROM e WHERE y < 2000),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY p, y DESC) = 1)
SELECT master.stock_id, round(v, 7) AS cash_dividend, CAST(y AS INTEGER) AS source_year, CASE p WHEN 1 THEN 'ex_year' WHEN 2 THEN 'fiscal_year' WHEN 3 THEN 'latest_before' ELSE 'none' END AS source FROM master LEFT JOIN b ON master.stock_id = b.stock_id"""


def dividend_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    rows = FI.dividend_by_payout(FI.eps_by_ratio(x["annual"], x["history"]), FI.payout_history(x["dividends"], x["eps"], AS_OF)).join(FI.actual_dividend(x["dividends"], TARGET_YEAR), "stock_id", "left")
    out = FI.dividend_yields(rows.select("stock_id", "estimated_cash_dividend", "actual_cash_dividend"), x["prices"], TARGET_YEAR, AS_OF)
    return neat(out.select("stock_id", "yield_mode", "target_month", "price_date", (F.col("stock_price") + 3e-8).alias("stock_price"), "estimated_yield_percent", "actual_yield_percent", "yield_error_percent_point", "is_evaluation"))


YIELDS_SQL = f"""{_BASE}, {_PAYOUT},
now AS (SELECT stock_id, arg_max(close, date) AS stock_price, max(date) AS price_date FROM px WHERE date <= {S.AS_OF} GROUP BY 1),
mo AS (SELECT stock_id, CAST(CASE WHEN year(date) = 2000 THEN month(date) ELSE 0 END AS INTEGER) AS target_month, arg_max(close, date) AS close, max(date) AS price_date FROM px WHERE year(date) <= 2000 GROUP BY 1, 2),
gr AS (SELECT stock_id, CAST(unnest(range(0, 13)) AS INTEGER) AS target_month FROM (SELECT DISTINCT stock_id FROM mo)),
fl AS (SELECT gr.stock_id, gr.target_month, last_value(close IGNORE NULLS) OVER w AS stock_price, last_value(price_date IGNORE NULLS) OVER w AS price_date FROM gr LEFT JOIN mo ON gr.stock_id = mo.stock_id AND gr.target_month = mo.target_month
       WINDOW w AS (PARTITION BY gr.stock_id ORDER BY gr.target_month ROWS UNBOUNDED PRECEDING)),
y AS (
  SELECT dd.stock_id, 'as_of_price' AS yield_mode, CAST(NULL AS INTEGER) AS target_month, price_date, stock_price, cash, CAST(NULL AS DOUBLE) AS actual, false AS is_evaluation FROM dd LEFT JOIN now ON dd.stock_id = now.stock_id
  UNION ALL SELECT dd.stock_id, 'target_month_end', m.target_month, price_date, stock_price, cash, actual, true FROM dd CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS target_month) m LEFT JOIN fl ON dd.stock_id = fl.stock_id AND m.target_month = fl.target_month)
SELECT stock_id, yield_mode, target_month, price_date, round(stock_price + 3e-8, 6) AS stock_price, round(cash / stock_price * 100, 6) AS estimated_yield_percent, round(actual / stock_price * 100, 6) AS actual_yield_percent,
       round(cash / stock_price * 100 - actual / stock_price * 100, 6) AS yield_error_percent_point, is_evaluation FROM y"""


def ratio_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.stability_bucket(K.ratio_stability(_inputs(spark, sf_dir)["history"]))
    return neat(rows.select("stock_id", "ratio_count", "ratio_std_to_median", "latest_deviation_percent", (F.col("max_abs_change") * 1e6).alias("max_abs_change"), "ratio_stability_bucket"))


STABILITY_SQL = f"""{_BASE},
x AS (SELECT *, abs(r - lag(r) OVER (PARTITION BY stock_id ORDER BY revenue_year)) AS ch, row_number() OVER (PARTITION BY stock_id ORDER BY revenue_year DESC) AS n FROM hist),
s AS (SELECT stock_id, count(*) AS ratio_count, stddev_pop(r) AS sd, quantile_cont(r, 0.5) AS md, quantile_cont(r, 0.5) FILTER (WHERE n <= 3) AS rm, max(r) FILTER (WHERE n = 1) AS lt, max(ch) AS mc FROM x GROUP BY 1),
t AS (SELECT *, CASE WHEN abs(md) > 1e-12 THEN abs(sd / md) END AS cv, CASE WHEN abs(rm) > 1e-12 THEN abs(lt - rm) / abs(rm) * 100 END AS dv FROM s)
SELECT stock_id, ratio_count, round(cv, 6) AS ratio_std_to_median, round(dv, 6) AS latest_deviation_percent, round(mc * 1e6, 6) AS max_abs_change,
       CASE WHEN ratio_count < 3 THEN 'insufficient_history' WHEN cv IS NULL THEN 'unstable_ratio' WHEN cv <= 0.35 AND coalesce(dv, 0) <= 50 THEN 'stable_ratio' WHEN cv <= 1 AND coalesce(dv, 0) <= 150 THEN 'moderate_ratio' ELSE 'unstable_ratio' END AS ratio_stability_bucket FROM t"""


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(FC.seasonal_quantile_forecast(monthly_revenue(spark, sf_dir), TARGET_YEAR), 4)


SEASONAL_FORECAST_SQL = f"""WITH {S.panel()},
p AS (SELECT *, CASE WHEN lag(revenue_year) OVER w = revenue_year - 1 THEN revenue / nullif(lag(revenue) OVER w, 0) - 1 END AS g, row_number() OVER (PARTITION BY stock_id, revenue_month ORDER BY revenue_year DESC) AS n
      FROM panel WHERE revenue_year < 2000 WINDOW w AS (PARTITION BY stock_id, revenue_month ORDER BY revenue_year)),
m AS (SELECT stock_id, revenue_month, max(revenue) FILTER (WHERE revenue_year = 1999) AS b, quantile_cont(g, 0.5) FILTER (WHERE n <= 3) AS g FROM p GROUP BY 1, 2),
a AS (SELECT stock_id, avg(revenue) AS a FROM p WHERE revenue_year = 1999 GROUP BY 1),
k AS (SELECT stock_id, CAST(unnest(range(1, 13)) AS INTEGER) AS target_month FROM (SELECT DISTINCT stock_id FROM p))
SELECT k.stock_id, 2000 AS target_year, target_month, round(greatest(coalesce(b, a) * (1 + coalesce(g, 0)), 0), 4) AS predicted_revenue FROM k LEFT JOIN m ON k.stock_id = m.stock_id AND target_month = revenue_month LEFT JOIN a ON k.stock_id = a.stock_id"""


def weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-03 to FC-05: weights from 1999, applied to 2000."""
    weights = FC.inverse_error_weights(predictions(spark, sf_dir, 1999), ("formula", "last_observed", "seasonal_naive"))
    return neat(FC.weighted_ensemble(predictions(spark, sf_dir), weights), 4)


_PRED99 = S.PREDICTIONS.replace("pred AS (", "pv AS (", 1).replace(f"target_year = {S.TARGET}", "target_year = 1999")
ENSEMBLE_SQL = f"""WITH {S.full()}, {_PRED99},
mp AS (SELECT stock_id, model, avg(CASE WHEN actual_revenue <> 0 THEN abs(predicted_revenue - actual_revenue) / abs(actual_revenue) END) * 100 AS mape FROM pv GROUP BY 1, 2),
gk AS (SELECT stock_id, unnest(['formula', 'last_observed', 'seasonal_naive']) AS model FROM (SELECT DISTINCT stock_id FROM pv)),
wt AS (SELECT gk.stock_id, gk.model, 1 / greatest(coalesce(mape, max(mape) OVER (PARTITION BY gk.stock_id), 1.0), 1e-6) AS w FROM gk LEFT JOIN mp ON gk.stock_id = mp.stock_id AND gk.model = mp.model),
en AS (SELECT pred.stock_id, target_year, target_month, sum(w * predicted_revenue) / sum(w) AS p, coalesce(stddev_samp(predicted_revenue), 0) AS s, count(*) AS models FROM pred JOIN wt ON pred.stock_id = wt.stock_id AND pred.model = wt.model GROUP BY 1, 2, 3)
SELECT stock_id, target_year, target_month, round(p, 4) AS predicted_revenue, round(s, 4) AS spread, models, round(greatest(p - 1.28 * s, 0), 4) AS lower, round(p + 1.28 * s, 4) AS upper FROM en"""


def time_safe_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-03, FEA-04, DIV-09: three cut-offs an entity, features, buckets and rules of thumb."""
    samples = entity_master(spark, sf_dir).select("stock_id", F.explode(F.array(*[F.lit(y) for y in (1998, 1999, 2000)])).alias("target_year")).withColumn("as_of_date", F.make_date("target_year", F.lit(1), F.lit(10)))
    rows = FI.time_safe_features(samples, monthly_revenue(spark, sf_dir), quarterly_eps(spark, sf_dir), dividends(spark, sf_dir))
    return neat(FI.heuristic_hurdles(FI.selection_buckets(rows)).drop("as_of_date"), 5)


BUCKETS_SQL = f"""WITH {S.panel()}, {S.EPS}, {S.DIVIDENDS}, {S.MASTER},
sm AS (SELECT stock_id, CAST(y AS INTEGER) AS target_year, make_date(y, 1, 10) AS d FROM master, (SELECT unnest([1998, 1999, 2000]) AS y)),
c AS (SELECT sm.stock_id, target_year, fiscal_year, TotalCashDividend AS v, row_number() OVER (PARTITION BY sm.stock_id, target_year ORDER BY fiscal_year DESC) AS n FROM sm JOIN dv ON sm.stock_id = dv.stock_id AND available_date <= d),
c2 AS (SELECT stock_id, target_year, max(v) FILTER (WHERE n = 1) AS last_known_cash_dividend, quantile_cont(v, 0.5) FILTER (WHERE n <= 3) AS recent_cash_dividend_median, avg(v) FILTER (WHERE n <= 3) AS recent_cash_dividend_mean,
        sum(v * CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) FILTER (WHERE n <= 3) / sum(CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) FILTER (WHERE n <= 3) AS recent_cash_dividend_smoothed,
        avg(CAST(v > 0 AS INTEGER)) FILTER (WHERE n <= 3) AS recent_paid_rate, count(*) AS dividend_history_count, CAST(target_year - max(fiscal_year) AS DOUBLE) AS years_since_last_dividend_reference FROM c GROUP BY 1, 2),
e AS (SELECT sm.stock_id, target_year, EPS AS v, row_number() OVER (PARTITION BY sm.stock_id, target_year ORDER BY eps_year DESC, eps_quarter DESC) AS n FROM sm JOIN eps ON sm.stock_id = eps.stock_id AND statement_available_date <= d),
e2 AS (SELECT stock_id, target_year, max(v) FILTER (WHERE n = 1) AS latest_available_eps, sum(v) FILTER (WHERE n <= 4) AS available_eps_ttm, CASE WHEN count(*) >= 8 THEN sum(v) FILTER (WHERE n <= 4) / nullif(sum(v) FILTER (WHERE n BETWEEN 5 AND 8), 0) - 1 END AS available_eps_ttm_yoy, count(*) AS eps_history_count FROM e GROUP BY 1, 2),
r AS (SELECT sm.stock_id, target_year, revenue AS v, row_number() OVER (PARTITION BY sm.stock_id, target_year ORDER BY revenue_year DESC, revenue_month DESC) AS n FROM sm JOIN panel ON sm.stock_id = panel.stock_id AND make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= d),
r2 AS (SELECT stock_id, target_year, sum(v) FILTER (WHERE n <= 12) AS known_revenue_ltm, sum(v) FILTER (WHERE n <= 3) AS known_revenue_recent_3m, count(*) AS revenue_history_count FROM r GROUP BY 1, 2),
f AS (SELECT sm.stock_id, sm.target_year, c2.* EXCLUDE (stock_id, target_year, dividend_history_count), coalesce(dividend_history_count, 0) AS dividend_history_count, latest_available_eps, available_eps_ttm, available_eps_ttm_yoy, coalesce(eps_history_count, 0) AS eps_history_count, known_revenue_ltm, known_revenue_recent_3m, coalesce(revenue_history_count, 0) AS revenue_history_count
      FROM sm LEFT JOIN c2 USING (stock_id, target_year) LEFT JOIN e2 USING (stock_id, target_year) LEFT JOIN r2 USING (stock_id, target_year)),
g AS (SELECT *, concat_ws('|', CASE WHEN dividend_history_count <= 0 THEN 'paid_no_history' WHEN recent_paid_rate >= 0.67 THEN 'paid_high' WHEN recent_paid_rate > 0 THEN 'paid_mixed' ELSE 'paid_none' END,
        CASE WHEN dividend_history_count >= 3 THEN 'history_enough' WHEN dividend_history_count > 0 THEN 'history_sparse' ELSE 'history_none' END, CASE WHEN last_known_cash_dividend > 0 THEN 'latest_positive' WHEN last_known_cash_dividend = 0 THEN 'latest_zero' ELSE 'latest_missing' END) AS dividend_selection_bucket,
        unnest([{{'m': 'direct_hurdle_last_known', 'p': CAST(coalesce(last_known_cash_dividend, 0) > 0 AS INTEGER)::DOUBLE, 'a': greatest(coalesce(last_known_cash_dividend, 0), 0)}},
                {{'m': 'direct_hurdle_recent_median', 'p': coalesce(recent_paid_rate, 0), 'a': greatest(coalesce(recent_cash_dividend_median, 0), 0)}}, {{'m': 'direct_hurdle_smoothed', 'p': coalesce(recent_paid_rate, 0), 'a': greatest(coalesce(recent_cash_dividend_smoothed, 0), 0)}}]) AS u FROM f)
SELECT stock_id, target_year, {', '.join(f'round({c} , 5) AS {c}' for c in ('last_known_cash_dividend', 'recent_cash_dividend_median', 'recent_cash_dividend_mean', 'recent_cash_dividend_smoothed', 'recent_paid_rate', 'years_since_last_dividend_reference', 'latest_available_eps', 'available_eps_ttm', 'available_eps_ttm_yoy', 'known_revenue_ltm', 'known_revenue_recent_3m'))},
       dividend_history_count, eps_history_count, revenue_history_count, dividend_selection_bucket, u.m AS dividend_method, round(u.p, 5) AS paid_probability, round(CASE WHEN u.p >= 0.5 THEN u.a ELSE 0 END, 5) AS estimated_cash_dividend FROM g"""


def dividend_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV-04: all dividend methods side by side."""
    x = _inputs(spark, sf_dir)
    rows = FI.dividend_matrix(FI.eps_by_ratio(x["annual"], x["history"]), x["dividends"], x["eps"], AS_OF)
    return neat(rows.groupBy("dividend_method").agg(F.count("estimated_cash_dividend").alias("estimates"), F.avg("estimated_cash_dividend").alias("mean_estimate"), F.count_if(F.col("estimated_cash_dividend") == 0).alias("zeros")))


QUERIES = {
    "time_safe_buckets": time_safe_buckets,
    "dividend_matrix": dividend_matrix,
    "annual_totals": annual_totals,
    "prediction_failures": prediction_failures,
    "eps_current_ratio": eps_current_ratio,
    "eps_seasonal_quarter": eps_seasonal_quarter,
    "eps_known_quarters": eps_known_quarters,
    "dividend_payout": dividend_payout,
    "dividend_cash_history": dividend_cash_history,
    "dividend_patterns": dividend_patterns,
    "dividend_chain": dividend_chain,
    "dividend_yields": dividend_yields,
    "ratio_stability": ratio_stability,
    "seasonal_forecast": seasonal_forecast,
    "weighted_ensemble": weighted_ensemble,
}
ORACLE_SQL = {
    "time_safe_buckets": BUCKETS_SQL,
    "annual_totals": ANNUAL_SQL,
    "prediction_failures": FAILURES_SQL,
    "eps_current_ratio": RATIO_SQL,
    "eps_seasonal_quarter": SEASONAL_SQL,
    "eps_known_quarters": KNOWN_SQL,
    "dividend_payout": PAYOUT_SQL,
    "dividend_cash_history": CASH_SQL,
    "dividend_patterns": PATTERNS_SQL,
    "dividend_chain": CHAIN_SQL,
    "dividend_yields": YIELDS_SQL,
    "ratio_stability": STABILITY_SQL,
    "seasonal_forecast": SEASONAL_FORECAST_SQL,
    "weighted_ensemble": ENSEMBLE_SQL,
}
