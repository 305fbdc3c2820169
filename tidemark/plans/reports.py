"""Queries over reports and benchmark compositions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cohorts as K
from tidemark.operators import finance as FI
from tidemark.operators import forecast as FC
from tidemark.operators import metrics as M
from tidemark.operators import reports as RP
from tidemark.operators.calendar import growth_windows
from tidemark.operators.quality import candidate_pool, union_all
from tidemark.operators.studies import layered_accuracy, leakage_share
from tidemark.plans import finance as PF
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.plans.finance import _inputs
from tidemark.sources.adapters import AS_OF, TARGET_YEAR, dividends, entity_master, monthly_revenue, quarterly_eps, written_facts
from tidemark.sources.artifacts import settled

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MODELS = ["formula", "seasonal_naive", "last_observed"]


def _register(sql: str | None = None):
    def keep(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return keep


_BASE = PF._BASE
_WMAPE = "sum(abs(predicted_revenue - actual_revenue)) / nullif(sum(abs(actual_revenue)), 0) * 100"
_EXACT = """ck AS (SELECT stock_id, target_year, target_month FROM pred GROUP BY ALL HAVING count(DISTINCT model) = 3),
cc AS (SELECT pred.* FROM pred SEMI JOIN ck USING (stock_id, target_year, target_month)),
cy AS (SELECT model, stock_id, target_year FROM cc GROUP BY ALL HAVING count(DISTINCT target_month) = 12),
ex AS (SELECT cc.* FROM cc SEMI JOIN cy USING (model, stock_id, target_year))"""


@_register(f"""WITH {S.full()} SELECT model, stock_id, target_year, round(sum(predicted_revenue), 4) AS predicted_annual_revenue, round(sum(actual_revenue), 4) AS actual_annual_revenue, count(predicted_revenue) AS prediction_months, count(actual_revenue) AS actual_months FROM pred GROUP BY 1, 2, 3""")
def annual_predictions_and_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06."""
    return neat(RP.annual_with_actuals(predictions(spark, sf_dir)), 4)


@_register(f"""WITH {S.full()} SELECT model, stock_id, target_year, CAST((target_month - 1) // 3 + 1 AS INTEGER) AS target_quarter, round(sum(predicted_revenue), 4) AS predicted_quarter_revenue, count(*) AS months FROM pred GROUP BY 1, 2, 3, 4""")
def quarterly_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07."""
    return neat(RP.quarterly_totals(predictions(spark, sf_dir)), 4)


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FC.growth_signal(growth_windows(monthly_revenue(spark, sf_dir)))
    rows = rows.select("stock_id", (F.col("month_index") + 1).alias("month_index"), "growth_signal", "regime", "growth_phase", "high_growth", "growth_rate", "growth_ratio", "growth_streak")
    return predictions(spark, sf_dir).where("model = 'formula'").join(rows, ["stock_id", "month_index"])


#: Growth vectors and regimes of the month before each prediction.
_REGIME = """gf0 AS (SELECT *, coalesce(CAST(revenue > lag(revenue) OVER w AS INTEGER), 0) AS up, greatest(least(coalesce(revenue / nullif(lag(revenue) OVER w, 0) - 1, 0), 5.0), -0.95) AS gr
  FROM seg WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
gf1 AS (SELECT *, avg(gr) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(gr) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6, sum(up) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / 12.0 AS share,
  list(up) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS bits FROM gf0 WINDOW w AS (PARTITION BY stock_id, calendar_segment ORDER BY month_index)),
gf2 AS (SELECT *, coalesce(list_position(list_reverse(bits), 0) - 1, 12) AS streak FROM gf1 WHERE consecutive_months >= 12),
gs AS (SELECT stock_id, month_index + 1 AS month_index, 0.5 * m3 + 0.3 * m6 + 0.2 * gr AS growth_signal, gr AS growth_rate, share AS growth_ratio, streak AS growth_streak,
  CASE WHEN share > 0.65 THEN 'growth' WHEN share < 0.4 THEN 'decline' ELSE 'cycle' END AS regime, share > 0.65 AND streak >= 4 AS growth_phase, share > 0.6 OR streak >= 5 AS high_growth FROM gf2),
rg AS (SELECT pred.*, gs.* EXCLUDE (stock_id, month_index) FROM pred JOIN gs USING (stock_id, month_index) WHERE model = 'formula')"""


@_register(f"""WITH {S.full()}, {_REGIME},
c AS (SELECT stock_id, count(*) AS months, {', '.join(f"count(*) FILTER (WHERE regime = '{v}') AS {v}_months" for v in ('cycle', 'growth', 'decline'))}, round(sum(actual_revenue), 4) AS total FROM rg GROUP BY 1)
SELECT *, {', '.join(f'round({v}_months / months, 6) AS {v}_share' for v in ('cycle', 'growth', 'decline'))}, CASE greatest(cycle_months, growth_months, decline_months) WHEN cycle_months THEN 'cycle' WHEN growth_months THEN 'growth' ELSE 'decline' END AS dominant,
       round(greatest(cycle_months, growth_months, decline_months) / months, 6) AS confidence, CAST(ntile(4) OVER (ORDER BY total, stock_id) AS INTEGER) AS size_quartile FROM c""")
def dominant_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    out = RP.dominant_category(_regimes(spark, sf_dir), "regime", ("cycle", "growth", "decline"), "actual_revenue")
    return out.select(*[F.round(c, 4 if c == "total" else 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@_register(f"""WITH {S.full()}, n AS (SELECT stock_id, sum(CASE WHEN history_months < 15 THEN 1 ELSE 0 END) AS fallback, CAST(max(history_months) // 12 AS INTEGER) AS years FROM formula WHERE target_year = 2000 GROUP BY 1),
w AS (SELECT stock_id, {_WMAPE} AS w FROM pred WHERE model = 'formula' GROUP BY 1)
SELECT years, n.stock_id % 3 AS kind, count(DISTINCT n.stock_id) AS stocks, round(quantile_cont(w, 0.5), 6) AS median_metric, CAST(sum(fallback) AS BIGINT) AS months FROM n JOIN w ON n.stock_id = w.stock_id GROUP BY 1, 2""")
def parameter_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: entities by the years of history that their formula saw, and by a second parameter."""
    rows = FC.formula_forecast(monthly_revenue(spark, sf_dir)).where(F.col("target_year") == TARGET_YEAR)
    rows = rows.groupBy("stock_id").agg(F.sum((F.col("history_months") < 15).cast("int")).alias("fallback"), F.floor(F.max("history_months") / 12).cast("int").alias("years"))
    metric = M.accuracy(predictions(spark, sf_dir).where("model = 'formula'"), "stock_id").select("stock_id", "WMAPE")
    return neat(RP.parameter_frequency(rows.join(metric, "stock_id").withColumn("kind", F.col("stock_id") % 3), "WMAPE", "fallback", "years", "kind"))


@_register(f"""{_BASE}, f AS (SELECT model, stock_id, target_year FROM monthly WHERE NOT (stock_id % 6 = 1 AND target_month > 8) GROUP BY 1, 2, 3 HAVING count(DISTINCT target_month) < 12)
SELECT 'formula run' AS workflow, target_year, model, 'incomplete year' AS error_type, count(*) AS failures, 'stock ' || min(stock_id) AS example FROM f GROUP BY 2, 3""")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: what failed when a sixth of the entities lost their last months."""
    monthly = predictions(spark, sf_dir).where("model = 'formula' and not (stock_id % 6 = 1 and target_month > 8)")
    failed = FI.annual_predictions(monthly)[1]
    return RP.failure_summary(failed.select(F.lit("formula run").alias("workflow"), "target_year", "model", "stock_id", F.col("reason").alias("error_type"), F.concat(F.lit("stock "), F.col("stock_id").cast("string")).alias("error")))


@_register(f"""WITH {S.full()}, {S.MASTER}, {_EXACT}
SELECT 'attempted stocks' AS item, count(DISTINCT stock_id) AS value FROM master UNION ALL SELECT 'successful stocks', count(DISTINCT stock_id) FROM pred
UNION ALL SELECT 'failed stocks', count(DISTINCT stock_id) FROM master WHERE stock_id NOT IN (SELECT stock_id FROM pred) UNION ALL SELECT 'exact stocks', count(DISTINCT stock_id) FROM cc
UNION ALL SELECT 'exact stock-months', count(*) FROM ck UNION ALL SELECT 'complete-year stocks', count(DISTINCT stock_id) FROM ex""")
def universe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    return RP.universe_summary(entity_master(spark, sf_dir), predictions(spark, sf_dir), MODELS)


_RATES = "p0 AS (SELECT *, regime = 'growth' AND growth_phase AND growth_rate > 0 AND growth_signal > 0 AS adj FROM rg), p1 AS (SELECT *, CASE WHEN adj THEN predicted_revenue * (1 + 0.8 * growth_signal) ELSE predicted_revenue END AS b FROM p0), p2 AS (SELECT *, regime = 'decline' AND b > last_observed_revenue AS cap FROM p1), p3 AS (SELECT * EXCLUDE predicted_revenue, predicted_revenue AS plain_revenue, CASE WHEN cap THEN least(b, last_observed_revenue) ELSE b END AS predicted_revenue FROM p2)"


@_register(f"""WITH {S.full()}, {_REGIME}, {_RATES}, p4 AS (SELECT * EXCLUDE predicted_revenue, greatest(5 * last_observed_revenue, 1.0) AS lim, predicted_revenue > greatest(1.5 * last_observed_revenue, 1.0) AS clipped, least(predicted_revenue, greatest(1.5 * last_observed_revenue, 1.0)) AS predicted_revenue FROM p3 WHERE last_observed_revenue IS NOT NULL)
SELECT regime, {S.metrics()}, count(DISTINCT stock_id) AS stock_count, round(avg(CAST(adj AS INTEGER)) * 100, 6) AS GrowthBoostRate, round(avg(CAST(cap AS INTEGER)) * 100, 6) AS DeclineCapRate, round(avg(CAST(clipped AS INTEGER)) * 100, 6) AS GuardrailClipRate FROM p4 GROUP BY 1""")
def adjustment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31, FC-17 to FC-19: metrics of adjusted predictions by regime, with the rates of boosts, caps and cuts."""
    rows = FC.adjust_for_growth(_regimes(spark, sf_dir))
    top = F.greatest(1.5 * F.col("last_observed_revenue"), F.lit(1.0))
    rows = rows.withColumns({"clipped": F.col("predicted_revenue") > top, "predicted_revenue": F.least(F.col("predicted_revenue"), top)})
    return neat(RP.adjustment_metrics(rows, "regime"))


@_register(f"WITH {S.full()}, {_REGIME}, {_RATES} SELECT regime, {S.metrics()} FROM p3 GROUP BY 1")
def growth_adjusted_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-17, FC-18."""
    return neat(M.accuracy(FC.adjust_for_growth(_regimes(spark, sf_dir)), "regime"))


@_register(f"""WITH {S.full()}, {_REGIME}, {_RATES}
SELECT CAST(stock_id % 5 AS INTEGER) AS cluster, count(*) AS months, round(avg(abs(plain_revenue - actual_revenue)), 4) AS plain_mae, round(avg(abs(predicted_revenue - actual_revenue)), 4) AS adjusted_mae, round(avg(abs(plain_revenue - actual_revenue)) - avg(abs(predicted_revenue - actual_revenue)), 4) AS improvement,
  round(avg(actual_revenue), 4) AS mean_actual, count(*) FILTER (WHERE high_growth) AS high_growth_months, count(*) FILTER (WHERE growth_phase) AS growth_phase_months, count(*) FILTER (WHERE adj) AS adjusted_months, count(*) FILTER (WHERE cap) AS capped_months,
  count(*) FILTER (WHERE regime = 'cycle') AS cycle_months, count(*) FILTER (WHERE regime = 'decline') AS decline_months, round(avg(growth_signal), 4) AS mean_growth_signal, round(avg(predicted_revenue / nullif(plain_revenue, 0)), 4) AS mean_adjustment_ratio FROM p3 GROUP BY 1""")
def cluster_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: effects of the adjustment by group of entities."""
    from tidemark.operators.learned import cluster_effects as effects

    rows = _regimes(spark, sf_dir).withColumn("plain_revenue", F.col("predicted_revenue"))
    rows = FC.adjust_for_growth(rows).withColumns({"adjusted_revenue": F.col("predicted_revenue"), "cluster": (F.col("stock_id") % 5).cast("int")})
    return neat(effects(rows), 4)


@_register(f"WITH {S.DIVIDENDS} SELECT DISTINCT CAST(year(ex_dividend_date) AS INTEGER) AS training_year FROM dv WHERE year(ex_dividend_date) BETWEEN 1995 AND 1999")
def training_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32."""
    return RP.training_years(dividends(spark, sf_dir), TARGET_YEAR, 1995)


@_register(f"""WITH {S.full()}, {_EXACT} SELECT model, {S.metrics()}, round(quantile_cont(CASE WHEN actual_revenue <> 0 THEN abs(predicted_revenue - actual_revenue) / abs(actual_revenue) END, 0.9) * 100, 6) AS P90APE,
round(avg(CASE WHEN mase_scale > 0 THEN abs(predicted_revenue - actual_revenue) / mase_scale END), 6) AS MASE, count(DISTINCT stock_id) AS stock_count FROM cc GROUP BY 1""")
def common_cohort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-26."""
    return neat(RP.common_cohort_comparison(predictions(spark, sf_dir), MODELS))


@_register(f"""WITH {S.full()}, {_EXACT}, s AS (SELECT stock_id, model, {_WMAPE} AS w, avg(abs(predicted_revenue - actual_revenue)) AS e FROM ex GROUP BY 1, 2),
p AS (SELECT stock_id, {', '.join(f"max(w) FILTER (WHERE model = '{m}') AS {m}_WMAPE, max(e) FILTER (WHERE model = '{m}') AS {m}_MAE" for m in MODELS)} FROM s GROUP BY 1)
SELECT stock_id, {', '.join(f'round({m}_WMAPE, 6) AS {m}_WMAPE, round({m}_MAE, 6) AS {m}_MAE' for m in MODELS)}, formula_WMAPE < seasonal_naive_WMAPE AS beats_seasonal_naive, formula_WMAPE < last_observed_WMAPE AS beats_last_observed, formula_WMAPE > 15 AS over_limit FROM p""")
def entities_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-27."""
    return neat(RP.side_by_side(predictions(spark, sf_dir), "formula", MODELS[1:]))


@_register(f"""WITH {S.full()}, {_EXACT}, {S.MASTER}, pool AS (SELECT stock_id FROM panel GROUP BY 1 HAVING count(*) FILTER (WHERE revenue_year = 2000) >= 12 AND sum(revenue) FILTER (WHERE revenue_year = 1999) > 0),
sw AS (SELECT model, stock_id, {_WMAPE} AS w FROM ex SEMI JOIN pool USING (stock_id) GROUP BY 1, 2), b AS (SELECT model, count(*) AS wins FROM (SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY w, model) = 1) GROUP BY 1)
SELECT 'exact' AS part, model, count(*) AS observations, round({_WMAPE}, 6) AS WMAPE, (SELECT coalesce(max(wins), 0) FROM b WHERE b.model = ex.model) AS wins FROM ex SEMI JOIN pool USING (stock_id) GROUP BY 2
UNION ALL SELECT 'all attempted', model, count(*), round({_WMAPE}, 6), NULL FROM pred SEMI JOIN pool USING (stock_id) GROUP BY 2""")
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-32: pool, comparable cohort, overall metrics and wins, beside all that was attempted."""
    out = RP.benchmark(candidate_pool(monthly_revenue(spark, sf_dir), entity_master(spark, sf_dir), TARGET_YEAR), predictions(spark, sf_dir), MODELS)
    exact = out["overall"].select("model", "observations", "WMAPE").join(out["winners"].select("model", "wins"), "model").select(F.lit("exact").alias("part"), "model", "observations", "WMAPE", "wins")
    return neat(exact.union(out["all_attempted"].select(F.lit("all attempted"), "model", "observations", "WMAPE", F.lit(None).cast("long"))))


_MODEL99 = PF.ENSEMBLE_SQL[: PF.ENSEMBLE_SQL.index("en AS (")]


@_register(f"""{_MODEL99}
ev AS (SELECT pv.stock_id, target_year, target_month, sum(w * predicted_revenue) / sum(w) AS p, max(actual_revenue) AS a FROM pv JOIN wt ON pv.stock_id = wt.stock_id AND pv.model = wt.model GROUP BY 1, 2, 3),
em AS (SELECT stock_id, avg(abs(p - a) / abs(a)) * 100 AS m, count(*) AS months FROM ev WHERE a <> 0 GROUP BY 1), bs AS (SELECT stock_id, arg_min(model, mape) AS best_model, min(mape) AS best_mape FROM mp GROUP BY 1)
SELECT bs.stock_id, best_model, round(best_mape, 6) AS best_mape, round(m, 6) AS ensemble_mape, months, CASE WHEN m IS NULL OR m - best_mape >= 3 THEN best_model WHEN m - best_mape <= 1 THEN 'ensemble' ELSE 'default' END AS recommendation FROM bs LEFT JOIN em ON bs.stock_id = em.stock_id""")
def ensemble_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-06, FC-07: the ensemble's own error on the validation year against the best single model."""
    validation = predictions(spark, sf_dir, TARGET_YEAR - 1)
    weights = FC.inverse_error_weights(validation, ("formula", "last_observed", "seasonal_naive"))
    own = M.accuracy(validation, "stock_id", "model").select("stock_id", "model", F.col("MAPE").alias("mape"))
    return neat(FC.recommend_model(own, RP.ensemble_validation(validation, weights)))


@_register(f"""{_MODEL99}
en AS (SELECT pred.stock_id, target_year, target_month, sum(w * predicted_revenue) / sum(w) AS p FROM pred JOIN wt ON pred.stock_id = wt.stock_id AND pred.model = wt.model WHERE NOT (pred.stock_id % 9 = 2 AND target_month = 12) AND pred.stock_id % 11 <> 3 GROUP BY 1, 2, 3),
n AS (SELECT s_suppkey AS stock_id, count(target_month) AS n FROM supplier LEFT JOIN en ON s_suppkey = en.stock_id GROUP BY 1)
SELECT en.stock_id, target_month, round(p, 4) AS predicted_revenue, CAST(NULL AS VARCHAR) AS failure FROM en JOIN n ON en.stock_id = n.stock_id WHERE n >= 12
UNION ALL SELECT stock_id, NULL, NULL, CASE WHEN n = 0 THEN 'no prediction' ELSE 'incomplete year' END FROM n WHERE n < 12""")
def ensemble_or_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-21: the weighted ensemble of all entities, and a row for each entity that has no whole year."""
    weights = FC.inverse_error_weights(predictions(spark, sf_dir, TARGET_YEAR - 1), ("formula", "last_observed", "seasonal_naive"))
    rows = FC.weighted_ensemble(predictions(spark, sf_dir), weights).where("not (stock_id % 9 = 2 and target_month = 12) and stock_id % 11 <> 3")
    return neat(RP.ensemble_or_failure(entity_master(spark, sf_dir), rows).select("stock_id", "target_month", "predicted_revenue", "failure"), 4)


@_register(f"""{_BASE}, oy AS (SELECT stock_id, sum(revenue) AS r FROM panel WHERE revenue_year = 2000 GROUP BY 1 HAVING count(DISTINCT revenue_month) >= 12)
SELECT oy.stock_id, round(r, 4) AS actual_annual_revenue, round(r * ratio, 6) AS estimated_eps, 'current_ratio_oracle' AS eps_method, true AS is_hindsight, CASE WHEN ratio IS NULL THEN 'EPS unavailable' ELSE 'ok' END AS status FROM oy LEFT JOIN rr ON oy.stock_id = rr.stock_id""")
def eps_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPS-05."""
    out = RP.oracle_eps(monthly_revenue(spark, sf_dir), _inputs(spark, sf_dir)["history"], TARGET_YEAR)
    return out.select("stock_id", F.round("predicted_annual_revenue", 4).alias("actual_annual_revenue"), F.round("estimated_eps", 6).alias("estimated_eps"), "eps_method", "is_hindsight", "status")


def _payout_sql(mode: str, where: str) -> str:
    return f"""{mode}_c AS (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c FROM dv WHERE {where} GROUP BY 1, 2),
{mode}_h AS (SELECT {mode}_c.stock_id, fiscal_year, least(greatest(c / annual_eps, 0), 1.5) AS p FROM {mode}_c JOIN ae ON {mode}_c.stock_id = ae.stock_id AND fiscal_year = eps_year WHERE annual_eps > 0 AND c >= 0),
{mode}_o AS (SELECT stock_id, quantile_cont(p, 0.5) AS p FROM (SELECT * FROM {mode}_h QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY fiscal_year DESC) <= 3) GROUP BY 1),
{mode}_p AS (SELECT est.stock_id, greatest(e * coalesce(o.p, (SELECT quantile_cont(m, 0.5) FROM (SELECT quantile_cont(p, 0.5) AS m FROM {mode}_h GROUP BY stock_id))), 0) AS v FROM est LEFT JOIN {mode}_o o ON est.stock_id = o.stock_id WHERE e IS NOT NULL)"""


def _cash_sql(mode: str, where: str) -> str:
    return f"""{mode}_r AS (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c, row_number() OVER (PARTITION BY stock_id ORDER BY fiscal_year DESC) AS n FROM dv WHERE {where} GROUP BY 1, 2),
{mode}_w AS (SELECT stock_id, max(c) FILTER (WHERE n = 1) AS l, quantile_cont(c, 0.5) AS m, sum(c * CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) / sum(CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END) AS s FROM {mode}_r WHERE n <= 3 GROUP BY 1)"""


_WHERE = {"current_system": "true", "ex_date_safe": f"ex_dividend_date <= {S.AS_OF}", "announcement_safe": f"available_date <= {S.AS_OF}"}
_MATRIX = f"""{_BASE}, est AS (SELECT annual.stock_id, predicted_annual_revenue * ratio AS e FROM annual LEFT JOIN rr ON annual.stock_id = rr.stock_id),
{', '.join(_payout_sql(m, w) for m, w in _WHERE.items())}, {', '.join(_cash_sql(m, w) for m, w in _WHERE.items() if m != 'current_system')},
mx AS ({' UNION ALL '.join(f"SELECT est.stock_id, e, '{m}_payout' AS dividend_method, p.v AS v FROM est LEFT JOIN {m}_p p ON est.stock_id = p.stock_id" for m in _WHERE)}
UNION ALL {' UNION ALL '.join(f"SELECT est.stock_id, e, '{m}_{k}', w.{k[0]} FROM est LEFT JOIN {m}_w w ON est.stock_id = w.stock_id" for m in ('ex_date_safe', 'announcement_safe') for k in ('last', 'median', 'smoothed'))}
UNION ALL SELECT est.stock_id, e, 'eps_sign_guard_last', CASE WHEN e <= 0 THEN 0 ELSE w.l END FROM est LEFT JOIN ex_date_safe_w w ON est.stock_id = w.stock_id)"""


@_register(f"{_MATRIX} SELECT stock_id, dividend_method, round(e, 6) AS estimated_eps, round(v, 6) AS estimated_cash_dividend FROM mx")
def dividend_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV-04: all ten methods."""
    x = _inputs(spark, sf_dir)
    return neat(FI.dividend_matrix(FI.eps_by_ratio(x["annual"], x["history"]), x["dividends"], x["eps"], AS_OF).select("stock_id", "dividend_method", "estimated_eps", "estimated_cash_dividend"))


@_register(f"{_MATRIX} SELECT dividend_method, count(v) AS estimates, round(avg(v), 6) AS mean_estimate, count(*) FILTER (WHERE v = 0) AS zeros FROM mx GROUP BY 1")
def dividend_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PF.dividend_matrix(spark, sf_dir)


_ACTUAL = "act AS (SELECT stock_id, sum(TotalCashDividend) AS actual FROM dv WHERE year(ex_dividend_date) = 2000 GROUP BY 1)"
_NOW = f"now AS (SELECT stock_id, arg_max(close, date) AS px, max(date) AS d FROM px WHERE date <= {S.AS_OF} GROUP BY 1)"


@_register(f"""{_MATRIX}, {_ACTUAL}, {_NOW}, j AS (SELECT mx.stock_id, dividend_method, v, actual, px, v / px * 100 AS y, actual / px * 100 AS ay FROM mx LEFT JOIN act ON mx.stock_id = act.stock_id LEFT JOIN now ON mx.stock_id = now.stock_id)
SELECT dividend_method, count(*) AS rows, round(avg(abs(v - actual)), 6) AS dividend_mae, round(avg(v - actual), 6) AS dividend_bias, round(avg(abs(y - ay)), 4) AS yield_mae, round(avg(actual / 0.08), 6) AS entry_price FROM j GROUP BY 1""")
def aligned_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-24: every method against one canonical actual, whatever actuals the estimates brought along."""
    x = _inputs(spark, sf_dir)
    rows = FI.dividend_matrix(FI.eps_by_ratio(x["annual"], x["history"]), x["dividends"], x["eps"], AS_OF).join(FI.price_as_of(x["prices"], AS_OF), "stock_id", "left")
    rows = rows.withColumns({"estimated_yield_percent": F.col("estimated_cash_dividend") / F.col("stock_price") * 100, "actual_cash_dividend": F.lit(-1.0)})
    rows = RP.align_to_actuals(rows, FI.actual_dividend(x["dividends"], TARGET_YEAR))
    out = rows.groupBy("dividend_method").agg(F.count("*").alias("rows"), F.avg("cash_dividend_abs_error").alias("dividend_mae"), F.avg("cash_dividend_error").alias("dividend_bias"), F.round(F.avg(F.abs("yield_error_percent_point")), 4).alias("yield_mae"), F.avg("actual_entry_price_8pct").alias("entry_price"))
    return neat(out)


@_register(f"""{_MATRIX}, y AS (SELECT stock_id, v, unnest([10.0, 20.0]) AS px FROM mx WHERE dividend_method = 'announcement_safe_last')
SELECT stock_id, px AS stock_price, round(v / px * 100, 6) AS estimated_yield_percent, {', '.join(f'round(v / {k / 100}, 6) AS entry_price_{k}pct' for k in (7, 8, 9))} FROM y""")
def repriced_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YLD-02, YLD-03: stored dividends at two other prices, and the prices at which they yield 7, 8 and 9 percent."""
    x = _inputs(spark, sf_dir)
    stored = FI.dividend_matrix(FI.eps_by_ratio(x["annual"], x["history"]), x["dividends"], x["eps"], AS_OF).where("dividend_method = 'announcement_safe_last'").withColumn("actual_cash_dividend", F.lit(None).cast("double"))
    prices = stored.select("stock_id", F.explode(F.array(F.lit(10.0), F.lit(20.0))).alias("stock_price"))
    rows = FI.entry_prices(FI.reprice(stored, prices))
    return neat(rows.select("stock_id", "stock_price", "estimated_yield_percent", *[f"entry_price_{k}pct" for k in (7, 8, 9)]))


@_register(f"""{_BASE}, {PF._PAYOUT.split('act AS (')[0]}
{_ACTUAL}, {_NOW}, fc AS (SELECT stock_id, sum(TotalCashDividend) AS f FROM dv WHERE fiscal_year = 2000 GROUP BY 1),
aey AS (SELECT stock_id, sum(EPS) AS ae FROM eps WHERE eps_year = 2000 GROUP BY 1 HAVING count(DISTINCT eps_quarter) >= 4), an AS (SELECT stock_id, sum(predicted_revenue) AS p, sum(actual_revenue) AS a FROM pred WHERE model = 'formula' GROUP BY 1),
r AS (SELECT an.stock_id, abs(an.p - an.a) / nullif(abs(an.a), 0) * 100 AS r1, abs(estimated_eps - ae) AS r2, CASE WHEN estimated_eps IS NOT NULL THEN greatest(estimated_eps * coalesce(own.p2, cs.p), 0) END AS cash, actual, f, px FROM an LEFT JOIN est ON an.stock_id = est.stock_id
  LEFT JOIN (SELECT stock_id, p AS p2 FROM own) own ON an.stock_id = own.stock_id CROSS JOIN cs LEFT JOIN act ON an.stock_id = act.stock_id LEFT JOIN fc ON an.stock_id = fc.stock_id LEFT JOIN aey ON an.stock_id = aey.stock_id LEFT JOIN now ON an.stock_id = now.stock_id)
SELECT 'formula' AS model, count(*) AS stocks, round(avg(r1), 6) AS revenue_abs_percent_error, round(avg(r2), 6) AS eps_abs_error, round(avg(CASE WHEN cash IS NOT NULL THEN abs(cash - actual) END), 6) AS ex_year_dividend_abs_error, round(avg(abs(cash - f)), 6) AS fiscal_dividend_abs_error,
       round(avg(abs(cash / px * 100 - actual / px * 100)), 6) AS yield_abs_error FROM r""")
def financial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-29: mean errors of every stage of the chain, dividends on two bases."""
    x = _inputs(spark, sf_dir)
    eps = FI.eps_by_ratio(x["annual"], x["history"])
    dividend = FI.dividend_by_payout(eps, FI.payout_history(x["dividends"], x["eps"], AS_OF)).select("model", "stock_id", "estimated_cash_dividend")
    actual_eps = FI.annual_eps(quarterly_eps(spark, sf_dir)).where(F.col("eps_year") == TARGET_YEAR).select("stock_id", F.col("annual_eps").alias("actual_eps"))
    annual = RP.annual_with_actuals(predictions(spark, sf_dir).where("model = 'formula'"))
    rows = RP.entity_results(annual, eps.select("model", "stock_id", "estimated_eps"), actual_eps, dividend, FI.dual_basis_dividends(x["dividends"], TARGET_YEAR), FI.price_as_of(x["prices"], AS_OF))
    return neat(RP.results_overall(rows, "model"))


@_register()
def stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: the mean errors of the chain as one row for each stage."""
    stages = {"revenue_abs_percent_error": "revenue", "eps_abs_error": "eps", "ex_year_dividend_abs_error": "cash_dividend", "yield_abs_error": "yield"}
    return RP.error_decomposition(financial_results(spark, sf_dir), ["model"], stages)


ORACLE_SQL["stage_errors"] = f"""WITH fr AS ({ORACLE_SQL['financial_results']}) {' UNION ALL '.join(f"SELECT model, '{s}' AS error_stage, {c} AS average_abs_error FROM fr" for c, s in (('revenue_abs_percent_error', 'revenue'), ('eps_abs_error', 'eps'), ('ex_year_dividend_abs_error', 'cash_dividend'), ('yield_abs_error', 'yield')))}"""


_EPS2 = f"""{PF._QUARTERS}, sq AS (SELECT model, tq.stock_id, target_year, sum(q * coalesce(qm.r, rr.ratio)) AS e, count(coalesce(qm.r, rr.ratio)) AS n FROM tq LEFT JOIN qm ON tq.stock_id = qm.stock_id AND tq.eps_quarter = qm.eps_quarter LEFT JOIN rr ON tq.stock_id = rr.stock_id GROUP BY 1, 2, 3),
aey AS (SELECT stock_id, sum(EPS) AS a FROM eps WHERE eps_year = 2000 GROUP BY 1 HAVING count(DISTINCT eps_quarter) >= 4),
e2 AS (SELECT annual.stock_id, 'current_ratio' AS eps_method, predicted_annual_revenue * ratio AS e FROM annual JOIN rr ON annual.stock_id = rr.stock_id UNION ALL SELECT annual.stock_id, 'seasonal_quarter_median', sq.e FROM annual JOIN sq ON annual.stock_id = sq.stock_id WHERE n >= 4)"""


def _eps_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    quarter = FI.eps_by_quarter(x["annual"], x["monthly"], x["past"], x["known"], x["history"])
    rows = FI.eps_by_ratio(x["annual"], x["history"]).select("stock_id", "eps_method", "estimated_eps").union(quarter.select("stock_id", "eps_method", "estimated_eps"))
    actual = FI.annual_eps(quarterly_eps(spark, sf_dir)).where(F.col("eps_year") == TARGET_YEAR).select("stock_id", F.col("annual_eps").alias("actual_eps"))
    return rows.join(actual, "stock_id", "left")


@_register(f"""{_BASE}, {_EPS2}, s AS (SELECT eps_method, e2.stock_id, abs(e - a) AS m, e - a AS b, CASE WHEN a <> 0 THEN abs(e - a) / abs(a) * 100 END AS p FROM e2 JOIN aey ON e2.stock_id = aey.stock_id WHERE e IS NOT NULL)
SELECT eps_method, count(*) AS stocks, CAST(count(*) AS BIGINT) AS observations, round(avg(m), 6) AS MAE, round(quantile_cont(m, 0.5), 6) AS median_abs_error, round(avg(b), 6) AS bias, round(avg(p), 6) AS MAPE FROM s GROUP BY 1""")
def layered_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-19, EVL-17: EPS errors of two methods by entity first."""
    return neat(layered_accuracy(_eps_estimates(spark, sf_dir), "estimated_eps", "actual_eps", "eps_method"))


@_register(f"""{_BASE}, {_EPS2}, w AS (SELECT e2.stock_id, max(abs(e - a)) FILTER (WHERE eps_method = 'current_ratio') AS c, max(abs(e - a)) FILTER (WHERE eps_method <> 'current_ratio') AS s FROM e2 JOIN aey ON e2.stock_id = aey.stock_id GROUP BY 1)
SELECT stock_id, round(s, 6) AS candidate_error, round(c, 6) AS baseline_error, CASE WHEN s - c IS NULL THEN 'missing' WHEN s - c < -1e-9 THEN 'improved' WHEN s - c > 1e-9 THEN 'worse' ELSE 'tied' END AS outcome, round((s - c) / nullif(c, 0) * 100, 4) AS change_percent FROM w""")
def eps_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-20, EVL-22: the seasonal method against the annual one, entity by entity."""
    rows = _eps_estimates(spark, sf_dir).where("actual_eps is not null").withColumn("error", F.abs(F.col("estimated_eps") - F.col("actual_eps")))
    side = lambda m: rows.where(F.col("eps_method") == m)
    out = K.error_comparison(side("seasonal_quarter_median"), side("current_ratio"), "error")
    return neat(out.withColumn("change_percent", F.round("change_percent", 4)))


@_register(f"""WITH {S.EPS}, {S.DIVIDENDS}, ae AS (SELECT stock_id, eps_year, sum(EPS) AS e FROM eps WHERE statement_available_date <= {S.AS_OF} GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4),
h AS (SELECT d.stock_id, bool_or(late) AS f FROM (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c, bool_or(available_date > {S.AS_OF}) AS late FROM dv GROUP BY 1, 2) d JOIN ae ON d.stock_id = ae.stock_id AND fiscal_year = eps_year WHERE e > 0 AND c >= 0 GROUP BY 1)
SELECT 'current_system' AS evidence_mode, count(*) AS stocks, count(*) FILTER (WHERE f) AS leaking, round(avg(CAST(f AS INTEGER)) * 100, 6) AS leaking_percent FROM h""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-21: how many entities' payout evidence is later than the cut-off when none is kept out."""
    x = _inputs(spark, sf_dir)
    return neat(leakage_share(FI.payout_history(x["dividends"], x["eps"], AS_OF, "current_system").withColumn("evidence_mode", F.lit("current_system")), "is_hindsight", "evidence_mode"))


_STABILITY = PF.STABILITY_SQL[: PF.STABILITY_SQL.rindex("SELECT stock_id, ratio_count")]


@_register(f"""{_STABILITY.rstrip()}, b AS (SELECT stock_id, CASE WHEN ratio_count < 3 THEN 'insufficient_history' WHEN cv IS NULL THEN 'unstable_ratio' WHEN cv <= 0.35 AND coalesce(dv, 0) <= 50 THEN 'stable_ratio' WHEN cv <= 1 AND coalesce(dv, 0) <= 150 THEN 'moderate_ratio' ELSE 'unstable_ratio' END AS bk FROM t), {_EPS2},
oy AS (SELECT stock_id, sum(revenue) AS r FROM panel WHERE revenue_year = 2000 GROUP BY 1 HAVING count(DISTINCT revenue_month) >= 12),
w AS (SELECT aey.stock_id, max(abs(e - a)) FILTER (WHERE eps_method = 'current_ratio') AS c, max(abs(e - a)) FILTER (WHERE eps_method <> 'current_ratio') AS s FROM e2 JOIN aey ON e2.stock_id = aey.stock_id GROUP BY 1),
k AS (SELECT b.stock_id, bk, c, s, abs(oy.r * rr.ratio - aey.a) AS o, abs(predicted_annual_revenue - oy.r) / nullif(oy.r, 0) * 100 AS g FROM b LEFT JOIN w ON b.stock_id = w.stock_id LEFT JOIN oy ON b.stock_id = oy.stock_id LEFT JOIN rr ON b.stock_id = rr.stock_id LEFT JOIN aey ON b.stock_id = aey.stock_id LEFT JOIN annual ON b.stock_id = annual.stock_id),
z AS (SELECT *, coalesce(c, 'inf'::DOUBLE) AS cc, coalesce(s, 'inf'::DOUBLE) AS ss FROM k),
d AS (SELECT stock_id, bk, CASE WHEN cc = 'inf' AND ss = 'inf' THEN 'manual_review' WHEN bk = 'stable_ratio' AND cc <= ss * 1.10 THEN 'keep_current_ratio' WHEN bk = 'insufficient_history' THEN 'manual_or_cross_sectional_ml' WHEN ss < cc AND ss <= cc * 0.90 THEN 'test_seasonal_quarter_ratio' WHEN bk = 'unstable_ratio' THEN 'stock_specific_or_ml_eps_layer' ELSE 'stock_specific_validation' END AS path,
  CASE WHEN c IS NULL THEN 'missing_current_ratio_result' WHEN o IS NULL THEN 'missing_oracle_diagnostic' WHEN c < o * 0.75 THEN 'forecast_error_offset_formula_error' WHEN o >= c * 0.75 THEN 'eps_ratio_formula_error' WHEN g >= 20 THEN 'revenue_forecast_error' ELSE 'mixed_error' END AS driver FROM z),
q2 AS (SELECT 'ratio_stability' AS diagnostic, bk AS bucket FROM d UNION ALL SELECT 'recommended_path', path FROM d UNION ALL SELECT 'error_driver', driver FROM d)
SELECT diagnostic, bucket, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY diagnostic), 6) AS share_percent FROM q2 GROUP BY 1, 2""")
def eps_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-37, EVL-16, AGG-26: stability of ratios, recommended methods and drivers of errors, each with the shares of its buckets."""
    x = _inputs(spark, sf_dir)
    stability = K.stability_bucket(K.ratio_stability(x["history"])).select("stock_id", "ratio_stability_bucket")
    errors = _eps_estimates(spark, sf_dir).where("actual_eps is not null").groupBy("stock_id").pivot("eps_method", ["current_ratio", "seasonal_quarter_median"]).agg(F.first(F.abs(F.col("estimated_eps") - F.col("actual_eps"))))
    actual = FI.annual_eps(quarterly_eps(spark, sf_dir)).where(F.col("eps_year") == TARGET_YEAR).select("stock_id", F.col("annual_eps").alias("_a"))
    oracle = RP.oracle_eps(monthly_revenue(spark, sf_dir), x["history"], TARGET_YEAR).select("stock_id", F.col("estimated_eps").alias("_o"), F.col("predicted_annual_revenue").alias("_r"))
    rows = stability.join(errors, "stock_id", "left").join(oracle, "stock_id", "left").join(actual, "stock_id", "left").join(x["annual"].select("stock_id", "predicted_annual_revenue"), "stock_id", "left")
    rows = rows.withColumns({"best_current": F.col("current_ratio"), "current_ratio_error": F.col("current_ratio"), "best_seasonal": F.col("seasonal_quarter_median"), "best_ml": F.lit(None).cast("double"), "oracle_error": F.abs(F.col("_o") - F.col("_a")), "revenue_error_percent": F.try_divide(F.abs(F.col("predicted_annual_revenue") - F.col("_r")), F.col("_r")) * 100})
    rows = K.ratio_error_driver(K.recommend_eps_path(rows))
    return neat(RP.diagnostic_shares({"ratio_stability": (rows, "ratio_stability_bucket"), "recommended_path": (rows, "recommended_path"), "error_driver": (rows, "error_driver")}))


_FOLDS = PF.BUCKETS_SQL[: PF.BUCKETS_SQL.rindex("SELECT stock_id, target_year")]


@_register(f"""{_FOLDS.rstrip()}, ac AS (SELECT stock_id, year(ex_dividend_date) AS target_year, sum(TotalCashDividend) AS a FROM dv GROUP BY 1, 2),
er AS (SELECT g.stock_id, g.target_year, dividend_selection_bucket AS bucket, u.m AS method, abs(CASE WHEN u.p >= 0.5 THEN u.a ELSE 0 END - coalesce(ac.a, 0)) AS e FROM g LEFT JOIN ac ON g.stock_id = ac.stock_id AND g.target_year = ac.target_year),
ov AS (SELECT method FROM er WHERE target_year < 2000 GROUP BY 1 ORDER BY avg(e), method LIMIT 1),
bb AS (SELECT bucket, method, avg(e) AS e FROM er WHERE target_year < 2000 GROUP BY 1, 2 HAVING count(DISTINCT target_year) >= 2 AND count(*) >= 15 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY avg(e), method) = 1),
ch AS (SELECT DISTINCT er.bucket, coalesce(bb.method, (SELECT method FROM ov)) AS method, CASE WHEN bb.method IS NULL THEN 'global fallback' ELSE 'bucket' END AS source FROM er LEFT JOIN bb ON er.bucket = bb.bucket)
SELECT 'bucket' AS strategy, source, count(*) AS stocks, round(avg(e), 6) AS dividend_mae FROM er JOIN ch ON er.bucket = ch.bucket AND er.method = ch.method WHERE target_year = 2000 GROUP BY 2
UNION ALL SELECT 'global', 'global', count(*), round(avg(e), 6) FROM er WHERE target_year = 2000 AND method = (SELECT method FROM ov)
UNION ALL SELECT 'hindsight', 'hindsight', count(*), round(avg(e), 6) FROM (SELECT stock_id, min(e) AS e FROM er WHERE target_year = 2000 GROUP BY 1)""")
def dividend_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-34, EVL-12, EVL-13: rules chosen over two validation years, by bucket and for all, on the target year; the best in hindsight beside them."""
    paid = dividends(spark, sf_dir)
    samples = entity_master(spark, sf_dir).select("stock_id", F.explode(F.array(*[F.lit(y) for y in (1998, 1999, 2000)])).alias("target_year")).withColumn("as_of_date", F.make_date("target_year", F.lit(1), F.lit(10)))
    features = FI.time_safe_features(samples, monthly_revenue(spark, sf_dir), quarterly_eps(spark, sf_dir), paid)
    estimates = FI.heuristic_hurdles(FI.selection_buckets(features)).select("stock_id", "target_year", F.col("dividend_selection_bucket").alias("bucket"), F.col("dividend_method").alias("method"), "estimated_cash_dividend")
    actuals = paid.groupBy("stock_id", F.year("ex_dividend_date").alias("target_year")).agg(F.sum("TotalCashDividend").alias("actual_cash_dividend"))
    errors = RP.fold_errors(estimates, actuals)
    chosen = RP.chosen_by_folds(errors, [1998, 1999], "bucket", "method", 2, 15)
    best = errors.where("target_year < 2000").groupBy("method").agg(F.avg("cash_dividend_abs_error").alias("_e")).agg(F.min_by("method", F.struct("_e", "method")))
    test = errors.where("target_year = 2000")
    mean = lambda rows: rows.groupBy("strategy", "source").agg(F.count("*").alias("stocks"), F.avg("cash_dividend_abs_error").alias("dividend_mae"))
    by_bucket = mean(test.join(chosen, ["bucket", "method"]).withColumn("strategy", F.lit("bucket")))
    overall = mean(test.where(F.col("method") == best.scalar()).withColumns({"strategy": F.lit("global"), "source": F.lit("global")}))
    late = test.groupBy("stock_id").agg(F.min("cash_dividend_abs_error").alias("cash_dividend_abs_error")).withColumns({"strategy": F.lit("hindsight"), "source": F.lit("hindsight")})
    return neat(union_all([by_bucket, overall, mean(late)]))


@_register(f"""WITH {S.full()}, {_REGIME}, {_RATES}, v AS (SELECT * EXCLUDE predicted_revenue, unnest([{{'n': 'base', 'p': predicted_revenue}}, {{'n': 'no boost', 'p': CASE WHEN regime = 'decline' THEN least(plain_revenue, last_observed_revenue) ELSE plain_revenue END}}, {{'n': 'no cap', 'p': b}}, {{'n': 'plain', 'p': plain_revenue}}]) AS x FROM p3),
m AS (SELECT x.n AS experiment, {S.metrics('x.p')} FROM v GROUP BY 1)
SELECT *, (SELECT WMAPE FROM m WHERE experiment = 'base') AS base_WMAPE, round(WMAPE - (SELECT WMAPE FROM m WHERE experiment = 'base'), 5) AS WMAPE_change FROM m""")
def adjustment_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-31, EVL-30: the adjusted predictions, and with one part left out at a time."""
    rows = _regimes(spark, sf_dir).withColumn("plain", F.col("predicted_revenue"))
    rows = FC.adjust_for_growth(rows)
    boosted = F.when(F.col("adjustment_applied"), F.col("plain") * (1 + 0.8 * F.greatest(F.col("growth_signal"), F.lit(0.0)))).otherwise(F.col("plain"))
    capped = F.when(F.col("regime") == "decline", F.least("plain", "last_observed_revenue")).otherwise(F.col("plain"))
    out = RP.ablation(rows, {"base": F.col("predicted_revenue"), "no boost": capped, "no cap": boosted, "plain": F.col("plain")}, "base")
    return neat(out.withColumn("WMAPE_change", F.round("WMAPE_change", 5)))


def _replay_sql(year: int) -> str:
    cut = f"DATE '{year}-01-10'"
    return f"""past{year} AS (SELECT * FROM panel WHERE make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= {cut}), ek{year} AS (SELECT * FROM eps WHERE statement_available_date <= {cut}),
ae{year} AS (SELECT stock_id, eps_year, sum(EPS) AS e FROM ek{year} GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4), ar{year} AS (SELECT stock_id, revenue_year, sum(revenue) AS r FROM past{year} GROUP BY 1, 2 HAVING count(DISTINCT revenue_month) >= 12),
h{year} AS (SELECT a.stock_id, e / r AS x FROM ar{year} a JOIN ae{year} b ON a.stock_id = b.stock_id AND revenue_year = eps_year WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY a.stock_id ORDER BY revenue_year DESC) <= 3), r{year} AS (SELECT stock_id, quantile_cont(x, 0.5) AS x FROM h{year} GROUP BY 1),
qr{year} AS (SELECT stock_id, revenue_year, (revenue_month - 1) // 3 + 1 AS q, sum(revenue) AS v FROM past{year} GROUP BY 1, 2, 3 HAVING count(DISTINCT revenue_month) >= 3),
qm{year} AS (SELECT stock_id, q, quantile_cont(x, 0.5) AS x FROM (SELECT a.stock_id, a.q, EPS / v AS x FROM qr{year} a JOIN ek{year} b ON a.stock_id = b.stock_id AND revenue_year = eps_year AND q = eps_quarter WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY a.stock_id, a.q ORDER BY revenue_year DESC) <= 3) GROUP BY 1, 2),
t{year} AS (SELECT stock_id, (revenue_month - 1) // 3 + 1 AS q, sum(revenue) AS v, count(*) AS n FROM panel WHERE revenue_year = {year} AND stock_id IN (SELECT stock_id FROM panel WHERE revenue_year = {year} GROUP BY 1 HAVING count(DISTINCT revenue_month) = 12) GROUP BY 1, 2),
c{year} AS (SELECT t.stock_id, 'current_ratio' AS method, sum(v) * max(r.x) AS e FROM t{year} t JOIN r{year} r ON t.stock_id = r.stock_id GROUP BY 1 UNION ALL
  SELECT t.stock_id, 'seasonal_quarter_median', CASE WHEN count(coalesce(m.x, r.x)) >= 4 THEN sum(v * coalesce(m.x, r.x)) END FROM t{year} t LEFT JOIN qm{year} m ON t.stock_id = m.stock_id AND t.q = m.q LEFT JOIN r{year} r ON t.stock_id = r.stock_id GROUP BY 1),
e{year} AS (SELECT c.stock_id, method, abs(e - a) AS err FROM c{year} c JOIN (SELECT stock_id, sum(EPS) AS a FROM eps WHERE eps_year = {year} GROUP BY 1 HAVING count(DISTINCT eps_quarter) >= 4) y ON c.stock_id = y.stock_id WHERE e IS NOT NULL)"""


def _bucket_sql(year: int) -> str:
    """Stability of the ratios known at the year's cut-off, as ``bk`` of each entity."""
    return f"""x{year} AS (SELECT a.stock_id, revenue_year, e / r AS r FROM ar{year} a JOIN ae{year} b ON a.stock_id = b.stock_id AND revenue_year = eps_year WHERE r > 0),
s{year} AS (SELECT stock_id, count(*) AS n, stddev_pop(r) AS sd, quantile_cont(r, 0.5) AS md, quantile_cont(r, 0.5) FILTER (WHERE k <= 3) AS rm, max(r) FILTER (WHERE k = 1) AS lt FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY revenue_year DESC) AS k FROM x{year}) GROUP BY 1),
b{year} AS (SELECT stock_id, CASE WHEN n < 3 THEN 'insufficient_history' WHEN abs(md) <= 1e-12 THEN 'unstable_ratio' WHEN abs(sd / md) <= 0.35 AND d <= 50 THEN 'stable_ratio' WHEN abs(sd / md) <= 1 AND d <= 150 THEN 'moderate_ratio' ELSE 'unstable_ratio' END AS bk
  FROM (SELECT *, CASE WHEN abs(rm) > 1e-12 THEN abs(lt - rm) / abs(rm) * 100 ELSE 0 END AS d FROM s{year})),
g{year} AS (SELECT e{year}.*, coalesce(bk, 'insufficient_history') AS bk FROM e{year} LEFT JOIN b{year} USING (stock_id))"""


@_register(f"""WITH {S.panel()}, {S.EPS}, {_replay_sql(1999)}, {_bucket_sql(1999)}, {_replay_sql(2000)}, {_bucket_sql(2000)}, gm AS (SELECT method FROM e1999 GROUP BY 1 ORDER BY avg(err), method LIMIT 1), om AS (SELECT stock_id, method FROM e1999 QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY err, method) = 1),
cb AS (SELECT bk, method FROM (SELECT bk, method, avg(err) AS e FROM g1999 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY bk ORDER BY e, method) = 1)
SELECT 'fixed' AS strategy, false AS is_hindsight, count(*) AS stocks, round(avg(err), 6) AS eps_mae FROM e2000 WHERE method = (SELECT method FROM gm) UNION ALL SELECT 'entity', false, count(*), round(avg(err), 6) FROM e2000 JOIN om USING (stock_id, method)
UNION ALL SELECT 'bucket', false, count(*), round(avg(err), 6) FROM g2000 LEFT JOIN cb ON g2000.bk = cb.bk WHERE g2000.method = coalesce(cb.method, 'current_ratio') UNION ALL SELECT 'hindsight', true, count(*), round(avg(err), 6) FROM (SELECT stock_id, min(err) AS err FROM e2000 GROUP BY 1)""")
def eps_layer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-36, EVL-13: EPS methods on actual revenue, chosen in the year before the target year (for all, by entity, by stability of the ratio as known then) and applied to it."""
    facts = written_facts(spark, sf_dir)
    revenue, quarterly = facts["revenue"], facts["quarterly"]

    def errors(year: int) -> DataFrame:
        as_of = f"{year}-01-10"
        past = revenue.where(F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(as_of).cast("date"))
        monthly = K.complete_years(revenue.where(F.col("revenue_year") == year).select(F.lit("replay").alias("model"), "stock_id", F.col("revenue_year").alias("target_year"), F.col("revenue_month").alias("target_month"), F.col("revenue").alias("predicted_revenue")))
        known, annual = FI.available(quarterly, "statement_available_date", as_of), FI.annual_predictions(monthly)[0]
        history = FI.ratio_history(past, FI.annual_eps(quarterly, as_of))
        rows = FI.eps_by_ratio(annual, history).select("stock_id", F.col("eps_method").alias("method"), "estimated_eps").union(FI.eps_by_quarter(annual, monthly, past, known, history).select("stock_id", "eps_method", "estimated_eps"))
        actual = FI.annual_eps(quarterly).where(F.col("eps_year") == year).select("stock_id", "annual_eps")
        bucket = K.stability_bucket(K.ratio_stability(history)).select("stock_id", F.col("ratio_stability_bucket").alias("bucket"))
        rows = rows.join(actual, "stock_id").where("estimated_eps is not null").join(bucket, "stock_id", "left")
        return rows.select("stock_id", "method", F.coalesce("bucket", F.lit("insufficient_history")).alias("bucket"), F.abs(F.col("estimated_eps") - F.col("annual_eps")).alias("error"))

    # Each is read by every way of choosing.
    before, test = (settled(errors(year), "eps-errors") for year in (TARGET_YEAR - 1, TARGET_YEAR))
    overall = before.groupBy("method").agg(F.avg("error").alias("error")).orderBy("error", "method").limit(1)
    own = K.best_per(before, "stock_id", "error", "method")
    # Each bucket takes what did best in it the year before, buckets that were empty then the plain ratio.
    scores = before.groupBy("bucket", "method").agg(F.avg("error").alias("mean_error"), F.count("*").alias("rows"))
    buckets = K.with_fallback(K.best_per(scores, "bucket", "mean_error", "method"), test.select("bucket").distinct(), ["bucket"], "method", "current_ratio")
    fixed = test.join(overall.select("method"), "method", "left_semi").withColumns({"strategy": F.lit("fixed"), "is_hindsight": F.lit(False)})
    rows = union_all([fixed, K.strategy_rows(test, "none", own, buckets, "error")])
    return neat(rows.groupBy("strategy", "is_hindsight").agg(F.count("*").alias("stocks"), F.avg("error").alias("eps_mae")))


@_register(f"""WITH {S.full()}, t AS (SELECT model, unnest([0.1, 0.2, 0.3, 0.4]) AS threshold, predicted_revenue, actual_revenue, last_observed_revenue FROM pred WHERE model = 'formula'),
s AS (SELECT threshold, avg(abs(CASE WHEN abs(predicted_revenue / nullif(last_observed_revenue, 0) - 1) >= threshold THEN last_observed_revenue ELSE predicted_revenue END - actual_revenue)) AS e FROM t WHERE last_observed_revenue > 0 GROUP BY 1)
SELECT threshold, round(e, 6) AS mean_error FROM s ORDER BY s.e, threshold DESC LIMIT 1""")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-09: from which change on the last value does better than the formula."""
    rows = predictions(spark, sf_dir).where("model = 'formula' and last_observed_revenue > 0").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])))
    far = F.abs(F.col("predicted_revenue") / F.col("last_observed_revenue") - 1) >= F.col("threshold")
    scores = rows.groupBy("threshold").agg(F.avg(F.abs(F.when(far, F.col("last_observed_revenue")).otherwise(F.col("predicted_revenue")) - F.col("actual_revenue"))).alias("mean_error"))
    return neat(K.select_threshold(scores, "mean_error"))
