"""Queries over fitted models and folds over residuals; those without a fit have SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import finance as FI
from tidemark.operators import forecast as FC
from tidemark.operators import learned as L
from tidemark.operators import metrics as M
from tidemark.operators import studies as ST
from tidemark.operators.calendar import growth_windows
from tidemark.plans import features as PFX
from tidemark.plans import finance as PF
from tidemark.plans import reports as RS
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.plans.finance import _inputs
from tidemark.sources.adapters import AS_OF, TARGET_YEAR, daily_prices, dividends, entity_master, monthly_revenue, quarterly_eps, written_facts
from tidemark.sources.artifacts import settled


def arima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-10 over all entities and months."""
    return neat(FC.seasonal_arima_forecast(monthly_revenue(spark, sf_dir)))


def hybrid_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-11: formula and seasonal ARIMA combined for the target year."""
    panel = monthly_revenue(spark, sf_dir)
    formula = FC.formula_forecast(panel).where(F.col("target_year") == TARGET_YEAR).select("stock_id", "target_year", "target_month", "formula_adjusted_revenue", "actual_revenue", "last_observed_revenue", "mase_scale")
    second = FC.seasonal_arima_forecast(panel).where(F.col("target_year") == TARGET_YEAR).select("stock_id", "target_year", "target_month", "second_revenue", "second_method")
    return neat(FC.combine_forecasts(formula, second))


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-07: eleven weights of the second forecast on the validation year, scored in one plan."""
    panel = monthly_revenue(spark, sf_dir)
    formula = FC.formula_forecast(panel).where("target_year = 1999").select("stock_id", "target_year", "target_month", "formula_adjusted_revenue", "actual_revenue", "last_observed_revenue")
    second = FC.seasonal_arima_forecast(panel).where("target_year = 1999").select("stock_id", "target_year", "target_month", "second_revenue", "second_method")
    return neat(ST.blend_scores(formula, second))


def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-09: twelve months ahead of the last whole year."""
    return neat(FC.recursive_forecast(monthly_revenue(spark, sf_dir).where(F.col("revenue_year") < TARGET_YEAR)))


def growth_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(L.cluster_profile(L.growth_clusters(monthly_revenue(spark, sf_dir))))


def pooled_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(L.pooled_trees(monthly_revenue(spark, sf_dir), TARGET_YEAR))


def sequence_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-14 and FC-16: guarded one-step predictions of the target year."""
    return neat(FC.guardrail(L.sequence_regression(monthly_revenue(spark, sf_dir), TARGET_YEAR - 1, TARGET_YEAR)))


def growth_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-17 to FC-19: regimes of the month before, boost and decline cap on the formula's predictions, scored by regime."""
    return neat(M.accuracy(FC.adjust_for_growth(_with_regime(spark, sf_dir)), "regime"))


def _with_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    regimes = FC.growth_signal(growth_windows(monthly_revenue(spark, sf_dir)))
    regimes = regimes.select("stock_id", (F.col("month_index") + 1).alias("month_index"), "growth_signal", "regime", "growth_phase", "growth_rate", "growth_ratio", "growth_streak")
    return predictions(spark, sf_dir).where("model = 'formula'").join(regimes, ["stock_id", "month_index"])


def confidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-20: the formula's predictions capped in declines at each confidence threshold, scored."""
    return neat(M.accuracy(FC.decline_cap_confidence(_with_regime(spark, sf_dir)), "confidence_threshold"))


def eps_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return neat(L.eps_regression(x["history"], x["annual"]))


def hurdle_samples(spark: SparkSession, sf_dir: str, first_year: int = 1995) -> DataFrame:
    """Every entity and year seen from the tenth of January, with the cash of the year's ex-dates."""
    facts = written_facts(spark, sf_dir)
    paid = facts["dividends"]
    years = [F.lit(y) for y in range(first_year, TARGET_YEAR + 1)]
    samples = entity_master(spark, sf_dir).select("stock_id", F.explode(F.array(*years)).alias("target_year")).withColumn("as_of_date", F.make_date("target_year", F.lit(1), F.lit(10)))
    rows = FI.time_safe_features(samples, facts["revenue"], facts["quarterly"], paid)
    actual = paid.groupBy("stock_id", F.year("ex_dividend_date").alias("target_year")).agg(F.sum("TotalCashDividend").alias("actual_cash_dividend"))
    return rows.join(actual, ["stock_id", "target_year"], "left").withColumn("actual_cash_dividend", F.coalesce("actual_cash_dividend", F.lit(0.0)))


def dividend_hurdle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV-08, DIV-10: both regressions at seven thresholds for the target year, learnt from years before it, each seen from its own cut-off."""
    samples = settled(hurdle_samples(spark, sf_dir), "hurdle-samples")
    return neat(L.hurdle_dividends(samples, TARGET_YEAR).unionByName(L.hurdle_dividends(samples, TARGET_YEAR, "elastic_net")))


def financial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YLD-05: the whole chain in one plan, both EPS methods, yields at the cut-off price."""
    monthly = predictions(spark, sf_dir).select("model", "stock_id", "target_year", "target_month", "predicted_revenue")
    x = _inputs(spark, sf_dir)
    out = FI.financial_forecast(monthly, monthly_revenue(spark, sf_dir), x["quarterly"], x["dividends"], x["prices"], TARGET_YEAR, AS_OF)
    return neat(out["yields"].where("yield_mode = 'as_of_price'").select("model", "stock_id", "eps_method", "estimated_eps", "estimated_cash_dividend", "stock_price", "estimated_yield_percent", "status"))



def break_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-08 on the validation year."""
    panel = monthly_revenue(spark, sf_dir)
    formula = FC.formula_forecast(panel).where("target_year = 1999").select("stock_id", "target_year", "target_month", "formula_adjusted_revenue", "actual_revenue", "last_observed_revenue")
    second = FC.seasonal_arima_forecast(panel).where("target_year = 1999").select("stock_id", "target_year", "target_month", "second_revenue", "second_method")
    return neat(ST.break_sweep(formula.join(FC.break_features(panel), ["stock_id", "target_year", "target_month"]), second))


NAIVE = FC.HybridConfig(second_method="seasonal_naive")


def _formula_and_naive(spark: SparkSession, sf_dir: str, year: int) -> tuple[DataFrame, DataFrame]:
    """The formula and the month of a year before as a second forecast of a year."""
    rows = FC.formula_forecast(monthly_revenue(spark, sf_dir)).where(F.col("target_year") == year)
    keys = ["stock_id", "target_year", "target_month"]
    second = rows.select(*keys, F.col("seasonal_naive_revenue").alias("second_revenue"), F.lit("seasonal_naive").alias("second_method"))
    return rows.select(*keys, "formula_adjusted_revenue", "actual_revenue", "last_observed_revenue"), second


def hybrid_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-11, JON-08 with last year's month as the second forecast."""
    return neat(FC.combine_forecasts(*_formula_and_naive(spark, sf_dir, TARGET_YEAR), NAIVE).select("stock_id", "target_year", "target_month", "formula_valid", "second_valid", "hybrid_predicted_revenue", "hybrid_method"), 4)


def blend_weights_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-07 with last year's month as the second forecast."""
    return neat(ST.blend_scores(*_formula_and_naive(spark, sf_dir, 1999), config=NAIVE))


def break_sweep_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-08 with last year's month as the second forecast."""
    formula, second = _formula_and_naive(spark, sf_dir, 1999)
    return neat(ST.break_sweep(formula.join(FC.break_features(monthly_revenue(spark, sf_dir)), ["stock_id", "target_year", "target_month"]), second, config=NAIVE))


def adjustment_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-05: every variant scored."""
    return neat(M.accuracy(ST.adjustment_variants(_with_regime(spark, sf_dir)), "alpha", "cap"))


def yield_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YLD-04, YLD-07, EVL-18: month-end yields of every revenue model and EPS method against actual ones."""
    monthly = predictions(spark, sf_dir).select("model", "stock_id", "target_year", "target_month", "predicted_revenue")
    x = _inputs(spark, sf_dir)
    out = FI.financial_forecast(monthly, monthly_revenue(spark, sf_dir), x["quarterly"], x["dividends"], x["prices"], TARGET_YEAR, AS_OF)
    return neat(ST.layered_accuracy(ST.yield_comparison(out["yields"]), "estimated_yield_percent", "actual_yield_percent", "model", "eps_method"))


def live_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YLD-06: 1999 and 2000 as of the cut-off, unpublished months by the recursive formula."""
    panel = monthly_revenue(spark, sf_dir)
    return neat(ST.live_months(panel, FC.recursive_forecast(panel.where(F.col("revenue_year") < TARGET_YEAR), 12), AS_OF, (TARGET_YEAR - 1, TARGET_YEAR)))


def live_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YLD-06: revenue to yield of 1999 and 2000 as of the cut-off: what was published as it is, the rest by forecast, seasonal ratios and patterns."""
    facts = written_facts(spark, sf_dir)
    panel = facts["revenue"]
    forecast = FC.recursive_forecast(panel.where(F.col("revenue_year") < TARGET_YEAR), 12)
    rows = ST.live_core(panel, forecast, facts["quarterly"], facts["dividends"], daily_prices(spark, sf_dir), entity_master(spark, sf_dir), AS_OF, (TARGET_YEAR - 1, TARGET_YEAR), 0.6)
    return neat(rows, 4)


def financial_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-15: dividend methods on the actual revenue of two validation years and on the formula for the target year; the chosen one is marked."""
    revenue, quarterly, paid = monthly_revenue(spark, sf_dir), quarterly_eps(spark, sf_dir), dividends(spark, sf_dir)
    scores = []
    for year in (1998, 1999, TARGET_YEAR):
        as_of = f"{year}-01-10"
        public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(as_of).cast("date")
        if year == TARGET_YEAR:
            monthly = predictions(spark, sf_dir).where("model = 'formula'")
        else:
            monthly = revenue.where(F.col("revenue_year") == year).select(F.lit("replay").alias("model"), "stock_id", F.col("revenue_year").alias("target_year"), F.col("revenue_month").alias("target_month"), F.col("revenue").alias("predicted_revenue"))
        eps = FI.annual_eps(quarterly, as_of)
        estimates = FI.eps_by_ratio(FI.annual_predictions(monthly)[0], FI.ratio_history(revenue.where(public), eps))
        methods = ["announcement_safe_payout", "announcement_safe_last", "announcement_safe_median", "announcement_safe_smoothed", "eps_sign_guard_last"]
        scores.append(ST.method_scores(FI.dividend_matrix(estimates, paid, eps, as_of), FI.actual_dividend(paid, year), methods, F.lit(year)))
    rows = scores[0].union(scores[1]).union(scores[2])
    chosen = F.broadcast(ST.select_method(rows, [1998, 1999]).select("dividend_method", "validation_mae"))  # one row
    return neat(rows.join(chosen, "dividend_method", "left").withColumn("selected", F.col("validation_mae").isNotNull()).drop("validation_mae"))


QUERIES = {
    "hybrid_naive": hybrid_naive,
    "blend_weights_naive": blend_weights_naive,
    "break_sweep_naive": break_sweep_naive,
    "break_sweep": break_sweep,
    "adjustment_variants": adjustment_variants,
    "yield_layers": yield_layers,
    "live_months": live_months,
    "live_core": live_core,
    "financial_ablation": financial_ablation,
    "arima_forecast": arima_forecast,
    "hybrid_forecast": hybrid_forecast,
    "blend_weights": blend_weights,
    "recursive_forecast": recursive_forecast,
    "growth_clusters": growth_clusters,
    "pooled_trees": pooled_trees,
    "sequence_regression": sequence_regression,
    "growth_adjusted": growth_adjusted,
    "confidence_caps": confidence_caps,
    "eps_regression": eps_regression,
    "dividend_hurdle": dividend_hurdle,
    "financial_summary": financial_summary,
}
ORACLE_SQL: dict[str, str] = {}

# Twins of what needs no fitted model.
_REG = f"WITH {S.full()}, {RS._REGIME}"
_ALL = PF._BASE.replace("monthly AS (SELECT 'formula' AS model, stock_id, target_year, target_month, predicted_revenue FROM pred WHERE model = 'formula')", "monthly AS (SELECT model, stock_id, target_year, target_month, predicted_revenue FROM pred)")
_CHAIN = f"""{_ALL}, {PF._QUARTERS}, {PF._PAYOUT.split('est AS (')[0]}
sq AS (SELECT tq.model, tq.stock_id, sum(q * coalesce(qm.r, rr.ratio)) AS e, count(coalesce(qm.r, rr.ratio)) AS n FROM tq LEFT JOIN qm ON tq.stock_id = qm.stock_id AND tq.eps_quarter = qm.eps_quarter LEFT JOIN rr ON tq.stock_id = rr.stock_id GROUP BY 1, 2),
es AS (SELECT annual.model, annual.stock_id, 'current_ratio' AS eps_method, predicted_annual_revenue * ratio AS e, CASE WHEN ratio IS NULL THEN 'EPS unavailable' ELSE 'ok' END AS status FROM annual LEFT JOIN rr ON annual.stock_id = rr.stock_id
  UNION ALL SELECT annual.model, annual.stock_id, 'seasonal_quarter_median', CASE WHEN n >= 4 THEN sq.e END, CASE WHEN n >= 4 THEN 'ok' ELSE 'EPS unavailable' END FROM annual LEFT JOIN sq ON annual.model = sq.model AND annual.stock_id = sq.stock_id),
dc AS (SELECT es.*, CASE WHEN e IS NOT NULL AND coalesce(own.p, (SELECT p FROM cs)) IS NOT NULL THEN greatest(e * coalesce(own.p, (SELECT p FROM cs)), 0) END AS cash FROM es LEFT JOIN own ON es.stock_id = own.stock_id)"""
_PATH = f"""WITH RECURSIVE {S.panel()}, {S.SEGMENTS}, l15 AS (SELECT stock_id, month_index, list(revenue) OVER (PARTITION BY stock_id, calendar_segment ORDER BY month_index ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS h, row_number() OVER (PARTITION BY stock_id ORDER BY month_index DESC) AS n FROM seg WHERE revenue_year < 2000),
go AS (SELECT stock_id, month_index, h, 0 AS step FROM l15 WHERE n = 1 AND len(h) = 15
  UNION ALL SELECT stock_id, month_index, list_append(h[2:], greatest(exp(0.75 * ln(1 + greatest(exp(ln(1 + h[4]) + greatest(least(g1 + g2 + g3 - greatest(g1, g2, g3) - least(g1, g2, g3), ln(2.0)), -ln(2.0))) - 1, 0)) + 0.25 * ln(1 + h[15])) - 1, 0)), step + 1
  FROM (SELECT *, ln(1 + h[15]) - ln(1 + h[3]) AS g1, ln(1 + h[14]) - ln(1 + h[2]) AS g2, ln(1 + h[13]) - ln(1 + h[1]) AS g3 FROM go WHERE step < 12)),
rc AS (SELECT stock_id, CAST((month_index + step) // 12 AS INTEGER) AS target_year, CAST((month_index + step) % 12 + 1 AS INTEGER) AS target_month, step, h[15] AS p FROM go WHERE step > 0)"""

_VALID = """coalesce(f >= 0, false) AS fv, coalesce(s >= 0 AND s < 9223372036854775807 AND s <= 2 * greatest(CASE WHEN coalesce(f >= 0, false) THEN f ELSE 0 END, CASE WHEN last_observed_revenue >= 0 THEN last_observed_revenue ELSE 0 END, 1), false) AS sv"""
_NAIVE = f"WITH {S.panel()}, {S.SEGMENTS}, {S.BASELINES}, {S.formula()}"


def _scores_sql(rows: str, configs: str) -> str:
    """Balanced scores over rows (configs, stock_id, p, actual_revenue)."""
    return f"""bs0 AS (SELECT {configs}, stock_id, sum(abs(p - actual_revenue)) AS e, sum(abs(actual_revenue)) AS a, count(*) AS n FROM {rows} WHERE p IS NOT NULL AND actual_revenue IS NOT NULL GROUP BY ALL),
bs AS (SELECT {configs}, CAST(sum(n) AS BIGINT) AS observations, sum(e) / sum(a) * 100 AS w, quantile_cont(e / a, 0.5) * 100 AS m FROM bs0 GROUP BY ALL)
SELECT {configs}, observations, round(w, 6) AS WMAPE, round(m, 6) AS median_stock_WMAPE, round(0.5 * w + 0.5 * m, 6) AS balanced_score FROM bs"""


_SWEPT = "[0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"
ORACLE_SQL |= {
    "hybrid_naive": f"""{_NAIVE}, h AS (SELECT *, {_VALID} FROM (SELECT *, formula_adjusted_revenue AS f, seasonal_naive_revenue AS s FROM formula WHERE target_year = 2000))
SELECT stock_id, target_year, target_month, fv AS formula_valid, sv AS second_valid, round(CASE WHEN fv AND sv THEN greatest(0.1 * s + 0.9 * f, 0) WHEN fv THEN f WHEN sv THEN s END, 4) AS hybrid_predicted_revenue, CASE WHEN fv AND sv THEN 'weighted_hybrid' WHEN fv THEN 'formula_fallback' WHEN sv THEN 'second_fallback' ELSE 'unavailable' END AS hybrid_method FROM h""",
    "blend_weights_naive": f"""{_NAIVE}, h AS (SELECT *, {_VALID} FROM (SELECT *, formula_adjusted_revenue AS f, seasonal_naive_revenue AS s FROM formula WHERE target_year = 1999)), wt AS (SELECT *, unnest({_SWEPT}) AS second_weight FROM h WHERE fv AND sv),
wp AS (SELECT *, greatest(second_weight * s + (1 - second_weight) * f, 0) AS p FROM wt), {_scores_sql('wp', 'second_weight')}""",
    "break_sweep_naive": f"""{PFX.BREAK_SQL[: PFX.BREAK_SQL.index('d AS (SELECT *, coalesce(q1 < 0.5')].rstrip().rstrip(',').rsplit('c AS (SELECT *', 1)[0].rstrip().rstrip(',')}, o0 AS (SELECT * FROM b2 WHERE target_year = 1999),
o1 AS (SELECT *, unnest([0.1::DOUBLE, 0.2, 0.3]) AS yoy_threshold FROM o0), o2 AS (SELECT *, unnest([0.2::DOUBLE, 0.3, 0.4]) AS level_threshold FROM o1), o3 AS (SELECT *, unnest([0.0::DOUBLE, 0.1, 0.2]) AS retention FROM o2),
o4 AS (SELECT *, CAST(coalesce(q1 < level_threshold, false) AS INTEGER) + CAST(coalesce(q2 < level_threshold, false) AS INTEGER) + CAST(coalesce(q3 < level_threshold, false) AS INTEGER) AS n FROM o3),
o5 AS (SELECT *, seasonal_naive_revenue AS s, CASE WHEN coalesce(q1 < yoy_threshold, false) AND (coalesce(lv < level_threshold, false) OR n >= 2) AND coalesce(last_observed_revenue >= 0, false) THEN greatest(retention * formula_adjusted_revenue + (1 - retention) * last_observed_revenue, 0) ELSE formula_adjusted_revenue END AS f FROM o4),
o6 AS (SELECT *, {_VALID} FROM o5), o7 AS (SELECT *, unnest({_SWEPT}) AS second_weight FROM o6 WHERE fv AND sv), o8 AS (SELECT *, greatest(second_weight * s + (1 - second_weight) * f, 0) AS p FROM o7), {_scores_sql('o8', 'yoy_threshold, level_threshold, retention, second_weight')}""",
    "growth_adjusted": RS.ORACLE_SQL["growth_adjusted_by_regime"],
    "confidence_caps": f"""{_REG}, s AS (SELECT *, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS confidence_threshold, CASE WHEN regime = 'decline' THEN 0.5 * greatest(least(((CASE WHEN last_observed_revenue > 0 THEN predicted_revenue / last_observed_revenue ELSE 1 END) - 1) / 0.5, 1), 0)
  + 0.35 * greatest(least((0.4 - growth_ratio) / 0.4, 1), 0) + 0.15 * greatest(least((4 - growth_streak) / 4, 1), 0) ELSE 0 END AS c FROM rg),
h AS (SELECT * EXCLUDE predicted_revenue, greatest(round_even(CASE WHEN c > 0 AND c >= confidence_threshold THEN least(predicted_revenue, last_observed_revenue) ELSE predicted_revenue END, 0), 0) AS predicted_revenue FROM s)
SELECT CAST(confidence_threshold AS DOUBLE) AS confidence_threshold, {S.metrics()} FROM h GROUP BY 1""",
    "adjustment_variants": f"""{_REG}, v AS (SELECT *, unnest([0.0, 0.4, 0.8]) AS alpha FROM rg), w AS (SELECT *, unnest([0.0, 1.0]) AS cap FROM v),
b AS (SELECT *, CASE WHEN regime = 'growth' AND growth_phase AND growth_rate > 0 THEN predicted_revenue * (1 + alpha * greatest(growth_signal, 0)) ELSE predicted_revenue END AS b FROM w),
h AS (SELECT * EXCLUDE predicted_revenue, CASE WHEN regime = 'decline' AND cap > 0 THEN least(b, last_observed_revenue) ELSE b END AS predicted_revenue FROM b)
SELECT CAST(alpha AS DOUBLE) AS alpha, CAST(cap AS DOUBLE) AS cap, {S.metrics()} FROM h GROUP BY 1, 2""",
    "recursive_forecast": f"{_PATH} SELECT stock_id, target_year, target_month, step, round(p, 6) AS predicted_revenue FROM rc",
    "live_months": f"""{_PATH}, k AS (SELECT stock_id, revenue_year AS target_year, revenue_month AS target_month, revenue FROM panel WHERE make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= {S.AS_OF}),
g AS (SELECT stock_id, target_year, CAST(unnest(range(1, 13)) AS INTEGER) AS target_month FROM (SELECT DISTINCT stock_id, CAST(unnest([1999, 2000]) AS INTEGER) AS target_year FROM k))
SELECT g.stock_id, g.target_year, g.target_month, round(coalesce(revenue, p), 6) AS predicted_revenue, CASE WHEN revenue IS NOT NULL THEN 'actual' WHEN p IS NOT NULL THEN 'forecast' ELSE 'missing' END AS basis
FROM g LEFT JOIN k ON g.stock_id = k.stock_id AND g.target_year = k.target_year AND g.target_month = k.target_month LEFT JOIN rc ON g.stock_id = rc.stock_id AND g.target_year = rc.target_year AND g.target_month = rc.target_month""",
    "live_core": f"""WITH RECURSIVE {S.full()}, {S.EPS}, {S.DIVIDENDS}, {S.PRICES}, {S.MASTER}, {S.FINANCE}, {PF._QUARTERS}, {_PATH[_PATH.index('l15 AS ('):]},
{PF.PATTERNS_SQL[PF.PATTERNS_SQL.index('g AS (SELECT stock_id, unnest([1995'):PF.PATTERNS_SQL.index('est AS (')].rstrip().rstrip(',')},
lg AS (SELECT stock_id, target_year, CAST(unnest(range(1, 13)) AS INTEGER) AS target_month FROM (SELECT DISTINCT stock_id, CAST(unnest([1999, 2000]) AS INTEGER) AS target_year FROM past)),
lm AS (SELECT lg.*, coalesce(past.revenue, rc.p) AS p, past.revenue IS NOT NULL AS fact FROM lg LEFT JOIN past ON lg.stock_id = past.stock_id AND lg.target_year = past.revenue_year AND lg.target_month = past.revenue_month
  LEFT JOIN rc ON lg.stock_id = rc.stock_id AND lg.target_year = rc.target_year AND lg.target_month = rc.target_month),
la AS (SELECT stock_id, target_year, sum(greatest(p, 0)) AS r, count(*) FILTER (WHERE fact) AS known_months FROM lm GROUP BY 1, 2 HAVING count(p) = 12),
lq AS (SELECT stock_id, target_year, (target_month - 1) // 3 + 1 AS eps_quarter, sum(p) AS q FROM lm GROUP BY 1, 2, 3),
lx AS (SELECT la.stock_id, la.target_year, ek.EPS AS a, coalesce(ek.EPS, q * qm.r, q * rr.ratio) AS v FROM la JOIN lq ON la.stock_id = lq.stock_id AND la.target_year = lq.target_year LEFT JOIN ek ON la.stock_id = ek.stock_id AND la.target_year = ek.eps_year AND lq.eps_quarter = ek.eps_quarter
  LEFT JOIN qm ON la.stock_id = qm.stock_id AND lq.eps_quarter = qm.eps_quarter LEFT JOIN rr ON la.stock_id = rr.stock_id),
le AS (SELECT stock_id, target_year, count(a) AS known_quarters, CASE WHEN count(v) = 4 THEN sum(v) END AS e FROM lx GROUP BY 1, 2),
lp AS (SELECT stock_id, arg_max(close, date) AS stock_price FROM px WHERE date <= {S.AS_OF} GROUP BY 1),
ld AS (SELECT la.*, known_quarters, e, dividend_pattern, CASE WHEN dividend_pattern = 'none' THEN 0 WHEN dividend_pattern = 'fixed' THEN m WHEN dividend_pattern = 'normal' AND e * payout_ratio IS NOT NULL THEN greatest(e * payout_ratio, 0) END AS cash FROM la LEFT JOIN le ON la.stock_id = le.stock_id AND la.target_year = le.target_year LEFT JOIN f ON la.stock_id = f.stock_id)
SELECT ld.stock_id, target_year, round(r, 4) AS predicted_annual_revenue, known_months, known_quarters, round(e, 4) AS estimated_eps, dividend_pattern, round(cash, 4) AS estimated_cash_dividend, round(stock_price, 4) AS stock_price, round(cash / nullif(stock_price, 0) * 100, 4) AS estimated_yield_percent
FROM ld LEFT JOIN lp ON ld.stock_id = lp.stock_id""",
    "financial_summary": f"""{_CHAIN}, now AS (SELECT stock_id, arg_max(close, date) AS px FROM px WHERE date <= {S.AS_OF} GROUP BY 1)
SELECT model, dc.stock_id, eps_method, round(e, 6) AS estimated_eps, round(cash, 6) AS estimated_cash_dividend, round(px, 6) AS stock_price, round(cash / px * 100, 6) AS estimated_yield_percent, status FROM dc LEFT JOIN now ON dc.stock_id = now.stock_id""",
    "yield_layers": f"""{_CHAIN}, {PF.YIELDS_SQL[PF.YIELDS_SQL.index('mo AS ('):PF.YIELDS_SQL.index('\ny AS (')].rstrip().rstrip(',')}, act AS (SELECT stock_id, sum(TotalCashDividend) AS actual FROM dv WHERE year(ex_dividend_date) = 2000 GROUP BY 1),
v AS (SELECT model, eps_method, dc.stock_id, cash / stock_price * 100 AS y, actual / stock_price * 100 AS a FROM dc JOIN fl ON dc.stock_id = fl.stock_id AND fl.target_month > 0 LEFT JOIN act ON dc.stock_id = act.stock_id WHERE stock_price > 0),
o AS (SELECT model, eps_method, stock_id, avg(abs(y - a)) AS m, avg(y - a) AS b, avg(CASE WHEN a <> 0 THEN abs(y - a) / abs(a) END) * 100 AS p, count(*) AS n FROM v WHERE y IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2, 3)
SELECT model, eps_method, count(*) AS stocks, CAST(sum(n) AS BIGINT) AS observations, round(avg(m), 6) AS MAE, round(quantile_cont(m, 0.5), 6) AS median_abs_error, round(avg(b), 6) AS bias, round(avg(p), 6) AS MAPE FROM o GROUP BY 1, 2""",
}
