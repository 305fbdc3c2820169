"""Studies composed of other operators: sweeps, ablations and comparisons, each one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators import finance as FI
from tidemark.operators.cohorts import best_per, method_cohort, to_long
from tidemark.operators.forecast import HybridConfig, blended, weighted_forecasts
from tidemark.operators.metrics import balanced_score, balanced_scores
from tidemark.sources.artifacts import settled

ID = "stock_id"


def layered_accuracy(rows: DataFrame, estimate: str, actual: str, *groups: str) -> DataFrame:
    """EVL-17 to EVL-19: errors of an estimate by entity first, then the entities' mean and median for each group."""
    error = F.abs(F.col(estimate) - F.col(actual))
    known = rows.where(F.col(estimate).isNotNull() & F.col(actual).isNotNull())
    each = known.groupBy(*groups, ID).agg(F.avg(error).alias("_mae"), F.avg(F.col(estimate) - F.col(actual)).alias("_bias"), F.avg(F.when(F.col(actual) != 0, error / F.abs(actual)) * 100).alias("_ape"), F.count("*").alias("_n"))
    return each.groupBy(*groups).agg(F.count("*").alias("stocks"), F.sum("_n").alias("observations"), F.avg("_mae").alias("MAE"), F.percentile("_mae", 0.5).alias("median_abs_error"), F.avg("_bias").alias("bias"), F.avg("_ape").alias("MAPE"))


def leakage_share(rows: DataFrame, flag: str, *groups: str) -> DataFrame:
    """EVL-21: the share of entities whose evidence includes something later than the cut-off."""
    return rows.groupBy(*groups, ID).agg(F.bool_or(flag).alias("_f")).groupBy(*groups).agg(F.count("*").alias("stocks"), F.count_if("_f").alias("leaking"), (F.avg(F.col("_f").cast("int")) * 100).alias("leaking_percent"))


def yield_comparison(yields: DataFrame) -> DataFrame:
    """YLD-04: estimated against actual yields of each month end, with their errors."""
    rows = yields.where("is_evaluation")
    error = F.col("estimated_yield_percent") - F.col("actual_yield_percent")
    return rows.withColumns({"yield_abs_error": F.abs(error), "yield_relative_error_percent": ratio(error, F.col("actual_yield_percent")) * 100, "has_actual": F.col("actual_yield_percent").isNotNull()})


def live_months(panel: DataFrame, forecast: DataFrame, as_of: str, years: tuple[int, int]) -> DataFrame:
    """YLD-06: the months of two years: what was published by the cut-off as it is, the rest by forecast, each with its basis."""
    public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(as_of).cast("date")
    known = panel.where(public).select(ID, F.col("revenue_year").alias("target_year"), F.col("revenue_month").alias("target_month"), F.col("revenue").alias("_actual"))
    grid = known.select(ID).distinct().withColumn("target_year", F.explode(F.array(*[F.lit(y) for y in years]))).withColumn("target_month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    rows = grid.join(known, [ID, "target_year", "target_month"], "left").join(forecast.select(ID, "target_year", "target_month", "predicted_revenue"), [ID, "target_year", "target_month"], "left")
    basis = F.when(F.col("_actual").isNotNull(), "actual").when(F.col("predicted_revenue").isNotNull(), "forecast").otherwise("missing")
    return rows.select(ID, "target_year", "target_month", F.coalesce("_actual", "predicted_revenue").alias("predicted_revenue"), basis.alias("basis"))


def live_core(panel: DataFrame, forecast: DataFrame, quarterly: DataFrame, dividends: DataFrame, prices: DataFrame, entities: DataFrame, as_of: str, years: tuple[int, int], tolerance: float = 0.05) -> DataFrame:
    """YLD-06: revenue, EPS, dividend and yield of two years as known and foreseen at the cut-off.

    Months as of :func:`live_months`; published quarters of EPS with the others by ratio (EPS-03); dividends by the pattern of the five years before
    (DIV-06, DIV-07); the last close. A year needs twelve months and four quarters; ``known_months`` and ``known_quarters`` say how much of it is fact.
    """
    # Read by totals, by both years' quarters and by the count of what is known.
    months = settled(live_months(panel, forecast, as_of, years).withColumn("model", F.lit("live")), "live-months")
    annual = FI.annual_predictions(months)[0]
    public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(as_of).cast("date")
    past, eps = panel.where(public), settled(FI.annual_eps(quarterly, as_of), "annual-eps")
    history = settled(FI.ratio_history(past, eps), "ratio-history")
    of = lambda rows, year: rows.where(F.col("target_year") == year)
    quarters = [FI.eps_known_quarters(of(annual, y), of(months, y), past, quarterly, history, y, as_of) for y in years]
    quarters = quarters[0].unionByName(quarters[1])
    own = quarters.groupBy("model", ID, "target_year").agg(F.count_if(F.col("basis") == "actual").alias("known_quarters"), F.when(F.count("estimated_eps") == 4, F.sum("estimated_eps")).alias("estimated_eps"))
    known = months.groupBy(ID, "target_year").agg(F.count_if(F.col("basis") == "actual").alias("known_months"))
    patterns = FI.dividend_patterns(FI.five_years(entities, eps, dividends, as_of), tolerance)
    rows = FI.dividend_by_pattern(annual.join(own, ["model", ID, "target_year"], "left").join(known, [ID, "target_year"], "left"), patterns)
    rows = rows.join(FI.price_as_of(prices, as_of), ID, "left")
    percent = ratio(F.col("estimated_cash_dividend"), F.col("stock_price")) * 100
    return rows.withColumn("estimated_yield_percent", percent).select(ID, "target_year", "predicted_annual_revenue", "known_months", "known_quarters", "estimated_eps", "dividend_pattern", "estimated_cash_dividend", "stock_price", "estimated_yield_percent")


def yields_of_models(wide: DataFrame, models: dict[str, str], revenue: DataFrame, quarterly: DataFrame, dividends: DataFrame, prices: DataFrame, target_year: int, as_of: str) -> dict[str, DataFrame]:
    """YLD-07: forecasts with a column for each model through the whole financial chain."""
    return FI.financial_forecast(to_long(wide, [ID, "target_year", "target_month"], models), revenue, quarterly, dividends, prices, target_year, as_of)


def _grid(rows: DataFrame, values: dict[str, tuple[float, ...]]) -> DataFrame:
    """Rows under every combination of a small grid of parameters, as columns."""
    for name, options in values.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in options])))
    return rows


def adjustment_variants(predictions: DataFrame, alphas: tuple[float, ...] = (0.0, 0.4, 0.8), caps: tuple[float, ...] = (0.0, 1.0)) -> DataFrame:
    """EVL-05: growth boosts of several strengths with and without the cap in declines, in one pass; rows as for adjust_for_growth."""
    rows = _grid(predictions, {"alpha": alphas, "cap": caps})
    p, last, positive = F.col("predicted_revenue"), F.col("last_observed_revenue"), F.greatest(F.col("growth_signal"), F.lit(0.0))
    boost = (F.col("regime") == "growth") & F.col("growth_phase") & (F.col("growth_rate") > 0)
    boosted = F.when(boost, p * (1 + F.col("alpha") * positive)).otherwise(p)
    return rows.withColumn("predicted_revenue", F.when((F.col("regime") == "decline") & (F.col("cap") > 0), F.least(boosted, last)).otherwise(boosted))


WEIGHTS = tuple(round(k / 10, 1) for k in range(11))


def blend_scores(formula: DataFrame, second: DataFrame, weights: tuple[float, ...] = WEIGHTS, config: HybridConfig = HybridConfig()) -> DataFrame:
    """EVL-07: the balanced score of each weight of the second forecast, where both are valid: joined once, weights exploded after."""
    rows = _grid(formula.join(second, [ID, "target_year", "target_month"]), {"second_weight": weights})
    return balanced_score(weighted_forecasts(rows, config).where("both_models_valid"), "second_weight", predicted="hybrid_predicted_revenue")


def break_sweep(featured: DataFrame, second: DataFrame, yoy: tuple[float, ...] = (0.1, 0.2, 0.3), level: tuple[float, ...] = (0.2, 0.3, 0.4), retention: tuple[float, ...] = (0.0, 0.1, 0.2), weights: tuple[float, ...] = WEIGHTS, config: HybridConfig = HybridConfig()) -> DataFrame:
    """EVL-08: 27 settings of the structural break by 11 blend weights on the same rows, with their balanced scores.

    Formula and second forecast are joined once and lie by entity; settings of the break are exploded from there into sums for each
    setting and entity, which takes no shuffle, and weights are columns of these sums (whether both are valid does not depend on them).
    """
    rows = featured.join(second, [ID, "target_year", "target_month"]).repartition(ID)
    rows = _grid(rows, {"yoy_threshold": yoy, "level_threshold": level, "retention": retention})
    below = lambda c, t: F.coalesce(F.col(c) < t, F.lit(False))
    recent = sum((below(f"break_recent_ratio_{k}", F.col("level_threshold")).cast("int") for k in (1, 2, 3)), F.lit(0))
    hit = below("break_last_yoy_ratio", F.col("yoy_threshold")) & (below("break_level_ratio", F.col("level_threshold")) | (recent >= 2)) & F.coalesce(F.col("last_observed_revenue") >= 0, F.lit(False))
    moved = F.greatest(F.col("retention") * F.col("formula_adjusted_revenue") + (1 - F.col("retention")) * F.col("last_observed_revenue"), F.lit(0.0))
    rows = rows.withColumn("formula_adjusted_revenue", F.when(hit, moved).otherwise(F.col("formula_adjusted_revenue")))
    valid = weighted_forecasts(rows, config).where("both_models_valid")
    each = {float(w): blended(F.col("formula_adjusted_revenue"), F.col("second_revenue"), float(w)) for w in weights}
    return balanced_scores(valid, "second_weight", each, "yoy_threshold", "level_threshold", "retention")


def method_scores(estimates: DataFrame, actuals: DataFrame, methods: list[str], year: Column) -> DataFrame:
    """EVL-15, EVL-11: mean absolute dividend error of each method on the entities that all methods have."""
    rows = estimates.join(actuals, ID).withColumn("fold_year", year)
    cohort = method_cohort(rows, ["fold_year", ID], "dividend_method", F.col("estimated_cash_dividend").isNotNull() & F.col("actual_cash_dividend").isNotNull(), methods)
    error = F.abs(F.col("estimated_cash_dividend") - F.col("actual_cash_dividend"))
    return cohort.groupBy("fold_year", "dividend_method").agg(F.count("*").alias("stocks"), F.avg(error).alias("dividend_mae"))


def select_method(scores: DataFrame, folds: list[int]) -> DataFrame:
    """EVL-11: the method of smallest mean error over the validation folds, ties by name: one row."""
    mean = scores.where(F.col("fold_year").isin(folds)).groupBy("dividend_method").agg(F.avg("dividend_mae").alias("validation_mae")).withColumn("_k", F.lit(1))
    return best_per(mean, "_k", "validation_mae", "dividend_method").drop("_k")
