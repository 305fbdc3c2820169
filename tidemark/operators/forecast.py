"""Whole-universe monthly forecasts: every operator is one plan over all entities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import level_of, log_level, median_of_sorted, percent_change, ratio, safe_round
from tidemark.operators.calendar import ID, MONTH, VALUE, YEAR, baselines, by_segment, months_before, with_segments


@dataclass(frozen=True)
class FormulaConfig:
    """Parameters of the revenue formula."""

    seasonal_weight: float = 0.75
    residual_alpha: float = 0.2
    residual_strength: float = 0.5
    growth_log_cap: float = math.log(2.0)
    correction_log_cap: float = 0.5
    min_history: int = 15


#: Settings of the formula that one sweep may hold.
MOST_CONFIGS = 256


def _clip(c: Column, cap: Column) -> Column:
    # greatest and least pass over nulls, which must stay null here.
    return F.when(c.isNotNull(), F.greatest(F.least(c, cap), -cap))


FORMULA_PARAMETERS = ("seasonal_weight", "residual_alpha", "residual_strength", "growth_log_cap", "correction_log_cap")


def _residual_state(residual: Column, alpha: float, w: Window) -> Column:
    """WIN-19: sum of alpha (1 - alpha)^age times the residuals of the months before, by place in the segment (``history_months``).

    A running sum of residuals scaled up by their place and scaled down again, as far as doubles hold the scale; later places fold the last
    residuals that still count in a double. Short segments collect nothing for that.
    """
    if not 0 <= alpha <= 1:
        raise ValueError(f"residual_alpha must lie between 0 and 1, not {alpha}")
    place, keep = F.col("history_months"), 1 - alpha
    # Places up to which the scale stays below 10^250, and residuals that are more than 10^-18 of their value.
    scaled_to = math.floor(250 / -math.log10(keep)) if 0 < keep < 1 else (0 if keep == 0 else 1 << 30)
    last = math.ceil(18 / -math.log10(keep)) if 0 < keep < 1 else 1
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    state = F.lit(0.0)
    if scaled_to:
        running = F.sum(F.when(place <= scaled_to, residual * F.pow(F.lit(keep), -place))).over(past)
        state = alpha * F.pow(F.lit(keep), place - 1) * F.coalesce(running, F.lit(0.0))
    if keep < 1:
        late = F.collect_list(F.when(place >= scaled_to - last, F.coalesce(residual, F.lit(0.0)))).over(w.rowsBetween(-last, -1))
        state = F.when(place <= scaled_to, state).otherwise(F.aggregate(late, F.lit(0.0), lambda s, r: s * keep + alpha * r))
    return state


def _formula_settings(panel: DataFrame, grid: list[dict], min_history: int) -> DataFrame:
    """The months of the panel with ``_e``, an array with an entry for each setting of the formula: its parameters, parts and state."""
    rows = baselines(panel)
    w = by_segment()
    growth = [F.log1p(F.lag(VALUE, k).over(w)) - F.log1p(F.lag(VALUE, k + 12).over(w)) for k in (1, 2, 3)]
    rows = rows.withColumn("_median_growth", growth[0] + growth[1] + growth[2] - F.greatest(*growth) - F.least(*growth))
    known = F.col("history_months") >= min_history

    def by(g: dict) -> Column:
        growth_log = F.when(known, _clip(F.col("_median_growth"), F.lit(float(g["growth_log_cap"]))))
        seasonal = F.expm1(F.log1p("seasonal_naive_revenue") + growth_log)
        base = F.expm1(g["seasonal_weight"] * log_level(seasonal) + (1 - g["seasonal_weight"]) * F.log1p("last_observed_revenue"))
        return F.struct(growth_log.alias("growth_log"), seasonal.alias("seasonal_growth_forecast"), F.when(known, F.greatest(base, F.lit(0.0))).alias("_base"))

    rows = rows.withColumn("_g", F.array(*[by(g) for g in grid]))
    residual = lambda k: F.when(known, F.log1p(VALUE) - F.log1p(F.col("_g")[k]["_base"]))
    # Settings of one alpha and base would share sums; the optimiser sees equal windows once.
    rows = rows.withColumn("_s", F.array(*[F.when(known, _residual_state(residual(k), float(g["residual_alpha"]), w)) for k, g in enumerate(grid)]))
    settings = lambda g: [F.lit(g[c] if c == "config_id" else float(g[c])).alias(c) for c in g]
    each = F.array(*[F.struct(*settings(g), *[F.col("_g")[k][c].alias(c) for c in ("growth_log", "seasonal_growth_forecast", "_base")], F.col("_s")[k].alias("residual_state")) for k, g in enumerate(grid)])
    return rows.withColumn("_e", each).drop("_g", "_s", "_median_growth")


def _fallback_revenue() -> Column:
    return F.when(F.col("history_months") >= 12, F.col("seasonal_naive_revenue")).when(F.col("history_months") > 0, F.col("last_observed_revenue"))


def _correction(part) -> Column:
    return _clip(part("residual_strength") * part("residual_state"), part("correction_log_cap"))


def _adjusted(part, min_history: int) -> Column:
    """The formula's forecast from the parts of one setting (``part`` gives one by its name)."""
    corrected = F.greatest(F.expm1(F.log1p(part("_base")) + _correction(part)), F.lit(0.0))
    return F.when(F.col("history_months") >= min_history, corrected).otherwise(_fallback_revenue())


def _grid_of(configs: DataFrame) -> list[dict]:
    """Every setting is a few columns of each row, so all share the segment's windows; more settings than columns can be is an error."""
    grid = [r.asDict() for r in configs.select("config_id", *FORMULA_PARAMETERS).orderBy("config_id").limit(MOST_CONFIGS + 1).collect()]
    if len(grid) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations in one sweep")
    return grid


def formula_forecast(panel: DataFrame, config: FormulaConfig = FormulaConfig(), configs: DataFrame | None = None) -> DataFrame:
    """FC-08: one-step forecasts of every month by the revenue formula, with fallbacks by length of history.

    The seasonal anchor grows by the (capped) median log growth on last year of the last three months and is blended with the last
    level in logs; an exponentially weighted mean of past residuals (WIN-19) corrects the result. With ``configs``
    (config_id, seasonal_weight, residual_alpha, residual_strength, growth_log_cap, correction_log_cap: a small grid of parameters) every
    configuration is forecast in the same plan (EVL-06).
    """
    grid = [{c: float(getattr(config, c)) for c in FORMULA_PARAMETERS}] if configs is None else _grid_of(configs)
    rows = _formula_settings(panel, grid, config.min_history)
    rows = rows.withColumn("_e", F.explode("_e")).select("*", "_e.*").drop("_e")
    known = F.col("history_months") >= config.min_history
    rows = rows.withColumn("applied_correction_log", F.when(known, _correction(F.col)).when(F.col("history_months") > 0, F.lit(0.0)))
    rows = rows.withColumns({
        "formula_base_revenue": F.coalesce("_base", _fallback_revenue()),
        "formula_adjusted_revenue": _adjusted(F.col, config.min_history),
        "forecast_method": F.when(known, "revenue_adjustment_formula").when(F.col("history_months") >= 12, "seasonal_naive_fallback").when(F.col("history_months") > 0, "last_observed_fallback").otherwise("missing_prediction"),
        "actual_revenue": F.col(VALUE),
        "target_year": F.col(YEAR),
        "target_month": F.col(MONTH),
    })
    return rows.drop("_base")


def tuned_formula(panel: DataFrame, configs: DataFrame, validation_year: int, target_year: int, min_history: int = 15) -> DataFrame:
    """EVL-30: each entity's own setting of the formula, the one of least absolute error over its validation year, on the target year.

    Rows are not multiplied by settings: each month holds the forecasts of all as an array, an entity's errors are summed place by place,
    and the place of the least (the first of equals) picks from the arrays of the target year. Entities without months in the validation year
    take the first setting. Columns: keys, config_id (null if untuned), validation_error, predicted_revenue, untuned_revenue (first setting).
    """
    if validation_year >= target_year:
        raise ValueError("the validation year must lie before the target year")
    grid = _grid_of(configs)
    rows = _formula_settings(panel.where(F.col(YEAR) <= target_year), grid, min_history)
    rows = rows.withColumn("_p", F.transform("_e", lambda e: _adjusted(lambda c: e[c], min_history)))
    whole = Window.partitionBy(ID)
    error = lambda k: F.sum(F.when(F.col(YEAR) == validation_year, F.abs(F.col("_p")[k] - F.col(VALUE)))).over(whole)
    rows = rows.withColumn("_errors", F.array(*[error(k) for k in range(len(grid))])).where(F.col(YEAR) == target_year)
    least = F.array_min("_errors")
    place = F.when(least.isNotNull(), F.array_position("_errors", least)).cast("int")
    return rows.select(
        ID, F.col(YEAR).alias("target_year"), F.col(MONTH).alias("target_month"), "month_index", F.col(VALUE).alias("actual_revenue"), "last_observed_revenue", "mase_scale",
        F.when(place.isNotNull(), F.element_at("_e", F.coalesce(place, F.lit(1)))["config_id"]).alias("config_id"), least.alias("validation_error"), F.element_at("_p", F.coalesce(place, F.lit(1))).alias("predicted_revenue"), F.col("_p")[0].alias("untuned_revenue"),
    ).where("predicted_revenue is not null")


def seasonal_quantile_forecast(panel: DataFrame, target_year: int) -> DataFrame:
    """FC-01: last year's month times one plus the median of the last three yearly growths known before the target year.

    Without a last-year value the entity's mean of its last year stands in; without growths the month is repeated.
    """
    past = panel.where(F.col(YEAR) < target_year).withColumn("month_index", F.col(YEAR) * 12 + F.col(MONTH) - 1)
    w = Window.partitionBy(ID, MONTH).orderBy(YEAR)
    growth = F.when(F.lag(YEAR).over(w) == F.col(YEAR) - 1, percent_change(F.col(VALUE), F.lag(VALUE).over(w)))
    rows = past.withColumn("_g", growth).withColumn("_n", F.row_number().over(Window.partitionBy(ID, MONTH).orderBy(F.desc(YEAR))))
    months = rows.groupBy(ID, MONTH).agg(F.max(F.when(F.col(YEAR) == target_year - 1, F.col(VALUE))).alias("_base"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.col("_g")))).alias("_growths"))
    mean = past.where(F.col(YEAR) == target_year - 1).groupBy(ID).agg(F.avg(VALUE).alias("_mean"))
    grid = past.select(ID).distinct().withColumn(MONTH, F.explode(F.sequence(F.lit(1), F.lit(12))))
    out = grid.join(months, [ID, MONTH], "left").join(mean, ID, "left")
    base = F.coalesce("_base", "_mean")
    return out.select(ID, F.lit(target_year).alias("target_year"), F.col(MONTH).alias("target_month"), F.greatest(base * (1 + F.coalesce(median_of_sorted(F.col("_growths")), F.lit(0.0))), F.lit(0.0)).alias("predicted_revenue"))


def inverse_error_weights(validation: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """FC-03: weights of each entity's models from their validation MAPE; a missing model has the worst, none at all means equal."""
    ape = F.when(F.col("actual_revenue") != 0, F.abs(F.col("predicted_revenue") - F.col("actual_revenue")) / F.abs("actual_revenue"))
    mape = validation.groupBy(ID, "model").agg((F.avg(ape) * 100).alias("mape"))
    grid = validation.select(ID).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    rows = grid.join(mape, [ID, "model"], "left")
    w = Window.partitionBy(ID)
    rows = rows.withColumn("mape", F.coalesce("mape", F.max("mape").over(w), F.lit(1.0)))
    inverse = 1 / F.greatest(F.col("mape"), F.lit(1e-6))
    return rows.withColumn("_i", inverse).withColumn("weight", F.col("_i") / F.sum("_i").over(w)).drop("_i")


def weighted_ensemble(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """FC-04, FC-05: weighted mean of the models at hand (weights scaled to them), their spread and 1.28 sigma bounds."""
    rows = predictions.where(F.col("predicted_revenue").isNotNull()).join(weights.select(ID, "model", "weight"), [ID, "model"])
    out = rows.groupBy(ID, "target_year", "target_month").agg(
        ratio(F.sum(F.col("weight") * F.col("predicted_revenue")), F.sum("weight")).alias("predicted_revenue"),
        F.coalesce(F.stddev_samp("predicted_revenue"), F.lit(0.0)).alias("spread"),
        F.count("*").alias("models"),
    )
    return out.withColumns({"lower": F.greatest(F.col("predicted_revenue") - 1.28 * F.col("spread"), F.lit(0.0)), "upper": F.col("predicted_revenue") + 1.28 * F.col("spread")})


def recommend_model(weights: DataFrame, ensemble_mape: DataFrame) -> DataFrame:
    """FC-06, FC-07: the best single model where it beats the ensemble by 3 points, the ensemble where it is within 1 point or better, else the default."""
    best = weights.groupBy(ID).agg(F.min_by("model", F.struct("mape", "model")).alias("best_model"), F.min("mape").alias("best_mape"))
    rows = best.join(ensemble_mape, ID, "left")
    gap = F.col("ensemble_mape") - F.col("best_mape")
    return rows.withColumn("recommendation", F.when(F.col("ensemble_mape").isNull() | (gap >= 3), F.col("best_model")).when(gap <= 1, F.lit("ensemble")).otherwise("default"))


@dataclass(frozen=True)
class HybridConfig:
    second_weight: float = 0.1
    upper_multiplier: float = 2.0
    number_guard: float = float(2**63 - 1)
    second_method: str = "seasonal_arima"


def combine_forecasts(formula: DataFrame, second: DataFrame, config: HybridConfig = HybridConfig()) -> DataFrame:
    """JON-08, FC-11: outer join of formula and second forecast, weighted where both are valid, else the valid one.

    ``formula``: keys, formula_adjusted_revenue, actual_revenue, last_observed_revenue; ``second``: keys,
    second_revenue, second_method. A second forecast above ``upper_multiplier`` times the larger of formula and last value is not valid.
    """
    return weighted_forecasts(formula.join(second, [ID, "target_year", "target_month"], "full"), config)


def blended(formula: Column, second: Column, weight: Column | float) -> Column:
    """FC-11: both forecasts by the weight of the second."""
    return F.greatest(weight * second + (1 - weight) * formula, F.lit(0.0))


def weighted_forecasts(rows: DataFrame, config: HybridConfig = HybridConfig()) -> DataFrame:
    """FC-11 on rows that hold both forecasts already; a column ``second_weight`` stands for the one of the config, so that a sweep explodes joined rows."""
    f, s, last = F.col("formula_adjusted_revenue"), F.col("second_revenue"), F.col("last_observed_revenue")
    formula_valid = F.coalesce(f >= 0, F.lit(False))
    anchor = F.greatest(F.when(formula_valid, f).otherwise(0.0), F.when(last >= 0, last).otherwise(0.0))
    upper = config.upper_multiplier * F.greatest(anchor, F.lit(1.0))
    second_valid = F.coalesce((s >= 0) & (s < config.number_guard) & (s <= upper) & (F.col("second_method") == config.second_method), F.lit(False))
    rows = rows.withColumns({"formula_valid": formula_valid, "second_valid": second_valid, "guardrail_upper": upper})
    both = F.col("formula_valid") & F.col("second_valid")
    w = F.lit(config.second_weight) if "second_weight" not in rows.columns else F.col("second_weight")
    return rows.withColumns({
        "hybrid_predicted_revenue": F.greatest(F.when(both, blended(f, s, w)).when(F.col("formula_valid"), f).when(F.col("second_valid"), s), F.lit(0.0)),
        "hybrid_method": F.when(both, "weighted_hybrid").when(F.col("formula_valid"), "formula_fallback").when(F.col("second_valid"), "second_fallback").otherwise("unavailable"),
        "both_models_valid": both,
    }).withColumn("hybrid_predicted_revenue", F.when(F.col("hybrid_method") != "unavailable", F.col("hybrid_predicted_revenue")))


@dataclass(frozen=True)
class BreakConfig:
    yoy_ratio_threshold: float = 0.10
    level_ratio_threshold: float = 0.20
    formula_retention: float = 0.10
    recent_ratio_threshold: float = 0.20
    required_recent_breaks: int = 2


def _level_ratio(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (F.greatest(a, F.lit(0.0)) + 1e-9) / (F.greatest(b, F.lit(0.0)) + 1e-9))


def break_features(panel: DataFrame) -> DataFrame:
    """JON-15, FC-12: the last month against the same month a year before and against the median of the last twelve calendar months."""
    rows = panel.withColumn("month_index", F.col(YEAR) * 12 + F.col(MONTH) - 1)
    entity = Window.partitionBy(ID).orderBy("month_index")
    recent = [_level_ratio(months_before(VALUE, k), months_before(VALUE, k + 12)) for k in (1, 2, 3)]
    last12 = F.array_sort(F.collect_list(VALUE).over(entity.rangeBetween(-12, -1)))
    return rows.withColumns({
        "break_last_yoy_ratio": recent[0],
        "break_level_ratio": _level_ratio(months_before(VALUE, 1), median_of_sorted(last12)),
        "break_recent_ratio_1": recent[0],
        "break_recent_ratio_2": recent[1],
        "break_recent_ratio_3": recent[2],
    }).select(ID, F.col(YEAR).alias("target_year"), F.col(MONTH).alias("target_month"), *[c for c in ("break_last_yoy_ratio", "break_level_ratio", "break_recent_ratio_1", "break_recent_ratio_2", "break_recent_ratio_3")])


def apply_breaks(featured: DataFrame, config: BreakConfig = BreakConfig()) -> DataFrame:
    """FC-12: where a collapse is detected the formula gives way to the last level."""
    count = sum((F.coalesce(F.col(f"break_recent_ratio_{k}") < config.recent_ratio_threshold, F.lit(False)).cast("int") for k in (1, 2, 3)), F.lit(0))
    rows = featured.withColumn("recent_break_count", count)
    seen = F.coalesce(F.col("break_last_yoy_ratio") < config.yoy_ratio_threshold, F.lit(False)) & (F.coalesce(F.col("break_level_ratio") < config.level_ratio_threshold, F.lit(False)) | (F.col("recent_break_count") >= config.required_recent_breaks))
    valid = seen & F.coalesce(F.col("last_observed_revenue") >= 0, F.lit(False))
    moved = F.greatest(config.formula_retention * F.col("formula_adjusted_revenue") + (1 - config.formula_retention) * F.col("last_observed_revenue"), F.lit(0.0))
    return rows.withColumns({"structural_break_detected": valid, "original_formula_revenue": F.col("formula_adjusted_revenue"), "formula_adjusted_revenue": F.when(valid, moved).otherwise(F.col("formula_adjusted_revenue"))})


def guardrail(predictions: DataFrame, predicted: str = "predicted_revenue") -> DataFrame:
    """FC-16: predictions cut to at most max(5 x last, 4 x window maximum, 1), at least 0, and whether they were."""
    cap = F.greatest(5 * F.col("last_observed_revenue"), 4 * F.col("window_max"), F.lit(1.0))
    cut = F.least(F.greatest(F.col(predicted), F.lit(0.0)), cap)
    return predictions.withColumns({"prediction_cap": cap, "clipped": cut != F.col(predicted), predicted: cut})


def growth_signal(windows: DataFrame) -> DataFrame:
    """FC-17: growth signal, regime, growth phase and high-growth flag of each month, from the rows of growth_windows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    share, streak = F.col("growth_ratio"), F.col("growth_streak")
    return windows.withColumns({
        "growth_signal": 0.5 * zero("momentum_3m") + 0.3 * zero("momentum_6m") + 0.2 * zero("growth_rate"),
        "regime": F.when(share > 0.65, "growth").when(share < 0.4, "decline").otherwise("cycle"),
        "growth_phase": F.coalesce((share > 0.65) & (streak >= 4), F.lit(False)),
        "high_growth": F.coalesce((share > 0.6) | (streak >= 5), F.lit(False)),
    })


def adjust_for_growth(predictions: DataFrame, alpha: float = 0.8, conditional: bool = True, by_regime: bool = True, cap_ratio_max: float | None = None, cap_prediction_min: float = 1.0) -> DataFrame:
    """FC-18: a boost by the growth signal where it is allowed, and a cap at the last level in declines.

    ``conditional`` asks for a growth phase, ``by_regime`` for the growth regime; the last month must have grown.
    """
    p, last = F.col("predicted_revenue"), F.col("last_observed_revenue")
    positive = F.greatest(F.col("growth_signal"), F.lit(0.0))
    allowed = (F.col("growth_rate") > 0) & (positive > 0)
    allowed = allowed & (F.col("regime") == "growth") if by_regime else allowed
    allowed = F.coalesce(allowed & F.col("growth_phase") if conditional else allowed, F.lit(False))
    rows = predictions.withColumns({"adjustment_applied": allowed, "_boosted": F.when(allowed, p * (1 + alpha * positive)).otherwise(p)})
    capped = (F.col("regime") == "decline") & (F.col("_boosted") > last * cap_prediction_min) if by_regime else F.lit(False)
    capped = capped & (F.col("growth_ratio") <= cap_ratio_max) if cap_ratio_max is not None else capped
    rows = rows.withColumn("decline_capped", F.coalesce(capped, F.lit(False)))
    return rows.withColumn("predicted_revenue", F.when(F.col("decline_capped"), F.least(F.col("_boosted"), last)).otherwise(F.col("_boosted"))).drop("_boosted")


def decline_cap_confidence(predictions: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), weights: tuple[float, float, float] = (0.5, 0.35, 0.15), overshoot_scale: float = 0.5, decline_reference: float = 0.4, streak_reference: float = 4.0) -> DataFrame:
    """FC-20: a confidence that a decline should be capped, from overshoot, depth and streak, and the predictions under each threshold."""
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    times = F.when(F.col("last_observed_revenue") > 0, F.col("predicted_revenue") / F.col("last_observed_revenue")).otherwise(1.0)
    parts = (unit((times - 1) / overshoot_scale), unit((decline_reference - F.col("growth_ratio")) / decline_reference), unit((streak_reference - F.col("growth_streak")) / streak_reference))
    score = sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0)) / sum(weights)
    rows = predictions.withColumn("decline_cap_confidence", F.when(F.col("regime") == "decline", score).otherwise(0.0))
    rows = rows.withColumn("confidence_threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = (F.col("decline_cap_confidence") > 0) & (F.col("decline_cap_confidence") >= F.col("confidence_threshold"))
    return rows.withColumns({"confidence_cap_applied": hit, "predicted_revenue": safe_round(F.when(hit, F.least("predicted_revenue", "last_observed_revenue")).otherwise(F.col("predicted_revenue"))).cast("double")})


def recombine_trend_cycle(rows: DataFrame, slope_beta: float = 0.35, most_scale: float = 2.5) -> DataFrame:
    """FC-15: in the cycle regime, trend prediction times slope boost plus the cycle prediction scaled to the observed volatility.

    ``rows``: predicted_revenue, trend_prediction, cycle_prediction, cycle_volatility_6m, trend_slope_rate, regime.
    """
    spread = F.broadcast(rows.agg(F.stddev_pop("cycle_prediction").alias("_sd")))  # one row
    rows = rows.join(spread)
    scale = F.when(F.col("_sd") > 1e-6, F.greatest(F.least(F.coalesce(F.col("cycle_volatility_6m") / (F.col("_sd") + 1e-6), F.lit(1.0)), F.lit(most_scale)), F.lit(1 / most_scale))).otherwise(1.0)
    boost = F.least(F.greatest(F.when(F.col("trend_slope_rate") > 0, 1 + slope_beta * F.col("trend_slope_rate")).otherwise(1.0), F.lit(1.0)), F.lit(1.35))
    both = F.greatest(F.col("trend_prediction") * boost + F.col("cycle_prediction") * scale, F.lit(0.0))
    return rows.withColumns({"volatility_scale": scale, "trend_boost": boost, "predicted_revenue": F.when(F.col("regime") == "cycle", both).otherwise(F.col("predicted_revenue"))}).drop("_sd")


def recursive_forecast(panel: DataFrame, months: int = 12, config: FormulaConfig = FormulaConfig()) -> DataFrame:
    """FC-09: several steps ahead, each on the forecasts before it: a fold over the last fifteen values of each entity."""
    rows = with_segments(panel)
    last15 = F.collect_list(VALUE).over(by_segment().rowsBetween(-14, 0))
    rows = rows.withColumn("_h", last15).withColumn("_n", F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("month_index")))).where((F.col("_n") == 1) & (F.size("_h") == 15))

    def step(state: Column, _: Column) -> Column:
        at = lambda k: F.element_at(state, -k)
        g = [F.log1p(at(k)) - F.log1p(at(k + 12)) for k in (1, 2, 3)]
        growth = _clip(g[0] + g[1] + g[2] - F.greatest(*g) - F.least(*g), F.lit(config.growth_log_cap))
        seasonal = F.expm1(F.log1p(at(12)) + growth)
        level = F.expm1(config.seasonal_weight * F.log1p(F.greatest(seasonal, F.lit(0.0))) + (1 - config.seasonal_weight) * F.log1p(at(1)))
        return F.concat(state, F.array(F.greatest(level, F.lit(0.0))))

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(months)), F.col("_h"), step), 16, months)
    out = rows.select(ID, "month_index", F.posexplode(path).alias("_k", "predicted_revenue")).withColumn("_t", F.col("month_index") + 1 + F.col("_k"))
    return out.select(ID, F.floor(F.col("_t") / 12).cast("int").alias("target_year"), (F.col("_t") % 12 + 1).cast("int").alias("target_month"), (F.col("_k") + 1).alias("step"), "predicted_revenue")


#: FC-10 candidates: every pair of an order (p, 1, q) and a seasonal order (P, 1, Q)12, in the reference's order.
ARIMA_ORDERS = ((0, 1, 1), (1, 1, 0), (1, 1, 1))
ARIMA_SEASONAL_ORDERS = ((0, 1, 1), (1, 1, 0), (0, 1, 0))
#: Values tried for each coefficient, smallest first, so that ties go to the simpler model.
ARIMA_GRID = (0.0, -0.2, 0.2, -0.4, 0.4, -0.6, 0.6, -0.8, 0.8, -0.95, 0.95)


def _arima_paths(min_history: int):
    """Arrow function: (id, segment, start, logs of consecutive months) to the fitted months of each segment.

    Residuals do not depend on the month that is forecast, so one pass over a segment serves all of its months: the
    sums of squares of all candidates grow by a month at a time. A month without a level ends the history.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts, cut, free, orders = [], [0], [], []
        for p, _, q in ARIMA_ORDERS:
            for sp, _, sq in ARIMA_SEASONAL_ORDERS:
                axes = [ARIMA_GRID if on else (0.0,) for on in (p, q, sp, sq)]
                parts.append(np.stack(np.meshgrid(*axes, indexing="ij")).reshape(4, -1))
                cut.append(cut[-1] + parts[-1].shape[1])
                free.append(p + q + sp + sq + 1)
                orders.append((f"({p}, 1, {q})", f"({sp}, 1, {sq}, 12)"))
        phi, theta, sphi, stheta = np.concatenate(parts, axis=1)
        both, sboth, free, first = phi * sphi, theta * stheta, np.array(free), np.array(cut[:-1])

        def segment(start, logs):
            begin, chosen = 0, None
            w, e, sse = [0.0] * 13, [np.zeros(len(phi))] * 13, np.zeros(len(phi))
            for t, y in enumerate(logs):
                n = t - begin - 13
                if (start + t) % 12 == 0:
                    # The order is chosen on what is known before the year, its coefficients anew for each month.
                    chosen = None
                    if t - begin >= min_history:
                        least = np.minimum.reduceat(sse, first)
                        chosen = int(np.argmin(n * np.log(np.maximum(least / n, 1e-12)) + 2.0 * free))
                if n >= 0:
                    anchor = logs[t - 1] + logs[t - 12] - logs[t - 13]
                    step = phi * w[-1] + sphi * w[-12] - both * w[-13] + theta * e[-1] + stheta * e[-12] + sboth * e[-13]
                    if chosen is not None:
                        best = cut[chosen] + int(np.argmin(sse[cut[chosen] : cut[chosen + 1]]))
                        variance = max(sse[best] / n, 1e-12)
                        aic = n * np.log(variance) + 2.0 * free[chosen]
                        yield start + t, aic, *orders[chosen], phi[best], theta[best], sphi[best], stheta[best], anchor + step[best], variance**0.5
                if y is None or not np.isfinite(y):
                    begin, chosen = t + 1, None
                    w, e, sse = [0.0] * 13, [np.zeros(len(phi))] * 13, np.zeros(len(phi))
                elif n >= 0:
                    d = y - anchor
                    w, e = [*w[1:], d], [*e[1:], d - step]
                    sse = sse + e[-1] * e[-1]

        names = ["calendar_segment", "month_index", "aic", "arima_order", "seasonal_order", "phi", "theta", "seasonal_phi", "seasonal_theta", "_log", "_sd"]
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                number = batch.column(1)[i].as_py()
                for row in segment(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()):
                    at.append(i)
                    rows.append((number, *row))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), *[pa.float64()] * 6]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([float(x) for x in c] if k == pa.float64() else c, k) for c, k in zip(columns, kinds, strict=True)]], names=[ID, *names])

    return run


def seasonal_arima_forecast(panel: DataFrame, min_history: int = 36) -> DataFrame:
    """FC-10, re-aimed: nine seasonal ARIMA orders on log1p by conditional sum of squares over a grid of their coefficients.

    The order with the smallest AIC on the consecutive months before a year serves all months of the year; its coefficients
    are those of the smallest sum of squares over all consecutive months before each month. What has no ``min_history`` consecutive
    months before its year falls back to the value a year before. Exact maximum likelihood is out of scope, so figures differ from a
    state-space solver.
    """
    known = F.when(F.col(VALUE) >= 0, F.log1p(F.col(VALUE).cast("double")))
    rows = baselines(panel).withColumn("_y", known)
    keys = [ID, "calendar_segment", "month_index"]
    months = rows.groupBy(ID, "calendar_segment").agg(F.array_sort(F.collect_list(F.struct(F.col("month_index").cast("long").alias("m"), F.col("_y").alias("y")))).alias("_s"))
    months = months.where(F.size("_s") > min_history).select(ID, F.col("calendar_segment").cast("long"), F.col("_s")[0]["m"].alias("_start"), F.col("_s.y").alias("_logs"))
    kind = panel.schema[ID].dataType.simpleString()
    best = months.mapInArrow(_arima_paths(min_history), f"{ID} {kind}, calendar_segment long, month_index long, aic double, arima_order string, seasonal_order string, phi double, theta double, seasonal_phi double, seasonal_theta double, _log double, _sd double")
    out = rows.select(*keys, YEAR, MONTH, "seasonal_naive_revenue", "last_observed_revenue", F.col(VALUE).alias("actual_revenue")).join(best, keys, "left")
    fitted = F.col("_log").isNotNull()
    return out.select(
        ID, F.col(YEAR).alias("target_year"), F.col(MONTH).alias("target_month"), "actual_revenue", "last_observed_revenue", "aic", "arima_order", "seasonal_order", "phi", "theta", "seasonal_phi", "seasonal_theta",
        F.when(fitted, level_of(F.col("_log"))).otherwise(F.col("seasonal_naive_revenue")).alias("second_revenue"),
        F.when(fitted, level_of(F.col("_log") - 1.96 * F.col("_sd"))).alias("lower"),
        F.when(fitted, level_of(F.col("_log") + 1.96 * F.col("_sd"))).alias("upper"),
        F.when(fitted, "seasonal_arima").when(F.col("seasonal_naive_revenue").isNotNull(), "seasonal_naive").otherwise("missing_prediction").alias("second_method"),
    )
