"""Reports over predictions, estimates and failures: totals, shares, summaries and side-by-side tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import quarter_of, ratio
from tidemark.operators import finance as FI
from tidemark.operators.cohorts import comparable_cohort, complete_years
from tidemark.operators.forecast import weighted_ensemble
from tidemark.operators.metrics import accuracy, extended_accuracy, metric_columns, ranked, scored, winners

ID = "stock_id"


def annual_with_actuals(predictions: DataFrame) -> DataFrame:
    """AGG-06: annual prediction and actual with the months that each has."""
    return predictions.groupBy("model", ID, "target_year").agg(
        F.sum("predicted_revenue").alias("predicted_annual_revenue"), F.sum("actual_revenue").alias("actual_annual_revenue"),
        F.count("predicted_revenue").alias("prediction_months"), F.count("actual_revenue").alias("actual_months"),
    )


def quarterly_totals(predictions: DataFrame) -> DataFrame:
    """AGG-07: predicted revenue of each quarter and its months."""
    return predictions.groupBy("model", ID, "target_year", quarter_of(F.col("target_month")).alias("target_quarter")).agg(F.sum("predicted_revenue").alias("predicted_quarter_revenue"), F.count("*").alias("months"))


def dominant_category(rows: DataFrame, category: str, values: tuple[str, ...], total: str) -> DataFrame:
    """AGG-16: how often an entity is in each category, its dominant one (ties to the earlier of ``values``) and its quartile of size.

    Sizes are sums to four digits: what lies below depends on the order of the rows, and equal sizes go by the entity.
    """
    out = rows.groupBy(ID).agg(F.count("*").alias("months"), *[F.count_if(F.col(category) == v).alias(f"{v}_months") for v in values], F.round(F.sum(total), 4).alias("total"))
    share = [F.col(f"{v}_months") / F.col("months") for v in values]
    top = F.greatest(*share)
    dominant = F.coalesce(*[F.when(s == top, v) for s, v in zip(share, values, strict=True)])
    out = out.withColumns({**{f"{v}_share": s for v, s in zip(values, share, strict=True)}, "dominant": dominant, "confidence": top})
    return ranked(out, "total", ID, 4).withColumnRenamed("tile", "size_quartile").drop("rank")


def parameter_frequency(rows: DataFrame, metric: str, months: str, *parameters: str) -> DataFrame:
    """AGG-20: how many entities chose each combination of parameters, their median metric and a sum of months."""
    return rows.groupBy(*parameters).agg(F.count_distinct(ID).alias("stocks"), F.percentile(metric, 0.5).alias("median_metric"), F.sum(months).alias("months"))


def failure_summary(failures: DataFrame) -> DataFrame:
    """AGG-21: failures of each workflow, model and type with the error of the smallest entity; rows: workflow, target_year, model, stock_id, error_type, error."""
    return failures.groupBy("workflow", "target_year", "model", "error_type").agg(F.count("*").alias("failures"), F.min_by("error", F.struct(ID, "error")).alias("example"))


def universe_summary(attempted: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """AGG-22: entities that were attempted, succeeded, failed, are comparable and have whole years, as rows of item and value."""
    exact = comparable_cohort(predictions, models)
    ids = lambda rows: rows.agg(F.count_distinct(ID))
    items = {
        "attempted stocks": ids(attempted), "successful stocks": ids(predictions), "failed stocks": ids(attempted.join(predictions.select(ID).distinct(), ID, "left_anti")), "exact stocks": ids(exact),
        "exact stock-months": exact.select(ID, "target_year", "target_month").distinct().agg(F.count("*")), "complete-year stocks": ids(complete_years(exact)),
    }
    return reduce(lambda a, b: a.union(b), [rows.toDF("value").select(F.lit(name).alias("item"), "value") for name, rows in items.items()])


def error_decomposition(rows: DataFrame, keys: list[str], stages: dict[str, str]) -> DataFrame:
    """AGG-25: averages of stages as rows; ``stages``: column to stage."""
    return rows.select(*keys, *[F.col(c).cast("double").alias(s) for c, s in stages.items()]).unpivot(keys, list(stages.values()), "error_stage", "average_abs_error")


def diagnostic_shares(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """AGG-26: count and share of each bucket of several diagnostics; ``parts``: kind to (rows, column of buckets)."""
    out = []
    for kind, (rows, column) in parts.items():
        counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("bucket")).agg(F.count("*").alias("rows"))
        out.append(counts.select(F.lit(kind).alias("diagnostic"), "bucket", "rows", (F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy(F.lit(kind)))).alias("share_percent")))
    return reduce(lambda a, b: a.union(b), out)


def adjustment_metrics(rows: DataFrame, *groups: str) -> DataFrame:
    """AGG-31: the metric vector with how often predictions were boosted, capped and cut, in percent."""
    rate = lambda c: (F.avg(F.col(c).cast("int")) * 100)
    known = scored(rows).where("last_observed_revenue is not null")
    return known.groupBy(*groups).agg(*metric_columns(), F.count_distinct(ID).alias("stock_count"), rate("adjustment_applied").alias("GrowthBoostRate"), rate("decline_capped").alias("DeclineCapRate"), rate("clipped").alias("GuardrailClipRate"))


def training_years(dividends: DataFrame, target_year: int, first_year: int) -> DataFrame:
    """AGG-32: the ex-years before the target year that there is evidence of."""
    return dividends.select(F.year("ex_dividend_date").alias("training_year")).where((F.col("training_year") >= first_year) & (F.col("training_year") < target_year)).distinct()


def align_to_actuals(estimates: DataFrame, actuals: DataFrame, rates: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    """EVL-24: estimates beside one canonical actual, whatever actual they brought along, with all errors anew.

    ``estimates``: stock_id, estimated_cash_dividend, stock_price, estimated_yield_percent; ``actuals``: stock_id, actual_cash_dividend.
    """
    own = [c for c in ("actual_cash_dividend", "cash_dividend_error", "cash_dividend_abs_error", "actual_yield_percent", "yield_error_percent_point") if c in estimates.columns]
    rows = estimates.drop(*own).join(actuals.select(ID, "actual_cash_dividend"), ID, "left")
    error = F.col("estimated_cash_dividend") - F.col("actual_cash_dividend")
    percent = F.when(F.col("stock_price") > 0, F.col("actual_cash_dividend") / F.col("stock_price") * 100)
    rows = rows.withColumns({"cash_dividend_error": error, "cash_dividend_abs_error": F.abs(error), "actual_yield_percent": percent})
    rows = rows.withColumn("yield_error_percent_point", F.col("estimated_yield_percent") - F.col("actual_yield_percent"))
    return rows.withColumns({f"actual_entry_price_{r}pct": F.col("actual_cash_dividend") / (r / 100) for r in rates})


def common_cohort_comparison(predictions: DataFrame, models: list[str]) -> DataFrame:
    """EVL-26: all models on the rows that every one of them has."""
    return extended_accuracy(comparable_cohort(predictions, models), "model")


def side_by_side(predictions: DataFrame, main: str, others: list[str], limit: float = 15.0) -> DataFrame:
    """EVL-27: each entity's error under every model on complete years, whether the main one wins, and whether it is above the limit."""
    full = complete_years(comparable_cohort(predictions, [main, *others]))
    wide = accuracy(full, "model", ID).groupBy(ID).pivot("model", [main, *others]).agg(F.first("WMAPE").alias("WMAPE"), F.first("MAE").alias("MAE"))
    beats = {f"beats_{o}": F.col(f"{main}_WMAPE") < F.col(f"{o}_WMAPE") for o in others}
    return wide.withColumns({**beats, "over_limit": F.col(f"{main}_WMAPE") > limit})


def oracle_eps(revenue: DataFrame, history: DataFrame, target_year: int) -> DataFrame:
    """EPS-05: the ratio method on the revenue that came true; marked as hindsight."""
    actual = FI.annual_revenue(revenue.where(F.col("revenue_year") == target_year)).select(F.lit("actual_revenue").alias("model"), ID, F.col("revenue_year").alias("target_year"), F.col("annual_revenue").alias("predicted_annual_revenue"))
    return FI.eps_by_ratio(actual, history).withColumns({"eps_method": F.lit("current_ratio_oracle"), "is_hindsight": F.lit(True)})


def ensemble_validation(validation: DataFrame, weights: DataFrame) -> DataFrame:
    """FC-06: the percentage error of the weighted ensemble itself on the validation year, for each entity."""
    actual = validation.groupBy(ID, "target_year", "target_month").agg(F.first("actual_revenue").alias("actual_revenue"))
    rows = weighted_ensemble(validation, weights).join(actual, [ID, "target_year", "target_month"]).where("actual_revenue <> 0")
    return rows.groupBy(ID).agg((F.avg(F.abs(F.col("predicted_revenue") - F.col("actual_revenue")) / F.abs("actual_revenue")) * 100).alias("ensemble_mape"), F.count("*").alias("months"))


def ensemble_or_failure(entities: DataFrame, ensemble: DataFrame, months: int = 12) -> DataFrame:
    """FC-21: the ensemble's rows of all entities, with one failure row for each entity that has none or too few."""
    counts = entities.select(ID).distinct().join(ensemble.groupBy(ID).agg(F.count("*").alias("_n")), ID, "left")
    reason = F.when(F.col("_n").isNull(), "no prediction").when(F.col("_n") < months, "incomplete year")
    failed = counts.withColumn("failure", reason).where("failure is not null").select(ID, "failure")
    good = ensemble.join(failed, ID, "left_anti").withColumn("failure", F.lit(None).cast("string"))
    return good.unionByName(failed, allowMissingColumns=True)


def benchmark(pool: DataFrame, predictions: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    """EVL-32: a whole comparison: the pool's comparable complete years overall, by entity and by wins, and all that was attempted."""
    attempted = predictions.join(pool.select(ID).distinct(), ID, "left_semi")
    exact = complete_years(comparable_cohort(attempted, models))
    by_stock = accuracy(exact, "model", ID)
    return {"overall": accuracy(exact, "model"), "stocks": by_stock, "winners": winners(by_stock), "all_attempted": accuracy(attempted, "model")}


def entity_results(annual: DataFrame, eps: DataFrame, actual_eps: DataFrame, dividend: DataFrame, bases: DataFrame, price: DataFrame) -> DataFrame:
    """EVL-29: errors of revenue, EPS, dividend on two bases (cash of the year's ex-dates, and of the fiscal year) and yield for each entity.

    ``annual`` as of annual_with_actuals, ``eps``: model, stock_id, estimated_eps; ``actual_eps``: stock_id, actual_eps; ``dividend``: model,
    stock_id, estimated_cash_dividend; ``bases`` as of dual_basis_dividends; ``price``: stock_id, stock_price.
    """
    rows = annual.join(eps, ["model", ID], "left").join(actual_eps, ID, "left").join(dividend, ["model", ID], "left").join(bases, ID, "left").join(price, ID, "left")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    percent = lambda c: ratio(F.col(c), F.col("stock_price")) * 100
    return rows.withColumns({
        "revenue_abs_percent_error": ratio(gap("predicted_annual_revenue", "actual_annual_revenue"), F.abs("actual_annual_revenue")) * 100, "eps_abs_error": gap("estimated_eps", "actual_eps"),
        "ex_year_dividend_abs_error": gap("estimated_cash_dividend", "ex_year_cash_dividend"), "fiscal_dividend_abs_error": gap("estimated_cash_dividend", "fiscal_cash_dividend"),
        "yield_abs_error": F.abs(percent("estimated_cash_dividend") - percent("ex_year_cash_dividend")),
    })


def results_overall(rows: DataFrame, *groups: str) -> DataFrame:
    """EVL-29: the entities' mean errors."""
    names = ("revenue_abs_percent_error", "eps_abs_error", "ex_year_dividend_abs_error", "fiscal_dividend_abs_error", "yield_abs_error")
    return rows.groupBy(*groups).agg(F.count("*").alias("stocks"), *[F.avg(c).alias(c) for c in names])


def fold_errors(estimates: DataFrame, actuals: DataFrame) -> DataFrame:
    """EVL-34: absolute dividend errors of methods in each fold; an entity without a dividend paid nothing. Keys: stock_id, target_year."""
    rows = estimates.join(actuals, [ID, "target_year"], "left").withColumn("actual_cash_dividend", F.coalesce("actual_cash_dividend", F.lit(0.0)))
    return rows.withColumn("cash_dividend_abs_error", F.abs(F.col("estimated_cash_dividend") - F.col("actual_cash_dividend")))


def chosen_by_folds(errors: DataFrame, folds: list[int], bucket: str, method: str, least_folds: int, least_rows: int) -> DataFrame:
    """EVL-34, EVL-11, EVL-12: of each bucket the method of smallest mean error over the folds, the best of all buckets where it has too few folds or rows."""
    known = errors.where(F.col("target_year").isin(folds))
    overall = known.groupBy(method).agg(F.avg("cash_dividend_abs_error").alias("_e")).agg(F.min_by(method, F.struct("_e", method))).scalar()
    by = known.groupBy(bucket, method).agg(F.avg("cash_dividend_abs_error").alias("_e"), F.count_distinct("target_year").alias("_f"), F.count("*").alias("_n"))
    enough = (F.col("_f") >= least_folds) & (F.col("_n") >= least_rows)
    best = by.where(enough).groupBy(bucket).agg(F.min_by(method, F.struct("_e", method)).alias("_best"))
    rows = errors.select(bucket).distinct().join(best, bucket, "left").withColumn("_overall", overall)
    return rows.select(bucket, F.coalesce("_best", "_overall").alias(method), F.when(F.col("_best").isNull(), "global fallback").otherwise("bucket").alias("source"))


def monthly_against_direct(monthly: DataFrame, direct: DataFrame) -> DataFrame:
    """EVL-35: sums of monthly predictions against direct three-month predictions on the windows that both have, with the winner of each entity.

    Both: stock_id, month_index, predicted_3m; ``monthly`` has actual_3m too.
    """
    rows = monthly.select(ID, "month_index", "actual_3m", F.col("predicted_3m").alias("_m")).join(direct.select(ID, "month_index", F.col("predicted_3m").alias("_d")), [ID, "month_index"])
    error = lambda c: F.sum(F.abs(F.col(c) - F.col("actual_3m")))
    out = rows.groupBy(ID).agg(F.count("*").alias("windows"), (ratio(error("_m"), F.sum(F.abs("actual_3m"))) * 100).alias("monthly_WMAPE"), (ratio(error("_d"), F.sum(F.abs("actual_3m"))) * 100).alias("direct_WMAPE"))
    d = F.col("direct_WMAPE") - F.col("monthly_WMAPE")
    return out.withColumn("winner", F.when(d < 0, "direct").when(d > 0, "monthly").otherwise("tie"))


def ablation(rows: DataFrame, parts: dict[str, Column], base: str, predicted: str = "predicted_revenue") -> DataFrame:
    """EVL-31, EVL-30: predictions under a base and with one part of it changed at a time, each scored, with the change against the base.

    ``parts``: name to the predicted value; ``base`` names one of them. One pass: the parts are an array on each row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("experiment"), c.alias("_p")) for n, c in parts.items()]))
    out = accuracy(rows.withColumn("_x", each).select(*[c for c in rows.columns if c != predicted], "_x.experiment", F.col("_x._p").alias(predicted)), "experiment")
    mine = out.where(F.col("experiment") == base).select(F.col("WMAPE").alias("_w"))
    return out.withColumn("base_WMAPE", mine.scalar()).withColumn("WMAPE_change", F.col("WMAPE") - F.col("base_WMAPE"))
