"""Cohorts, selections, dedup, sampling and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators.asof import latest_known

KEYS = ("stock_id", "target_year", "target_month")


def comparable_cohort(predictions: DataFrame, required: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """JON-09, SET-02: rows whose key every required model has a prediction for."""
    rows = predictions.where(F.col("model").isin(required) & F.col("predicted_revenue").isNotNull())
    full = rows.groupBy(*keys).agg(F.count_distinct("model").alias("_n")).where(F.col("_n") == len(required)).select(*keys)
    return rows.join(full, list(keys), "left_semi")


def cohort_issues(predictions: DataFrame, required: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """JON-09 guards, SET-03: missing models, duplicate keys and conflicting actuals as rows."""
    spark = predictions.sparkSession
    wanted = spark.createDataFrame([(m,) for m in required], "model string")
    missing = wanted.join(predictions.select("model").distinct(), "model", "left_anti").select("model", F.lit("missing model").alias("issue"), F.lit(1).cast("long").alias("rows"))
    double = predictions.groupBy("model", *keys).count().where("count > 1").groupBy("model").agg(F.count("*").alias("rows")).select("model", F.lit("duplicate keys").alias("issue"), "rows")
    actuals = predictions.groupBy(*keys).agg((F.max("actual_revenue") - F.min("actual_revenue")).alias("_d")).where(F.abs("_d") > 1e-6).agg(F.count("*").alias("rows")).where("rows > 0")
    return missing.unionByName(double).unionByName(actuals.select(F.lit("*").alias("model"), F.lit("conflicting actuals").alias("issue"), "rows"))


def method_cohort(rows: DataFrame, identity: list[str], method: str, valid: Column, methods: list[str]) -> DataFrame:
    """JON-10: identities that are valid under every method."""
    good = rows.where(valid & F.col(method).isin(methods)).groupBy(*identity).agg(F.count_distinct(method).alias("_n")).where(F.col("_n") == len(methods)).select(*identity)
    return rows.where(F.col(method).isin(methods)).join(good, identity, "left_semi")


def complete_years(predictions: DataFrame, months: int = 12) -> DataFrame:
    """JON-11: entities and models with all months."""
    keys = ["model", "stock_id", "target_year"]
    full = predictions.groupBy(*keys).agg(F.count_distinct("target_month").alias("_n")).where(F.col("_n") == months).select(*keys)
    return predictions.join(full, keys, "left_semi")


def attach_actuals(predictions: DataFrame, panel: DataFrame) -> DataFrame:
    """JON-07, JON-14: the actual of the target month and the value of the month before, from a panel without repeated keys."""
    facts = panel.select("stock_id", (F.col("revenue_year") * 12 + F.col("revenue_month") - 1).alias("_mi"), "revenue")
    rows = predictions.withColumn("_mi", F.col("target_year") * 12 + F.col("target_month") - 1)
    rows = rows.join(facts.withColumnRenamed("revenue", "actual_revenue"), ["stock_id", "_mi"], "left")
    before = facts.select("stock_id", (F.col("_mi") + 1).alias("_mi"), F.col("revenue").alias("last_observed_revenue"))
    return rows.join(before, ["stock_id", "_mi"], "left").drop("_mi")


def coalesce_labels(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JON-12: labels from two sources, the first one's where it has them."""
    other = second.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return first.select(key, *columns).join(other, key, "full").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def known_at(cutoffs: DataFrame, facts: DataFrame, keys: list[str], as_of: str, public: str, value: Column, name: str) -> DataFrame:
    """JON-06: for each row the newest fact that was public at the row's own cut-off date."""
    return latest_known(cutoffs, facts, keys, as_of, public, value, name)


def with_fallback(selection: DataFrame, rows: DataFrame, keys: list[str], column: str, default: str) -> DataFrame:
    """JON-16: the selected choice of each group, the default with a reason where there is none."""
    out = rows.join(selection.select(*keys, F.col(column).alias("_s")), keys, "left")
    return out.withColumns({column: F.coalesce("_s", F.lit(default)), "selection_reason": F.when(F.col("_s").isNull(), "default").otherwise("selected")}).drop("_s")


def members(rows: DataFrame, ids: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """JON-17, SRC-09, SRC-18: rows whose key is (or is not) in a list."""
    return rows.join(ids.select(*keys).distinct(), keys, "left_semi" if inside else "left_anti")


def keep_last(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """SRT-01, SRC-02: the newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_and_worst(rows: DataFrame, group: str, metric: str, key: str, n: int = 10) -> DataFrame:
    """SRT-03: the ``n`` smallest and largest of each group, ties by key."""
    up, down = Window.partitionBy(group).orderBy(metric, key), Window.partitionBy(group).orderBy(F.desc(metric), key)
    out = rows.where(F.col(metric).isNotNull()).withColumns({"rank_best": F.row_number().over(up), "rank_worst": F.row_number().over(down)})
    return out.where((F.col("rank_best") <= n) | (F.col("rank_worst") <= n))


def leaders(rows: DataFrame, column: str, key: str, n: int, largest: bool = True) -> DataFrame:
    """SRT-04: the top rows of a report."""
    return rows.where(F.col(column).isNotNull()).orderBy(F.desc(column) if largest else F.asc(column), key).limit(n)


def first_by_preference(rows: DataFrame, keys: list[str], preferences: list[Column], *order: str) -> DataFrame:
    """SRT-05: of each key the row that meets the earliest preference, ties by order."""
    rank = F.lit(len(preferences))
    for k in range(len(preferences) - 1, -1, -1):
        rank = F.when(preferences[k], F.lit(k)).otherwise(rank)
    rows = rows.withColumn("_p", rank)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_p", *order))).where("_n = 1").drop("_n", "_p")


def _mark(keys: list[str], seed: int) -> Column:
    """A hash of the keys' text that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary"))


def fixed_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """SRT-06: the same ``n`` rows every time: those of smallest hash."""
    return rows.orderBy(_mark(keys, seed), *keys).limit(n)


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """SRT-07: one of each group in turn until there are ``n``."""
    w = Window.partitionBy(group).orderBy(_mark([key], seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).orderBy("_n", group).limit(n).drop("_n")


def forward_split(rows: DataFrame, year: str, keys: list[str], n: int, share: float = 0.2, seed: int = 42) -> DataFrame:
    """SRT-08: the latest year is held out; each side is a fixed sample of its part of the budget."""
    last = F.broadcast(rows.agg(F.max(year).alias("_last")))
    marked = rows.join(last, F.col(year) == F.col("_last"), "left").withColumn("is_validation", F.col("_last").isNotNull()).drop("_last")
    held = fixed_sample(marked.where("is_validation"), keys, int(n * share), seed)
    return held.unionByName(fixed_sample(marked.where("not is_validation"), keys, n - int(n * share), seed))


def best_per(rows: DataFrame, group: str, metric: str, *ties: str) -> DataFrame:
    """SRT-09, EVL-11: the row of the smallest metric in each group."""
    w = Window.partitionBy(group).orderBy(F.col(metric).asc_nulls_last(), *ties)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def to_long(rows: DataFrame, keys: list[str], models: dict[str, str], value: str = "predicted_revenue") -> DataFrame:
    """SET-04: columns of models as rows; ``models``: column to model name."""
    out = rows.select(*keys, *[F.col(c).alias(m) for c, m in models.items()])
    return out.unpivot(keys, list(models.values()), "model", value)


def to_wide(rows: DataFrame, keys: list[str], names: str, values: list, metric: str) -> DataFrame:
    """SET-05: rows of models as columns."""
    return rows.groupBy(*keys).pivot(names, values).agg(F.first(metric))


def ratio_stability(history: DataFrame) -> DataFrame:
    """WIN-20: mean, median, spread and drift of an entity's EPS/revenue ratio; the latest against the median of the last three years."""
    newest = Window.partitionBy("stock_id").orderBy(F.desc("revenue_year"))
    rows = history.withColumn("_n", F.row_number().over(newest))
    rows = rows.withColumn("_change", F.abs(F.col("eps_to_revenue_ratio") - F.lag("eps_to_revenue_ratio").over(Window.partitionBy("stock_id").orderBy("revenue_year"))))
    out = rows.groupBy("stock_id").agg(
        F.count("*").alias("ratio_count"), F.avg("eps_to_revenue_ratio").alias("ratio_mean"), F.percentile("eps_to_revenue_ratio", 0.5).alias("ratio_median"),
        F.stddev_pop("eps_to_revenue_ratio").alias("ratio_std"), F.max(F.when(F.col("_n") == 1, F.col("eps_to_revenue_ratio"))).alias("latest_ratio"),
        F.percentile(F.when(F.col("_n") <= 3, F.col("eps_to_revenue_ratio")), 0.5).alias("recent_median"), F.max("_change").alias("max_abs_change"),
    )
    drift = F.when(F.abs("recent_median") > 1e-12, F.abs(F.col("latest_ratio") - F.col("recent_median")) / F.abs("recent_median") * 100)
    return out.withColumns({"ratio_std_to_median": F.when(F.abs("ratio_median") > 1e-12, F.abs(F.col("ratio_std") / F.col("ratio_median"))), "latest_deviation_percent": drift})


def stability_bucket(rows: DataFrame) -> DataFrame:
    """EVL-16: how far the ratio of an entity can be trusted."""
    cv, drift = F.col("ratio_std_to_median"), F.coalesce("latest_deviation_percent", F.lit(0.0))
    bucket = F.when(F.col("ratio_count") < 3, "insufficient_history").when(cv.isNull(), "unstable_ratio").when((cv <= 0.35) & (drift <= 50), "stable_ratio").when((cv <= 1.0) & (drift <= 150), "moderate_ratio").otherwise("unstable_ratio")
    return rows.withColumn("ratio_stability_bucket", bucket)


def recommend_eps_path(rows: DataFrame) -> DataFrame:
    """EVL-16: which EPS method to go on with, from the errors best_current, best_seasonal and best_ml and the stability of the ratio."""
    inf = F.lit(float("inf"))
    c, s, m = (F.coalesce(F.col(n), inf) for n in ("best_current", "best_seasonal", "best_ml"))
    bucket = F.col("ratio_stability_bucket")
    path = (
        F.when((c == inf) & (s == inf) & (m == inf), "manual_review")
        .when((bucket == "stable_ratio") & (c <= F.least(s, m) * 1.10), "keep_current_ratio")
        .when(bucket == "insufficient_history", "manual_or_cross_sectional_ml")
        .when((s < c) & (s <= m) & (s <= F.least(c, m) * 0.90), "test_seasonal_quarter_ratio")
        .when((m < c) & (m < s) & (m <= F.least(c, s) * 0.90), "test_ml_eps_layer")
        .when(bucket == "unstable_ratio", "stock_specific_or_ml_eps_layer")
        .otherwise("stock_specific_validation")
    )
    return rows.withColumn("recommended_path", path)


def ratio_error_driver(rows: DataFrame) -> DataFrame:
    """EVL-16: what an error of the ratio method comes from, against the same method on actual revenue."""
    now, oracle, revenue = F.col("current_ratio_error"), F.col("oracle_error"), F.col("revenue_error_percent")
    driver = (
        F.when(now.isNull(), "missing_current_ratio_result").when(oracle.isNull(), "missing_oracle_diagnostic").when(now < oracle * 0.75, "forecast_error_offset_formula_error")
        .when(oracle >= now * 0.75, "eps_ratio_formula_error").when(revenue >= 20, "revenue_forecast_error").otherwise("mixed_error")
    )
    return rows.withColumn("error_driver", driver)


def treatment_effects(rows: DataFrame, baseline: str, keys: list[str], metric: str, name: str = "model") -> DataFrame:
    """EVL-02 to EVL-04, EVL-14: every variant's metric against the baseline's at the same keys, with the change in percent and the winner."""
    base = rows.where(F.col(name) == baseline).select(*keys, F.col(metric).alias("baseline_value"))
    d = F.col(metric) - F.col("baseline_value")
    out = rows.where(F.col(name) != baseline).join(base, keys) if keys else rows.where(F.col(name) != baseline).join(F.broadcast(base.limit(1)))
    return out.select(*keys, name, F.col(metric).alias("value"), "baseline_value", d.alias("delta"), (ratio(d, F.col("baseline_value")) * 100).alias("change_percent"), F.when(d < 0, F.col(name)).when(d > 0, F.lit(baseline)).otherwise("tie").alias("winner"))


def strategy_rows(test: DataFrame, fixed: str, own: DataFrame, by_bucket: DataFrame, metric: str) -> DataFrame:
    """EVL-13: test rows under four strategies: one fixed method, the entity's choice, its bucket's choice, and the best in hindsight (marked)."""
    mark = lambda rows, s, late: rows.withColumns({"strategy": F.lit(s), "is_hindsight": F.lit(late)})
    chosen = test.join(own.select("stock_id", F.col("method").alias("_m")), "stock_id").where("method = _m").drop("_m")
    bucket = test.join(by_bucket.select("bucket", F.col("method").alias("_m")), "bucket").where("method = _m").drop("_m")
    best = best_per(test.where(F.col(metric).isNotNull()), "stock_id", metric, "method")
    parts = [mark(test.where(F.col("method") == fixed), "fixed", False), mark(chosen, "entity", False), mark(bucket, "bucket", False), mark(best, "hindsight", True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_by_bucket(scores: DataFrame, global_method: str, metric: str = "mean_error", least_rows: int = 5) -> DataFrame:
    """EVL-12: the best method of each bucket where it has support, the global one elsewhere."""
    best = best_per(scores.where(F.col("rows") >= least_rows), "bucket", metric, "method").select("bucket", F.col("method").alias("_m"))
    return scores.select("bucket").distinct().join(best, "bucket", "left").select("bucket", F.coalesce("_m", F.lit(global_method)).alias("method"), F.when(F.col("_m").isNull(), "global fallback").otherwise("bucket").alias("source"))


def select_threshold(scores: DataFrame, metric: str) -> DataFrame:
    """EVL-09: the threshold of the smallest metric, ties to the higher one."""
    return scores.where(F.col(metric).isNotNull()).orderBy(metric, F.desc("threshold")).limit(1)


def fallback_choice(validation: DataFrame, plain: str, adjusted: str, metric: str = "WMAPE", least_gain: float = 0.0) -> DataFrame:
    """EVL-10: the adjusted model for entities where it gains more than ``least_gain`` on validation, the plain one elsewhere."""
    wide = to_wide(validation.where(F.col("model").isin(plain, adjusted)), ["stock_id"], "model", [plain, adjusted], metric)
    gain = F.col(plain) - F.col(adjusted)
    return wide.select("stock_id", F.when(gain > least_gain, adjusted).otherwise(plain).alias("selected_model"), gain.alias("improvement"), F.when(gain.isNull(), "no validation").when(gain > least_gain, "improved").otherwise("not improved").alias("selection_reason"))


def error_comparison(candidate: DataFrame, baseline: DataFrame, metric: str, tolerance: float = 1e-9) -> DataFrame:
    """EVL-22, EVL-20: improved, worse, tied or missing for each entity, with the change in percent."""
    rows = candidate.select("stock_id", F.col(metric).alias("candidate_error")).join(baseline.select("stock_id", F.col(metric).alias("baseline_error")), "stock_id", "full")
    d = F.col("candidate_error") - F.col("baseline_error")
    return rows.withColumns({"outcome": F.when(d.isNull(), "missing").when(d < -tolerance, "improved").when(d > tolerance, "worse").otherwise("tied"), "change_percent": ratio(d, F.col("baseline_error")) * 100})


def paid_outcomes(estimates: DataFrame) -> DataFrame:
    """EVL-23: true and false positives and negatives of paying a dividend at all."""
    actual, said = F.col("actual_cash_dividend") > 0, F.col("estimated_cash_dividend") > 0
    outcome = F.when(actual.isNull() | said.isNull(), "unknown").when(actual & said, "true_positive").when(~actual & said, "false_positive").when(actual & ~said, "false_negative").otherwise("true_negative")
    return estimates.withColumn("outcome", outcome)


def underestimate_risk(stock_accuracy: DataFrame) -> DataFrame:
    """EVL-25: a score from how often and how far an entity is underestimated, and its level."""
    score = F.col("UnderestimateRate") * 0.7 + F.least(F.greatest(-ratio(F.col("Bias"), F.col("MAE")), F.lit(0.0)), F.lit(1.0)) * 30
    rows = stock_accuracy.withColumn("risk_score", score)
    return rows.withColumn("risk_level", F.when(F.col("risk_score") >= 70, "high").when(F.col("risk_score") >= 45, "medium").otherwise("low"))
