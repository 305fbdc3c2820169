"""Forecasts from windows of consecutive months: heads for growth clusters, direct targets of several months, trend and cycle parts, and their assembly."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import level_of, log_level
from tidemark.operators.calendar import ID, MONTH, VALUE, YEAR, by_segment, growth_features, growth_windows, sequence_samples, with_segments
from tidemark.operators.forecast import adjust_for_growth, growth_signal, guardrail, recombine_trend_cycle, tuned_formula
from tidemark.operators.learned import growth_clusters
from tidemark.operators.metrics import accuracy
from tidemark.sources.artifacts import settled


@dataclass(frozen=True)
class Line:
    """A fitted plane over two predictors."""

    base: float
    first: float
    second: float

    def at(self, x: Column, y: Column) -> Column:
        return self.base + self.first * x + self.second * y


def pooled_fit(rows: DataFrame, label: str, first: str, second: str) -> Line:
    """Least squares of ``label`` on two predictors over all rows that have the three: one aggregation, partial sums in the tasks.

    Predictors that vary together (or not at all) leave the second out; without rows everything is 0.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull())
    pairs = {"aa": (first, first), "bb": (second, second), "ab": (first, second), "ay": (first, label), "by": (second, label)}
    means = {"a": first, "b": second, "y": label}
    m = known.agg(*[F.avg(c).alias(k) for k, c in means.items()], *[F.covar_pop(*c).alias(k) for k, c in pairs.items()]).first()
    if m["y"] is None:
        return Line(0.0, 0.0, 0.0)
    whole = m["aa"] * m["bb"] - m["ab"] ** 2
    if whole > 1e-9 * m["aa"] * m["bb"]:
        one, two = (m["ay"] * m["bb"] - m["by"] * m["ab"]) / whole, (m["by"] * m["aa"] - m["ay"] * m["ab"]) / whole
    else:
        one, two = (m["ay"] / m["aa"] if m["aa"] > 0 else 0.0), 0.0
    return Line(m["y"] - one * m["a"] - two * m["b"], one, two)


def direct_horizon_forecast(panel: DataFrame, target_year: int, horizon: int = 3, months: int = 12) -> DataFrame:
    """EVL-35: sums of the next ``horizon`` months predicted at once, by a pooled fit in logs on the last ``horizon`` months and the same ones a year before.

    It learns from windows whose whole target lies before the target year. ``month_index`` is the first month of the target.
    """
    if horizon > months:
        raise ValueError("a window must hold the same months of the year before")
    rows = sequence_samples(panel, months, horizon)
    ago = F.aggregate(F.slice("inputs", months - 12 + 1, horizon) if months >= 12 else F.lit(None).cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumns({"_y": log_level(F.col("target")), "_last": log_level(F.col("trailing_sum")), "_ago": log_level(ago)})
    line = pooled_fit(rows.where(F.col("target_index") + horizon - 1 < target_year * 12), "_y", "_last", "_ago")
    out = rows.where(F.col("target_year") == target_year)
    return out.select(ID, F.col("target_index").alias("month_index"), level_of(line.at(F.col("_last"), F.col("_ago"))).alias("predicted_3m" if horizon == 3 else f"predicted_{horizon}m"), F.col("target").alias("actual_sum"))


def _clipped_level(prediction: Column, mean: float | None, sd: float | None) -> Column:
    """A predicted log level held within four deviations of the training target, as a level."""
    low, high = (F.lit((mean or 0.0) + side * 4 * (sd or 0.0)) for side in (-1, 1))
    return level_of(F.least(F.greatest(prediction, low), high))


def window_clusters(panel: DataFrame, k: int, train_end_year: int) -> DataFrame:
    """(stock_id, month_index, cluster): the growth cluster of the twelve months up to each month, by centres of the training years; -1 where the window is not full."""
    rows = growth_clusters(panel, k, train_end_year)
    return rows.select(ID, (F.col(YEAR) * 12 + F.col(MONTH) - 1).alias("month_index"), "cluster")


def clustered_windows(panel: DataFrame, train_end_year: int, k: int = 5, months: int = 12, clusters: DataFrame | None = None) -> DataFrame:
    """Windows of ``months`` months with the month after them and the growth cluster of their last month, as a written table: fits read it several times."""
    panel = settled(panel, "panel") if clusters is None else panel
    samples = sequence_samples(panel, months)
    clusters = window_clusters(panel, k, train_end_year) if clusters is None else clusters
    rows = samples.join(clusters.select(ID, "month_index", "cluster"), [ID, "month_index"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return settled(rows.select(ID, "target_year", "target_index", "cluster", "inputs", "target", "window_max"), "clustered-windows")


def conditioned_sequence_regression(panel: DataFrame, train_end_year: int, target_year: int, k: int = 5, months: int = 12, clusters: DataFrame | None = None, strength: float = 0.01) -> DataFrame:
    """FC-14, FC-13: windows of log levels to the next month's, with a head for each growth cluster in one fit.

    The design holds the standardised window once for all clusters and once more for the window's own cluster (products with its one-hot
    place), so the ridge shares what clusters have in common and learns what they do not. A window's cluster is that of its
    last month, found with centres of the training years: nothing of the target month enters it. ``clusters`` may bring others.
    """
    return conditioned_heads(clustered_windows(panel, train_end_year, k, months, clusters), train_end_year, target_year, k, months, strength)


def conditioned_heads(windows: DataFrame, train_end_year: int, target_year: int, k: int = 5, months: int = 12, strength: float = 0.01) -> DataFrame:
    """FC-14 on the rows of :func:`clustered_windows`."""
    rows = windows.withColumn("x", array_to_vector(F.transform("inputs", lambda v: F.log1p(F.greatest(v, F.lit(0.0)))))).withColumn("y", log_level(F.col("target")))
    train = rows.where(F.col("target_year") <= train_end_year)
    scale = StandardScaler(inputCol="x", outputCol="_z", withMean=True).fit(train)

    def designed(part: DataFrame) -> DataFrame:
        z = vector_to_array(F.col("_z"))
        own = lambda c: F.when(F.col("cluster") == c, F.concat(F.array(F.lit(1.0)), z)).otherwise(F.array_repeat(F.lit(0.0), months + 1))
        return scale.transform(part).withColumn("features", array_to_vector(F.flatten(F.array(z, *[own(c) for c in range(-1, k)]))))

    model = LinearRegression(labelCol="y", regParam=strength, standardization=False).fit(designed(train))
    mean, sd = train.agg(F.avg("y"), F.stddev_pop("y")).first()
    out = model.transform(designed(rows.where(F.col("target_year") == target_year)))
    return out.select(ID, "target_year", (F.col("target_index") % 12 + 1).cast("int").alias("target_month"), "cluster", _clipped_level(F.col("prediction"), mean, sd).alias("predicted_revenue"), F.col("target").alias("actual_revenue"), F.element_at("inputs", -1).alias("last_observed_revenue"), "window_max")


def trend_cycle_forecasts(panel: DataFrame, train_end_year: int, target_year: int) -> DataFrame:
    """FC-15: the two parts of each month predicted from the months before it, by pooled fits over the training years.

    The trend (mean of twelve months) follows from the last trend and its slope over three months, the cycle (what is left) from the last
    cycle and that of the same month last year (learnt where both years have whole trends). Columns: keys, trend_prediction, cycle_prediction, trend_slope_rate and cycle_volatility_6m of
    the month before.
    """
    w = by_segment()
    lag = lambda c, k=1: F.lag(c, k).over(w)
    rows = growth_features(panel).withColumns({"_trend": lag("trend_component"), "_slope": lag("trend_slope"), "_cycle": lag("cycle_component"), "_cycle_ago": lag("cycle_component", 12), "_rate": lag("trend_slope_rate"), "_volatility": lag("cycle_volatility_6m")})
    train = rows.where(F.col(YEAR) <= train_end_year)
    trend, cycle = pooled_fit(train, "trend_component", "_trend", "_slope"), pooled_fit(train.where("consecutive_months >= 24"), "cycle_component", "_cycle", "_cycle_ago")
    out = rows.where((F.col(YEAR) == target_year) & F.col("_trend").isNotNull() & F.col("_cycle_ago").isNotNull())
    return out.select(ID, "month_index", F.greatest(trend.at(F.col("_trend"), F.col("_slope")), F.lit(0.0)).alias("trend_prediction"), cycle.at(F.col("_cycle"), F.col("_cycle_ago")).alias("cycle_prediction"), F.col("_rate").alias("trend_slope_rate"), F.col("_volatility").alias("cycle_volatility_6m"))


def month_before(panel: DataFrame) -> DataFrame:
    """Growth signal, regime and largest value of the twelve months before each month, by ``month_index`` of that month."""
    rows = growth_signal(growth_windows(panel)).select(ID, (F.col("month_index") + 1).alias("month_index"), "growth_signal", "regime", "growth_phase", "high_growth", "growth_rate", "growth_ratio", "growth_streak")
    top = with_segments(panel).select(ID, (F.col("month_index") + 1).alias("month_index"), F.max(VALUE).over(by_segment().rowsBetween(-11, 0)).alias("window_max"))
    return rows.join(top, [ID, "month_index"])


def assembled_forecast(rows: DataFrame, alpha: float = 0.8, conditional: bool = True, by_regime: bool = True, slope_beta: float = 0.35) -> DataFrame:
    """FC-19: a raw prediction through the guardrail, the trend and cycle parts in the cycle regime (where rows have them), the growth adjustment, and the guardrail again.

    ``rows``: predicted_revenue, last_observed_revenue, window_max and the growth columns of the month before, and for FC-15
    trend_prediction, cycle_prediction, trend_slope_rate, cycle_volatility_6m. Every stage stays as a column, with what it did.
    """
    out = guardrail(rows.withColumn("raw_revenue", F.col("predicted_revenue"))).withColumnsRenamed({"clipped": "clipped_before", "prediction_cap": "_cap"})
    out = out.withColumn("guarded_revenue", F.col("predicted_revenue"))
    if {"trend_prediction", "cycle_prediction"} <= set(rows.columns):
        parts = F.col("trend_prediction").isNotNull() & F.col("cycle_prediction").isNotNull()
        out = recombine_trend_cycle(out, slope_beta).withColumn("predicted_revenue", F.when(parts, F.col("predicted_revenue")).otherwise(F.col("guarded_revenue")))
    out = out.withColumn("recombined_revenue", F.col("predicted_revenue"))
    out = adjust_for_growth(out, alpha, conditional, by_regime).withColumn("adjusted_revenue", F.col("predicted_revenue"))
    return guardrail(out).withColumnRenamed("clipped", "clipped_after").drop("_cap")


def growth_adjusted_value(p: Column, alpha: float, conditional: bool = True, by_regime: bool = True) -> Column:
    """FC-18 as one expression of a prediction: a boost by the growth signal of the month before, and by regime the last month as a cap in declines."""
    positive, last = F.greatest(F.col("growth_signal"), F.lit(0.0)), F.col("last_observed_revenue")
    allowed = (F.col("growth_rate") > 0) & (positive > 0)
    allowed = allowed & (F.col("regime") == "growth") if by_regime else allowed
    allowed = allowed & F.col("growth_phase") if conditional else allowed
    boosted = F.when(allowed, p * (1 + alpha * positive)).otherwise(p)
    return F.when(F.col("regime") == "decline", F.least(boosted, last)).otherwise(boosted) if by_regime else boosted


def adjustment_axes(rows: DataFrame, alphas: tuple[float, ...] = (0.0, 0.4, 0.8)) -> DataFrame:
    """EVL-05, EVL-04: every combination of strength, condition, regime and components of the adjustment, scored on the same months.

    ``rows``: as for :func:`assembled_forecast`, with actual_revenue and mase_scale. One pass: the variants of a month are an array on its row.
    ``WMAPE_change`` is against the plain prediction (no strength, regime or components), ``winner`` says which of both does better.
    """
    parts = recombine_trend_cycle(rows.withColumn("_plain", F.col("predicted_revenue")).withColumn("predicted_revenue", F.lit(None).cast("double"))).withColumnRenamed("predicted_revenue", "_parts")
    axes = list(product(alphas, (False, True), (False, True), (False, True)))

    def value(alpha: float, conditional: bool, by_regime: bool, components: bool) -> Column:
        p = F.coalesce(F.col("_parts"), F.col("_plain")) if components else F.col("_plain")
        return growth_adjusted_value(p, alpha, conditional, by_regime)

    names = ("alpha", "conditional", "by_regime", "components")
    variants = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v, strict=True)], value(*v).alias("predicted_revenue")) for v in axes]
    each = parts.withColumn("_v", F.explode(F.array(*variants))).select(ID, "month_index", "actual_revenue", "last_observed_revenue", "_v.*")
    out = accuracy(each, *names)
    plain = out.where((F.col("alpha") == 0) & ~F.col("conditional") & ~F.col("by_regime") & ~F.col("components")).select("WMAPE")
    is_plain = (F.col("alpha") == 0) & ~F.col("by_regime") & ~F.col("components")
    change = F.when(is_plain, 0.0).otherwise(F.col("WMAPE") - plain.scalar())
    return out.withColumn("WMAPE_change", change).withColumn("winner", F.when(F.col("WMAPE_change") < 0, "variant").when(F.col("WMAPE_change") > 0, "plain").otherwise("tie"))


def scenario_grid(panel: DataFrame, configs: DataFrame, target_year: int, alpha: float = 0.8) -> DataFrame:
    """EVL-30: growth adjustment by trend and cycle parts by settings tuned for each entity, on and off: eight scenarios scored on the same months.

    Everything is learnt before the target year: settings on the year before it, the parts on the years up to that. One pass: a month's
    scenarios are an array on its row. ``improvement`` is the WMAPE of the scenario with everything off less the scenario's.
    """
    panel = settled(panel, "panel")
    base = tuned_formula(panel, configs, target_year - 1, target_year)
    rows = base.join(month_before(panel), [ID, "month_index"]).join(trend_cycle_forecasts(panel, target_year - 1, target_year), [ID, "month_index"])
    # The spread of the cycles, the scores and the scenario that all are compared with read these rows each.
    rows = settled(rows, "scenario-months")
    rows = recombine_trend_cycle(rows.withColumnsRenamed({"predicted_revenue": "_tuned"}).withColumn("predicted_revenue", F.lit(None).cast("double"))).withColumnRenamed("predicted_revenue", "_parts")

    def value(growth: bool, parts: bool, tuned: bool) -> Column:
        p = F.col("_tuned" if tuned else "untuned_revenue")
        p = F.coalesce(F.col("_parts"), p) if parts else p
        return growth_adjusted_value(p, alpha) if growth else p

    scenarios = [F.struct(*[F.lit(on).alias(n) for n, on in zip(("growth", "trend_cycle", "auto_tune"), s, strict=True)], value(*s).alias("predicted_revenue")) for s in product((False, True), repeat=3)]
    each = rows.withColumn("_s", F.explode(F.array(*scenarios))).select(ID, "month_index", "actual_revenue", "last_observed_revenue", "_s.*")
    out = settled(accuracy(each, "growth", "trend_cycle", "auto_tune"), "scenario-scores")
    plain = ~(F.col("growth") | F.col("trend_cycle") | F.col("auto_tune"))
    off = out.where(plain).select("WMAPE")
    return out.withColumn("improvement", F.when(plain, 0.0).otherwise(off.scalar() - F.col("WMAPE")))


def plain_and_conditioned(panel: DataFrame, train_end_year: int, target_year: int, k: int = 5) -> DataFrame:
    """FC-14: errors of windows with heads for clusters and without, by the cluster that each window was in, on the same months."""
    windows = clustered_windows(panel, train_end_year, k)
    heads = conditioned_heads(windows, train_end_year, target_year, k)
    shared = conditioned_heads(windows.withColumn("cluster", F.lit(-1)), train_end_year, target_year, 0)
    rows = heads.join(shared.select(ID, "target_year", "target_month", F.col("predicted_revenue").alias("_shared")), [ID, "target_year", "target_month"])
    error = lambda c: F.sum(F.abs(F.col(c) - F.col("actual_revenue"))) / F.sum(F.abs("actual_revenue")) * 100
    return rows.groupBy("cluster").agg(F.count("*").alias("months"), F.count_distinct(ID).alias("stocks"), error("predicted_revenue").alias("conditioned_WMAPE"), error("_shared").alias("shared_WMAPE"))

