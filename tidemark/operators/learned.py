"""Model-backed forecasts on Spark ML: pooled over all entities, with forward-year validation and fixed seeds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import level_of, log_level
from tidemark.operators.calendar import ID, MONTH, VALUE, YEAR, growth_windows, sequence_samples, with_segments
from tidemark.sources.artifacts import settled

SEED = 42


def growth_clusters(panel: DataFrame, k: int = 5, train_end_year: int = 1999) -> DataFrame:
    """FC-13: k-means over twelve-month growth vectors, fitted on years up to ``train_end_year``; months without a full window are -1."""
    windows = growth_windows(panel).select(ID, YEAR, MONTH, "growth_ratio", "growth_streak", "growth_vector", array_to_vector(F.col("growth_vector").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(windows.where(F.col(YEAR) <= train_end_year))
    found = model.transform(windows).drop("features")
    return panel.join(found, [ID, YEAR, MONTH], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def elbow(panel: DataFrame, ks: tuple[int, ...] = (4, 5, 6, 7, 8), train_end_year: int = 1999) -> list[tuple[int, float]]:
    """FC-13: the training cost of each number of clusters."""
    windows = growth_windows(panel).where(F.col(YEAR) <= train_end_year).select(array_to_vector(F.col("growth_vector").cast("array<double>")).alias("features")).cache()
    out = [(k, KMeans(k=k, seed=SEED).fit(windows).summary.trainingCost) for k in ks]
    windows.unpersist()
    return out


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """AGG-17: size and means of each cluster, the mean of each place of its vectors, these as 0 and 1, and its kind; ``growth_vector`` is in the rows."""
    known = clustered.where("cluster >= 0")
    places = known.select("cluster", F.posexplode("growth_vector").alias("place", "up")).groupBy("cluster", "place").agg(F.avg("up").alias("mean"))
    vectors = places.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", F.round("mean", 3).alias("mean"), (F.col("mean") >= 0.5).cast("int").cast("string").alias("bit")))).alias("_v"))
    vectors = vectors.select("cluster", F.transform("_v", lambda x: x["mean"]).alias("vector_means"), F.concat_ws("", F.transform("_v", lambda x: x["bit"])).alias("pattern"))
    rows = known.groupBy("cluster").agg(F.count("*").alias("windows"), F.count_distinct(ID).alias("stocks"), F.avg("growth_ratio").alias("growth_ratio"), F.avg("growth_streak").alias("growth_streak"))
    kind = F.when(F.col("growth_ratio") >= 0.70, "consistent_growth").when(F.col("growth_ratio") >= 0.55, "growth_bias").when(F.col("growth_ratio") >= 0.40, "mixed_or_turnaround").otherwise("decline_bias")
    return rows.join(vectors, "cluster").withColumn("cluster_type", kind)


def cluster_effects(rows: DataFrame) -> DataFrame:
    """AGG-18: what adjustment does in each cluster.

    ``rows``: cluster, actual_revenue, plain_revenue, adjusted_revenue, regime, growth_phase, high_growth, growth_signal, adjustment_applied, decline_capped.
    """
    error = lambda c: F.avg(F.abs(F.col(c) - F.col("actual_revenue")))
    return rows.groupBy("cluster").agg(
        F.count("*").alias("months"), error("plain_revenue").alias("plain_mae"), error("adjusted_revenue").alias("adjusted_mae"), (error("plain_revenue") - error("adjusted_revenue")).alias("improvement"),
        F.avg("actual_revenue").alias("mean_actual"), F.count_if("high_growth").alias("high_growth_months"), F.count_if("growth_phase").alias("growth_phase_months"), F.count_if("adjustment_applied").alias("adjusted_months"),
        F.count_if("decline_capped").alias("capped_months"), F.count_if(F.col("regime") == "cycle").alias("cycle_months"), F.count_if(F.col("regime") == "decline").alias("decline_months"),
        F.avg("growth_signal").alias("mean_growth_signal"), F.avg(F.try_divide(F.col("adjusted_revenue"), F.col("plain_revenue"))).alias("mean_adjustment_ratio"),
    )


def yearly_samples(panel: DataFrame) -> DataFrame:
    """Features of a month and its level a year later, in logs."""
    rows = with_segments(panel).withColumn("log_revenue", log_level(F.col(VALUE)))
    w = Window.partitionBy(ID).orderBy("month_index")
    at = lambda k: F.first("log_revenue").over(w.rangeBetween(-k, -k))
    rows = rows.withColumns({"lag_1": at(1), "lag_3": at(3), "lag_12": at(12), "mean_12": F.avg("log_revenue").over(w.rangeBetween(-11, 0)), "target": at(-12), "month_sin": F.sin(F.col(MONTH) * 3.141592653589793 / 6), "month_cos": F.cos(F.col(MONTH) * 3.141592653589793 / 6)})
    return rows.withColumn("target_year", F.col(YEAR) + 1)


TREE_FEATURES = ["log_revenue", "lag_1", "lag_3", "lag_12", "mean_12", "month_sin", "month_cos"]


def pooled_trees(panel: DataFrame, target_year: int, depths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """FC-02: one boosted-tree regression for all entities on the log level a year ahead; depth chosen on the year before."""
    # Every fit and score reads the samples.
    rows = settled(yearly_samples(panel).where(F.col("target_year") <= target_year).select(ID, "target_year", MONTH, "month_index", *TREE_FEATURES, "target"), "yearly-samples")
    steps = [Imputer(strategy="median", inputCols=TREE_FEATURES, outputCols=[f"{c}_f" for c in TREE_FEATURES]), VectorAssembler(inputCols=[f"{c}_f" for c in TREE_FEATURES], outputCol="features")]
    known = rows.where(F.col("target").isNotNull()).orderBy(ID, "month_index")
    fit = lambda depth, year: Pipeline(stages=[*steps, GBTRegressor(labelCol="target", maxDepth=depth, maxIter=20, stepSize=0.1, seed=SEED)]).fit(known.where(F.col("target_year") < year))
    scores = []
    for depth in depths:
        tried = fit(depth, target_year - 1).transform(known.where(F.col("target_year") == target_year - 1))
        scores.append((tried.agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0] or float("inf"), depth))
    best = fit(min(scores)[1], target_year)
    out = best.transform(rows.where(F.col("target_year") == target_year))
    return out.select(ID, "target_year", F.col(MONTH).alias("target_month"), level_of(F.col("prediction")).alias("predicted_revenue"))


def sequence_regression(panel: DataFrame, train_end_year: int, target_year: int, months: int = 12) -> DataFrame:
    """FC-14: standardised windows of log levels to the next month's, by ridge regression; clipped to four deviations of the training target."""
    rows = sequence_samples(panel, months).withColumn("x", array_to_vector(F.transform("inputs", lambda v: F.log1p(F.greatest(v, F.lit(0.0)))))).withColumn("y", log_level(F.col("target")))
    train = rows.where(F.col("target_year") <= train_end_year)
    model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="features", withMean=True), LinearRegression(labelCol="y", regParam=0.1)]).fit(train)
    mean, sd = train.agg(F.avg("y"), F.stddev_pop("y")).first()
    out = model.transform(rows.where(F.col("target_year") == target_year))
    clipped = F.least(F.greatest(F.col("prediction"), F.lit((mean or 0) - 4 * (sd or 0))), F.lit((mean or 0) + 4 * (sd or 0)))
    return out.select(ID, "target_year", (F.col("target_index") % 12 + 1).cast("int").alias("target_month"), level_of(clipped).alias("predicted_revenue"), F.col("target").alias("actual_revenue"), F.element_at("inputs", -1).alias("last_observed_revenue"), "window_max")


def lagged_annual(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN-16: (each year beside the entity's year before, with the change of the ratio; the last year of each entity under the same names)."""
    w = Window.partitionBy(ID).orderBy("revenue_year")
    rows = history.withColumns({"prev_revenue": F.lag("annual_revenue").over(w), "prev_eps": F.lag("annual_eps").over(w), "prev_ratio": F.lag("eps_to_revenue_ratio").over(w)})
    last = history.groupBy(ID).agg(*[F.max_by(c, "revenue_year").alias(n) for c, n in (("annual_revenue", "prev_revenue"), ("annual_eps", "prev_eps"), ("eps_to_revenue_ratio", "prev_ratio"))])
    return rows.withColumn("ratio_change", F.col("eps_to_revenue_ratio") - F.col("prev_ratio")), last


def eps_regression(history: DataFrame, annual: DataFrame, kind: str = "ridge") -> DataFrame:
    """EPS-04: regularised regression of annual EPS on revenue and the year before; medians for what is missing."""
    rows, last = lagged_annual(settled(history, "ratio-history"))
    target = annual.withColumnRenamed("predicted_annual_revenue", "annual_revenue").join(last, ID, "left")
    columns = ["annual_revenue", "prev_revenue", "prev_eps", "prev_ratio"]
    mix = {"ridge": 0.0, "elastic_net": 0.5, "lasso": 1.0}[kind]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=[f"{c}_f" for c in columns]), VectorAssembler(inputCols=[f"{c}_f" for c in columns], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(labelCol="annual_eps", regParam=0.1, elasticNetParam=mix)]
    model = Pipeline(stages=stages).fit(rows.where(F.col("prev_eps").isNotNull()).orderBy(ID, "revenue_year"))
    return model.transform(target).select("model", ID, "target_year", F.lit(kind).alias("eps_method"), F.col("prediction").alias("estimated_eps"))


HURDLE_FEATURES = ["last_known_cash_dividend", "recent_cash_dividend_median", "recent_cash_dividend_smoothed", "recent_paid_rate", "dividend_history_count", "latest_available_eps", "available_eps_ttm", "known_revenue_ltm"]
THRESHOLDS = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60)


def hurdle_dividends(samples: DataFrame, target_year: int, kind: str = "ridge", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """DIV-08, DIV-10: whether a dividend is paid (balanced logistic regression) times how much (regression of paid years), for each threshold.

    ``samples``: rows of time_safe_features, each seen from its own cut-off, with actual_cash_dividend (of years before ``target_year`` only
    those count as known). With one class only the probability is its share; without paid years the amount is 0, with few (under five) their mean.
    """
    rows = samples.na.fill(0.0, HURDLE_FEATURES).withColumn("paid", (F.col("actual_cash_dividend") > 0).cast("double"))
    rows = VectorAssembler(inputCols=HURDLE_FEATURES, outputCol="raw").transform(rows)
    train = rows.where((F.col("target_year") < target_year) & F.col("actual_cash_dividend").isNotNull())
    n, share, paid, mean = train.agg(F.count("*"), F.avg("paid"), F.count_if(F.col("paid") == 1), F.avg(F.when(F.col("paid") == 1, F.col("actual_cash_dividend")))).first()
    target, share, mix = rows.where(F.col("target_year") == target_year), share or 0.0, {"ridge": 0.0, "elastic_net": 0.5}[kind]
    if n:
        scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        train, target = scale.transform(train), scale.transform(target)
    if 0 < share < 1:
        weighted = train.withColumn("w", F.when(F.col("paid") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        target = LogisticRegression(labelCol="paid", weightCol="w", regParam=0.1, elasticNetParam=mix).fit(weighted).transform(target).withColumn("paid_probability", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    else:
        target = target.withColumn("paid_probability", F.lit(float(share)))
    if paid >= 5:
        target = LinearRegression(labelCol="actual_cash_dividend", regParam=0.1, elasticNetParam=mix).fit(train.where("paid = 1")).transform(target)
    else:
        target = target.withColumn("prediction", F.lit(float(mean or 0.0)))
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    out = target.select(ID, "target_year", "paid_probability", F.col("prediction").alias("_amount"), "actual_cash_dividend", grid.alias("threshold"))
    method = F.concat(F.lit(f"direct_hurdle_{kind}_t"), F.lpad(F.round(F.col("threshold") * 100).cast("int").cast("string"), 3, "0"))
    return out.withColumns({"dividend_method": method, "estimated_cash_dividend": F.when(F.col("paid_probability") >= F.col("threshold"), F.greatest("_amount", F.lit(0.0))).otherwise(0.0)}).drop("_amount")
