"""Forecast metrics as conditional aggregates: one pass for any grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio


def _errors(predicted: str, actual: str) -> tuple[Column, Column, Column, Column]:
    p, a = F.col(predicted), F.col(actual)
    error = p - a
    return p, a, error, F.when(a != 0, F.abs(error) / F.abs(a))


def metric_columns(predicted: str = "predicted_revenue", actual: str = "actual_revenue", last: str | None = "last_observed_revenue") -> list[Column]:
    """AGG-08: the metric vector of the rows that have prediction and actual (percentages in percent).

    Direction accuracy counts only rows with a last observed value.
    """
    p, a, error, ape = _errors(predicted, actual)
    size = F.abs(a) + F.abs(p)
    out = [
        F.count("*").alias("observations"),
        F.avg(error * error).alias("MSE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        (F.avg(ape) * 100).alias("MAPE"),
        (F.percentile(ape, 0.5) * 100).alias("MedianAPE"),
        (ratio(F.sum(F.abs(error)), F.sum(F.abs(a))) * 100).alias("WMAPE"),
        (F.avg(F.when(size != 0, 2 * F.abs(error) / size)) * 100).alias("SMAPE"),
        F.avg(error).alias("Bias"),
        (F.avg((p < a).cast("int")) * 100).alias("UnderestimateRate"),
    ]
    if last:
        now = F.col(last)
        out.append((F.avg(F.when(now.isNotNull(), (F.signum(p - now) == F.signum(a - now)).cast("int"))) * 100).alias("DirectionAccuracy"))
    return out


def scored(predictions: DataFrame, predicted: str = "predicted_revenue", actual: str = "actual_revenue") -> DataFrame:
    return predictions.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())


def accuracy(predictions: DataFrame, *groups: str, predicted: str = "predicted_revenue", last: str | None = "last_observed_revenue", strict: bool = False) -> DataFrame:
    """AGG-08: metrics by group; ``strict`` leaves out rows without a last observed value altogether."""
    rows = scored(predictions, predicted)
    if strict and last:
        rows = rows.where(F.col(last).isNotNull())
    return rows.groupBy(*groups).agg(*metric_columns(predicted, last=last))


def extended_accuracy(predictions: DataFrame, *groups: str, predicted: str = "predicted_revenue") -> DataFrame:
    """AGG-09: adds MASE, the 90th percentile of the percentage error and the number of entities."""
    _, _, error, ape = _errors(predicted, "actual_revenue")
    more = [
        (F.percentile(ape, 0.9) * 100).alias("P90APE"),
        F.avg(F.when(F.col("mase_scale") > 0, F.abs(error) / F.col("mase_scale"))).alias("MASE"),
        F.count_distinct("stock_id").alias("stock_count"),
    ]
    return scored(predictions, predicted).groupBy(*groups).agg(*metric_columns(predicted), *more)


def accuracy_by_levels(predictions: DataFrame, model: str, *levels: str, predicted: str = "predicted_revenue") -> DataFrame:
    """AGG-10: one scan for the model overall and for each level, by grouping sets; ``level`` names the grouping."""
    rows = scored(predictions, predicted)
    sets = [[F.col(model)], *[[F.col(model), F.col(c)] for c in levels]]
    out = rows.groupingSets(sets, F.col(model), *[F.col(c) for c in levels]).agg(*metric_columns(predicted), F.grouping_id().alias("_gid"))
    level = F.lit("overall")
    for k, c in enumerate(levels):
        # The bit of a column is 0 in the grouping that has it.
        all_off = (1 << len(levels)) - 1
        level = F.when(F.col("_gid") == (all_off & ~(1 << (len(levels) - 1 - k))), F.lit(c)).otherwise(level)
    key = F.coalesce(*[F.col(c).cast("string") for c in levels])
    return out.withColumns({"level": level, "group_key": key}).drop("_gid", *levels)


def balanced_score(predictions: DataFrame, *configs: str, predicted: str = "predicted_revenue") -> DataFrame:
    """AGG-28: half the pooled WMAPE and half the median of the entities' WMAPE, for each configuration."""
    _, a, error, _ = _errors(predicted, "actual_revenue")
    each = scored(predictions, predicted).groupBy(*configs, "stock_id").agg(F.sum(F.abs(error)).alias("_e"), F.sum(F.abs(a)).alias("_a"), F.count("*").alias("_n"))
    pooled = each.groupBy(*configs).agg(
        F.sum("_n").alias("observations"),
        (ratio(F.sum("_e"), F.sum("_a")) * 100).alias("WMAPE"),
        (F.percentile(ratio(F.col("_e"), F.col("_a")), 0.5) * 100).alias("median_stock_WMAPE"),
    )
    return pooled.withColumn("balanced_score", 0.5 * F.col("WMAPE") + 0.5 * F.col("median_stock_WMAPE"))


def balanced_scores(rows: DataFrame, name: str, predicted: dict[float, Column], *configs: str) -> DataFrame:
    """AGG-28 for several predictions of each row: as :func:`balanced_score` by ``configs`` and ``name``, which holds the keys of ``predicted``.

    Predictions are columns of sums and not rows, so a setting costs a row for each entity, and few groups have quantiles at a time. Rows that lie by
    entity already are summed where they are.
    """
    a = F.col("actual_revenue")
    known = rows.where(a.isNotNull())
    of = lambda c, p: F.sum(F.when(p.isNotNull(), c))
    sums = [s for k, p in enumerate(predicted.values()) for s in (of(F.abs(p - a), p).alias(f"_e{k}"), of(F.abs(a), p).alias(f"_a{k}"), F.count(p).alias(f"_n{k}"))]
    each = known.groupBy(*configs, "stock_id").agg(*sums)

    def scores(k: int) -> list[Column]:
        e, a = F.col(f"_e{k}"), F.col(f"_a{k}")
        return [F.sum(f"_n{k}").alias("observations"), (ratio(F.sum(e), F.sum(a)) * 100).alias("WMAPE"), (F.percentile(ratio(e, a), 0.5) * 100).alias("median_stock_WMAPE")]

    pooled = each.groupBy(*configs).agg(*[F.struct(F.lit(v).alias(name), *scores(k)).alias(f"_s{k}") for k, v in enumerate(predicted)])
    out = pooled.select(*configs, F.explode(F.array(*[f"_s{k}" for k in range(len(predicted))])).alias("_s")).select(*configs, "_s.*").where("observations > 0")
    return out.withColumn("balanced_score", 0.5 * F.col("WMAPE") + 0.5 * F.col("median_stock_WMAPE"))


#: Bounds between blocks of values in a search for quantiles.
QUANTILE_BLOCKS = 256


def exact_quantiles(rows: DataFrame, value: str, quantiles: tuple[float, ...], *groups: str, name: str = "quantiles") -> DataFrame:
    """The groups with ``name``, the interpolated quantiles of the known values as an array: exact, and no task holds a group.

    Equal values are counted first. Bounds from a sketch cut each group's values into blocks whose counts tell in which of them a rank
    lies; only these blocks are sorted, each apart. Groups of null are groups; a group without values has no row.
    """
    group = F.struct(*[F.col(c) for c in groups]) if groups else F.struct(F.lit(0).alias("all"))
    known = rows.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    counts = known.groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    cuts = F.array(*[F.lit(k / QUANTILE_BLOCKS) for k in range(1, QUANTILE_BLOCKS)])
    bounds = known.groupBy("_g").agg(F.array_distinct(F.percentile_approx("_v", cuts, 10 * QUANTILE_BLOCKS)).alias("_bounds"), F.count("*").alias("_total"))
    placed = counts.join(bounds, "_g").withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")
    blocks = placed.groupBy("_g", "_b").agg(F.sum("_n").alias("_in"), F.first("_total").alias("_total"))
    before = F.sum("_in").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_in")
    ends = [f((F.col("_total") - 1) * q).cast("long") for q in quantiles for f in (F.floor, F.ceil)]
    here = F.filter(F.array_distinct(F.array(*ends)), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")))
    sought = blocks.withColumn("_before", before).withColumn("_ranks", here).where(F.size("_ranks") > 0).select("_g", "_b", "_before", "_ranks")
    found = placed.join(sought, ["_g", "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    found = found.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))))
    # Two ranks for each quantile at most.
    each = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"), F.first("_total").alias("_total"))

    def at(q: float) -> Column:
        place = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        return F.when(low == high, F.col("_at")[low]).otherwise((high - place) * F.col("_at")[low] + (place - low) * F.col("_at")[high])

    return each.select(*[F.col("_g")[c].alias(c) for c in groups], F.array(*[at(q) for q in quantiles]).alias(name))


def error_quantiles(accuracy_rows: DataFrame, metric: str, *groups: str) -> DataFrame:
    """AGG-13: P10, P25, P50, P75 and P90 of an entity-level metric."""
    q = exact_quantiles(accuracy_rows, metric, (0.1, 0.25, 0.5, 0.75, 0.9), *groups, name="_q")
    out = accuracy_rows.where(F.col(metric).isNotNull()).groupBy(*groups).agg(F.count("*").alias("stock_count"))
    out = out.join(F.broadcast(q) if not groups else q, _same(groups, out, q)).select(*[out[c] for c in groups], "stock_count", "_q")
    return out.select(*groups, "stock_count", *[F.col("_q")[k].alias(f"P{p}") for k, p in enumerate((10, 25, 50, 75, 90))])


def _same(groups: tuple[str, ...], left: DataFrame, right: DataFrame) -> Column:
    """Equal groups, null ones too; of one row each without groups."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in groups], F.lit(True))


def error_bands(accuracy_rows: DataFrame, metric: str, group: str, edges: tuple[float, ...] = (5, 10, 15, 20, 30, 50)) -> DataFrame:
    """AGG-14: entities per band of a metric (left bound included) and their share; empty bands count 0."""
    spark = accuracy_rows.sparkSession
    labels = [f"<{edges[0]:g}", *[f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:], strict=False)], f">={edges[-1]:g}"]
    band = F.lit(0)
    for k, edge in enumerate(edges, 1):
        band = F.when(F.col(metric) >= edge, F.lit(k)).otherwise(band)
    counts = accuracy_rows.where(F.col(metric).isNotNull()).groupBy(group, band.alias("band")).agg(F.count("*").alias("stocks"))
    # A row for each band, a handful: crossed with the groups by explode, not by a join.
    frame = counts.select(group).distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    out = frame.join(counts, [group, "band"], "left").withColumn("stocks", F.coalesce("stocks", F.lit(0)))
    names = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "band int, label string"))
    share = ratio(F.col("stocks") * 100.0, F.sum("stocks").over(Window.partitionBy(group)))
    return out.join(names, "band").withColumn("share_percent", share).select(group, "band", "label", "stocks", "share_percent")


#: Bounds between blocks of a global ranking.
BLOCKS = 256


def ranked(rows: DataFrame, value: str, key: str, tiles: int) -> DataFrame:
    """``rows`` with ``rank`` by value and key over all rows and its ``tile`` of as many equal parts, the first ones larger.

    Blocks of values are ranked apart and offset by the counts of the blocks before; only the bounds of the blocks come to the driver. A value
    that fills blocks of its own is cut further by ranges of its keys (numbers or dates), so no task sorts all its rows.
    """
    cuts = rows.approxQuantile(value, [k / BLOCKS for k in range(1, BLOCKS)], 0.001)
    bounds, heavy = sorted(set(cuts)), sorted({b for b in cuts if cuts.count(b) > 1})
    block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b < F.col(value)))
    is_heavy = F.coalesce(F.col(value).isin(heavy), F.lit(False))
    own = F.lit(0)
    if heavy and dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"):
        of_keys = rows.where(is_heavy).agg(F.percentile_approx(key, [k / BLOCKS for k in range(1, BLOCKS)], 10 * BLOCKS)).first()[0] or []
        own = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(of_keys))]), lambda b: b < F.col(key)))
    # In order: the block, of it the heavy value last, of that the keys' ranges.
    placed = rows.withColumn("_b", (block * 2 + F.when(is_heavy, 1).otherwise(0)) * BLOCKS + F.when(is_heavy, own).otherwise(0))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most BLOCKS rows, and as many for each of at most BLOCKS / 2 heavy values.
    every = Window.partitionBy(F.lit(1))
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_all"))
    out = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(value, key))).join(F.broadcast(counts), "_b")
    out = out.withColumns({"rank": F.col("_before") + F.col("_k"), "_q": F.floor(F.col("_all") / tiles), "_r": F.col("_all") % tiles})
    large = F.col("_r") * (F.col("_q") + 1)
    tile = F.when(F.col("rank") <= large, F.floor((F.col("rank") - 1) / (F.col("_q") + 1)) + 1).otherwise(F.floor((F.col("rank") - 1 - F.col("_r")) / F.greatest(F.col("_q"), F.lit(1))) + 1)
    return out.withColumn("tile", tile.cast("int")).drop("_b", "_k", "_before", "_all", "_q", "_r")


def size_buckets(predictions: DataFrame, buckets: int = 4) -> DataFrame:
    """AGG-15: metrics by quantile of the entities' mean actual, smallest first; ties by entity."""
    means = scored(predictions).groupBy("stock_id").agg(F.avg("actual_revenue").alias("_mean"))
    sized = ranked(means, "_mean", "stock_id", buckets).select("stock_id", F.col("tile").alias("size_bucket"))
    return accuracy(predictions.join(sized, "stock_id"), "model", "size_bucket")


def winners(stock_accuracy: DataFrame, metric: str = "WMAPE", model: str = "model") -> DataFrame:
    """AGG-19: how often each model has the smallest metric of an entity (ties by name), its rate, mean and median."""
    known = stock_accuracy.where(F.col(metric).isNotNull())
    best = known.withColumn("_r", F.row_number().over(Window.partitionBy("stock_id").orderBy(metric, model))).where("_r = 1")
    wins = best.groupBy(model).agg(F.count("*").alias("wins"))
    total = known.groupBy(model).agg(F.count("*").alias("stocks"), F.avg(metric).alias("mean_metric"), F.percentile(metric, 0.5).alias("median_metric"))
    return total.join(wins, model, "left").withColumn("wins", F.coalesce("wins", F.lit(0))).withColumn("win_rate_percent", F.col("wins") * 100.0 / F.col("stocks"))


def month_extremes(month_accuracy: DataFrame, metric: str = "WMAPE") -> DataFrame:
    """AGG-23: best and worst month of each model, ties to the earlier month."""
    return month_accuracy.groupBy("model").agg(
        F.min_by("target_month", F.struct(metric, "target_month")).alias("best_month"),
        F.min(metric).alias("best_value"),
        F.min_by("target_month", F.struct(-F.col(metric), "target_month")).alias("worst_month"),
        F.max(metric).alias("worst_value"),
        F.avg(metric).alias("mean_value"),
    )


def score_distribution(rows: DataFrame, score: str, regime: str) -> DataFrame:
    """AGG-24: mean, quantiles and maximum of a score overall and by regime."""
    qs = (0.5, 0.75, 0.9)
    parts = []
    for groups, label in (((), F.lit("all")), ((regime,), F.col(regime))):
        some = rows.groupBy(*groups).agg(F.count(score).alias("rows"), F.avg(score).alias("mean"), F.max(score).alias("max"))
        q = exact_quantiles(rows, score, qs, *groups, name="_q")
        joined = some.join(q, _same(groups, some, q), "left").select(*[some[c] for c in groups], "rows", "mean", "max", "_q")
        parts.append(joined.select(label.alias(regime), "rows", "mean", *[F.col("_q")[k].alias(f"p{round(100 * x)}") for k, x in enumerate(qs)], "max"))
    return parts[0].unionByName(parts[1])


def annual_accuracy(predictions: DataFrame) -> DataFrame:
    """EVL-28: annual totals and bias of each entity and model."""
    rows = scored(predictions).groupBy("model", "stock_id").agg(F.count("*").alias("months"), F.sum("predicted_revenue").alias("predicted_annual"), F.sum("actual_revenue").alias("actual_annual"))
    return rows.withColumn("annual_bias_percent", ratio(F.col("predicted_annual") - F.col("actual_annual"), F.col("actual_annual")) * 100)


def pairwise_effects(stock_accuracy: DataFrame, baseline: str, challenger: str, metric: str = "WMAPE") -> DataFrame:
    """EVL-01: the challenger's metric against the baseline's for each entity, with the winner."""
    wide = stock_accuracy.where(F.col("model").isin(baseline, challenger)).groupBy("stock_id").pivot("model", [baseline, challenger]).agg(F.first(metric))
    rows = wide.where(F.col(baseline).isNotNull() & F.col(challenger).isNotNull())
    delta = F.col(challenger) - F.col(baseline)
    return rows.select("stock_id", F.col(baseline).alias("baseline_value"), F.col(challenger).alias("challenger_value"), delta.alias("delta"), F.when(delta < 0, challenger).when(delta > 0, baseline).otherwise("tie").alias("winner"))


def effect_summary(effects: DataFrame) -> DataFrame:
    """EVL-01: how often each side wins and the mean and median effect."""
    return effects.groupBy().agg(F.count("*").alias("stocks"), F.count_if(F.col("delta") < 0).alias("challenger_wins"), F.count_if(F.col("delta") > 0).alias("baseline_wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.5).alias("median_delta"))
