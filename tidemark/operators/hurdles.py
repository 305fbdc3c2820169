"""EVL-34: learnt dividend hurdles and rules of thumb against each other over forward folds, chosen by bucket and applied to a later year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.finance import ID, heuristic_hurdles
from tidemark.operators.learned import THRESHOLDS, hurdle_dividends
from tidemark.operators.reports import chosen_by_folds, fold_errors

BUCKET = "dividend_selection_bucket"


def hurdle_estimates(samples: DataFrame, years: list[int], kinds: tuple[str, ...] = ("ridge", "elastic_net"), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(stock_id, target_year, bucket, method, estimated_cash_dividend) of every learnt hurdle and rule of thumb in each year.

    ``samples``: rows of time_safe_features with their bucket and actual_cash_dividend, best a written table: it is read by every fit. A year's fits
    see the years before it only; a threshold costs a column, not a fit.
    """
    columns = [ID, "target_year", "dividend_method", "estimated_cash_dividend"]
    fitted = [hurdle_dividends(samples, year, kind, thresholds).select(columns) for year in years for kind in kinds]
    rules = heuristic_hurdles(samples.where(F.col("target_year").isin(years))).select(columns)
    rows = reduce(DataFrame.unionByName, [rules, *fitted])
    return rows.join(samples.select(ID, "target_year", F.col(BUCKET).alias("bucket")), [ID, "target_year"]).withColumnRenamed("dividend_method", "method")


def fold_comparison(errors: DataFrame) -> DataFrame:
    """Mean error and confusion of each method in each year, with its place among them (ties by name)."""
    out = errors.groupBy("target_year", "method").agg(
        F.count("*").alias("stocks"), F.avg("cash_dividend_abs_error").alias("dividend_mae"),
        F.count_if((F.col("estimated_cash_dividend") > 0) & (F.col("actual_cash_dividend") > 0)).alias("paid_found"), F.count_if((F.col("estimated_cash_dividend") <= 0) & (F.col("actual_cash_dividend") > 0)).alias("paid_missed"),
        F.count_if((F.col("estimated_cash_dividend") > 0) & (F.col("actual_cash_dividend") <= 0)).alias("paid_false"),
    )
    # A row for each method and year: a few dozen.
    best = out.groupBy("target_year").agg(F.min(F.struct("dividend_mae", "method")).alias("_b"))
    return out.join(F.broadcast(best), "target_year").withColumn("is_best", F.col("method") == F.col("_b.method")).drop("_b")


def chosen_strategies(errors: DataFrame, folds: list[int], target_year: int, least_folds: int = 2, least_rows: int = 15) -> dict[str, DataFrame]:
    """EVL-11 to EVL-14: choices over the folds and how they do in the target year.

    ``choices``: of each bucket its method and where that came from (too few folds or rows: the best of all buckets). ``strategies``: error of
    the bucket's choices, of the one best method and of the best in hindsight, with the improvement on the one best. ``winners``: how many
    entities each of bucket and global serves better.
    """
    if any(year >= target_year for year in folds):
        raise ValueError("folds must lie before the target year")
    choices = chosen_by_folds(errors, folds, "bucket", "method", least_folds, least_rows)
    known, test = errors.where(F.col("target_year").isin(folds)), errors.where(F.col("target_year") == target_year)
    best = known.groupBy("method").agg(F.avg("cash_dividend_abs_error").alias("_e")).agg(F.min_by("method", F.struct("_e", "method"))).scalar()
    e = F.col("cash_dividend_abs_error")
    bucket = test.join(F.broadcast(choices), ["bucket", "method"]).select(ID, "source", e.alias("_bucket"))  # a row for each bucket
    single = test.where(F.col("method") == best).select(ID, e.alias("_global"))
    late = test.groupBy(ID).agg(F.min(e).alias("_hindsight"))
    rows = bucket.join(single, ID).join(late, ID)
    mean = lambda name: F.avg(f"_{name}").alias(name)
    means = rows.agg(F.count("*").alias("stocks"), mean("bucket"), mean("global"), mean("hindsight"))
    strategies = means.select("stocks", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("dividend_mae"), (F.col("global") - F.col(n)).alias("improvement")) for n in ("bucket", "global", "hindsight")])).alias("_s")).select("stocks", "_s.*")
    winner = F.when(F.col("_bucket") < F.col("_global"), "bucket").when(F.col("_bucket") > F.col("_global"), "global").otherwise("tie")
    winners = rows.groupBy("source", winner.alias("winner")).agg(F.count("*").alias("stocks"), F.avg(F.col("_global") - F.col("_bucket")).alias("mean_improvement"))
    return {"choices": choices, "strategies": strategies, "winners": winners}


def hurdle_errors(samples: DataFrame, years: list[int], **options) -> DataFrame:
    """Errors of all hurdles in all years; ``samples`` carries the actual dividends."""
    actuals = samples.select(ID, "target_year", "actual_cash_dividend")
    return fold_errors(hurdle_estimates(samples, years, **options), actuals)
