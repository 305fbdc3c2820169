"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cohorts import to_long
from tidemark.operators.forecast import formula_forecast
from tidemark.operators.metrics import accuracy
from tidemark.sources.adapters import TARGET_YEAR, entity_master, monthly_revenue

MODELS = {"formula_adjusted_revenue": "formula", "seasonal_naive_revenue": "seasonal_naive", "last_observed_revenue": "last_observed"}


def neat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def predictions(spark: SparkSession, sf_dir: str, year: int = TARGET_YEAR, by: str = "l_suppkey", panel: DataFrame | None = None) -> DataFrame:
    """Formula, seasonal-naive and last-value predictions of a year in long form, with actuals; of ``panel`` where it is at hand."""
    rows = formula_forecast(monthly_revenue(spark, sf_dir, by) if panel is None else panel).where(F.col("target_year") == year).withColumn("_last", F.col("last_observed_revenue"))
    keys = ["stock_id", "target_year", "target_month", "month_index", "actual_revenue", "_last", "mase_scale"]
    return to_long(rows, keys, MODELS).withColumnRenamed("_last", "last_observed_revenue").where("predicted_revenue is not null")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FC-08 to AGG-10: every entity's months of the target year by the revenue formula, scored by industry."""
    rows = predictions(spark, sf_dir).where("model = 'formula'").join(entity_master(spark, sf_dir), "stock_id", "left")
    return neat(accuracy(rows, "industry_category"))
