"""Queries over learnt dividend hurdles in forward folds; fits have no SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import finance as FI
from tidemark.operators import hurdles as H
from tidemark.plans.common import neat
from tidemark.plans.learned import hurdle_samples
from tidemark.sources.adapters import TARGET_YEAR
from tidemark.sources.artifacts import settled

FOLDS = [TARGET_YEAR - 2, TARGET_YEAR - 1]


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = settled(FI.selection_buckets(hurdle_samples(spark, sf_dir)), "hurdle-samples")
    return settled(H.hurdle_errors(samples, [*FOLDS, TARGET_YEAR]), "hurdle-errors")


def learned_dividend_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-34, EVL-14: ridge and elastic-net hurdles at seven thresholds and three rules, chosen by bucket and for all over two years, on the target year."""
    return neat(H.chosen_strategies(_errors(spark, sf_dir), FOLDS, TARGET_YEAR)["strategies"])


def learned_dividend_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-12: the method of each bucket, or the fallback."""
    return H.chosen_strategies(_errors(spark, sf_dir), FOLDS, TARGET_YEAR)["choices"]


def dividend_method_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-34, EVL-23: every method in every year: error, what it found, missed and made up, and the best."""
    return neat(H.fold_comparison(_errors(spark, sf_dir)))


QUERIES = {"learned_dividend_folds": learned_dividend_folds, "learned_dividend_choices": learned_dividend_choices, "dividend_method_folds": dividend_method_folds}
ORACLE_SQL: dict[str, str] = {}
