"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of their input with the input's values, whatever their names: operators see the id, the text and
columns under reserved names only. Null and repeated ids are rows like others; null and blank texts fail the quality rules; of rows of
equal id and text the duplicates stage keeps one; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.best_fit_packing import pack_documents
from tidemark.llm.jaccard_join import ngram_jaccard_components
from tidemark.llm.mixing import mix_to_targets
from tidemark.llm.quality_classifier import fit_quality_classifier, score_quality
from tidemark.llm.quality_rules import apply_quality_rules
from tidemark.llm.storage import settle, ship

#: Factors of the shares of tokens that the domains of the labels have after the filters.
MIXING_FACTORS = {"clean": 1.0, "poor": 0.5, "toxic": 0.25}


def label_domain() -> Column:
    """The domain of a row of labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")


def shielded(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but id and text under reserved names, and the columns that bring the names back."""
    names = {c: c if c in ("doc_id", "text") else f"_input_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees hold for good; learnt from the labels of the documents at hand.

    Null and empty texts are judged by their statistics like others; without labels every document stays.
    """
    ship(spark)
    rows, back = shielded(docs)
    forest = fit_quality_classifier(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(rows, forest).where("predicted = 1").select(back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, row by row; null and blank texts have too few words and go."""
    rows, back = shielded(docs)
    return apply_quality_rules(rows).where("kept").select(back)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, which rows of null or repeated ids have too, and its name, which no column has yet."""
    name = "_row"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of smallest doc_id (null last); rows that the operator links to none stay.

    Rows are followed by id and text, so an id that other texts have too loses none of these; texts without a word all stay.
    """
    keyed, row = with_row_key(docs)
    groups = ngram_jaccard_components(keyed, id_col=row).where("n_shingles > 0")
    groups = settle(groups.groupBy(F.col("doc_id").alias(row)).agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "groups")
    ids = keyed.groupBy(row).agg(F.min("doc_id").alias("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row))
    first = settle(groups.join(ids, row).groupBy("component_id").agg(best.alias("best")).select(f"best.{row}"), "first")
    kept = keyed.join(groups.join(first, row, "left_anti").select(row), row, "left_anti")
    # Rows of equal id and text have one key.
    again = groups.where("rows > 1").join(first, row, "left_semi").select(row)
    if again.limit(1).count():
        kept = kept.join(again, row, "left_anti").unionByName(kept.join(again, row, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: rows of equal id and text have one rate; null and repeated ids are rows like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keyed, row = with_row_key(docs)
    rates = mix_to_targets(keyed, labels, label_domain(), MIXING_FACTORS, relative=True, row_col=row)
    # Rows of equal key have equal texts, so equal rates.
    rates = rates.groupBy(row).agg(F.max("copies").alias(f"{row}_copies"))
    copies = F.explode(F.sequence(F.lit(0), F.col(f"{row}_copies")))
    return keyed.join(rates, row).withColumn(f"{row}_copy", copies).where(F.col(f"{row}_copy") > 0).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of fixed length."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the trees, the rates or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = settle(docs, "stage")
    return docs
