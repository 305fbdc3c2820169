"""The stages of the corpus pipeline, each against what its operator says of its input."""

from __future__ import annotations

import corpus_pipeline as P
from pyspark.sql import functions as F

from tidemark.llm.jaccard_join import ngram_jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        before, after = docs.select("doc_id").collect(), out.select("doc_id").collect()
        assert {r[0] for r in after} <= {r[0] for r in before}
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "n-gram Jaccard join":
            groups = ngram_jaccard_components(docs).groupBy("component_id").count()
            assert groups.where("count > 1").count() == 0 and len(after) < len(before)
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    kept = P.quality_rules(spark, P.quality_classifier(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF)
    long = spark.read.parquet(f"{SF}/documents.parquet").where(F.size(F.split("text", r"\s+")) > 60).join(clean, "doc_id", "left_semi")
    assert long.join(kept, "doc_id", "left_anti").count() <= 0.02 * long.count()


def words(start, n=40):
    return " ".join(f"w{start + k}" for k in range(n))


def test_stages_keep_rows_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(999, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = [
        (1, words(0), 1), (2, words(0) + " more", 2), (2, words(1000), 3), (None, words(2000), 4), (None, words(2000), 5), (None, words(3000), 6),
        (3, words(4000), 7), (3, words(4000), 8), (3, words(5000), 9), (None, words(0) + " other", 10), (4, "", 11), (4, "", 12), (None, None, 13), (5, "", 14),
    ]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, copies int, component_id int, _row int, n_tokens int")
    out = P.near_duplicates(spark, docs, str(tmp_path))
    kept = sorted(r.copies for r in out.collect())
    # The near copies of 1, one of the equal rows without an id and one of the equal rows 3 go; nothing else does.
    assert out.columns == docs.columns and len(kept) == 10
    assert {1, 3, 6, 9, 11, 12, 13, 14} < set(kept) and len({4, 5} & set(kept)) == len({7, 8} & set(kept)) == 1
    mixed = P.source_mixing(spark, docs, f"file://{tmp_path}")
    assert mixed.columns == docs.columns and sorted(r.copies for r in mixed.collect()) == list(range(1, 15))


def test_columns_come_out_as_they_went_in(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["score", "predicted", "kept", "n_words", "copies", "_copy", "_words", "_row", "rate", "component_id", "KEPT_", "base_failed", "_input_1"]
    wide = docs.select("doc_id", "text", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names]).union(docs.limit(1).select(F.lit(None), F.lit(None), *[F.lit(f"{c}:None") for c in names]))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert [r[c] for c in names] == [f"{c}:{r.doc_id}" for c in names], name
        assert stage(spark, wide.limit(0), SF).count() == 0
    assert P.STAGES[-1][1](spark, wide.limit(0), SF).count() == 0
