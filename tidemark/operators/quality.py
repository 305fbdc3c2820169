"""Contract checks and audits: problems come out as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio

#: Required columns of the canonical datasets.
CONTRACT = {
    "stock_list": ("stock_id", "stock_name", "industry_category"),
    "revenue": ("stock_id", "revenue_year", "revenue_month", "revenue"),
    "eps": ("stock_id", "date", "EPS", "statement_available_date"),
    "dividends": ("stock_id", "fiscal_year", "TotalCashDividend", "available_date", "ex_dividend_date"),
    "daily_prices": ("stock_id", "date", "close"),
}


def union_all(parts: list[DataFrame]) -> DataFrame:
    """SET-01: one frame from many, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validate(frames: dict[str, DataFrame], spark: SparkSession, least_entities: dict[str, int] | None = None) -> DataFrame:
    """DQ-01: (dataset, severity, issue, value): missing datasets and columns, too few entities."""
    rows, counts = [], []
    for name, columns in CONTRACT.items():
        if name not in frames:
            rows.append((name, "error", "missing dataset", None))
            continue
        missing = [c for c in columns if c not in frames[name].columns]
        rows += [(name, "error", f"missing column {c}", None) for c in missing]
        least = (least_entities or {}).get(name)
        if least is not None and "stock_id" not in missing:
            n = frames[name].agg(F.count_distinct("stock_id").alias("value"))
            counts.append(n.where(F.col("value") < least).select(F.lit(name).alias("dataset"), F.lit("error").alias("severity"), F.lit("too few entities").alias("issue"), "value"))
    schema = "dataset string, severity string, issue string, value long"
    return union_all([spark.createDataFrame(rows, schema), *counts])


def panel_checks(panel: DataFrame) -> DataFrame:
    """DQ-02: (check, rows, stocks) for null keys, bad months, duplicate keys, interior gaps and negative values."""
    index = F.col("revenue_year") * 12 + F.col("revenue_month") - 1
    w = Window.partitionBy("stock_id").orderBy("_mi")
    rows = panel.withColumn("_mi", index)
    rows = rows.withColumns({"_gap": F.col("_mi") - F.lag("_mi").over(w) > 1, "_same": F.col("_mi") == F.lag("_mi").over(w)})
    checks = {
        "null_key": F.col("stock_id").isNull() | F.col("_mi").isNull(),
        "month_out_of_range": ~F.col("revenue_month").between(1, 12),
        "duplicate_key": F.coalesce(F.col("_same"), F.lit(False)),
        "interior_gap": F.coalesce(F.col("_gap"), F.lit(False)),
        "negative_value": F.coalesce(F.col("revenue") < 0, F.lit(False)),
    }
    sums = rows.agg(*[F.count_if(c).alias(f"{k}_rows") for k, c in checks.items()], *[F.count_distinct(F.when(c, F.col("stock_id"))).alias(f"{k}_stocks") for k, c in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"{k}_rows").alias("rows"), F.col(f"{k}_stocks").alias("stocks")) for k in checks]))
    return sums.select(each.alias("c")).select("c.*")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """DQ-03: row and entity counts and a fingerprint (a sum of hashes of the columns' text) that tells repeated rows and not their order."""
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns]).cast("binary")), 1, 12), 16, 10)
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("stock_id").alias("stocks"), F.sum(mark.cast("decimal(20,0)")).alias("fingerprint"))


def verify_fingerprint(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """DQ-03: what of each dataset's counts and fingerprint differs from what was declared; both sides have a column dataset."""
    both = observed.alias("o").join(declared.alias("d"), "dataset", "full")
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"d.{c}"))
    issue = F.when(F.col("d.rows").isNull(), "not declared").when(F.col("o.rows").isNull(), "missing").when(~same("rows"), "row count").when(~same("stocks"), "entity count").when(~same("fingerprint"), "content").otherwise("ok")
    return both.select("dataset", F.col("o.rows").alias("observed_rows"), F.col("d.rows").alias("declared_rows"), issue.alias("result"))


def coverage(frames: dict[str, DataFrame], master: DataFrame) -> DataFrame:
    """DQ-04: entities of each dataset as a share of the master list."""
    total = F.broadcast(master.agg(F.count_distinct("stock_id").alias("master_stocks")).withColumn("_k", F.lit(1)))
    parts = [f.agg(F.count_distinct("stock_id").alias("stocks")).select(F.lit(name).alias("dataset"), "stocks", F.lit(1).alias("_k")) for name, f in frames.items()]
    return union_all(parts).join(total, "_k").select("dataset", "stocks", "master_stocks", ratio(F.col("stocks").cast("double"), F.col("master_stocks")).alias("coverage"))


def manifest(frames: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """DQ-05: one row a dataset: rows, entities, first and last period. ``frames``: name to (rows, period)."""
    parts = []
    for name, (rows, period) in frames.items():
        parts.append(rows.agg(F.count("*").alias("rows"), F.count_distinct("stock_id").alias("stocks"), F.min(period.cast("string")).alias("first_period"), F.max(period.cast("string")).alias("last_period")).withColumn("dataset", F.lit(name)))
    return union_all(parts)


def key_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-06: keys in both, in the baseline only and in the candidate only."""
    a = baseline.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = candidate.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("_a") & F.col("_b")).alias("common_keys"), F.count_if(F.col("_b").isNull()).alias("baseline_only"), F.count_if(F.col("_a").isNull()).alias("candidate_only"))


def numeric_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str], columns: list[str], absolute: float = 1e-9, relative: float = 1e-6) -> DataFrame:
    """DQ-07: per column the compared rows and those that differ beyond both tolerances; duplicate keys meet by ordinal."""
    def ordered(rows: DataFrame, tag: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*columns)
        return rows.select(*keys, F.row_number().over(w).alias("_n"), *[F.col(c).cast("double").alias(f"{c}{tag}") for c in columns])

    both = ordered(baseline, "_a").join(ordered(candidate, "_b"), [*keys, "_n"])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b")) for c in columns]))
    rows = both.select(each.alias("c")).select("c.*").where("a is not null or b is not null")
    off = F.abs(F.col("a") - F.col("b"))
    differs = F.coalesce(off > F.greatest(F.lit(absolute), relative * F.greatest(F.abs("a"), F.abs("b"))), F.lit(True))
    return rows.groupBy("column").agg(F.count("*").alias("compared"), F.count_if(differs).alias("different"), F.max(off).alias("max_difference"))


def column_presence(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """DQ-08: which columns each side has."""
    names = sorted(set(baseline.columns) | set(candidate.columns))
    return baseline.sparkSession.createDataFrame([(c, c in baseline.columns, c in candidate.columns) for c in names], "column string, in_baseline boolean, in_candidate boolean")


def readiness(checks: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """DQ-09: (check, value) rows against lowest and highest allowed values: pass or fail."""
    low = F.create_map(*[F.lit(x) for k, (a, _) in bounds.items() for x in (k, float("-inf") if a is None else float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in bounds.items() for x in (k, float("inf") if b is None else float(b))])
    known = checks.where(F.col("check").isin(list(bounds)))
    good = F.coalesce((F.col("value") >= low[F.col("check")]) & (F.col("value") <= high[F.col("check")]), F.lit(False))
    return known.withColumns({"passed": good, "status": F.when(good, "pass").otherwise("fail")})


def normalise_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-10: keys as text: dates in ISO form, whole numbers without a fraction."""
    kinds = dict(rows.dtypes)
    text = lambda c: F.date_format(c, "yyyy-MM-dd") if kinds[c] in ("date", "timestamp") else F.coalesce(F.regexp_extract(F.col(c).cast("string"), r"^(-?\d+)\.0*$", 1), F.lit(""))
    out = {c: F.when(text(c) != "", text(c)).otherwise(F.col(c).cast("string")) for c in keys}
    return rows.withColumns(out)


def universe_audit(panel: DataFrame, years: list[int], target_year: int) -> DataFrame:
    """DQ-11: months of each year by entity, and whether the entity can be forecast."""
    rows = panel.where(F.col("revenue_year").isin(years)).groupBy("stock_id").pivot("revenue_year", years).agg(F.count_distinct("revenue_month"))
    rows = rows.select("stock_id", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"months_{y}") for y in years])
    before, now = F.col(f"months_{target_year - 1}"), F.col(f"months_{target_year}")
    reason = F.when(before < 12, "previous year incomplete").when(now < 12, "target year incomplete").otherwise("eligible")
    return rows.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def prediction_failures(predictions: DataFrame, months: int = 12) -> DataFrame:
    """DQ-13: entities and years of external predictions that repeat months, lack some or are not finite."""
    bad = F.col("predicted_revenue").isNull() | F.isnan("predicted_revenue") | (F.abs("predicted_revenue") == float("inf")) | (F.col("predicted_revenue") < 0)
    rows = predictions.groupBy("model", "stock_id", "target_year").agg(F.count("*").alias("_n"), F.count_distinct("target_month").alias("months"), F.count_if(bad).alias("bad_values"))
    reason = F.when(F.col("_n") > F.col("months"), "duplicate months").when(F.col("bad_values") > 0, "invalid value").when(F.col("months") < months, "incomplete year")
    return rows.withColumn("reason", reason).where("reason is not null").drop("_n")


def provenance_issues(predictions: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """DQ-14: models whose architecture column is missing, unknown or mixed."""
    rows = predictions.groupBy("model").agg(F.count_if(F.col("architecture").isNull()).alias("missing"), F.count_if(F.col("architecture").isNotNull() & ~F.col("architecture").isin(*allowed)).alias("invalid"), F.count_distinct("architecture").alias("kinds"))
    issue = F.when(F.col("missing") > 0, "missing").when(F.col("invalid") > 0, "invalid").when(F.col("kinds") > 1, "mixed")
    return rows.withColumn("issue", issue).where("issue is not null")


def saturation(predictions: DataFrame, guard: float = float(2**63 - 1)) -> DataFrame:
    """DQ-15: predictions marked valid or saturated."""
    p = F.col("predicted_revenue")
    return predictions.withColumn("numeric_valid", F.coalesce((p >= 0) & (p < guard) & ~F.isnan(p), F.lit(False)))


def candidate_pool(panel: DataFrame, master: DataFrame, target_year: int, least_months: int = 12) -> DataFrame:
    """DQ-16: entities with enough months of the target year and revenue in the year before, industry filled in."""
    rows = panel.groupBy("stock_id").agg(F.count_if(F.col("revenue_year") == target_year).alias("target_months"), F.sum(F.when(F.col("revenue_year") == target_year - 1, F.col("revenue"))).alias("prior_revenue"))
    rows = rows.where((F.col("target_months") >= least_months) & (F.col("prior_revenue") > 0))
    return rows.join(master, "stock_id", "left").withColumn("industry_category", F.coalesce("industry_category", F.lit("unknown")))


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A guard before joins that must not multiply rows: fails the plan where a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated key {keys}"))).otherwise(F.lit(True))).drop("_n")
