"""Scans of raw and canonical files, as-of snapshots and sinks.

Raw files are read with explicit text schemas and cast with try_cast, so a bad cell is a null and no inference pass is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, parse_local_year, parse_number, revenue_available_date, statement_available_date
from tidemark.operators.quality import validate


def text_csv(spark: SparkSession, path: str, columns: list[str], recursive: bool = True) -> DataFrame:
    """SRC-01: a folder of per-entity CSV files as text columns, with the entity of the file's name; columns by header."""
    rows = spark.read.options(header=True, enforceSchema=False, recursiveFileLookup=recursive, pathGlobFilter="*.csv").csv(path)
    found = [F.col(f"`{c}`").cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return rows.select(*found, F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)[^/]*$", 1).try_cast("long").alias("file_stock_id"))


def entity_info(raw: DataFrame) -> DataFrame:
    """SRC-02: numeric ids, the latest record of each (ties by name), under canonical names."""
    rows = raw.select(F.col("stock_id").try_cast("long").alias("stock_id"), "stock_name", "industry_category", F.to_date(F.try_to_timestamp("date")).alias("_date")).where("stock_id is not null")
    w = Window.partitionBy("stock_id").orderBy(F.col("_date").desc_nulls_last(), "stock_name", "industry_category")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("stock_id", "stock_name", "industry_category")


def revenue_source(raw: DataFrame, divisor: float = 1.0) -> DataFrame:
    """SRC-03: non-negative finite values, revenue_thousand or else revenue / 1000, the last record of each month kept."""
    value = parse_number(F.col("revenue_thousand")) if "revenue_thousand" in raw.columns else parse_number(F.col("revenue")) / 1000
    order = F.col("date").cast("string") if "date" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(*[F.col(c).try_cast("double").try_cast("int").alias(c) for c in ("stock_id", "revenue_year", "revenue_month")], (value / divisor).alias("revenue_thousand"), order.alias("_order"))
    rows = rows.where("stock_id is not null and revenue_year is not null and revenue_month between 1 and 12 and revenue_thousand >= 0")
    w = Window.partitionBy("stock_id", "revenue_year", "revenue_month").orderBy(F.col("_order").desc_nulls_last(), F.desc("revenue_thousand"))
    out = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_order")
    return out.withColumn("revenue_available_date", revenue_available_date(F.col("revenue_year"), F.col("revenue_month")))


def eps_source(raw: DataFrame) -> DataFrame:
    """SRC-04: the EPS lines of long statements with their publication date."""
    date = F.to_date(F.try_to_timestamp("date"))
    rows = raw.where("type = 'EPS'").select(F.col("stock_id").try_cast("long").alias("stock_id"), date.alias("date"), parse_number(F.col("value")).alias("EPS"))
    rows = rows.where("stock_id is not null and date is not null")
    return rows.select("stock_id", "date", F.year("date").alias("eps_year"), F.quarter("date").alias("eps_quarter"), "EPS", statement_available_date(F.col("date")).alias("statement_available_date"))


def dividend_source(raw: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """SRC-05: both cash parts (missing is 0), fiscal year from its text, availability from the announcement or else the ex-date."""
    date = lambda c: F.to_date(F.try_to_timestamp(c))
    cash = F.coalesce(parse_number(F.col("CashEarningsDistribution")), F.lit(0.0)) + F.coalesce(parse_number(F.col("CashStatutorySurplus")), F.lit(0.0))
    rows = raw.select(
        F.col("stock_id").try_cast("long").alias("stock_id"), "year", parse_local_year(F.col("year")).alias("fiscal_year"), cash.alias("TotalCashDividend"),
        date("CashExDividendTradingDate").alias("ex_dividend_date"), date("AnnouncementDate").alias("announcement_date"),
    )
    span = lambda c: F.coalesce(c.between(first_year, last_year), F.lit(False))
    rows = rows.where(F.col("stock_id").isNotNull() & (span(F.col("fiscal_year")) | span(F.year("ex_dividend_date")) | span(F.year("announcement_date"))))
    source = F.when(F.col("announcement_date").isNotNull(), "announcement").when(F.col("ex_dividend_date").isNotNull(), "ex_date").otherwise("unknown")
    return rows.withColumns({"available_date": F.coalesce("announcement_date", "ex_dividend_date"), "dividend_available_source": source})


def price_source(raw: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """SRC-06, SRC-07: daily closes of a span of years; years and ids filter at the scan on columnar input."""
    date = F.to_date(F.try_to_timestamp("date"))
    columns = [parse_number(F.col(c)).alias(c) for c in ("open", "max", "min", "close") if c in raw.columns]
    rows = raw.select(F.col("stock_id").try_cast("long").alias("stock_id"), date.alias("date"), *columns)
    return rows.where(F.col("stock_id").isNotNull() & F.col("close").isNotNull() & F.year("date").between(first_year, last_year))


def target_slice(revenue: DataFrame, year: int) -> DataFrame:
    """SRC-08: one year of the panel."""
    return revenue.where(F.col("revenue_year") == year)


def choose_entities(master: DataFrame, ids: list[int] | None = None, first: int | None = None) -> DataFrame:
    """SRC-09: the named entities, or the first in order of id."""
    rows = master.select("stock_id").distinct()
    if ids is not None:
        rows = rows.where(F.col("stock_id").isin([int(i) for i in ids]))
    return rows.orderBy("stock_id").limit(first) if first else rows


def prediction_source(raw: DataFrame, year: int, models: list[str] | None = None) -> DataFrame:
    """SRC-12: prediction rows of a year with numbers coerced; models that were asked for and are absent come out as failure rows."""
    rows = raw.select(
        *[F.col(c) for c in ("source_family", "model") if c in raw.columns], F.col("stock_id").try_cast("long").alias("stock_id"),
        F.col("target_year").try_cast("int").alias("target_year"), F.col("target_month").try_cast("int").alias("target_month"), finite(F.col("predicted_revenue").try_cast("double")).alias("predicted_revenue"),
    ).where(F.col("target_year") == year)
    if not models:
        return rows.withColumn("failure", F.lit(None).cast("string"))
    wanted = raw.sparkSession.createDataFrame([(m,) for m in models], "model string")
    missing = wanted.join(rows.select("model").distinct(), "model", "left_anti").withColumn("failure", F.lit("missing model"))
    return rows.where(F.col("model").isin(models)).withColumn("failure", F.lit(None).cast("string")).unionByName(missing, allowMissingColumns=True)


def revenue_snapshot(revenue: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """SRC-14: (what was public at the cut-off, the count of rows that could not be used)."""
    cut = F.lit(as_of).cast("date")
    public = revenue_available_date(F.col("revenue_year"), F.col("revenue_month")) <= cut
    sound = F.col("revenue").isNotNull() & (F.col("revenue") >= 0)
    return revenue.where(public & sound), revenue.agg(F.count_if(~F.coalesce(sound, F.lit(False))).alias("invalid_rows"))


def raw_to_canonical(raw: dict[str, DataFrame], first_year: int, last_year: int) -> dict[str, DataFrame]:
    """SRC-10: all datasets from their raw tables."""
    return {
        "stock_list": entity_info(raw["info"]),
        "revenue": revenue_source(raw["revenue"]).withColumn("revenue", F.col("revenue_thousand")),
        "eps": eps_source(raw["statements"]),
        "dividends": dividend_source(raw["dividends"], first_year, last_year),
        "daily_prices": price_source(raw["prices"], first_year, last_year),
    }


def write_validated(frames: dict[str, DataFrame], path: str, spark: SparkSession, least: dict[str, int] | None = None) -> DataFrame:
    """SRC-11: writes all datasets as Parquet if the contract holds; returns the issues, empty when written."""
    issues = validate(frames, spark, least)
    if not issues.where("severity = 'error'").limit(1).count():
        for name, rows in frames.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return issues


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """SRC-15: the artifact at ``path`` if it is complete (its success mark stands), else built and written."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def entity_documents(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """SRC-16: one JSON document for each entity: its rows in order, numbers that are not finite as null."""
    kinds = dict(rows.dtypes)
    clean = lambda c: finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    items = F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.struct(*[clean(c) for c in columns]).alias("_v"))))
    out = rows.groupBy(key).agg(items.alias("_i"))
    return out.select(key, F.to_json(F.struct(F.col(key), F.transform("_i", lambda x: x["_v"]).alias("rows")), {"ignoreNullFields": "false"}).alias("document"))


def write_partitioned(rows: DataFrame, path: str, column: str) -> None:
    """SRC-17: one folder for each label."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)


def not_done(entities: DataFrame, done: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """SRC-18: entities that neither finished nor failed in an earlier run."""
    rest = entities.join(done.select("stock_id").distinct(), "stock_id", "left_anti")
    return rest if failed is None else rest.join(failed.select("stock_id").distinct(), "stock_id", "left_anti")


def available_prices(prices: DataFrame, ids: Column | None, as_of: str) -> DataFrame:
    """SRC-07: closes up to the cut-off, of chosen entities."""
    rows = prices.where(F.col("date") <= F.lit(as_of).cast("date"))
    return rows if ids is None else rows.where(ids)
