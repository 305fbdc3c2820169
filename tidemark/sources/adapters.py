"""The canonical datasets of the library, taken from the order and line-item tables of a warehouse.

Money is summed as decimal(18,4), so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import statement_available_date
from tidemark.sources.artifacts import settled

MONEY = "decimal(18,4)"
TARGET_YEAR = 2000
AS_OF = "2000-01-10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a facts table whose months one task of a panel holds.
PANEL_BYTES = 8 << 20


def _by_entity(spark: SparkSession, path: str, panel: DataFrame) -> DataFrame:
    """A large panel by entity in partitions that its facts' size tells, so that tasks of its windows keep their size; small ones as Spark lays them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts = -(-at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() // PANEL_BYTES)
    return panel.repartition(parts, "stock_id") if parts > spark.sparkContext.defaultParallelism else panel


def _money(c: Column) -> Column:
    return F.sum(c.cast(MONEY))


def entity_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_id, stock_name, industry_category)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("industry_category"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stock_id"), F.col("s_name").alias("stock_name"), "s_nationkey")
    return supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"], "left").select("stock_id", "stock_name", "industry_category")


def monthly_revenue(spark: SparkSession, sf_dir: str, by: str = "l_suppkey") -> DataFrame:
    """(stock_id, revenue_year, revenue_month, revenue); ``by`` l_suppkey is dense, l_partkey has gaps."""
    sold = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    keys = (F.col(by).alias("stock_id"), F.year("l_shipdate").alias("revenue_year"), F.month("l_shipdate").alias("revenue_month"))
    panel = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(_money(sold).cast("double").alias("revenue"))
    return _by_entity(spark, f"{sf_dir}/lineitem.parquet", panel)


def quarterly_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_id, date, eps_year, eps_quarter, EPS, statement_available_date); negative quarters occur."""
    earned = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stock_id"), F.year("l_shipdate").alias("eps_year"), F.quarter("l_shipdate").alias("eps_quarter"))
    return _with_dates(rows.agg((_money(earned).cast("double") / 1e4).alias("EPS")))


def _with_dates(rows: DataFrame) -> DataFrame:
    date = F.last_day(F.make_date("eps_year", F.col("eps_quarter") * 3, F.lit(1)))
    rows = rows.withColumn("date", date)
    return rows.select("stock_id", "date", "eps_year", "eps_quarter", "EPS", statement_available_date(F.col("date")).alias("statement_available_date"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_id, fiscal_year, TotalCashDividend, available_date, ex_dividend_date)."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    rows = lines.groupBy(F.col("l_suppkey").alias("stock_id"), F.year("l_shipdate").alias("fiscal_year"))
    rows = rows.agg((_money(F.col("l_extendedprice") * F.col("l_tax")).cast("double") / 1e5).alias("TotalCashDividend"))
    return _with_payment(rows)


def _with_payment(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"available_date": F.make_date(F.col("fiscal_year") + 1, F.lit(6), F.lit(10)), "ex_dividend_date": F.make_date(F.col("fiscal_year") + 1, F.lit(7), F.lit(2))})


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stock_id, date, close)."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_suppkey").alias("stock_id"), F.to_date("l_shipdate").alias("date"))
    return rows.agg((F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 100).alias("close"))


def written_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``revenue``, ``quarterly`` and ``dividends``: the rows of monthly_revenue, quarterly_eps and dividends from one pass over the line items.

    Sums of entities and months are written once and read by all three, for queries that read them many times. Decimals, so sums of sums are exact.
    """
    price, paying = F.col("l_extendedprice"), F.col("l_returnflag") == "A"
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stock_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    sums = lines.agg(_money(price * (1 - F.col("l_discount"))).alias("revenue"), _money(price * (F.col("l_discount") - F.col("l_tax"))).alias("earned"), _money(F.when(paying, price * F.col("l_tax"))).alias("cash"), F.bool_or(paying).alias("paying"))
    months = settled(sums, "facts")
    revenue = months.select("stock_id", F.col("year").alias("revenue_year"), F.col("month").alias("revenue_month"), F.col("revenue").cast("double").alias("revenue"))
    quarters = months.groupBy("stock_id", F.col("year").alias("eps_year"), F.ceil(F.col("month") / 3).cast("int").alias("eps_quarter")).agg((F.sum("earned").cast("double") / 1e4).alias("EPS"))
    years = months.where("paying").groupBy("stock_id", F.col("year").alias("fiscal_year")).agg((F.sum("cash").cast("double") / 1e5).alias("TotalCashDividend"))
    return {"revenue": _by_entity(spark, f"{sf_dir}/lineitem.parquet", revenue), "quarterly": _with_dates(quarters), "dividends": _with_payment(years)}
