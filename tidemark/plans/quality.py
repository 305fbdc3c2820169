"""Queries over the quality and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans import sql as S
from tidemark.plans.common import neat
from tidemark.sources.adapters import daily_prices, dividends, entity_master, monthly_revenue, quarterly_eps


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"revenue": monthly_revenue(spark, sf_dir), "eps": quarterly_eps(spark, sf_dir), "dividends": dividends(spark, sf_dir), "daily_prices": daily_prices(spark, sf_dir)}


def panel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.panel_checks(monthly_revenue(spark, sf_dir, "l_partkey"))


PANEL_SQL = f"""WITH {S.panel('l_partkey')},
a AS (SELECT *, revenue_year * 12 + revenue_month - 1 AS mi FROM panel),
b AS (SELECT *, mi - lag(mi) OVER (PARTITION BY stock_id ORDER BY mi) AS d FROM a),
c AS (SELECT stock_id, unnest([
  {{'check': 'null_key', 'hit': stock_id IS NULL OR mi IS NULL}}, {{'check': 'month_out_of_range', 'hit': revenue_month NOT BETWEEN 1 AND 12}},
  {{'check': 'duplicate_key', 'hit': coalesce(d = 0, false)}}, {{'check': 'interior_gap', 'hit': coalesce(d > 1, false)}}, {{'check': 'negative_value', 'hit': revenue < 0}}]) AS u FROM b)
SELECT u.check AS "check", count(*) FILTER (WHERE u.hit) AS rows, count(DISTINCT CASE WHEN u.hit THEN stock_id END) AS stocks FROM c GROUP BY 1"""


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    period = {"revenue": F.make_date("revenue_year", "revenue_month", F.lit(1)), "eps": F.col("date"), "dividends": F.col("fiscal_year"), "daily_prices": F.col("date")}
    rows = Q.manifest({k: (f[k], period[k]) for k in f})
    return neat(rows.join(Q.coverage(f, entity_master(spark, sf_dir)).select("dataset", "coverage"), "dataset"))


MANIFEST_SQL = f"""WITH {S.panel()}, {S.EPS}, {S.DIVIDENDS}, {S.PRICES}, {S.MASTER},
m AS (
  SELECT 'revenue' AS dataset, stock_id, CAST(make_date(revenue_year, revenue_month, 1) AS VARCHAR) AS p FROM panel
  UNION ALL SELECT 'eps', stock_id, CAST(last_day(make_date(eps_year, eps_quarter * 3, 1)) AS VARCHAR) FROM eps
  UNION ALL SELECT 'dividends', stock_id, CAST(fiscal_year AS VARCHAR) FROM dv
  UNION ALL SELECT 'daily_prices', stock_id, CAST(date AS VARCHAR) FROM px)
SELECT dataset, count(*) AS rows, count(DISTINCT stock_id) AS stocks, min(p) AS first_period, max(p) AS last_period,
       round(count(DISTINCT stock_id) / (SELECT count(DISTINCT stock_id) FROM master), 6) AS coverage
FROM m GROUP BY 1"""


def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate that lacks a month and differs in another, against the panel."""
    base = monthly_revenue(spark, sf_dir)
    other = base.where("not (revenue_year = 1996 and revenue_month = 2)").withColumn("revenue", F.when(F.col("revenue_month") == 7, F.col("revenue") * 1.01).otherwise(F.col("revenue")))
    keys = ["stock_id", "revenue_year", "revenue_month"]
    diff = Q.numeric_diff(base, other, keys, ["revenue"]).select(F.explode(F.array(F.struct(F.lit("compared").alias("check"), F.col("compared").cast("double").alias("value")), F.struct(F.lit("different").alias("check"), F.col("different").cast("double").alias("value")))).alias("c")).select("c.*")
    cover = Q.key_diff(base, other, keys)
    cover = cover.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in cover.columns])).alias("c")).select("c.*")
    return Q.readiness(diff.union(cover), {"compared": (1, None), "different": (None, 0), "common_keys": (1, None), "baseline_only": (None, 0), "candidate_only": (None, 0)})


AUDIT_SQL = f"""WITH {S.panel()},
o AS (SELECT stock_id, revenue_year, revenue_month, CASE WHEN revenue_month = 7 THEN revenue * 1.01 ELSE revenue END AS revenue FROM panel WHERE NOT (revenue_year = 1996 AND revenue_month = 2)),
j AS (SELECT a.revenue AS x, b.revenue AS y, a.stock_id AS ka, b.stock_id AS kb FROM panel a FULL JOIN o b ON a.stock_id = b.stock_id AND a.revenue_year = b.revenue_year AND a.revenue_month = b.revenue_month),
v AS (
  SELECT 'compared' AS "check", CAST(count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) AS DOUBLE) AS value FROM j
  UNION ALL SELECT 'different', count(*) FILTER (WHERE abs(x - y) > greatest(1e-9, 1e-6 * greatest(abs(x), abs(y)))) FROM j
  UNION ALL SELECT 'common_keys', count(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) FROM j
  UNION ALL SELECT 'baseline_only', count(*) FILTER (WHERE kb IS NULL) FROM j UNION ALL SELECT 'candidate_only', count(*) FILTER (WHERE ka IS NULL) FROM j),
p AS (SELECT *, CASE WHEN "check" IN ('compared', 'common_keys') THEN value >= 1 ELSE value <= 0 END AS passed FROM v)
SELECT "check", value, passed, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status FROM p"""


def universe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.universe_audit(monthly_revenue(spark, sf_dir), [1998, 1999, 2000], 2000)


UNIVERSE_SQL = f"""WITH {S.panel()},
a AS (SELECT stock_id, {', '.join(f'count(DISTINCT revenue_month) FILTER (WHERE revenue_year = {y}) AS months_{y}' for y in (1998, 1999, 2000))} FROM panel WHERE revenue_year IN (1998, 1999, 2000) GROUP BY 1),
b AS (SELECT *, CASE WHEN months_1999 < 12 THEN 'previous year incomplete' WHEN months_2000 < 12 THEN 'target year incomplete' ELSE 'eligible' END AS reason FROM a)
SELECT *, reason = 'eligible' AS eligible FROM b"""


def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neat(Q.candidate_pool(monthly_revenue(spark, sf_dir), entity_master(spark, sf_dir), 2000), 4)


POOL_SQL = f"""WITH {S.panel()}, {S.MASTER},
a AS (SELECT stock_id, count(*) FILTER (WHERE revenue_year = 2000) AS target_months, sum(revenue) FILTER (WHERE revenue_year = 1999) AS prior_revenue FROM panel GROUP BY 1)
SELECT a.stock_id, target_months, round(prior_revenue, 4) AS prior_revenue, stock_name, coalesce(industry_category, 'unknown') AS industry_category
FROM a LEFT JOIN master ON a.stock_id = master.stock_id WHERE target_months >= 12 AND prior_revenue > 0"""

QUERIES = {"panel_checks": panel_checks, "dataset_manifest": dataset_manifest, "dataset_audit": dataset_audit, "universe_audit": universe_audit, "candidate_pool": candidate_pool}
ORACLE_SQL = {"panel_checks": PANEL_SQL, "dataset_manifest": MANIFEST_SQL, "dataset_audit": AUDIT_SQL, "universe_audit": UNIVERSE_SQL, "candidate_pool": POOL_SQL}
