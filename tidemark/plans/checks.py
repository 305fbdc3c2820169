"""Queries over raw sources, contracts, joins, picks and functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import cohorts as K
from tidemark.operators import finance as FI
from tidemark.operators import metrics as M
from tidemark.operators import quality as Q
from tidemark.plans import sql as S
from tidemark.plans.common import neat, predictions
from tidemark.sources import readers as R
from tidemark.sources.adapters import AS_OF, TARGET_YEAR, daily_prices, dividends, entity_master, monthly_revenue, quarterly_eps

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str):
    def keep(query):
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return keep


def _formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where("model = 'formula'")


# Raw sources


@_register(f"""WITH {S.panel()}
SELECT CAST(stock_id AS INTEGER) AS stock_id, revenue_year, revenue_month, floor(revenue) / 1000 AS revenue_thousand, CAST(make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH AS DATE) AS revenue_available_date FROM panel""")
def raw_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, FN-02, FN-04: months as text with commas, an older record of each and broken rows among them."""
    panel = monthly_revenue(spark, sf_dir)
    text = lambda value, date: panel.select(F.lit(date).alias("date"), F.concat(F.col("stock_id").cast("string"), F.lit(".0")).alias("stock_id"), F.col("revenue_year").cast("string").alias("revenue_year"), F.col("revenue_month").cast("string").alias("revenue_month"), value.alias("revenue"))
    whole = F.format_number(F.floor("revenue"), 0)
    raw = text(whole, "2001-01-01").union(text(F.lit("7"), "1990-01-01")).union(text(F.lit("n/a"), "2002-01-01")).union(text(F.lit("-5"), "2003-01-01"))
    return R.revenue_source(raw)


@_register(f"""WITH {S.EPS}
SELECT stock_id, eps_year, round(sum(EPS), 6) AS annual_eps, count(*) AS quarter_count, max(statement_available_date) AS latest_available_date FROM eps GROUP BY 1, 2 HAVING count(*) >= 4""")
def raw_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, FN-05, AGG-30: EPS lines of long statements, summed for years of four rows."""
    lines = quarterly_eps(spark, sf_dir).select(F.col("stock_id").cast("string").alias("stock_id"), F.col("date").cast("string").alias("date"), F.explode(F.array(F.lit("EPS"), F.lit("Revenue"))).alias("type"), F.col("EPS").cast("string").alias("value"))
    return neat(FI.annual_eps(R.eps_source(lines), count_rows=True))


@_register(f"""WITH {S.DIVIDENDS}
SELECT stock_id, fiscal_year, round(TotalCashDividend, 6) AS TotalCashDividend, ex_dividend_date, CASE WHEN stock_id % 3 = 0 THEN ex_dividend_date ELSE available_date END AS available_date,
       CASE WHEN stock_id % 3 = 0 THEN 'ex_date' ELSE 'announcement' END AS dividend_available_source
FROM dv WHERE fiscal_year BETWEEN 1996 AND 1998 OR year(ex_dividend_date) BETWEEN 1996 AND 1998 OR (stock_id % 3 <> 0 AND year(available_date) BETWEEN 1996 AND 1998)""")
def raw_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, FN-03: local years as text, two cash parts, announcements that are missing."""
    paid = dividends(spark, sf_dir)
    raw = paid.select(
        F.col("stock_id").cast("string").alias("stock_id"), F.concat((F.col("fiscal_year") - 1911).cast("string"), F.lit("年")).alias("year"), F.col("TotalCashDividend").cast("string").alias("CashEarningsDistribution"), F.lit("").alias("CashStatutorySurplus"),
        F.col("ex_dividend_date").cast("string").alias("CashExDividendTradingDate"), F.when(F.col("stock_id") % 3 != 0, F.col("available_date").cast("string")).alias("AnnouncementDate"),
    )
    return neat(R.dividend_source(raw, 1996, 1998).select("stock_id", "fiscal_year", "TotalCashDividend", "ex_dividend_date", "available_date", "dividend_available_source"))


@_register(f"""WITH {S.PRICES} SELECT stock_id, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, round(max(close), 6) AS top FROM px WHERE year(date) BETWEEN 1997 AND 1998 AND stock_id % 4 <> 1 GROUP BY 1""")
def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, SRC-07: closes as text of two years, rows without a close left out."""
    raw = daily_prices(spark, sf_dir).select(F.col("stock_id").cast("string").alias("stock_id"), F.col("date").cast("string").alias("date"), F.when(F.col("stock_id") % 4 != 1, F.col("close").cast("string")).alias("close"))
    rows = R.available_prices(R.price_source(raw, 1997, 1998), None, "1999-01-01")
    return neat(rows.groupBy("stock_id").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("close").alias("top")))


@_register(f"WITH {S.MASTER} SELECT stock_id, stock_name, industry_category FROM master")
def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: several records of each entity, of which the latest counts."""
    master = entity_master(spark, sf_dir)
    row = lambda name, date: master.select(F.col("stock_id").cast("string").alias("stock_id"), name.alias("stock_name"), "industry_category", F.lit(date).alias("date"))
    return R.entity_info(row(F.lit("old"), "2000-05-01").union(row(F.col("stock_name"), "2001-05-01")).union(row(F.lit("undated"), None)))


@_register(f"""WITH {S.panel()}, p AS (SELECT stock_id, revenue_year, revenue_month, CASE WHEN revenue_month = 7 THEN -revenue ELSE revenue END AS revenue FROM panel),
k AS (SELECT stock_id, count(*) AS months, round(sum(revenue), 4) AS revenue, max(revenue_year * 12 + revenue_month) AS last_month FROM p WHERE make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= {S.AS_OF} AND revenue >= 0 GROUP BY 1)
SELECT k.*, (SELECT count(*) FROM p WHERE revenue < 0) AS invalid_rows FROM k""")
def revenue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: what was public at the cut-off, with the count of rows that cannot be used."""
    panel = monthly_revenue(spark, sf_dir).withColumn("revenue", F.when(F.col("revenue_month") == 7, -F.col("revenue")).otherwise(F.col("revenue")))
    rows, bad = R.revenue_snapshot(panel, AS_OF)
    rows = rows.groupBy("stock_id").agg(F.count("*").alias("months"), F.sum("revenue").alias("revenue"), F.max(F.col("revenue_year") * 12 + F.col("revenue_month")).alias("last_month"))
    return neat(rows.withColumn("invalid_rows", bad.scalar()), 4)


@_register(f"""WITH {S.full()} SELECT model, CAST(NULL AS VARCHAR) AS failure, count(*) AS rows, round(sum(predicted_revenue), 3) AS total FROM pred WHERE model IN ('formula', 'last_observed') GROUP BY 1
UNION ALL SELECT 'absent', 'missing model', 1, NULL""")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: predictions as text of chosen models, one of which is absent."""
    raw = predictions(spark, sf_dir).select("model", *[F.col(c).cast("string").alias(c) for c in ("stock_id", "target_year", "target_month", "predicted_revenue")])
    rows = R.prediction_source(raw, TARGET_YEAR, ["formula", "last_observed", "absent"])
    return neat(rows.groupBy("model", "failure").agg(F.count("*").alias("rows"), F.sum("predicted_revenue").alias("total")), 3)


@_register("SELECT s_suppkey AS stock_id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey <> 7")
def remaining_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, SRC-09, JON-17: entities still to be done after a run that was cut off."""
    master = entity_master(spark, sf_dir)
    rest = R.not_done(R.choose_entities(master), master.where("stock_id % 3 = 0"), master.where("stock_id % 5 = 0"))
    return K.members(rest, R.choose_entities(master, [7]), ["stock_id"], inside=False)


@_register(f"""WITH {S.panel()}, r AS (SELECT stock_id, list({{'revenue_year': revenue_year, 'revenue_month': revenue_month}} ORDER BY revenue_year, revenue_month) AS rows FROM panel WHERE revenue_year = 2000 GROUP BY 1)
SELECT stock_id, CAST(to_json({{'stock_id': stock_id, 'rows': rows}}) AS VARCHAR) AS document FROM r""")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-08: one JSON document for each entity."""
    rows = R.target_slice(monthly_revenue(spark, sf_dir), 2000)
    return R.entity_documents(rows, "stock_id", ["revenue_year", "revenue_month"], ["revenue_year", "revenue_month"])


@_register(f"""WITH {S.MASTER} SELECT * FROM (VALUES ('eps', 'error', 'missing dataset', CAST(NULL AS BIGINT)), ('revenue', 'error', 'missing column revenue', NULL)) AS t(dataset, severity, issue, value)
UNION ALL SELECT 'stock_list', 'error', 'too few entities', count(DISTINCT stock_id) FROM master""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-01, SRC-11: a dataset that is missing, one without a column, one of too few entities."""
    frames = {"stock_list": entity_master(spark, sf_dir), "revenue": monthly_revenue(spark, sf_dir).drop("revenue"), "dividends": dividends(spark, sf_dir), "daily_prices": daily_prices(spark, sf_dir)}
    return Q.validate(frames, spark, {"stock_list": 10**9, "daily_prices": 1})


_HASH = "CAST(sum(CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT)) AS DECIMAL(38,0))"


@_register(f"""WITH {S.panel()}, {S.EPS},
a AS (SELECT 'revenue' AS dataset, count(*) AS n, {_HASH.format("concat_ws('|', stock_id, revenue_year, revenue_month)")} AS h FROM panel), b AS (SELECT 'eps' AS dataset, count(*) AS n FROM eps)
SELECT 'revenue' AS dataset, n AS observed_rows, n AS declared_rows, 'ok' AS result, CAST(h AS VARCHAR) AS fingerprint FROM a UNION ALL SELECT 'eps', n, n + (SELECT count(*) FROM eps), 'row count', NULL FROM b UNION ALL SELECT 'prices', NULL, 3, 'missing', NULL""")
def dataset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-03: observed against declared profiles: one that agrees, one of doubled rows, one that is missing."""
    revenue, eps = monthly_revenue(spark, sf_dir), quarterly_eps(spark, sf_dir)
    mark = lambda rows, name, *c: Q.fingerprint(rows, *c).withColumn("dataset", F.lit(name))
    observed = mark(revenue, "revenue", "stock_id", "revenue_year", "revenue_month").unionByName(mark(eps, "eps", "stock_id", "date"))
    declared = mark(revenue, "revenue", "stock_id", "revenue_year", "revenue_month").unionByName(mark(eps.union(eps), "eps", "stock_id", "date"))
    declared = declared.unionByName(declared.where("dataset = 'eps'").select(F.lit(3).cast("long").alias("rows"), F.lit(1).cast("long").alias("stocks"), "fingerprint", F.lit("prices").alias("dataset")))
    rows = Q.verify_fingerprint(observed, declared).join(observed.select("dataset", F.col("fingerprint").cast("decimal(38,0)").cast("string").alias("fingerprint")), "dataset", "left")
    return rows.withColumn("fingerprint", F.when(F.col("result") == "ok", F.col("fingerprint")))


@_register(f"WITH {S.EPS} SELECT CAST(stock_id AS VARCHAR) AS stock_id, strftime(last_day(make_date(eps_year, eps_quarter * 3, 1)), '%Y-%m-%d') AS date, CAST(eps_quarter AS VARCHAR) AS quarter FROM eps")
def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-10: dates, whole doubles and numbers as text keys."""
    return Q.normalise_keys(quarterly_eps(spark, sf_dir).select("stock_id", "date", F.col("eps_quarter").cast("double").alias("quarter")), ["stock_id", "date", "quarter"])


@_register(f"""WITH {S.panel()}, {S.EPS}, {S.DIVIDENDS}, {S.PRICES},
r AS (SELECT 'revenue' AS dataset, CAST(make_date(revenue_year, revenue_month, 1) AS VARCHAR) AS p, CAST(make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH AS DATE) AS a FROM panel
  UNION ALL SELECT 'eps', CAST(last_day(make_date(eps_year, eps_quarter * 3, 1)) AS VARCHAR), statement_available_date FROM eps UNION ALL SELECT 'dividends', CAST(fiscal_year AS VARCHAR), available_date FROM dv UNION ALL SELECT 'prices', CAST(date AS VARCHAR), date FROM px)
SELECT dataset, max(p) AS latest_period, max(a) AS latest_available, count(*) AS rows, 'ok' AS status FROM r WHERE a <= {S.AS_OF} GROUP BY 1""")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-12."""
    return FI.evidence_status(monthly_revenue(spark, sf_dir), quarterly_eps(spark, sf_dir), dividends(spark, sf_dir), daily_prices(spark, sf_dir), AS_OF)


@_register(f"""WITH {S.full()},
b AS (SELECT model, stock_id, target_year, target_month, CASE WHEN stock_id % 5 = 0 THEN -1 ELSE predicted_revenue END AS p FROM pred WHERE model = 'formula' AND NOT (stock_id % 3 = 0 AND target_month = 4)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE stock_id % 7 = 0), g AS (SELECT model, stock_id, target_year, count(*) AS n, count(DISTINCT target_month) AS months, count(*) FILTER (WHERE p < 0) AS bad_values FROM c GROUP BY 1, 2, 3)
SELECT model, stock_id, target_year, months, bad_values, CASE WHEN n > months THEN 'duplicate months' WHEN bad_values > 0 THEN 'invalid value' ELSE 'incomplete year' END AS reason FROM g WHERE n > months OR bad_values > 0 OR months < 12""")
def failed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-13: months repeated, missing or negative."""
    rows = _formula(spark, sf_dir).where("not (stock_id % 3 = 0 and target_month = 4)").select("model", "stock_id", "target_year", "target_month", F.when(F.col("stock_id") % 5 == 0, -1.0).otherwise(F.col("predicted_revenue")).alias("predicted_revenue"))
    return Q.prediction_failures(rows.union(rows.where("stock_id % 7 = 0")))


@_register(f"""WITH {S.full()}, a AS (SELECT model, CASE WHEN model = 'formula' AND stock_id % 2 = 0 THEN 'stacked' WHEN model = 'seasonal_naive' AND stock_id % 4 = 0 THEN NULL WHEN model = 'seasonal_naive' THEN 'disabled' ELSE 'plain' END AS architecture FROM pred)
SELECT model, count(*) FILTER (WHERE architecture IS NULL) AS missing, count(*) FILTER (WHERE architecture NOT IN ('plain', 'stacked')) AS invalid, count(DISTINCT architecture) AS kinds,
       CASE WHEN count(*) FILTER (WHERE architecture IS NULL) > 0 THEN 'missing' ELSE 'mixed' END AS issue FROM a WHERE model <> 'last_observed' GROUP BY 1""")
def provenance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-14, FN-19: architectures of models, one mixed, one missing."""
    named = predictions(spark, sf_dir).withColumn("architecture", X.sequence_backbone(F.col("model"), "plain", None, ("seasonal_naive",)))
    mixed = F.when((F.col("model") == "formula") & (F.col("stock_id") % 2 == 0), "stacked").when((F.col("model") == "seasonal_naive") & (F.col("stock_id") % 4 == 0), None).otherwise(F.col("architecture"))
    return Q.provenance_issues(named.withColumn("architecture", mixed), ("plain", "stacked"))


@_register(f"WITH {S.full()} SELECT model, count(*) AS rows, count(*) FILTER (WHERE target_month <> 3) AS valid FROM pred GROUP BY 1")
def saturated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-15: predictions beyond the range of whole numbers in one month."""
    rows = predictions(spark, sf_dir).withColumn("predicted_revenue", F.when(F.col("target_month") == 3, F.col("predicted_revenue") * 1e30 + 1e30).otherwise(F.col("predicted_revenue")))
    return Q.saturation(rows).groupBy("model").agg(F.count("*").alias("rows"), F.count_if("numeric_valid").alias("valid"))


# Functions


@_register("""SELECT s_suppkey AS stock_id, s_suppkey / 100 AS percent, CAST(s_suppkey AS DOUBLE) AS plain, CAST(s_suppkey * 1000 AS DOUBLE) AS number, s_suppkey % 2 = 0 AS truth, s_suppkey % 3 = 1 AS observed,
  CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 100) / 100 END AS threshold, round(s_acctbal / 7, 2) + 0.0 AS balance, CASE WHEN s_suppkey % 2 = 0 THEN 't' ELSE 'f' END AS backbone FROM supplier""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-01, FN-02, FN-13, FN-14, FN-16, FN-19, FN-20: parsing of text made of the entities' numbers."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("stock_id"), (F.col("s_acctbal") / 7).alias("balance"))
    n, text = F.col("stock_id"), F.col("stock_id").cast("string")
    return rows.select(
        "stock_id", X.parse_percent(F.concat(text, F.lit("%"))).alias("percent"), X.parse_percent(F.concat(F.lit(" "), text)).alias("plain"), X.parse_number(F.format_number(n * 1000, 0)).alias("number"),
        X.truth(F.when(n % 2 == 0, " Yes ").otherwise("no")).alias("truth"), X.observed_price(F.when(n % 3 == 0, "Synthetic feed").when(n % 3 == 1, "exchange")).alias("observed"),
        X.method_threshold(F.when(n % 2 == 0, F.concat(F.lit("direct_hurdle_ridge_t"), F.lpad((n % 100).cast("string"), 3, "0"))).otherwise("direct_hurdle")).alias("threshold"),
        (X.rounded(["balance"], 2)["balance"] + F.lit(0.0)).alias("balance"), X.sequence_backbone(F.when(n % 2 == 0, "a").otherwise("b"), "f", "t", ("a",)).alias("backbone"),
    )


@_register(f"""WITH {S.full()}
SELECT stock_id, target_month, round(CASE WHEN actual_revenue <> 0 AND abs(actual_revenue) >= 50000 THEN (predicted_revenue - actual_revenue) / abs(actual_revenue) * 100 END, 6) AS percent_error, round(predicted_revenue / 1000, 6) AS predicted_revenue_thousand,
       CAST(round_even(least(greatest(CASE WHEN target_month = 5 THEN 0 WHEN target_month = 6 THEN -3 ELSE predicted_revenue END, 0), 100000), 0) AS BIGINT) AS whole, round(ln(1 + predicted_revenue), 6) AS log_level, round(predicted_revenue, 4) AS level,
       target_year || '-' || lpad(CAST(target_month AS VARCHAR), 2, '0') || '~' || '2001-01' AS period FROM pred WHERE model = 'formula'""")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07, FN-08, FN-10, FN-17, FN-18 on predictions, some of them missing or negative."""
    p = F.col("predicted_revenue")
    odd = F.when(F.col("target_month") == 5, float("nan")).when(F.col("target_month") == 6, -3.0).otherwise(p)
    rows = _formula(spark, sf_dir).select(
        "stock_id", "target_month", X.percent_error(p, F.col("actual_revenue"), 50000.0).alias("percent_error"), X.thousands("predicted_revenue")["predicted_revenue_thousand"].alias("predicted_revenue_thousand"), X.safe_round(odd, 100000).alias("whole"),
        X.log_level(p).alias("log_level"), F.round(X.level_of(X.log_level(p)), 4).alias("level"), X.period_label(F.make_date("target_year", "target_month", F.lit(1)), F.lit("2001-01-05").cast("date")).alias("period"),
    )
    return neat(rows)


# Joins, picks and sets


@_register(f"""WITH {S.panel()}, c AS (SELECT DISTINCT stock_id, unnest([DATE '1994-03-01', DATE '1997-07-15', DATE '2000-01-10']) AS as_of_date FROM panel),
k AS (SELECT c.stock_id, as_of_date, arg_max(revenue, CAST(make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH AS DATE)) AS v FROM c JOIN panel ON c.stock_id = panel.stock_id AND make_date(revenue_year, revenue_month, 10) + INTERVAL 1 MONTH <= as_of_date GROUP BY 1, 2)
SELECT c.stock_id, c.as_of_date, round(v, 4) AS known_revenue FROM c LEFT JOIN k ON c.stock_id = k.stock_id AND c.as_of_date = k.as_of_date""")
def known_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06: the newest month that was public at each of three cut-offs of every entity."""
    panel = monthly_revenue(spark, sf_dir).withColumn("public", X.revenue_available_date(F.col("revenue_year"), F.col("revenue_month")))
    dates = [F.lit(d).cast("date") for d in ("1994-03-01", "1997-07-15", "2000-01-10")]
    cutoffs = panel.select("stock_id").distinct().withColumn("as_of_date", F.explode(F.array(*dates)))
    return neat(K.known_at(cutoffs, panel, ["stock_id"], "as_of_date", "public", F.col("revenue"), "known_revenue"), 4)


@_register(f"""WITH {S.full()}, m AS (SELECT stock_id, revenue_year * 12 + revenue_month - 1 AS mi, revenue FROM panel)
SELECT pred.stock_id, target_month, round(predicted_revenue, 4) AS predicted_revenue, round(a.revenue, 4) AS actual_revenue, round(b.revenue, 4) AS last_observed_revenue
FROM pred LEFT JOIN m a ON pred.stock_id = a.stock_id AND month_index = a.mi LEFT JOIN m b ON pred.stock_id = b.stock_id AND month_index - 1 = b.mi WHERE model = 'formula'""")
def attached_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07, JON-14, SRT-01: actuals and the month before joined to bare predictions, from a panel with repeated keys that are cleared first."""
    panel = monthly_revenue(spark, sf_dir)
    twice = panel.withColumn("version", F.lit(2)).union(panel.withColumn("revenue", F.lit(0.0)).withColumn("version", F.lit(1)))
    last = K.keep_last(twice, ["stock_id", "revenue_year", "revenue_month"], "version")
    bare = _formula(spark, sf_dir).select("stock_id", "target_year", "target_month", "predicted_revenue")
    return neat(K.attach_actuals(bare, last).select("stock_id", "target_month", "predicted_revenue", "actual_revenue", "last_observed_revenue"), 4)


@_register(f"""WITH {S.full()}, g AS (SELECT stock_id, target_month FROM pred WHERE predicted_revenue >= 0.8 * actual_revenue AND model IN ('formula', 'seasonal_naive') GROUP BY 1, 2 HAVING count(DISTINCT model) = 2)
SELECT model, count(*) AS rows, count(DISTINCT stock_id) AS stocks, round(sum(predicted_revenue), 3) AS total FROM pred SEMI JOIN g USING (stock_id, target_month) WHERE model IN ('formula', 'seasonal_naive') GROUP BY 1""")
def exact_method_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: months that are valid under both methods."""
    rows = K.method_cohort(predictions(spark, sf_dir), ["stock_id", "target_month"], "model", F.col("predicted_revenue") >= 0.8 * F.col("actual_revenue"), ["formula", "seasonal_naive"])
    return neat(rows.groupBy("model").agg(F.count("*").alias("rows"), F.count_distinct("stock_id").alias("stocks"), F.sum("predicted_revenue").alias("total")), 3)


@_register(f"""WITH {S.MASTER} SELECT stock_id, CASE WHEN stock_id % 2 = 0 THEN stock_name ELSE upper(stock_name) END AS stock_name, industry_category FROM master WHERE stock_id % 2 = 0 OR stock_id % 3 = 0
UNION ALL SELECT stock_id, NULL, industry_category FROM master WHERE stock_id % 2 <> 0 AND stock_id % 3 <> 0""")
def labels_of_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-12: names of one source where it has them, else of the other."""
    master = entity_master(spark, sf_dir)
    first = master.withColumn("stock_name", F.when(F.col("stock_id") % 2 == 0, F.col("stock_name")))
    second = master.where("stock_id % 3 = 0").withColumn("stock_name", F.upper("stock_name"))
    return K.coalesce_labels(first, second, "stock_id", ["stock_name", "industry_category"])


@_register(f"""WITH {S.full()}, c AS (SELECT DISTINCT stock_id, CASE WHEN stock_id % 4 = 0 THEN NULL WHEN stock_id % 2 = 0 THEN 'formula' ELSE 'seasonal_naive' END AS s FROM pred)
SELECT c.stock_id, coalesce(s, 'last_observed') AS model, CASE WHEN s IS NULL THEN 'default' ELSE 'selected' END AS selection_reason, count(*) AS months, round(sum(predicted_revenue), 4) AS total
FROM c JOIN pred ON c.stock_id = pred.stock_id AND pred.model = coalesce(s, 'last_observed') GROUP BY 1, 2, 3""")
def selection_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16: the selected model of each entity, the default where none was selected."""
    rows = predictions(spark, sf_dir)
    ids = rows.select("stock_id").distinct()
    chosen = ids.where("stock_id % 4 <> 0").withColumn("chosen", F.when(F.col("stock_id") % 2 == 0, "formula").otherwise("seasonal_naive"))
    picked = K.with_fallback(chosen, ids, ["stock_id"], "chosen", "last_observed").withColumnRenamed("chosen", "model")
    out = rows.join(picked, ["stock_id", "model"]).groupBy("stock_id", "model", "selection_reason").agg(F.count("*").alias("months"), F.sum("predicted_revenue").alias("total"))
    return neat(out, 4)


_STOCK_WMAPE = "sw AS (SELECT model, stock_id, sum(abs(predicted_revenue - actual_revenue)) / nullif(sum(abs(actual_revenue)), 0) * 100 AS w FROM pred GROUP BY 1, 2)"


@_register(f"""WITH {S.full()}, {_STOCK_WMAPE}, b AS (SELECT stock_id, max(w) FILTER (WHERE model = 'last_observed') AS b FROM sw GROUP BY 1),
e AS (SELECT sw.stock_id, model, w, b, w - b AS d FROM sw JOIN b ON sw.stock_id = b.stock_id WHERE model <> 'last_observed')
SELECT stock_id, model, round(w, 6) AS value, round(b, 6) AS baseline_value, round(d, 6) AS delta, round(d / nullif(b, 0) * 100, 5) AS change_percent, CASE WHEN d < 0 THEN model WHEN d > 0 THEN 'last_observed' ELSE 'tie' END AS winner FROM e""")
def treatment_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-02 to EVL-04, EVL-14: every model against the last value, entity by entity."""
    rows = K.treatment_effects(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"), "last_observed", ["stock_id"], "WMAPE")
    return neat(rows.withColumn("change_percent", F.round("change_percent", 5)))


@_register(f"""WITH {S.full()}, {_STOCK_WMAPE}, b AS (SELECT stock_id, max(w) FILTER (WHERE model = 'last_observed') AS b, max(w) FILTER (WHERE model = 'formula') AS f FROM sw GROUP BY 1),
t AS (SELECT stock_id, b - f AS gain FROM b WHERE b IS NOT NULL AND f IS NOT NULL)
(SELECT 'leader' AS side, stock_id, round(gain, 6) AS gain FROM t ORDER BY t.gain DESC, stock_id LIMIT 7) UNION ALL (SELECT 'hotspot', stock_id, round(gain, 6) FROM t ORDER BY t.gain, stock_id LIMIT 7)""")
def improvement_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-04: the entities that gain and lose most."""
    gain = M.pairwise_effects(M.accuracy(predictions(spark, sf_dir), "model", "stock_id"), "last_observed", "formula").select("stock_id", (-F.col("delta")).alias("gain"))
    side = lambda name, rows: rows.select(F.lit(name).alias("side"), "stock_id", "gain")
    return neat(side("leader", K.leaders(gain, "gain", "stock_id", 7)).union(side("hotspot", K.leaders(gain, "gain", "stock_id", 7, False))))


@_register(f"""WITH {S.full()}
SELECT stock_id, target_month, model, round(predicted_revenue, 4) AS predicted_revenue FROM pred
QUALIFY row_number() OVER (PARTITION BY stock_id, target_month ORDER BY CASE WHEN model = 'formula' AND predicted_revenue < actual_revenue THEN 0 WHEN model = 'seasonal_naive' THEN 1 ELSE 2 END, model) = 1""")
def preferred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: of each month the formula if it is low, else the seasonal value, else what comes first by name."""
    low = (F.col("model") == "formula") & (F.col("predicted_revenue") < F.col("actual_revenue"))
    rows = K.first_by_preference(predictions(spark, sf_dir), ["stock_id", "target_month"], [low, F.col("model") == "seasonal_naive"], "model")
    return neat(rows.select("stock_id", "target_month", "model", "predicted_revenue"), 4)


@_register(f"""WITH {S.panel()}, k AS (SELECT *, md5(concat_ws('|', stock_id, revenue_year, revenue_month, '42')) AS h FROM panel)
SELECT stock_id, revenue_year, revenue_month FROM k ORDER BY h, stock_id, revenue_year, revenue_month LIMIT 50""")
def sampled_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: the same fifty months every time."""
    return K.fixed_sample(monthly_revenue(spark, sf_dir), ["stock_id", "revenue_year", "revenue_month"], 50).select("stock_id", "revenue_year", "revenue_month")


@_register(f"""WITH {S.MASTER}, r AS (SELECT stock_id, industry_category, row_number() OVER (PARTITION BY industry_category ORDER BY md5(concat_ws('|', stock_id, '42')), stock_id) AS n FROM master)
SELECT stock_id, industry_category FROM r ORDER BY n, industry_category LIMIT 30""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07: thirty entities, one of each industry in turn."""
    return K.round_robin(entity_master(spark, sf_dir), "industry_category", "stock_id", 30).select("stock_id", "industry_category")


@_register(f"""WITH {S.panel()}, k AS (SELECT stock_id, revenue_year, revenue_month, revenue_year = (SELECT max(revenue_year) FROM panel) AS v, md5(concat_ws('|', stock_id, revenue_year, revenue_month, '42')) AS h FROM panel),
r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY h, stock_id, revenue_year, revenue_month) AS n FROM k)
SELECT stock_id, revenue_year, revenue_month, v AS is_validation FROM r WHERE n <= CASE WHEN v THEN 20 ELSE 80 END""")
def forward_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08: a hundred months, of which a fifth of the latest year."""
    return K.forward_split(monthly_revenue(spark, sf_dir), "revenue_year", ["stock_id", "revenue_year", "revenue_month"], 100).select("stock_id", "revenue_year", "revenue_month", "is_validation")


@_register(f"""WITH {S.full()}, {S.MASTER}, v AS (SELECT industry_category, model, sum(abs(predicted_revenue - actual_revenue)) / nullif(sum(abs(actual_revenue)), 0) * 100 AS w FROM pred LEFT JOIN master ON pred.stock_id = master.stock_id GROUP BY 1, 2)
SELECT industry_category, model, round(w, 6) AS WMAPE FROM v QUALIFY row_number() OVER (PARTITION BY industry_category ORDER BY w NULLS LAST, model) = 1""")
def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-09: the best model of each industry."""
    rows = M.accuracy(predictions(spark, sf_dir).join(entity_master(spark, sf_dir), "stock_id", "left"), "industry_category", "model")
    return neat(K.best_per(rows, "industry_category", "WMAPE", "model").select("industry_category", "model", "WMAPE"))


@_register(f"""WITH {S.full()}, o AS (SELECT stock_id, target_month FROM pred WHERE model = 'formula' AND NOT (stock_id % 5 = 0 AND target_month > 9))
SELECT 'predictions' AS source, count(*) AS rows, count(*) AS with_prediction FROM pred WHERE model = 'formula' UNION ALL SELECT 'failures', (SELECT count(*) * 12 FROM supplier) - (SELECT count(*) FROM o), 0""")
def predictions_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, SET-03: predictions in one frame with rows for the requested months that lack one."""
    rows = _formula(spark, sf_dir).select(F.lit("predictions").alias("source"), "stock_id", "target_month", "predicted_revenue")
    wanted = entity_master(spark, sf_dir).select("stock_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("target_month"))
    gaps = K.members(wanted, rows.where("not (stock_id % 5 = 0 and target_month > 9)"), ["stock_id", "target_month"], inside=False).withColumn("source", F.lit("failures"))
    return Q.union_all([rows, gaps]).groupBy("source").agg(F.count("*").alias("rows"), F.count("predicted_revenue").alias("with_prediction"))


@_register(f"""WITH {S.full()}, b AS (SELECT 'absent' AS model, 'missing model' AS issue, 1 AS rows UNION ALL SELECT 'formula', 'duplicate keys', count(*) FROM pred WHERE model = 'formula' AND target_month = 2
UNION ALL SELECT '*', 'conflicting actuals', count(*) FROM (SELECT DISTINCT stock_id FROM pred WHERE model = 'formula' AND target_month = 2)) SELECT * FROM b WHERE rows > 0""")
def cohort_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09, SET-03: a model that is missing, keys that repeat, actuals that disagree."""
    rows = predictions(spark, sf_dir)
    again = rows.where("model = 'formula' and target_month = 2").withColumn("actual_revenue", F.col("actual_revenue") + 1)
    return K.cohort_issues(rows.union(again), ["formula", "absent"])


# Evidence


@_register(f"""WITH {S.DIVIDENDS} SELECT stock_id, fiscal_year, round(sum(TotalCashDividend), 6) AS cash_dividend, CAST(min(year(ex_dividend_date)) AS INTEGER) AS min_ex_year, CAST(max(year(ex_dividend_date)) AS INTEGER) AS max_ex_year,
min(available_date) AS min_available_date, max(available_date) AS max_available_date, bool_or(available_date > {S.AS_OF}) AS uses_later_evidence FROM dv GROUP BY 1, 2""")
def cash_by_fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    return neat(FI.annual_cash(dividends(spark, sf_dir), AS_OF))


@_register(f"""WITH {S.DIVIDENDS}, e AS (SELECT stock_id, sum(TotalCashDividend) AS e FROM dv WHERE year(ex_dividend_date) = 1998 GROUP BY 1), f AS (SELECT stock_id, sum(TotalCashDividend) AS f FROM dv WHERE fiscal_year = 1998 GROUP BY 1)
SELECT stock_id, round(e, 6) AS ex_year_cash_dividend, round(f, 6) AS fiscal_cash_dividend FROM e FULL JOIN f USING (stock_id)""")
def dual_basis_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27."""
    return neat(FI.dual_basis_dividends(dividends(spark, sf_dir), 1998))


@_register(f"""WITH {S.EPS}, a AS (SELECT stock_id, eps_year, sum(EPS) AS v, count(DISTINCT eps_quarter) AS q FROM eps GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4)
SELECT stock_id, eps_year, round(v, 6) AS annual_eps FROM a WHERE eps_year <= 1997 QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY eps_year DESC) = 1""")
def latest_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPS-06."""
    return neat(FI.latest_annual_eps(FI.annual_eps(quarterly_eps(spark, sf_dir)), 1997).select("stock_id", "eps_year", "annual_eps"))


_EVIDENCE = {"announcement_safe": f"available_date <= {S.AS_OF}", "ex_date_safe": f"ex_dividend_date <= {S.AS_OF}", "current_system": "true"}


@_register(f"""WITH {S.EPS}, {S.DIVIDENDS}, ae AS (SELECT stock_id, eps_year, sum(EPS) AS e FROM eps GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4),
{', '.join(f"{m} AS (SELECT stock_id, fiscal_year, sum(TotalCashDividend) AS c, bool_or(available_date > {S.AS_OF}) AS late FROM dv WHERE {w} GROUP BY 1, 2)" for m, w in _EVIDENCE.items())}
{' UNION ALL '.join(f"SELECT '{m}' AS evidence_mode, t.stock_id, fiscal_year, round(least(greatest(c / e, 0), 1.5), 6) AS payout_ratio, {'late' if m == 'current_system' else 'false'} AS is_hindsight FROM {m} t JOIN ae ON t.stock_id = ae.stock_id AND fiscal_year = eps_year WHERE e > 0 AND c >= 0" for m in _EVIDENCE)}""")
def payout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV-03: payout ratios under the three kinds of evidence."""
    eps, paid = FI.annual_eps(quarterly_eps(spark, sf_dir)), dividends(spark, sf_dir)
    parts = [FI.payout_history(paid, eps, AS_OF, mode).select(F.lit(mode).alias("evidence_mode"), "stock_id", "fiscal_year", "payout_ratio", "is_hindsight") for mode in _EVIDENCE]
    return neat(Q.union_all(parts))


@_register(f"""WITH {S.full()}, e AS (SELECT model, abs(predicted_revenue - actual_revenue) / abs(actual_revenue) AS v FROM pred WHERE actual_revenue <> 0)
{' UNION ALL '.join(f"SELECT {k} AS model, count(v) AS rows, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max FROM e{g}" for k, g in (("'all'", ""), ("model", " GROUP BY model")))}""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: percentage errors overall and by model."""
    rows = predictions(spark, sf_dir).where("actual_revenue <> 0").withColumn("v", F.abs(F.col("predicted_revenue") - F.col("actual_revenue")) / F.abs("actual_revenue"))
    return neat(M.score_distribution(rows, "v", "model"))


@_register(f"""WITH {S.EPS}, {S.panel()}, ae AS (SELECT stock_id, eps_year, sum(EPS) AS e FROM eps GROUP BY 1, 2 HAVING count(DISTINCT eps_quarter) >= 4),
ar AS (SELECT stock_id, revenue_year, sum(revenue) AS r FROM panel GROUP BY 1, 2 HAVING count(DISTINCT revenue_month) >= 12), h AS (SELECT ar.stock_id, revenue_year, r, e, e / r AS x FROM ar JOIN ae ON ar.stock_id = ae.stock_id AND revenue_year = eps_year WHERE r > 0)
SELECT stock_id, revenue_year, round(lag(r) OVER w, 4) AS prev_revenue, round(lag(e) OVER w, 6) AS prev_eps, round((x - lag(x) OVER w) * 1e6, 3) AS ratio_change_millionths FROM h WINDOW w AS (PARTITION BY stock_id ORDER BY revenue_year)""")
def lagged_annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16."""
    from tidemark.operators.learned import lagged_annual

    rows, _ = lagged_annual(FI.ratio_history(monthly_revenue(spark, sf_dir), FI.annual_eps(quarterly_eps(spark, sf_dir))))
    return rows.select("stock_id", "revenue_year", F.round("prev_revenue", 4).alias("prev_revenue"), F.round("prev_eps", 6).alias("prev_eps"), F.round(F.col("ratio_change") * 1e6, 3).alias("ratio_change_millionths"))


@_register("""SELECT s_suppkey AS stock_id, CASE WHEN s_suppkey % 3 = 0 THEN 0.1 ELSE least(greatest(s_acctbal / 5000, 0), 1) END AS margin, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE least(greatest(s_acctbal / 4000, 0), 1.5) END AS payout_ratio,
CASE WHEN s_suppkey % 3 = 0 THEN 'default' ELSE 'policy' END AS policy_source FROM supplier""")
def dividend_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIV-11: margins and payouts out of bounds are clipped, missing ones are the default."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("stock_id"), (F.col("s_acctbal") / 5000).alias("margin"), (F.col("s_acctbal") / 4000).alias("payout_ratio"))
    return FI.policy_payout(entity_master(spark, sf_dir), rows)
