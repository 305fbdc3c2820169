"""Raw files, sinks and the operators of reports on small fixtures."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import learned as L
from tidemark.operators import metrics as M
from tidemark.operators import quality as Q
from tidemark.sources import adapters
from tidemark.sources import readers as R

FILES = {
    "info/all.csv": "industry_category,stock_id,stock_name,type,date\nfood,1101,old,twse,2020-01-01\ncement,1101,new,twse,2024-01-01\nx,no id,bad,twse,2024-01-01\n",
    "revenue/1101.csv": "date,stock_id,country,revenue,revenue_month,revenue_year,create_time\n2024-02-01,1101,T,1000,1,2024,\n2025-02-01,1101,T,1500,1,2025,\n2025-02-02,1101,T,\"1,600\",1,2025,\n2025-03-01,1101,T,oops,2,2025,\n2025-03-01,1101,T,9,13,2025,\n",
    "revenue/1102.csv": "date,stock_id,country,revenue,revenue_month,revenue_year,create_time\n",
    "statements/1101.csv": "date,stock_id,type,value,origin_name\n2025-03-31,1101,EPS,1.5,eps\n2025-06-30,1101,EPS,2,eps\n2025-09-30,1101,EPS,2.5,eps\n2025-12-31,1101,EPS,3,eps\n2025-12-31,1101,Revenue,9,rev\n",
    "dividends/1101.csv": "date,stock_id,year,StockEarningsDistribution,CashEarningsDistribution,CashStatutorySurplus,CashExDividendTradingDate,AnnouncementDate\n"
    "2024-01-01,1101,113年,0,1.5,,2025-07-01,2025-03-01\n2024-01-01,1101,113年後半年度,0,,0.5,2025-08-01,\n2024-01-01,1101,113年第4季,0,,,,\n2024-01-01,1101,不適用,0,9,,,\n",
    "prices/1101.csv": "date,stock_id,open,max,min,close\n2024-12-31,1101,79,81,78,80\n2025-01-02,1101,1,1,1,\n2019-01-02,1101,1,1,1,5\n",
}
COLUMNS = {
    "info": ["industry_category", "stock_id", "stock_name", "date"], "revenue": ["date", "stock_id", "revenue", "revenue_month", "revenue_year"], "statements": ["date", "stock_id", "type", "value"],
    "dividends": ["stock_id", "year", "CashEarningsDistribution", "CashStatutorySurplus", "CashExDividendTradingDate", "AnnouncementDate"], "prices": ["date", "stock_id", "open", "max", "min", "close"],
}


@pytest.fixture(scope="module")
def canonical(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    raw = {name: R.text_csv(spark, f"file://{root}/{name}", columns) for name, columns in COLUMNS.items()}
    assert {r.file_stock_id for r in raw["revenue"].collect()} == {1101}
    return R.raw_to_canonical(raw, 2024, 2025)


def test_raw_files_become_canonical_datasets(canonical):
    assert [tuple(r) for r in canonical["stock_list"].collect()] == [(1101, "new", "cement")]
    revenue = {(r.revenue_year, r.revenue_month): (r.revenue_thousand, r.revenue_available_date) for r in canonical["revenue"].collect()}
    assert revenue == {(2024, 1): (1.0, dt.date(2024, 2, 10)), (2025, 1): (1.6, dt.date(2025, 2, 10))}
    eps = {r.eps_quarter: (r.EPS, r.statement_available_date) for r in canonical["eps"].collect()}
    assert eps == {1: (1.5, dt.date(2025, 5, 15)), 2: (2.0, dt.date(2025, 8, 14)), 3: (2.5, dt.date(2025, 11, 14)), 4: (3.0, dt.date(2026, 3, 31))}
    paid = {r.year: (r.fiscal_year, r.TotalCashDividend, r.available_date, r.dividend_available_source) for r in canonical["dividends"].collect()}
    assert paid == {"113年": (2024, 1.5, dt.date(2025, 3, 1), "announcement"), "113年後半年度": (2024, 0.5, dt.date(2025, 8, 1), "ex_date"), "113年第4季": (2024, 0.0, None, "unknown")}
    assert [(r.date, r.close) for r in canonical["daily_prices"].collect()] == [(dt.date(2024, 12, 31), 80.0)]


def test_datasets_are_written_only_if_the_contract_holds(spark, canonical, tmp_path):
    assert R.write_validated(canonical, f"file://{tmp_path}/bad", spark, {"stock_list": 2}).count() == 1
    assert not (tmp_path / "bad").exists()
    assert R.write_validated(canonical, f"file://{tmp_path}/good", spark, {"stock_list": 1}).count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/good/revenue").count() == 2


def test_artifacts_documents_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, float("nan"), "a"), (1, 2, 2.5, "a"), (2, 1, 1.0, "b"), (3, 1, None, "c")], "stock_id long, month int, value double, label string")
    built = []
    for _ in range(2):
        out = R.load_or_build(spark, f"file://{tmp_path}/artifact", lambda: built.append(1) or rows)
    assert out.count() == 4 and len(built) == 1
    found = {r.stock_id: json.loads(r.document) for r in R.entity_documents(rows, "stock_id", ["month"], ["month", "value"]).collect()}
    assert found[1] == {"stock_id": 1, "rows": [{"month": 1, "value": None}, {"month": 2, "value": 2.5}]}
    R.write_partitioned(rows, f"file://{tmp_path}/parts", "label")
    assert sorted(p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()) == ["label=a", "label=b", "label=c"]
    ids = rows.select("stock_id").distinct()
    assert [r[0] for r in R.not_done(ids, rows.where("stock_id = 1"), rows.where("stock_id = 3")).collect()] == [2]


def test_fingerprints_tell_repeated_rows_and_not_their_order(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 3)], "stock_id long, v long")
    mark = lambda df: df.transform(lambda d: Q.fingerprint(d, "stock_id", "v")).first()
    assert mark(rows) == mark(rows.orderBy(F.desc("v"))) and mark(rows).fingerprint != mark(rows.where("v = 3")).fingerprint
    assert Q.column_presence(rows, rows.drop("v").withColumn("w", F.lit(1))).where("in_baseline <> in_candidate").count() == 2


def test_years_without_a_lunar_date_are_null(spark):
    rows = spark.createDataFrame([(2024, 2), (2024, 3), (1999, 2), (None, 1)], "y int, m int")
    assert [r[0] for r in rows.select(X.lunar_new_year(F.col("y"), F.col("m"))).collect()] == [1, 0, None, None]


def test_ranks_by_blocks_match_a_sort(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 97).cast("double").alias("v")).repartition(5)
    got = {r.id: (r["rank"], r["tile"]) for r in M.ranked(rows, "v", "id", 7).collect()}
    order = sorted(range(1000), key=lambda i: (i * 7919 % 97, i))
    sizes = [1000 // 7 + (k < 1000 % 7) for k in range(7)]
    tiles = [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
    assert got == {i: (k + 1, tiles[k]) for k, i in enumerate(order)}


def test_hurdles_learn_from_earlier_years_only(spark):
    rows = [(s, y, 1.0 + s % 3, 1.0 + s % 3, 1.0, 0.9 if s % 2 else 0.1, 3, 1.0, 4.0, 10.0, float(s % 2) * (1 + s % 3)) for s in range(40) for y in (1998, 1999, 2000)]
    samples = spark.createDataFrame(rows, "stock_id int, target_year int, last_known_cash_dividend double, recent_cash_dividend_median double, recent_cash_dividend_smoothed double, recent_paid_rate double, dividend_history_count int, latest_available_eps double, available_eps_ttm double, known_revenue_ltm double, actual_cash_dividend double")
    pick = lambda df: sorted((r.stock_id, r.threshold, r.dividend_method, round(r.estimated_cash_dividend, 6)) for r in L.hurdle_dividends(df, 2000).collect())
    poisoned = samples.withColumn("actual_cash_dividend", F.when(F.col("target_year") == 2000, 1e6).otherwise(F.col("actual_cash_dividend")))
    assert pick(samples) == pick(poisoned) and len(pick(samples)) == 40 * len(L.THRESHOLDS) and {m for _, _, m, _ in pick(samples)} >= {"direct_hurdle_ridge_t025", "direct_hurdle_ridge_t060"}
    # Nobody ever paid, and no history at all: constants.
    assert {x[3] for x in pick(samples.withColumn("actual_cash_dividend", F.lit(0.0)))} == {0.0}
    assert {x[3] for x in pick(samples.where("target_year = 2000"))} == {0.0}


def test_sets_by_content_id(spark, tmp_path):
    from tidemark.sources import artifacts as A

    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.0), (2, None, 2.0)], "id long, name string, x double")
    shuffled = rows.orderBy(F.desc("id")).repartition(3).select("x", "id", "name")
    assert A.rows_id(rows) == A.rows_id(shuffled)
    others = [rows.distinct(), rows.withColumn("x", F.col("x").cast("float")), rows.withColumnRenamed("x", "y"), spark.createDataFrame([(1, None, None), (2, "a", 2.0), (2, None, 2.0)], rows.schema), rows.where("id > 9")]
    assert len({A.rows_id(x) for x in [rows, *others]}) == 6

    built, root = [], f"file://{tmp_path}/sets"
    inputs = {"rows": rows}

    def get(**parameters):
        def build():
            built.append(parameters)
            return {"kept": rows.where(F.col("id") >= parameters["least"]), "counts": rows.groupBy("id").count()}

        return A.load_or_build_set(spark, root, inputs, parameters, build)

    assert get(least=2)["kept"].count() == 2 and get(least=2)["counts"].count() == 2 and len(built) == 1
    assert get(least=1)["kept"].count() == 3 and len(built) == 2  # other parameters, other tables
    inputs = {"rows": shuffled}
    assert get(least=1)["kept"].count() == 3 and len(built) == 2  # other order, same tables
    inputs = {"rows": rows.where("id = 2")}
    assert get(least=1)["kept"].count() == 3 and len(built) == 3  # other rows


def test_half_written_set_is_rebuilt(spark, tmp_path):
    from tidemark.sources import artifacts as A

    rows, root = spark.range(5).toDF("id"), f"file://{tmp_path}/sets"

    def dies():
        rows.write.parquet(f"{root}/.draft-{A.content_id({'r': rows}, {})}-x/kept")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        A.load_or_build_set(spark, root, {"r": rows}, {}, dies)
    fails_late = lambda: {"kept": rows, "bad": rows.select(F.raise_error(F.lit("late")).alias("e"))}
    with pytest.raises(Exception, match="late"):
        A.load_or_build_set(spark, root, {"r": rows}, {}, fails_late)
    assert not A.published(spark, root, A.content_id({"r": rows}, {}))
    assert A.load_or_build_set(spark, root, {"r": rows}, {}, lambda: {"kept": rows})["kept"].count() == 5
    assert A.drop_drafts(spark, root) == 2 and A.load_or_build_set(spark, root, {"r": rows}, {}, dies)["kept"].count() == 5


def test_late_writer_takes_the_published_set(spark, tmp_path):
    from tidemark.sources import artifacts as A

    rows, root = spark.range(5).toDF("id"), f"file://{tmp_path}/sets"

    def slow():
        A.load_or_build_set(spark, root, {"r": rows}, {}, lambda: {"kept": rows})
        return {"kept": rows}

    assert A.load_or_build_set(spark, root, {"r": rows}, {}, slow)["kept"].count() == 5 and A.drop_drafts(spark, root) == 0


def test_partitions_of_a_panel_follow_the_size_of_its_facts(spark, tmp_path, monkeypatch):
    from tidemark.sources import adapters as A

    rows = [(k % 7, k % 5, dt.datetime(1999, 1 + k % 12, 3), 10.0 + k, 0.1) for k in range(300)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_shipdate timestamp, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    small = A.monthly_revenue(spark, str(tmp_path))
    monkeypatch.setattr(A, "PANEL_BYTES", 100)
    large = A.monthly_revenue(spark, str(tmp_path))
    size = sum(p.stat().st_size for p in (tmp_path / "lineitem.parquet").iterdir() if not p.name.startswith("."))
    assert large.rdd.getNumPartitions() >= size // 100 > 10 > small.rdd.getNumPartitions()
    assert sorted(large.collect()) == sorted(small.collect())


def test_written_facts_are_the_separate_tables_from_one_pass(spark, tmp_path):
    day = lambda m, d=3: dt.date(1998 + m // 12, m % 12 + 1, d)
    rows = [(s, float(100 * s + 7 * m + k), k / 50, (m + k) % 4 / 50, "ANR"[(m + s + k) % 3], day(m)) for s in range(3) for m in range(0, 20, s + 1) for k in range(3)]
    rows += [(7, None, 0.1, 0.1, "A", day(1)), (7, 5.0, 0.1, 0.2, None, day(2)), (8, 5.0, 0.1, 0.2, "A", None), (None, 5.0, 0.1, 0.2, "A", day(5))]
    kinds = "l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = adapters.written_facts(spark, str(tmp_path))
    for name, made in (("revenue", adapters.monthly_revenue), ("quarterly", adapters.quarterly_eps), ("dividends", adapters.dividends)):
        want = made(spark, str(tmp_path))
        assert facts[name].dtypes == want.dtypes and not any("lineitem" in f for f in facts[name].inputFiles())
        assert sorted(map(repr, facts[name].collect())) == sorted(map(repr, want.collect()))
