"""From monthly revenue to earnings, dividends and yields, with nothing that was unknown at the cut-off date.

Panels: revenue (stock_id, revenue_year, revenue_month, revenue); quarterly EPS (stock_id, eps_year, eps_quarter, EPS,
statement_available_date); dividends (stock_id, fiscal_year, TotalCashDividend, available_date, ex_dividend_date); prices
(stock_id, date, close); predictions (model, stock_id, target_year, target_month, predicted_revenue).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import median_of_sorted, quarter_of, weighted_recent
from tidemark.operators.asof import history_known
from tidemark.sources.artifacts import settled

ID = "stock_id"


def available(rows: DataFrame, date: str, as_of: str) -> DataFrame:
    """JON-03: rows that were public on the cut-off date; rows without a date never were."""
    return rows.where(F.col(date).isNotNull() & (F.col(date) <= F.lit(as_of).cast("date")))


def newest(rows: DataFrame, keys: list[str], order: str, n: int = 3) -> DataFrame:
    """SRT-02: the ``n`` latest rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def annual_revenue(revenue: DataFrame, months: int = 12) -> DataFrame:
    """AGG-01: totals of complete years."""
    rows = revenue.groupBy(ID, "revenue_year").agg(F.sum("revenue").alias("annual_revenue"), F.count_distinct("revenue_month").alias("month_count"))
    return rows.where(F.col("month_count") >= months)


def quarterly_revenue(revenue: DataFrame) -> DataFrame:
    """AGG-02: totals of complete quarters."""
    rows = revenue.groupBy(ID, "revenue_year", quarter_of(F.col("revenue_month")).alias("eps_quarter")).agg(F.sum("revenue").alias("quarter_revenue"), F.count_distinct("revenue_month").alias("month_count"))
    return rows.where("month_count >= 3")


def annual_eps(quarterly: DataFrame, as_of: str | None = None, count_rows: bool = False) -> DataFrame:
    """AGG-03, AGG-30: EPS of years with four quarters (distinct ones, or rows with ``count_rows``) and when the last became public."""
    rows = available(quarterly, "statement_available_date", as_of) if as_of else quarterly
    quarters = F.count("*") if count_rows else F.count_distinct("eps_quarter")
    out = rows.where(F.col("EPS").isNotNull()).groupBy(ID, "eps_year").agg(F.sum("EPS").alias("annual_eps"), quarters.alias("quarter_count"), F.max("statement_available_date").alias("latest_available_date"))
    return out.where("quarter_count >= 4")


def annual_cash(dividends: DataFrame, as_of: str | None = None) -> DataFrame:
    """AGG-04: cash dividend by fiscal year with the span of its ex-dates and of its announcements, and whether any came after the cut-off."""
    known = dividends.where(F.col("fiscal_year").isNotNull())
    late = F.max((F.col("available_date") > F.lit(as_of).cast("date")).cast("int")) if as_of else F.lit(0)
    return known.groupBy(ID, "fiscal_year").agg(
        F.sum("TotalCashDividend").alias("cash_dividend"),
        F.min(F.year("ex_dividend_date")).alias("min_ex_year"),
        F.max(F.year("ex_dividend_date")).alias("max_ex_year"),
        F.min("available_date").alias("min_available_date"),
        F.max("available_date").alias("max_available_date"),
        F.coalesce(late, F.lit(0)).cast("boolean").alias("uses_later_evidence"),
    )


def actual_dividend(dividends: DataFrame, target_year: int) -> DataFrame:
    """AGG-29: cash of the ex-dates of a year; entities without any are absent."""
    return dividends.where(F.year("ex_dividend_date") == target_year).groupBy(ID).agg(F.sum("TotalCashDividend").alias("actual_cash_dividend"))


def dual_basis_dividends(dividends: DataFrame, target_year: int) -> DataFrame:
    """AGG-27: the year's cash by ex-date and by fiscal year side by side."""
    fiscal = dividends.where(F.col("fiscal_year") == target_year).groupBy(ID).agg(F.sum("TotalCashDividend").alias("fiscal_cash_dividend"))
    return actual_dividend(dividends, target_year).withColumnRenamed("actual_cash_dividend", "ex_year_cash_dividend").join(fiscal, ID, "full")


def annual_predictions(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG-05: (annual rows, failure rows): a year needs twelve distinct finite months."""
    finite = F.col("predicted_revenue").isNotNull() & ~F.isnan("predicted_revenue") & (F.abs("predicted_revenue") < float("inf"))
    rows = predictions.groupBy("model", ID, "target_year").agg(
        F.sum(F.when(finite, F.greatest(F.col("predicted_revenue"), F.lit(0.0)))).alias("predicted_annual_revenue"),
        F.count("*").alias("_rows"), F.count_distinct("target_month").alias("_months"), F.count_if(~finite).alias("_bad"),
    )
    reason = F.when(F.col("_rows") > F.col("_months"), "duplicate months").when(F.col("_bad") > 0, "non-finite prediction").when(F.col("_months") < 12, "incomplete year")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("_rows", "_months", "_bad", "reason"), rows.where("reason is not null").select("model", ID, "target_year", "reason", F.col("_months").alias("months"))


def ratio_history(revenue: DataFrame, eps: DataFrame) -> DataFrame:
    """Complete years with both revenue and EPS, and EPS per unit of revenue."""
    rows = annual_revenue(revenue).join(eps.withColumnRenamed("eps_year", "revenue_year"), [ID, "revenue_year"])
    return rows.where("annual_revenue > 0 and annual_eps is not null").withColumn("eps_to_revenue_ratio", F.col("annual_eps") / F.col("annual_revenue"))


def eps_by_ratio(annual: DataFrame, history: DataFrame) -> DataFrame:
    """EPS-01: predicted revenue times the median ratio of the last three complete years."""
    recent = newest(history, [ID], "revenue_year").groupBy(ID).agg(F.percentile("eps_to_revenue_ratio", 0.5).alias("eps_to_revenue_ratio"), F.max("revenue_year").alias("eps_reference_year"))
    rows = annual.join(recent, ID, "left")
    return rows.withColumns({"eps_method": F.lit("current_ratio"), "estimated_eps": F.col("predicted_annual_revenue") * F.col("eps_to_revenue_ratio"), "status": F.when(F.col("eps_to_revenue_ratio").isNull(), "EPS unavailable").otherwise("ok")})


def eps_by_quarter(annual: DataFrame, monthly: DataFrame, revenue: DataFrame, quarterly: DataFrame, history: DataFrame, strict: bool = True) -> DataFrame:
    """EPS-02: same-quarter ratio medians with the annual ratio where a quarter has none; ``strict`` needs all four quarters."""
    quarters = quarterly_revenue(revenue).join(quarterly.select(ID, F.col("eps_year").alias("revenue_year"), "eps_quarter", "EPS"), [ID, "revenue_year", "eps_quarter"])
    quarters = quarters.where("quarter_revenue > 0 and EPS is not null").withColumn("_r", F.col("EPS") / F.col("quarter_revenue"))
    seasonal = newest(quarters, [ID, "eps_quarter"], "revenue_year").groupBy(ID, "eps_quarter").agg(F.percentile("_r", 0.5).alias("_r"), F.max("revenue_year").alias("_y"))
    fallback = newest(history, [ID], "revenue_year").groupBy(ID).agg(F.percentile("eps_to_revenue_ratio", 0.5).alias("_a"))
    target = monthly.groupBy("model", ID, "target_year", quarter_of(F.col("target_month")).alias("eps_quarter")).agg(F.sum("predicted_revenue").alias("_q"))
    used = target.join(seasonal, [ID, "eps_quarter"], "left").join(fallback, ID, "left").withColumn("_used", F.coalesce("_r", "_a"))
    total = used.groupBy("model", ID, "target_year").agg(
        F.sum(F.col("_q") * F.col("_used")).alias("_eps"), F.count("_used").alias("used_quarters"), F.count_if(F.col("_r").isNull()).alias("fallback_quarters"), F.max("_y").alias("eps_reference_year"),
    )
    rows = annual.join(total, ["model", ID, "target_year"], "left")
    enough = F.coalesce(F.col("used_quarters") >= (4 if strict else 1), F.lit(False))
    return rows.withColumns({
        "eps_method": F.lit("seasonal_quarter_median"),
        "estimated_eps": F.when(enough, F.col("_eps")),
        "eps_to_revenue_ratio": F.when(enough & (F.col("predicted_annual_revenue") > 0), F.col("_eps") / F.col("predicted_annual_revenue")),
        "status": F.when(enough, "ok").otherwise("EPS unavailable"),
    }).drop("_eps")


def eps_known_quarters(annual: DataFrame, monthly: DataFrame, revenue: DataFrame, quarterly: DataFrame, history: DataFrame, target_year: int, as_of: str) -> DataFrame:
    """EPS-03: published quarters as they are, the others by seasonal or annual ratio; one row a quarter with its basis."""
    published = available(quarterly, "statement_available_date", as_of).where(F.col("eps_year") == target_year).select(ID, "eps_quarter", F.col("EPS").alias("actual_eps"))
    quarters = quarterly_revenue(revenue).join(available(quarterly, "statement_available_date", as_of).select(ID, F.col("eps_year").alias("revenue_year"), "eps_quarter", "EPS"), [ID, "revenue_year", "eps_quarter"]).where("quarter_revenue > 0")
    seasonal = newest(quarters.withColumn("_r", F.col("EPS") / F.col("quarter_revenue")), [ID, "eps_quarter"], "revenue_year").groupBy(ID, "eps_quarter").agg(F.percentile("_r", 0.5).alias("_r"))
    fallback = newest(history, [ID], "revenue_year").groupBy(ID).agg(F.percentile("eps_to_revenue_ratio", 0.5).alias("_a"))
    target = monthly.groupBy("model", ID, "target_year", quarter_of(F.col("target_month")).alias("eps_quarter")).agg(F.sum("predicted_revenue").alias("_q"))
    rows = annual.select("model", ID, "target_year").withColumn("eps_quarter", F.explode(F.sequence(F.lit(1), F.lit(4)))).join(target, ["model", ID, "target_year", "eps_quarter"], "left")
    rows = rows.join(published, [ID, "eps_quarter"], "left").join(seasonal, [ID, "eps_quarter"], "left").join(fallback, ID, "left")
    value = F.coalesce("actual_eps", F.col("_q") * F.col("_r"), F.col("_q") * F.col("_a"))
    basis = F.when(F.col("actual_eps").isNotNull(), "actual").when((F.col("_q") * F.col("_r")).isNotNull(), "seasonal").when((F.col("_q") * F.col("_a")).isNotNull(), "annual").otherwise("unavailable")
    return rows.select("model", ID, "target_year", "eps_quarter", value.alias("estimated_eps"), basis.alias("basis"))


def latest_annual_eps(eps: DataFrame, fiscal_year: int) -> DataFrame:
    """EPS-06: the latest complete year at or before ``fiscal_year``."""
    return newest(eps.where(F.col("eps_year") <= fiscal_year), [ID], "eps_year", 1)


def payout_history(dividends: DataFrame, eps: DataFrame, as_of: str, mode: str = "announcement_safe") -> DataFrame:
    """DIV-03: payout ratios (0 to 1.5) of years with positive EPS. Modes: announcement_safe (public by the cut-off), ex_date_safe
    (paid by it) and current_system (all years; marked as hindsight where it uses later evidence)."""
    cut = F.lit(as_of).cast("date")
    use = {"announcement_safe": F.col("available_date") <= cut, "ex_date_safe": F.col("ex_dividend_date") <= cut, "current_system": F.lit(True)}[mode]
    cash = annual_cash(dividends.where(F.coalesce(use, F.lit(False))), as_of)
    rows = cash.join(eps.select(ID, F.col("eps_year").alias("fiscal_year"), "annual_eps"), [ID, "fiscal_year"]).where("annual_eps > 0 and cash_dividend >= 0")
    return rows.withColumns({"payout_ratio": F.least(F.greatest(F.col("cash_dividend") / F.col("annual_eps"), F.lit(0.0)), F.lit(1.5)), "is_hindsight": F.lit(mode == "current_system") & F.col("uses_later_evidence")})


def cross_sectional_payout(history: DataFrame) -> DataFrame:
    """AGG-11: the median over entities of their median payout: one row."""
    return history.groupBy(ID).agg(F.percentile("payout_ratio", 0.5).alias("_m")).agg(F.percentile("_m", 0.5).alias("cross_payout"))


def dividend_by_payout(eps: DataFrame, history: DataFrame) -> DataFrame:
    """DIV-01: EPS times the median payout of the last three years, or that of all entities; at least 0."""
    own = newest(history, [ID], "fiscal_year").groupBy(ID).agg(F.percentile("payout_ratio", 0.5).alias("own_payout"), F.max("fiscal_year").alias("dividend_reference_year"))
    # One row, whatever the data: safe to broadcast.
    rows = eps.join(own, ID, "left").join(F.broadcast(cross_sectional_payout(history).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left").drop("_one")
    payout = F.coalesce("own_payout", "cross_payout")
    return rows.withColumns({
        "dividend_method": F.lit("announcement_safe_payout"),
        "payout_ratio": payout,
        "estimated_cash_dividend": F.when(F.col("estimated_eps").isNotNull() & payout.isNotNull(), F.greatest(F.col("estimated_eps") * payout, F.lit(0.0))),
        "dividend_source": F.when(F.col("own_payout").isNotNull(), "own payout").when(F.col("cross_payout").isNotNull(), "cross-sectional payout").otherwise("unavailable"),
    })


def cash_history_dividends(dividends: DataFrame, as_of: str, mode: str = "announcement_safe") -> DataFrame:
    """DIV-02: last, median and 0.5/0.3/0.2 weighted cash of the last three announced years (with ex_date_safe: paid years), one row each."""
    cash = available(dividends, {"announcement_safe": "available_date", "ex_date_safe": "ex_dividend_date"}[mode], as_of).where("fiscal_year is not null").groupBy(ID, "fiscal_year").agg(F.sum("TotalCashDividend").alias("cash_dividend"))
    recent = newest(cash.where("cash_dividend is not null"), [ID], "fiscal_year").groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("fiscal_year", "cash_dividend")), False).alias("_h"))
    values = F.transform("_h", lambda x: x["cash_dividend"])
    wide = recent.select(ID, F.get("_h", F.lit(0))["fiscal_year"].alias("dividend_reference_year"), F.get(values, F.lit(0)).alias(f"{mode}_last"), median_of_sorted(F.array_sort(values)).alias(f"{mode}_median"), weighted_recent(values).alias(f"{mode}_smoothed"))
    return wide.unpivot([ID, "dividend_reference_year"], [f"{mode}_{k}" for k in ("last", "median", "smoothed")], "dividend_method", "estimated_cash_dividend")


def five_years(entities: DataFrame, eps: DataFrame, dividends: DataFrame, as_of: str) -> DataFrame:
    """DIV-05, JON-13, AGG-12: entity by year scaffold of the five years before the cut-off with EPS, cash, payout and why a year is left out.

    A year with any negative or missing instalment has no cash total.
    """
    year = int(as_of[:4])
    public = available(dividends, "available_date", as_of)
    valid = F.col("TotalCashDividend").isNotNull() & ~F.isnan("TotalCashDividend") & (F.col("TotalCashDividend") >= 0)
    cash = public.groupBy(ID, "fiscal_year").agg(F.when(F.bool_and(valid), F.sum("TotalCashDividend")).alias("cash_dividend"))
    known = eps.where(F.col("latest_available_date") <= F.lit(as_of).cast("date")).select(ID, F.col("eps_year").alias("fiscal_year"), "annual_eps")
    grid = entities.select(ID).distinct().withColumn("fiscal_year", F.explode(F.sequence(F.lit(year - 5), F.lit(year - 1))))
    rows = grid.join(cash, [ID, "fiscal_year"], "left").join(known, [ID, "fiscal_year"], "left")
    reason = F.when(F.col("annual_eps").isNull(), "incomplete EPS").when(F.col("annual_eps") <= 0, "EPS not positive").when(F.col("cash_dividend").isNull(), "cash missing or invalid").otherwise("used")
    rows = rows.withColumn("reason", reason)
    return rows.withColumns({"included": F.col("reason") == "used", "payout_ratio": F.when(F.col("reason") == "used", F.col("cash_dividend") / F.col("annual_eps"))})


def dividend_patterns(history: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """DIV-06: fixed, none, normal or insufficient from five years of cash; ``history`` as of :func:`five_years`."""
    c = F.col("cash_dividend")
    rows = history.groupBy(ID).agg(
        F.count(c).alias("cash_history_years"), F.count_if(c > 0).alias("positive_cash_years"), F.count_if(c == 0).alias("zero_cash_years"),
        F.percentile("cash_dividend", 0.5).alias("_median"), F.max("cash_dividend").alias("_max"), F.min("cash_dividend").alias("_min"),
        F.avg("payout_ratio").alias("payout_ratio"), F.count("payout_ratio").alias("payout_valid_years"),
        F.max(F.when(c.isNotNull(), F.col("fiscal_year"))).alias("dividend_reference_year"),
    )
    deviation = F.when(F.col("_median") > 0, F.greatest(F.abs(F.col("_max") / F.col("_median") - 1), F.abs(F.col("_min") / F.col("_median") - 1)))
    rows = rows.withColumn("cash_max_deviation", deviation)
    fixed = (F.col("positive_cash_years") == 5) & (F.col("cash_max_deviation") <= tolerance + 1e-12)
    pattern = F.when(F.col("zero_cash_years") == 5, "none").when(fixed, "fixed").when((F.col("cash_history_years") >= 3) & (F.col("positive_cash_years") > 0), "normal").otherwise("insufficient")
    return rows.withColumns({"dividend_pattern": pattern, "fixed_cash_dividend": F.when(pattern == "fixed", F.col("_median"))}).drop("_median", "_max", "_min")


def dividend_by_pattern(eps: DataFrame, patterns: DataFrame) -> DataFrame:
    """DIV-07: nothing for none, the usual amount for fixed, EPS times mean payout for normal."""
    rows = eps.join(patterns.withColumnRenamed("payout_ratio", "mean_payout").select(ID, "dividend_pattern", "fixed_cash_dividend", "mean_payout"), ID, "left")
    p = F.col("dividend_pattern")
    return rows.withColumn("estimated_cash_dividend", F.when(p == "none", 0.0).when(p == "fixed", F.col("fixed_cash_dividend")).when(p == "normal", F.greatest(F.col("estimated_eps") * F.col("mean_payout"), F.lit(0.0))))


def dividend_chain(entities: DataFrame, dividends: DataFrame, target_year: int) -> DataFrame:
    """DIV-12: cash of the year's ex-dates, else of the fiscal year before, else of the latest earlier ex-year."""
    ex = dividends.groupBy(ID, F.year("ex_dividend_date").alias("y")).agg(F.sum("TotalCashDividend").alias("v"))
    now = ex.where(F.col("y") == target_year).select(ID, F.lit(1).alias("p"), "v", "y")
    fiscal = dividends.where(F.col("fiscal_year") == target_year - 1).groupBy(ID).agg(F.sum("TotalCashDividend").alias("v")).select(ID, F.lit(2).alias("p"), "v", F.lit(target_year - 1).alias("y"))
    before = newest(ex.where(F.col("y") < target_year), [ID], "y", 1).select(ID, F.lit(3).alias("p"), "v", "y")
    best = now.union(fiscal).union(before).where("v is not null").groupBy(ID).agg(F.min(F.struct("p", "v", "y")).alias("b"))
    source = F.element_at(F.array(F.lit("ex_year"), F.lit("fiscal_year"), F.lit("latest_before")), F.col("b.p"))
    return entities.select(ID).distinct().join(best, ID, "left").select(ID, F.col("b.v").alias("cash_dividend"), F.col("b.y").alias("source_year"), F.coalesce(F.when(F.col("b").isNotNull(), source), F.lit("none")).alias("source"))


def price_as_of(prices: DataFrame, as_of: str) -> DataFrame:
    """JON-03: the last close on or before the cut-off."""
    return prices.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy(ID).agg(F.max_by("close", "date").alias("stock_price"), F.max("date").alias("price_date"))


def month_end_prices(prices: DataFrame, target_year: int) -> DataFrame:
    """JON-04, JON-05: last close of each month of the year, carried forward from the month (or the year) before."""
    seen = prices.where(F.year("date") <= target_year)
    month = F.when(F.year("date") == target_year, F.month("date")).otherwise(0)
    last = seen.groupBy(ID, month.alias("target_month")).agg(F.max_by("close", "date").alias("close"), F.max("date").alias("price_date"))
    grid = seen.select(ID).distinct().withColumn("target_month", F.explode(F.sequence(F.lit(0), F.lit(12))))
    w = Window.partitionBy(ID).orderBy("target_month").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(last, [ID, "target_month"], "left")
    rows = rows.withColumns({"stock_price": F.last("close", True).over(w), "price_date": F.last("price_date", True).over(w)})
    return rows.where("target_month > 0").drop("close")


def _yields(rows: DataFrame, mode: str, evaluation: bool, min_price: float) -> DataFrame:
    sound = F.col("stock_price") > min_price
    percent = lambda c: F.when(sound, F.col(c) / F.col("stock_price") * 100)
    actual = percent("actual_cash_dividend") if evaluation else F.lit(None).cast("double")
    rows = rows.withColumns({"yield_mode": F.lit(mode), "estimated_yield_percent": percent("estimated_cash_dividend"), "actual_yield_percent": actual, "is_evaluation": F.lit(evaluation)})
    return rows.withColumn("yield_error_percent_point", F.col("estimated_yield_percent") - F.col("actual_yield_percent"))


def dividend_yields(estimates: DataFrame, prices: DataFrame, target_year: int, as_of: str, min_price: float = 0.0) -> DataFrame:
    """YLD-01: the yield at the cut-off price (deployable) and at each month end of the target year (evaluation)."""
    now = estimates.join(price_as_of(prices, as_of), ID, "left").withColumn("target_month", F.lit(None).cast("int"))
    months = estimates.withColumn("target_month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(month_end_prices(prices, target_year), [ID, "target_month"], "left")
    return _yields(now, "as_of_price", False, min_price).unionByName(_yields(months, "target_month_end", True, min_price))


def reprice(estimates: DataFrame, scenarios: DataFrame, min_price: float = 0.0) -> DataFrame:
    """YLD-02: stored dividends at other prices; ``scenarios``: stock_id, stock_price, price_date."""
    rows = estimates.join(scenarios, ID).withColumn("target_month", F.lit(None).cast("int"))
    return _yields(rows, "scenario_price", False, min_price)


def entry_prices(estimates: DataFrame, yields: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    """YLD-03: the prices at which an estimated dividend yields 7, 8 and 9 percent."""
    return estimates.withColumns({f"entry_price_{y}pct": F.col("estimated_cash_dividend") / (y / 100) for y in yields})


def evidence_status(revenue: DataFrame, quarterly: DataFrame, dividends: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """DQ-12: for each evidence table its latest period, latest publication, rows and whether there is any."""
    def one(name: str, rows: DataFrame, period: Column, public: Column) -> DataFrame:
        found = rows.agg(F.max(period.cast("string")).alias("latest_period"), F.max(public).alias("latest_available"), F.count("*").alias("rows"))
        return found.select(F.lit(name).alias("dataset"), "latest_period", "latest_available", "rows", F.when(F.col("rows") > 0, "ok").otherwise("missing").alias("status"))

    public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1)
    cut = F.lit(as_of).cast("date")
    parts = [
        one("revenue", revenue.where(public <= cut), F.make_date("revenue_year", "revenue_month", F.lit(1)), public),
        one("eps", available(quarterly, "statement_available_date", as_of), F.col("date"), F.col("statement_available_date")),
        one("dividends", available(dividends, "available_date", as_of), F.col("fiscal_year"), F.col("available_date")),
        one("prices", prices.where(F.col("date") <= cut), F.col("date"), F.col("date")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def financial_forecast(predictions: DataFrame, revenue: DataFrame, quarterly: DataFrame, dividends: DataFrame, prices: DataFrame, target_year: int, as_of: str) -> dict[str, DataFrame]:
    """YLD-05: predictions to EPS, dividends and yields in one lazy plan, with failures as rows."""
    public = F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1) <= F.lit(as_of).cast("date")
    past = revenue.where(public)
    annual, failures = annual_predictions(predictions)
    eps_known = available(quarterly, "statement_available_date", as_of)
    eps = annual_eps(quarterly, as_of)
    history = ratio_history(past, eps)
    estimates = eps_by_ratio(annual, history).unionByName(eps_by_quarter(annual, predictions, past, eps_known, history), allowMissingColumns=True)
    dividend = dividend_by_payout(estimates, payout_history(dividends, eps, as_of)).join(actual_dividend(dividends, target_year), ID, "left")
    return {"eps": estimates, "dividends": dividend, "yields": dividend_yields(dividend, prices, target_year, as_of), "failures": failures}



def eps_sign_guard(eps: DataFrame, cash: DataFrame) -> DataFrame:
    """DIV-04: the last paid dividend, nothing where the estimated EPS is not positive; ``cash`` as of :func:`cash_history_dividends`."""
    last = cash.where("dividend_method = 'ex_date_safe_last'").select(ID, "estimated_cash_dividend")
    guarded = F.when(F.col("estimated_eps") <= 0, 0.0).otherwise(F.col("estimated_cash_dividend"))
    return eps.join(last, ID, "left").withColumns({"dividend_method": F.lit("eps_sign_guard_last"), "estimated_cash_dividend": guarded})


def dividend_matrix(eps: DataFrame, dividends: DataFrame, annual: DataFrame, as_of: str) -> DataFrame:
    """DIV-04: one row for each entity and dividend method: payouts of the three evidence modes, cash histories of two and the sign guard."""
    columns = ["model", ID, "target_year", "eps_method", "estimated_eps", "dividend_method", "estimated_cash_dividend"]
    # Six parts read the estimates, three the annual EPS: forecasts behind them are made once.
    eps, annual = settled(eps.select(*columns[:5]), "estimates"), settled(annual, "annual-eps")
    parts = [dividend_by_payout(eps, payout_history(dividends, annual, as_of, mode)).withColumn("dividend_method", F.lit(f"{mode}_payout")).select(*columns) for mode in ("current_system", "ex_date_safe", "announcement_safe")]
    for mode in ("ex_date_safe", "announcement_safe"):
        cash = cash_history_dividends(dividends, as_of, mode)
        # Every entity has a row for every method, whatever is known of it.
        each = eps.withColumn("dividend_method", F.explode(F.array(*[F.lit(f"{mode}_{k}") for k in ("last", "median", "smoothed")])))
        parts.append(each.join(cash.drop("dividend_reference_year"), [ID, "dividend_method"], "left").select(*columns))
        if mode == "ex_date_safe":
            parts.append(eps_sign_guard(eps, cash).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_safe_features(samples: DataFrame, revenue: DataFrame, quarterly: DataFrame, dividends: DataFrame) -> DataFrame:
    """FEA-03, JON-06: what was known of cash, EPS and revenue at each sample's own cut-off; ``samples``: stock_id, target_year, as_of_date."""
    key = [ID, "target_year", "as_of_date"]
    asked = samples.select(*key).distinct()

    def known(facts: DataFrame, public: str, order: str, value: str, n: int) -> DataFrame:
        return history_known(asked, facts, ID, key, "as_of_date", public, order, value, n).where("known > 0")

    values = F.transform("history", lambda x: x["_value"])
    first = lambda n: F.slice(values, 1, n)
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))
    count = F.col("known").cast("int")
    cash = dividends.where("fiscal_year is not null").groupBy(ID, "fiscal_year").agg(F.sum("TotalCashDividend").alias("_c"), F.max("available_date").alias("available_date"))
    cash = known(cash, "available_date", "fiscal_year", "_c", 3).select(
        *key, F.get(values, F.lit(0)).alias("last_known_cash_dividend"), median_of_sorted(F.array_sort(values)).alias("recent_cash_dividend_median"), (total(values) / F.size(values)).alias("recent_cash_dividend_mean"),
        weighted_recent(values).alias("recent_cash_dividend_smoothed"), (F.size(F.filter(values, lambda x: x > 0)) / F.size(values)).alias("recent_paid_rate"), count.alias("dividend_history_count"),
        (F.col("target_year") - F.get("history", F.lit(0))["_order"]).cast("double").alias("years_since_last_dividend_reference"),
    )
    eps = known(quarterly.withColumn("_q", F.col("eps_year") * 4 + F.col("eps_quarter")), "statement_available_date", "_q", "EPS", 8)
    before = F.when(F.size(values) >= 8, total(F.slice(values, 5, 4)))
    eps = eps.select(*key, F.get(values, F.lit(0)).alias("latest_available_eps"), total(first(4)).alias("available_eps_ttm"), (F.try_divide(total(first(4)), before) - 1).alias("available_eps_ttm_yoy"), count.alias("eps_history_count"))
    public = revenue.withColumns({"_m": F.col("revenue_year") * 12 + F.col("revenue_month"), "_a": F.add_months(F.make_date("revenue_year", "revenue_month", F.lit(10)), 1)})
    sales = known(public, "_a", "_m", "revenue", 12).select(*key, total(values).alias("known_revenue_ltm"), total(first(3)).alias("known_revenue_recent_3m"), count.alias("revenue_history_count"))
    out = samples.join(cash, key, "left").join(eps, key, "left").join(sales, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dividend_history_count", "eps_history_count", "revenue_history_count")})


def selection_buckets(features: DataFrame) -> DataFrame:
    """FEA-04: paid rate, length of history and latest dividend as one bucket label."""
    n, rate, last = F.col("dividend_history_count"), F.col("recent_paid_rate"), F.col("last_known_cash_dividend")
    paid = F.when(n <= 0, "paid_no_history").when(rate >= 0.67, "paid_high").when(rate > 0, "paid_mixed").otherwise("paid_none")
    history = F.when(n >= 3, "history_enough").when(n > 0, "history_sparse").otherwise("history_none")
    latest = F.when(last > 0, "latest_positive").when(last == 0, "latest_zero").otherwise("latest_missing")
    return features.withColumn("dividend_selection_bucket", F.concat_ws("|", paid, history, latest))


def heuristic_hurdles(features: DataFrame) -> DataFrame:
    """DIV-09: three rules of thumb: last, median and smoothed dividend where it was paid at least half of the time."""
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    rate = F.coalesce("recent_paid_rate", F.lit(0.0))
    rules = [("direct_hurdle_last_known", zero("last_known_cash_dividend"), (zero("last_known_cash_dividend") > 0).cast("double")), ("direct_hurdle_recent_median", zero("recent_cash_dividend_median"), rate), ("direct_hurdle_smoothed", zero("recent_cash_dividend_smoothed"), rate)]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("dividend_method"), p.alias("paid_probability"), F.when(p >= 0.5, a).otherwise(0.0).alias("estimated_cash_dividend")) for m, a, p in rules]))
    return features.withColumn("_r", each).select("*", "_r.*").drop("_r")


def policy_payout(entities: DataFrame, policy: DataFrame, default_margin: float = 0.1, default_payout: float = 0.5) -> DataFrame:
    """DIV-11: an explicit margin and payout for each entity, clipped to 0..1 and 0..1.5, with a default where there is none."""
    clip = lambda c, top: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(top)), F.lit(0.0)))
    rows = entities.select(ID).distinct().join(policy.select(ID, "margin", "payout_ratio"), ID, "left")
    return rows.select(ID, F.coalesce(clip("margin", 1.0), F.lit(default_margin)).alias("margin"), F.coalesce(clip("payout_ratio", 1.5), F.lit(default_payout)).alias("payout_ratio"), F.when(F.col("payout_ratio").isNull(), "default").otherwise("policy").alias("policy_source"))
