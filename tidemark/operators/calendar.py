"""Calendar-safe windows: lags and rolling values that never cross a missing month.

All windows of a panel are partitioned by the entity (and its run of consecutive months), so one exchange serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import log_level, lunar_new_year_flag, median_of_sorted, percent_change, trailing_ones

ID, YEAR, MONTH, VALUE = "stock_id", "revenue_year", "revenue_month", "revenue"
SEGMENT = (ID, "calendar_segment")


def by_segment() -> Window:
    return Window.partitionBy(*SEGMENT).orderBy("month_index")


def by_entity() -> Window:
    return Window.partitionBy(ID).orderBy("month_index")


def with_segments(panel: DataFrame) -> DataFrame:
    """WIN-01: month_index, calendar_segment (runs of consecutive months) and consecutive_months."""
    rows = panel.withColumn("month_index", F.col(YEAR) * 12 + F.col(MONTH) - 1)
    start = F.coalesce((F.col("month_index") - F.lag("month_index").over(by_entity()) != 1).cast("int"), F.lit(1))
    rows = rows.withColumn("_start", start).withColumn("calendar_segment", F.sum("_start").over(by_entity().rowsBetween(Window.unboundedPreceding, 0))).drop("_start")
    return rows.withColumn("consecutive_months", F.row_number().over(by_segment()))


def months_before(c: str, months: int) -> Column:
    """JON-01, JON-02, JON-14: the entity's value exactly ``months`` calendar months earlier (later if negative)."""
    return F.first(c).over(by_entity().rangeBetween(-months, -months))


def rolling(c: str, months: int, least: int = 1, how=F.sum) -> Column:
    """WIN-04: aggregate over the last ``months`` rows of the segment, null before ``least`` of them."""
    window = by_segment().rowsBetween(-(months - 1), 0)
    return F.when(F.count(c).over(window) >= least, how(c).over(window))


def year_to_date(c: str) -> Column:
    """WIN-05: cumulative sum within the year; it goes on over missing months."""
    return F.sum(c).over(Window.partitionBy(ID, YEAR).orderBy("month_index").rowsBetween(Window.unboundedPreceding, 0))


def revenue_features(panel: DataFrame) -> DataFrame:
    """FEA-01: growth on last month, last year, rolling quarters and years, and the year so far (WIN-03 to WIN-06)."""
    rows = with_segments(panel)
    rows = rows.withColumns({
        "mom": percent_change(F.col(VALUE), F.lag(VALUE).over(by_segment())),
        "last_year_revenue": months_before(VALUE, 12),
        "last_3m_revenue": rolling(VALUE, 3),
        "last_12m_revenue": rolling(VALUE, 12),
        "acc_revenue": year_to_date(VALUE),
    })
    rows = rows.withColumn("yoy", percent_change(F.col(VALUE), F.col("last_year_revenue")))
    for c in ("last_3m_revenue", "last_12m_revenue", "acc_revenue"):
        rows = rows.withColumn(f"{c}_yoy", percent_change(F.col(c), months_before(c, 12)))
    return rows


def past_median(c: str) -> Column:
    """WIN-08: median of the entity's strictly earlier values."""
    before = F.array_sort(F.collect_list(c).over(by_entity().rowsBetween(Window.unboundedPreceding, -1)))
    return median_of_sorted(before)


def model_features(panel: DataFrame) -> DataFrame:
    """FEA-02: logs, time index, holiday flag, year-ago level and past-only imputation (WIN-07 to WIN-09)."""
    rows = with_segments(panel).withColumn("log_revenue", log_level(F.col(VALUE)))
    rows = rows.withColumn("lag_1", F.lag("log_revenue").over(by_segment())).withColumn("log_mom", F.col("log_revenue") - F.col("lag_1"))
    whole = Window.partitionBy(ID)
    n = F.row_number().over(by_entity())
    rows = rows.withColumns({
        "log_mom_3m": F.avg("log_mom").over(by_segment().rowsBetween(-2, 0)),
        "time_index": F.try_divide((n - 1).cast("double"), F.count("*").over(whole) - 1),
        "lunar_new_year": lunar_new_year_flag(F.col(YEAR), F.col(MONTH)),
        "last_year_revenue": months_before(VALUE, 12),
        "next_year_revenue": months_before(VALUE, -12),
        "history_12m_complete": F.col("consecutive_months") >= 12,
    })
    return rows.withColumn("log_mom_filled", F.coalesce("log_mom", past_median("log_mom"), F.lit(0.0)))


def growth_features(panel: DataFrame) -> DataFrame:
    """WIN-10: growth direction and rate (clipped), momentum, trend and cycle, volatility and slope, all within the segment.

    A month without one before it has growth 0; momentum is the mean growth of three and six months; the trend is the mean of twelve
    months from the third on (the value itself before), the cycle is what is left.
    """
    w = by_segment()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    between = lambda c, low, high: F.greatest(F.least(c, F.lit(high)), F.lit(low))
    before = F.lag(VALUE).over(w)
    rows = with_segments(panel).withColumns({
        "growth_direction": F.coalesce((F.col(VALUE) > before).cast("int"), F.lit(0)),
        "growth_rate": between(zero(percent_change(F.col(VALUE), before)), -0.95, 5.0),
        "trend_component": F.greatest(F.coalesce(rolling(VALUE, 12, 3, F.avg), F.col(VALUE)), F.lit(0.0)),
    })
    rows = rows.withColumns({
        "momentum_3m": rolling("growth_rate", 3, 1, F.avg),
        "momentum_6m": rolling("growth_rate", 6, 1, F.avg),
        "cycle_component": F.col(VALUE) - F.col("trend_component"),
        "trend_slope": zero(F.col("trend_component") - F.lag("trend_component", 3).over(w)),
        "_base": F.lag("trend_component", 3).over(w),
    })
    return rows.withColumns({
        "cycle_volatility_6m": zero(rolling("cycle_component", 6, 3, F.stddev_samp)),
        "trend_slope_rate": between(zero(F.try_divide(F.col("trend_slope"), F.col("_base"))), -1.0, 1.0),
    }).drop("_base")


def growth_windows(panel: DataFrame, months: int = 12) -> DataFrame:
    """WIN-12: the last ``months`` directions of growth as an array, with their share and trailing streak; full windows only."""
    rows = growth_features(panel)
    bits = F.collect_list("growth_direction").over(by_segment().rowsBetween(-(months - 1), 0))
    rows = rows.withColumn("growth_vector", bits).where(F.col("consecutive_months") >= months)
    total = F.aggregate("growth_vector", F.lit(0), lambda a, x: a + x)
    return rows.withColumns({"growth_ratio": total / F.lit(float(months)), "growth_streak": trailing_ones(F.col("growth_vector"))})


def sequence_samples(panel: DataFrame, months: int = 12, horizon: int = 1) -> DataFrame:
    """WIN-13, WIN-14: inputs of ``months`` consecutive months and the sum of the next ``horizon`` months as target."""
    rows = with_segments(panel)
    w = by_segment()
    ahead = w.rowsBetween(1, horizon)
    rows = rows.withColumns({
        "inputs": F.collect_list(VALUE).over(w.rowsBetween(-(months - 1), 0)),
        "target": F.when(F.count(VALUE).over(ahead) == horizon, F.sum(VALUE).over(ahead)),
        "trailing_sum": F.sum(VALUE).over(w.rowsBetween(-(horizon - 1), 0)),
        "window_max": F.max(VALUE).over(w.rowsBetween(-(months - 1), 0)),
        "target_index": F.col("month_index") + 1,
    })
    return rows.where((F.col("consecutive_months") >= months) & F.col("target").isNotNull()).withColumn("target_year", F.floor(F.col("target_index") / 12).cast("int"))


def three_month_totals(predictions: DataFrame, keys: tuple[str, ...] = ("model", ID)) -> DataFrame:
    """WIN-15: overlapping three-month sums of monthly predictions with the share of error that cancels out."""
    w = Window.partitionBy(*keys).orderBy("month_index")
    ahead = w.rowsBetween(0, 2)
    error = F.col("predicted_revenue") - F.col("actual_revenue")
    rows = predictions.withColumn("_error", error).withColumns({
        "predicted_3m": F.sum("predicted_revenue").over(ahead),
        "actual_3m": F.sum("actual_revenue").over(ahead),
        "_abs": F.sum(F.abs("_error")).over(ahead),
        "_span": F.lead("month_index", 2).over(w) - F.col("month_index"),
    })
    rows = rows.where("_span = 2").withColumn("error_cancellation_percent", (1 - F.try_divide(F.abs(F.col("predicted_3m") - F.col("actual_3m")), F.col("_abs"))) * 100)
    return rows.drop("_error", "_abs", "_span")


def eps_features(quarterly: DataFrame) -> DataFrame:
    """WIN-11: trailing four quarters, change on the same quarter last year and of the trailing sum; whole quarters only."""
    rows = quarterly.withColumn("quarter_index", F.col("eps_year") * 4 + F.col("eps_quarter") - 1)
    w = Window.partitionBy(ID).orderBy("quarter_index")
    last4 = w.rangeBetween(-3, 0)
    rows = rows.withColumns({
        "eps_ttm": F.when(F.count("EPS").over(last4) == 4, F.sum("EPS").over(last4)),
        "eps_last_year": F.first("EPS").over(w.rangeBetween(-4, -4)),
    })
    rows = rows.withColumn("_ttm_last_year", F.first("eps_ttm").over(w.rangeBetween(-4, -4)))
    return rows.withColumns({"eps_yoy": percent_change(F.col("EPS"), F.col("eps_last_year")), "eps_ttm_yoy": percent_change(F.col("eps_ttm"), F.col("_ttm_last_year"))}).drop("_ttm_last_year")


def baselines(panel: DataFrame) -> DataFrame:
    """WIN-02, WIN-17, WIN-18: history length, last observed and seasonal-naive values and the MASE scale before each month."""
    w = by_segment()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = with_segments(panel).withColumns({
        "history_months": F.col("consecutive_months") - 1,
        "last_observed_revenue": F.lag(VALUE).over(w),
        "seasonal_naive_revenue": F.lag(VALUE, 12).over(w),
        "_d12": F.abs(F.col(VALUE) - F.lag(VALUE, 12).over(w)),
        "_d1": F.abs(F.col(VALUE) - F.lag(VALUE).over(w)),
    })
    scale = F.when(F.col("history_months") >= 24, F.avg("_d12").over(past)).when(F.col("history_months") >= 2, F.avg("_d1").over(past))
    return rows.withColumn("mase_scale", F.when(scale > 0, scale)).drop("_d12", "_d1")


