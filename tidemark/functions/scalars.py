"""Column functions: parsing, dates, safe arithmetic and labels. All are plain Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A double with NaN and infinities as null, the one form of a missing number here."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parse_percent(c: Column) -> Column:
    """FN-01: numbers as text; only a trailing percent sign divides by 100."""
    text = F.trim(c.cast("string"))
    return F.when(text.endswith("%"), F.expr("1") * F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))


def parse_number(c: Column) -> Column:
    """FN-02: thousands commas and percent signs stripped, anything else null."""
    return finite(F.regexp_replace(c.cast("string"), "[%,]", "").try_cast("double"))


def parse_local_year(c: Column) -> Column:
    """FN-03: a Minguo year text such as '113年後半年度' as a Gregorian year, null if it names none."""
    digits = F.regexp_extract(c.cast("string"), r"^\s*(\d{2,3})", 1)
    return digits.try_cast("int") + 1911


def revenue_available_date(year: Column, month: Column) -> Column:
    """FN-04: the tenth of the month after."""
    return F.add_months(F.make_date(year, month, F.lit(10)), 1)


def statement_available_date(statement: Column) -> Column:
    """FN-05: when a quarter's statement is public, by the month of the statement date."""
    year, month = F.year(statement), F.month(statement)
    return (
        F.when(month <= 3, F.make_date(year, F.lit(5), F.lit(15)))
        .when(month <= 6, F.make_date(year, F.lit(8), F.lit(14)))
        .when(month <= 9, F.make_date(year, F.lit(11), F.lit(14)))
        .otherwise(F.make_date(year + 1, F.lit(3), F.lit(31)))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def percent_change(now: Column, before: Column) -> Column:
    """FN-06: now / before - 1, null where before is 0."""
    return F.try_divide(now, before) - 1


def percent_error(predicted: Column, actual: Column, least: float = 0.0) -> Column:
    """FN-07: signed percentage error, null where the actual is 0 or smaller in size than ``least``."""
    return F.when((actual != 0) & (F.abs(actual) >= least), (predicted - actual) / F.abs(actual) * 100)


def thousands(*columns: str) -> dict[str, Column]:
    """FN-08: raw money columns as their values in thousands, by name."""
    return {f"{c}_thousand": F.col(c) / 1000 for c in columns}


def trailing_ones(bits: Column) -> Column:
    """FN-09: how many ones an array of 0 and 1 ends in."""
    zero = F.array_position(F.reverse(bits), F.lit(0))
    return F.when(zero == 0, F.size(bits)).otherwise(zero - 1).cast("int")


def safe_round(c: Column, top: int = 2**62) -> Column:
    """FN-10: nearest integer (ties to even), at least 0 and at most ``top``; missing is 0."""
    return F.rint(F.least(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)), F.lit(float(top)))).cast("long")


def weighted_recent(newest_first: Column) -> Column:
    """FN-11: up to three values weighted 0.5, 0.3, 0.2, the weights scaled to what is there; null if nothing is."""
    weights = F.slice(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), 1, F.greatest(F.size(newest_first), F.lit(0)))
    dot = F.aggregate(F.zip_with(F.slice(newest_first, 1, 3), weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(newest_first) > 0, dot / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


#: FN-12, fixed values: month of the lunar new year by year.
LUNAR_NEW_YEAR_MONTH = {2019: 2, 2020: 1, 2021: 2, 2022: 2, 2023: 1, 2024: 2, 2025: 1, 2026: 2}


def lunar_new_year(year: Column, month: Column) -> Column:
    """FN-12: 1 in the month of the lunar new year, else 0; null in years that the table does not have."""
    table = F.create_map(*[F.lit(x) for pair in LUNAR_NEW_YEAR_MONTH.items() for x in pair])
    return (F.try_element_at(table, year) == month).cast("int")


#: Mean new moons of 2000 on (day of the Julian calendar, days each), and the main corrections of the true new moon: days
#: times the sine of sun's and moon's mean anomaly and the moon's latitude argument, each as (degrees at the first new moon of 2000, degrees a month).
NEW_MOON, LUNATION = 2451550.09766, 29.530588861
SUN_ANOMALY, MOON_ANOMALY, MOON_LATITUDE = (2.5534, 29.1053567), (201.5643, 385.81693528), (160.7108, 390.67050284)
MOON_TERMS = ((-0.40720, 0, 1, 0), (0.17241, 1, 0, 0), (0.01608, 0, 2, 0), (0.01039, 0, 0, 2), (0.00739, -1, 1, 0), (-0.00514, 1, 1, 0), (0.00208, 2, 0, 0))


def lunar_new_year_date(year: Column) -> Column:
    """The date of the lunar new year by astronomy, for any year from 1900 to 2100: the day, eight hours east of Greenwich, of the new moon nearest 5 February.

    A mean lunation with its main corrections is right to a few minutes, and new moons lie 29.5 days apart, so one lies in the fifteen days to either side.
    """
    # Julian day of 5 February, about 07:00 at Greenwich.
    middle = F.unix_date(F.make_date(year, F.lit(2), F.lit(5))) + 2440587.5 + 0.3
    k = F.round((middle - NEW_MOON) / LUNATION)
    sun, moon, latitude = (F.radians(base + k * each) for base, each in (SUN_ANOMALY, MOON_ANOMALY, MOON_LATITUDE))
    # The light of the delay between dynamical and universal time, about a minute in these years.
    true = NEW_MOON + LUNATION * k + sum((days * F.sin(a * sun + b * moon + c * latitude) for days, a, b, c in MOON_TERMS), F.lit(0.0)) - 70 / 86400
    return F.date_from_unix_date(F.floor(true + 8 / 24 - 2440587.5).cast("int"))


def lunar_new_year_flag(year: Column, month: Column) -> Column:
    """FN-12: 1 in the month of the lunar new year, else 0, in any year: by the table where it has the year, else computed."""
    return F.coalesce(lunar_new_year(year, month), (F.month(lunar_new_year_date(year)) == month).cast("int"))


def observed_price(source: Column) -> Column:
    """FN-13: false for sources that call themselves synthetic or simulated, and for none."""
    return F.coalesce(~F.lower(source).rlike("synthetic|simulated"), F.lit(False))


def truth(c: Column) -> Column:
    """FN-14: booleans given as text."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def first_known(c: str, *order: str) -> Column:
    """FN-15: aggregate: the first non-null value in the given order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))


def method_threshold(method: Column) -> Column:
    """FN-16: the threshold that a method's name ends in: '..._t045' is 0.45."""
    return F.regexp_extract(method, r"_t(\d{3})$", 1).try_cast("double") / 100


def quarter_of(month: Column) -> Column:
    """FN-17: 1 to 4."""
    return (F.floor((month - 1) / 3) + 1).cast("int")


def period_label(start: Column, end: Column) -> Column:
    """FN-17: 'yyyy-MM~yyyy-MM', null if a date is missing."""
    return F.concat(F.date_format(start, "yyyy-MM"), F.lit("~"), F.date_format(end, "yyyy-MM"))


def log_level(c: Column) -> Column:
    """FN-18: log1p of a level cut off at 0."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def level_of(log: Column, top: float = 50.0) -> Column:
    """FN-18: the level of a log1p value, at least 0; the exponent is cut off at ``top``."""
    return F.greatest(F.expm1(F.least(log, F.lit(top))), F.lit(0.0))


def median_of_sorted(values: Column) -> Column:
    """The median of an ascending array, null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def rounded(columns: list[str], digits: int = 6) -> dict[str, Column]:
    """FN-20: report columns rounded, by name."""
    return {c: F.round(F.col(c), digits) for c in columns}


def sequence_backbone(model: Column, main: str, other: str | None = None, others: tuple[str, ...] = ()) -> Column:
    """FN-19: the architecture behind a model's name: ``other`` for the models ``others`` ("disabled" where it is switched off), ``main`` for all else."""
    return F.when(model.isin(list(others)), F.lit(other or "disabled")).when(model.isNotNull(), F.lit(main))
