"""As-of joins of facts to many cut-offs: both in one sorted window for each entity, work in proportion to facts and cut-offs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_known(cutoffs: DataFrame, facts: DataFrame, keys: list[str], as_of: str, public: str, value: Column, name: str) -> DataFrame:
    """JON-06: each cut-off's row with the newest fact that was public by then, as ``name``; facts of one public date go by their value.

    Facts and cut-offs are sorted together by date, and a running maximum of (public date, value) is what each cut-off sees. Facts
    without a date were never public; a fact without a value hides the older ones, as in a join.
    """
    seen = F.struct(F.col(public).alias("_public"), value.alias("_value"))
    left = cutoffs.select(*keys, F.col(as_of).alias("_at"), F.lit(1).alias("_kind"), F.struct(*cutoffs.columns).alias("_row"), F.lit(None).cast(facts.select(seen.alias("s")).schema["s"].dataType).alias("_fact"))
    named = [F.col(c).isNotNull() for c in (public, *keys)]
    right = facts.where(reduce(Column.__and__, named)).select(*keys, F.col(public).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), seen.alias("_fact"))
    # A cut-off sees what became public on its own day.
    past = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(right).withColumn("_last", F.max("_fact").over(past)).where("_kind = 1")
    return rows.select("_row.*", F.col("_last._value").alias(name))


def history_known(cutoffs: DataFrame, facts: DataFrame, key: str, columns: list[str], as_of: str, public: str, order: str, value: str, n: int) -> DataFrame:
    """FEA-03: each cut-off (``columns``) with ``history``, the last ``n`` values in ``order`` among the facts that were public by then, newest first, and ``known``, how many were.

    Every fact carries itself and the ``n`` - 1 before it in order, a bounded array; the fact of highest order that is public brings its array
    to the cut-off. Where facts of an entity became public out of order such an array may hold what was not public yet, and that entity's facts
    are gathered up to each cut-off instead. Facts without date, order or value are left out; a cut-off without facts has an empty history.
    """
    known = facts.where(F.col(public).isNotNull() & F.col(order).isNotNull() & F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(public).alias("_public"), F.col(order).alias("_order"), F.col(value).alias("_value"))
    item = F.struct("_order", "_value")
    in_order = Window.partitionBy("_key").orderBy("_order", "_value")
    late = F.coalesce(F.max("_public").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_public"), F.lit(False))
    known = known.withColumns({"_array": F.collect_list(item).over(in_order.rowsBetween(-(n - 1), 0)), "_late": late})
    known = known.withColumn("_tangled", F.max("_late").over(Window.partitionBy("_key")))
    right = known.select("_key", F.col("_public").alias("_at"), F.lit(0).alias("_kind"), F.struct("_order", "_value", "_array").alias("_fact"), "_tangled")
    kinds = {f.name: f.dataType for f in right.schema}
    asked = F.struct(*columns)
    left = cutoffs.select(F.col(key).alias("_key"), F.col(as_of).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kinds["_fact"]).alias("_fact"), F.lit(None).cast("boolean").alias("_tangled"), asked.alias("_row"))
    right = right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType))
    past = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gathered = F.collect_list(F.when(F.col("_tangled"), F.struct("_fact._order", "_fact._value"))).over(past)
    rows = left.unionByName(right).withColumns({"_last": F.max("_fact").over(past), "known": F.count("_fact").over(past), "_gathered": gathered}).where("_kind = 1")
    newest = F.when(F.size("_gathered") > 0, F.slice(F.sort_array("_gathered", False), 1, n)).otherwise(F.reverse(F.coalesce("_last._array", F.array().cast(rows.schema["_gathered"].dataType))))
    return rows.select("_row.*", newest.alias("history"), "known")
