"""STR-01: revenue of the month so far from a stream of events, as a stream, as a batch, and as a batch that replays how a stream saw it.

The stream has two stateful steps under one watermark: event ids seen within the delay, and for each entity and month the running total
and the days that are still open, which is kept until the month is closed. Closed days are appended in order. What came too late is
counted by :class:`LateRows`, so no event is lost unnoticed. State of many entities belongs into a RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

#: Money is summed in whole ten-thousandths, so sums do not depend on the order of events.
UNIT = 10_000
DAY_MS = 86_400_000
EPOCH = date(1970, 1, 1)
DAILY = "stock_id long, day date, revenue double, events long, month_to_date double"


def _units(value: str) -> Column:
    return (F.col(value).cast("decimal(18,4)") * UNIT).cast("long")


def daily_totals(events: DataFrame) -> DataFrame:
    """Daily sums of each user from a batch: repeated events count once."""
    daily = events.dropDuplicates(["event_id"]).groupBy(F.col("user_id").alias("stock_id"), F.to_date("ts").alias("day"))
    return daily.agg((F.sum(_units("value")) / UNIT).alias("revenue"), F.count("*").alias("events"))


def month_to_date(daily: DataFrame) -> DataFrame:
    """Sums of the month so far by day, over daily totals."""
    w = Window.partitionBy("stock_id", F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("month_to_date", F.sum(F.round(F.col("revenue") * UNIT).cast("long")).over(w) / UNIT)


def _running(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One entity and month: adds events to their days, appends the days that the watermark has passed, and waits for the next one's end."""
    total, days = 0, {}
    if state.exists:
        total, starts, units, counts = state.get
        days = {d: [u, n] for d, u, n in zip(starts, units, counts, strict=True)}
    if not state.hasTimedOut:
        for frame in frames:
            # Few events to an entity and month: a loop costs less than a grouped frame. Nulls come as NaN; they add nothing, and an event without a day counts nowhere.
            for d, units in zip(frame["day_ms"].tolist(), frame["units"].tolist(), strict=True):
                if d == d:
                    held = days.setdefault(int(d), [0, 0])
                    held[0] += int(units) if units == units else 0
                    held[1] += 1
    mark, rows = state.getCurrentWatermarkMs(), []
    for d in sorted(days):
        if d + DAY_MS > mark:
            break
        units, n = days.pop(d)
        total += units
        rows.append((key[0], EPOCH + timedelta(milliseconds=d), units / UNIT, n, total / UNIT))
    end = int((pd.Timestamp(key[1]) + pd.offsets.MonthBegin(1)).timestamp() * 1000)
    if days or end > mark:
        opened = sorted(days)
        state.update((total, opened, [days[d][0] for d in opened], [days[d][1] for d in opened]))
        state.setTimeoutTimestamp(opened[0] + DAY_MS if opened else end)
    else:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=["stock_id", "day", "revenue", "events", "month_to_date"])


def month_to_date_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The closed days of a stream of (event_id, ts, user_id, value) with the month so far: events repeated within the delay count once, later ones are dropped by the watermark."""
    rows = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    start = F.unix_millis(F.date_trunc("day", "ts"))
    rows = rows.select(F.col("user_id").alias("stock_id"), F.trunc("ts", "month").alias("month"), "ts", start.alias("day_ms"), _units("value").alias("units"))
    return rows.groupBy("stock_id", "month").applyInPandasWithState(_running, DAILY, "total long, days array<long>, units array<long>, counts array<long>", "append", "EventTimeTimeout")


class LateRows(StreamingQueryListener):
    """How many events each query dropped because they came after the watermark: ``counts`` by the query's name, else its id."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        self.counts[event.name or str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        # The first step sees every event; what it lets pass is late for no later step.
        steps = [s for s in event.progress.stateOperators if s.operatorName == "dedupeWithinWatermark"]
        self.counts[event.progress.name or str(event.progress.id)] += sum(s.numRowsDroppedByWatermark for s in steps)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watermarks(events: DataFrame, batch: str, late: str = "2 days") -> DataFrame:
    """(batch, watermark) under which a stream that got ``events`` in these batches took each of them: a row for each batch, null in the first two.

    A batch drops what the watermark of the batch before it had passed, which that one had from the batches before itself.
    """
    newest = events.groupBy(batch).agg(F.max("ts").alias("_newest"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -2)
    # The watermark has whole milliseconds and begins at 1970.
    mark = F.timestamp_millis(F.unix_millis(F.max("_newest").over(before) - F.expr(f"interval {late}")))
    return newest.select(batch, mark.alias("watermark"))


def replayed(events: DataFrame, batch: str, late: str = "2 days") -> DataFrame:
    """``events`` with ``is_late`` and ``is_repeated`` as a stream sees them that gets them in order of the column ``batch``."""
    rows = events.join(F.broadcast(watermarks(events, batch, late)), batch, "left")  # a row for each batch
    rows = rows.withColumn("is_late", F.coalesce(F.col("ts") <= F.col("watermark"), F.lit(False)))
    order = Window.partitionBy("event_id", "is_late").orderBy(batch, "ts")
    return rows.withColumn("is_repeated", ~F.col("is_late") & (F.row_number().over(order) > 1)).drop("watermark")


def closed_days(daily: DataFrame, newest: Column, late: str = "2 days") -> DataFrame:
    """The daily totals that a stream has appended once its newest event is ``newest``."""
    return daily.where(F.col("day").cast("timestamp") + F.expr("interval 1 day") <= newest - F.expr(f"interval {late}"))


def run_month_to_date(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, late: str = "2 days", name: str | None = None, files_each: int = 1000, listener: LateRows | None = None) -> DataFrame:
    """Takes all event files of ``source`` that the checkpoint has not seen, appends closed days to ``target``, and reads that."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
    writer = month_to_date_stream(events, late).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    if listener is not None:
        spark.streams.addListener(listener)
    try:
        (writer.queryName(name) if name else writer).trigger(availableNow=True).start().awaitTermination()
        if listener is not None:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        if listener is not None:
            spark.streams.removeListener(listener)
    return spark.read.schema(DAILY).parquet(target)
