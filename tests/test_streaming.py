"""The month-to-date stream on real files: late, repeated and disordered events, restarts, and the batch twins."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import month_to_date as MTD

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
START = datetime(2024, 1, 20)


def made_batches(seed=1, batches=12):
    """Batches of events in some disorder: a batch covers two days, some events are a day old, some ten days, some come twice."""
    draw, out, event, past = random.Random(seed), [], 0, []
    for b in range(batches):
        rows = []
        for _ in range(40):
            event += 1
            back = draw.choice([0, 0, 0, 1, 10])
            rows.append((event, START + timedelta(days=2 * b - back, seconds=draw.randrange(2 * 86400)), draw.randrange(4), round(draw.uniform(-5, 50), 2)))
        rows += draw.sample(past, min(len(past), 8)) + draw.sample(rows, 5)
        past += rows
        draw.shuffle(rows)
        out.append(rows)
    return out


def plain_stream(batches, delay=timedelta(days=2)):
    """(rows, late): what a stream with this delay appends, one event after the other."""
    mark, newest, seen, days, late = datetime(1970, 1, 1), datetime(1970, 1, 1), set(), defaultdict(lambda: [0, 0]), 0
    marks = [mark, mark]
    for b, rows in enumerate(batches):
        mark = marks[b]  # of the batch before this one
        for event, ts, user, value in rows:
            if ts <= mark:
                late += 1
            elif event not in seen:
                seen.add(event)
                days[user, ts.date()][0] += round(value * 10000)
                days[user, ts.date()][1] += 1
            newest = max(newest, ts)
        mark = newest - delay
        mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
        marks.append(mark)
    total, out = Counter(), []
    for (user, day), (units, n) in sorted(days.items()):
        total[user, day.year, day.month] += units
        if datetime(day.year, day.month, day.day) + timedelta(days=1) <= mark:
            out.append((user, day, units / 10000, n, total[user, day.year, day.month] / 10000))
    return sorted(out), late


def write_batches(spark, batches, path, first=0):
    for b, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/b{b:03d}")


def rows_of(df):
    return sorted((r["stock_id"], r["day"], r["revenue"], r["events"], r["month_to_date"]) for r in df.collect())


def moved(tmp_path, name):
    """Event files in one folder, older ones first, as a file source lists them by time."""
    import os
    import shutil

    target = tmp_path / name
    target.mkdir(exist_ok=True)
    for k, p in enumerate(sorted((tmp_path / "made").glob("b*/*.parquet"))):
        at = target / f"{p.parent.name}.parquet"
        if not at.exists():
            shutil.copy(p, at)
            os.utime(at, (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))
    return str(target)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_files_equals_a_plain_loop_and_counts_late_events(spark, tmp_path, seed):
    batches, listener = made_batches(seed), MTD.LateRows()
    write_batches(spark, batches, str(tmp_path / "made"))
    out = MTD.run_month_to_date(spark, moved(tmp_path, "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "mark"), name=f"mtd{seed}", files_each=1, listener=listener)
    want, late = plain_stream(batches)
    assert rows_of(out) == want and late > 20 and listener.counts[f"mtd{seed}"] == late


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    batches = made_batches(3, 8)
    write_batches(spark, batches[:4], str(tmp_path / "made"))
    run = lambda: MTD.run_month_to_date(spark, moved(tmp_path, "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "mark"), files_each=1)
    assert rows_of(run()) == plain_stream(batches[:4])[0]
    write_batches(spark, batches[4:], str(tmp_path / "made"), 4)
    assert rows_of(run()) == plain_stream(batches)[0]
    assert rows_of(run()) == plain_stream(batches)[0]  # nothing new


def test_replay_of_batches_equals_the_stream(spark):
    batches = made_batches(4)
    events = spark.createDataFrame([(b, *r) for b, rows in enumerate(batches) for r in rows], f"batch int, {SCHEMA}")
    rows = MTD.replayed(events, "batch")
    want, late = plain_stream(batches)
    assert rows.where("is_late").count() == late
    daily = MTD.daily_totals(rows.where("not is_late and not is_repeated").drop("batch", "is_late", "is_repeated"))
    newest = max(r[1] for x in batches for r in x)
    assert rows_of(MTD.closed_days(MTD.month_to_date(daily), F.lit(newest))) == want


def test_batch_of_no_events(spark):
    assert MTD.month_to_date(MTD.daily_totals(spark.createDataFrame([], SCHEMA))).count() == 0


def test_an_entity_and_month_adds_events_to_days_and_skips_nulls():
    import pandas as pd

    class State:
        exists = hasTimedOut = False
        getCurrentWatermarkMs = staticmethod(lambda: 2 * MTD.DAY_MS)
        update = setTimeoutTimestamp = remove = staticmethod(lambda *_: None)

    frames = [pd.DataFrame({"day_ms": [0, MTD.DAY_MS, 0, None], "units": [5, 7, None, 9]}), pd.DataFrame({"day_ms": [0, 2 * MTD.DAY_MS], "units": [1, 3]})]
    (out,) = MTD._running((4, "1970-01-01"), iter(frames), State())
    assert out.values.tolist() == [[4, datetime(1970, 1, 1).date(), 0.0006, 3, 0.0006], [4, datetime(1970, 1, 2).date(), 0.0007, 1, 0.0013]]
