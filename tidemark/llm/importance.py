"""Resampling of documents towards the word distribution of a target.

Every document and every target text is a bag of hashed features, its runs of one and two words. Two arrays of ``BUCKETS`` counts say how
often a bucket occurs in all documents and in the target; the logarithm of their smoothed ratio is the bucket's gain, a document's weight the
mean gain of its features, and its score the weight plus Gumbel noise that is a hash of its id, so that the highest scores are a sample
without replacement in proportion to the weights.

The highest scores are found without a sort of all documents. Keys (score, id, row) are cut by medians of medians: each partition tells
the median of the keys that are still open in it, the driver takes the median of these weighted by how many keys each stands for, and at
least a quarter of the open keys falls on the side without the cutoff, whatever their order. A round is one job that counts both sides of
a cut and brings the medians for either, a row for each task; the open keys are written anew when few are left. This ends at the exact
cutoff key, and only what lies before it is sorted, by ranges.

Edge cases: a null text has no features; a document without features has weight 0; a target without features gives every bucket its smoothed
share; rows of a null id draw one noise together and come after other ids in ties; rows of equal score and id are drawn in any order, each
once; an empty table gives an empty result; no other columns are read than those named, under any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, settle, ship, shuffle_partitions
from tidemark.llm.textbatch import _LOWER, LONG, Terms, slices

BUCKETS = 10_000
#: Open keys are written anew when they are fewer than this part of the written ones.
THIN = 16
#: Winners that are sorted in one task.
SORTED_ROWS = 1 << 20
_LAST = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    """What eight shifts make of each byte, by the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of a word each: the first byte of all words at once, then the second, and so on."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    at, now, sizes = starts[order], state[order], size[order]
    longer = np.searchsorted(-sizes, -np.arange(1, LONG + 1), "right") if len(sizes) and sizes[0] <= LONG else None
    if longer is None:
        # Long words come first and go one by one.
        n_long = int(np.count_nonzero(size > LONG))
        for i in range(n_long):
            word = data[at[i] : at[i] + sizes[i]].tobytes()
            now[i] = zlib.crc32(word, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        rest = _advanced(now[n_long:], data, at[n_long:], at[n_long:] + sizes[n_long:]) if n_long < len(sizes) else now[n_long:]
        now = np.concatenate((now[:n_long], rest))
    else:
        for j, n in enumerate(longer.tolist()):
            if not n:
                break
            now[:n] = _CRC[(now[:n] ^ data[at[:n] + j]) & 255] ^ (now[:n] >> 8)
    out = np.empty_like(now)
    out[order] = now
    return out


def feature_buckets(texts: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, words that have a next one, bucket of these two) of a run of texts."""
    data = _LOWER[texts.data]
    one = _advanced(np.full(len(texts.starts), 0xFFFFFFFF, np.uint32), data, texts.starts, texts.ends)
    follows = np.ones(len(one), bool)
    follows[texts.first[1:][texts.word_counts() > 0] - 1] = False
    head = np.flatnonzero(follows)
    spaced = _CRC[(one[head] ^ 0x20) & 255] ^ (one[head] >> 8)
    two = _advanced(spaced, data, texts.starts[head + 1], texts.ends[head + 1])
    return (~one % np.uint32(BUCKETS)).astype(np.int64), head, (~two % np.uint32(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, texts in slices(batch.column(0), made=Terms):
            one, _, two = feature_buckets(texts)
            total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: partial sums in the tasks, ``BUCKETS`` numbers to the driver."""
    ship(texts.sparkSession)
    found = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of the shares of each bucket, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weighed(gains: np.ndarray):
    """Arrow function: the last column, a text, becomes (n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.zeros(0, np.int64)] * 3]
            for _, texts in slices(batch.column(batch.num_columns - 1), made=Terms):
                one, head, two = feature_buckets(texts)
                value = gains[one]
                value[head] += gains[two]
                sums, words = np.concatenate(([0], np.cumsum(value))), texts.word_counts()
                n = np.maximum(2 * words - 1, 0)
                found.append([words, n, (sums[texts.first[1:]] - sums[texts.first[:-1]]) // np.maximum(n, 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


Key = tuple[int, int, int]


def _up_to(key: Key) -> Column:
    """Keys (score, id, row) from the highest score to ``key``, which is among them; ids and rows rise."""
    score, doc, row = (F.col(c) for c in ("score", "_doc", "_row"))
    return (score > key[0]) | ((score == key[0]) & ((doc < key[1]) | ((doc == key[1]) & (row <= key[2]))))


def _surveyed(low: Key | None, high: Key | None, cut: Key | None):
    """Arrow function of a partition of keys: of those after ``low`` up to ``high``, how many lie up to the cut and how many after, and the median of either."""

    def within(keys: list[np.ndarray], end: Key) -> np.ndarray:
        score, doc, row = keys
        return (score > end[0]) | ((score == end[0]) & ((doc < end[1]) | ((doc == end[1]) & (row <= end[2]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys = [[np.zeros(0, np.int64)] * 3]
        for batch in batches:
            keys = [c.to_numpy() for c in batch.columns]
            for end, wanted in ((low, False), (high, True)):
                if end is not None:
                    chosen = within(keys, end) == wanted
                    keys = [c[chosen] for c in keys]
            open_keys.append(keys)
        keys = [np.concatenate(x) for x in zip(*open_keys, strict=True)]
        before = within(keys, cut) if cut is not None else np.zeros(len(keys[0]), bool)
        for side in (True, False):
            score, doc, row = (c[before == side] for c in keys)
            if len(score):
                # The median alone, component by component, in linear time.
                m = (len(score) - 1) // 2
                s = np.partition(-score, m)[m]
                m -= int(np.count_nonzero(-score < s))
                doc, row = doc[-score == s], row[-score == s]
                d = np.partition(doc, m)[m]
                m -= int(np.count_nonzero(doc < d))
                r = np.partition(row[doc == d], m)[m]
                yield pa.RecordBatch.from_pydict({"before": [side], "n": [len(score)], "score": [int(-s)], "_doc": [int(d)], "_row": [int(r)]})

    return run


def _weighted_median(medians: list[tuple[int, Key]]) -> Key:
    """The first of the medians in order with half of all keys before or at it."""
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda x: (-x[1][0], x[1][1:])):
        seen += n
        if seen >= half:
            break
    return key


def cutoff_key(keys: DataFrame, k: int) -> Key:
    """The ``k``-th (from 1) of the keys (score, _doc, _row), all different, by weighted medians of partition medians."""
    spent: list[str] = []
    low = high = cut = None
    written = keys.count()
    while True:
        found = keys.select("score", "_doc", "_row").mapInArrow(_surveyed(low, high, cut), "before boolean, n long, score long, _doc long, _row long").collect()
        sides = {side: [(r["n"], (r["score"], r["_doc"], r["_row"])) for r in found if r["before"] == side] for side in (True, False)}
        if cut is not None:
            before = sum(n for n, _ in sides[True])
            if before == k:
                discard(keys.sparkSession, spent)
                return cut
            if before > k:
                high, side = cut, True
            else:
                low, side, k = cut, False, k - before
        else:
            side = False
        open_rows = sum(n for n, _ in sides[side])
        cut = _weighted_median(sides[side])
        if open_rows * THIN < written and high is not None:
            keep, new = _up_to(high) if low is None else _up_to(high) & ~_up_to(low), []
            keys, written = settle(keys.where(keep).select("score", "_doc", "_row"), "keys", new), open_rows
            discard(keys.sparkSession, spent)
            spent = new


def ranked_winners(scored: DataFrame, cutoff: Key, rows: int) -> DataFrame:
    """The rows up to the cutoff with their ``rank`` from 1: sorted by ranges, each range numbered after those before."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc("_doc"), F.asc("_row")]
    ranges = scored.where(_up_to(cutoff)).repartitionByRange(shuffle_partitions(spark, rows, SORTED_ROWS), *order).sortWithinPartitions(*order)
    # The number is the partition's, in the upper bits, and the row's in it.
    numbered = settle(ranges.withColumn("_at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # A row for each partition: bounded by the number of partitions.
    return numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", place.cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null unless it is one of the ``percent`` in a hundred of the documents of enough words that are drawn."""
    spark = docs.sparkSession
    ship(spark)
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "_doc": F.coalesce("doc_id", F.lit(_LAST)), "_row": F.monotonically_increasing_id()})
    scored = settle(scored, "scored")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count()
    wanted = n * percent // 100
    columns = [F.col("doc_id").alias(id_col), "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = cutoff_key(scored.where(fit), wanted)
    lost = scored.where(~(fit & _up_to(cutoff))).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked_winners(scored.where(fit), cutoff, wanted).select(*columns, "rank").unionByName(lost)
