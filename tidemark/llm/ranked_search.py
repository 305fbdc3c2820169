"""Ranked lexical search by sequential reads of impact-sorted lists (no random access), whole documents against a set of items.

A term's share in a document's score is its impact: its weight, from the number of documents that hold it, times its count damped by the
document's length, all in whole numbers. Documents are read once; of each stays its length and its counts of the items' terms. These
small records are then searched where they lie. A task takes them in runs, sorts a run's entries into a list for each term by falling impact, and for
each item reads the lists of its terms side by side down to a falling bar. What was read of a document is the lower end of its score;
what its unread lists could add at most, the impact at which each was left, gives the upper end. While an unseen document could still
reach the score of the ``k``-th best, reads go on for all; after that for the documents whose upper end reaches it, until no list that
one of them was not seen in has anything left to give: members, ties and scores are then final. A list that no open document needs is not
read to its end, and a run whose best impacts together stay below the item's ``k``-th score so far is not read at all. Each task returns
``k`` documents an item at most, and the best of all tasks are ranked in Spark.

Items are a stated set of queries: they are taken in blocks of about ``BLOCK_TERMS`` terms, and only a block's terms, their weights
and items go to all tasks (``MAX_TERMS`` is checked), so any number of items is served, one pass for each block. The documents are never shuffled.

Terms are known by 64-bit hashes; two different terms share one with odds of about 1 in 10^19 a pair.

Edge cases: null and empty texts have no terms, so such items find nothing and such documents count for nothing; terms of weight 0 add
nothing; documents of score 0 are not listed; equal scores go by id, null ids last, and rows of equal id are documents of their own;
items of equal or null id are items of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import discard, settle, ship
from tidemark.llm.textbatch import Terms, give_back, slices

#: Terms of the items of a block on average, and at most (an item of more terms has a block of its own, and is refused beyond).
BLOCK_TERMS, MAX_TERMS = 1 << 19, 1 << 22
#: Entries of a run of records.
RUN_ENTRIES = 1 << 19
_LAST = (1 << 63) - 1


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term) of rows (item, text): each distinct term of an item once."""
    for batch in batches:
        names = batch.column(0).to_numpy()
        for row, texts in slices(batch.column(1), made=Terms):
            owner = np.repeat(np.arange(len(texts)), texts.word_counts())
            pairs = np.unique(np.stack((owner, texts.hashes().view(np.int64))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(names[row + pairs[0]]), pa.array(pairs[1])], names=["item", "term"])


def _counted(vocabulary):
    """Arrow function of rows (doc_id, text): those with a term, their number of terms, and how often they hold which terms of the sorted vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for row, texts in slices(batch.column(1), made=Terms):
                n, h = texts.word_counts(), texts.hashes().view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                owner = np.repeat(np.arange(len(texts)), n)[hit]
                entry, count = np.unique(owner * max(len(known), 1) + at[hit], return_counts=True)
                held = np.searchsorted(entry // max(len(known), 1), np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(held, x.astype(np.int32)) for x in (entry % max(len(known), 1), count)]
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
                yield part.filter(pa.array(n > 0))
        give_back()

    return run


class _Run:
    """Records of documents as one list for each term, entries by falling impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, held: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), held)
        counts = counts.astype(np.int64)
        fall = -weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[doc]))
        order = np.lexsort((doc, fall, terms))
        self.doc, self.fall = doc[order], fall[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the ``k`` best of score ``least`` or more, their scores final."""
        a, z = self.starts[terms], self.starts[terms + 1]
        some = z > a
        lists = [(self.doc[x:y], self.fall[x:y]) for x, y in zip(a[some], z[some], strict=True)]
        place, left = np.zeros(len(lists), np.int64), np.array([-fall[0] for _, fall in lists], np.int64)
        none = np.zeros(0, np.int64)
        if left.sum() < least or not left.any():
            return none, none
        low, seen = np.zeros(len(self.ids), np.int64), np.zeros((len(lists), len(self.ids)), bool)
        live, bar = None, int(left.max()) // 2
        while True:
            for t, (doc, fall) in enumerate(lists):
                if left[t] > bar:
                    # Down to the bar: entries of an impact above it.
                    end = int(np.searchsorted(fall, -bar, "left"))
                    read = slice(place[t], end)
                    low[doc[read]] -= fall[read]
                    seen[t, doc[read]] = True
                    place[t], left[t] = end, -fall[end] if end < len(fall) else 0
            most = int(left.sum())
            if live is None:
                met = np.flatnonzero(low)
                reach = max(least, int(np.partition(low[met], len(met) - k)[len(met) - k]) if len(met) >= k else 1)
                # A document that no list has shown yet could have the impacts at which all lists were left.
                if most < reach or not most:
                    live = met
            if live is not None:
                reach = max(least, int(np.partition(low[live], len(live) - k)[len(live) - k]) if len(live) >= k else 1)
                live = live[low[live] + most >= reach]
                may = left @ ~seen[:, live]
                live, may = live[low[live] + may >= reach], may[low[live] + may >= reach]
                if not may.any():
                    return live, low[live]
            bar //= 4


def _searched(block, k: int):
    """Arrow function of records (doc_id, m, terms, counts): (item, doc_id, score) of the ``k`` best of this task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, item_terms, weights = block.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in names]

        def search(parts: list[list[np.ndarray]]) -> None:
            records = _Run(*map(np.concatenate, zip(*parts, strict=True)), weights)
            for i, (scores, ids) in enumerate(best):
                doc, score = records.search(item_terms[first[i] : first[i + 1]], k, int(scores[-1]) if len(scores) == k else 1)
                if len(doc):
                    scores, ids = np.concatenate((scores, score)), np.concatenate((ids, records.ids[doc]))
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = scores[order], ids[order]

        parts, entries = [], 0
        for batch in batches:
            held = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            parts.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), held, *(batch.column(c).flatten().to_numpy() for c in (2, 3))])
            entries += len(parts[-1][3])
            if entries >= RUN_ENTRIES:
                search(parts)
                parts, entries = [], 0
        if parts:
            search(parts)
        del parts
        give_back()
        for i, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), names[i])), pa.array(ids), pa.array(scores)], names=["item", "doc", "score"])

    return run


def _block_ranking(docs: DataFrame, pairs: DataFrame, k: int, spent: list[str]) -> DataFrame:
    """(item, doc, score): the ``k`` best documents of each task for each item of one block."""
    spark = docs.sparkSession
    table = pairs.orderBy("item", "term").toArrow()
    if table.num_rows > MAX_TERMS:
        raise ValueError(f"a block of items has {table.num_rows} terms, more than {MAX_TERMS}: one item is too long to be sent to all tasks")
    terms, items = table.column("term").to_numpy(), table.column("item").to_numpy()
    vocabulary, at = np.unique(terms, return_inverse=True)
    records = settle(docs.mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, counts array<int>"), "records", spent)
    # N and L of an empty table are 0 and 1: nothing is searched then.
    n, length = records.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.count("*") + 1))).cast("long")
    held = records.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("weight")).toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    weights[held.column("term").to_numpy()] = held.column("weight").to_numpy()
    names, first = np.unique(items, return_index=True)
    block = spark.sparkContext.broadcast((names, np.append(first, len(items)), at, weights))
    m = F.expr(f"50 + (50 * n * {n}L) div {length}L")
    wanted = records.where(F.size("terms") > 0).select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), m.alias("m"), "terms", "counts")
    return wanted.mapInArrow(_searched(block, k), "item long, doc long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    ship(spark)
    spent: list[str] = []
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("item"))
    asked = settle(asked, "items", spent)
    pairs = settle(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long"), "terms", spent)
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    found = None
    for b in range(blocks):
        part = _block_ranking(rows, pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, spent)
        top = settle(part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked", spent)
        found = top if found is None else found.unionByName(top)
    named = found.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), "score")
    out = settle(named, "ranking")
    discard(spark, spent)
    return out
