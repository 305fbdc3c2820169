"""Exact top-k search by inner product with segment statistics of several resolutions.

A vector is cut into segments; of each the mean and the standard deviation are kept. For vectors x and y the squared distance is at
least the sum over segments of length L of L * ((mean x - mean y)^2 + (deviation x - deviation y)^2), and as <x, y> is half of
|x|^2 + |y|^2 less the squared distance, the product is at most the sum of L * (mean x * mean y + deviation x * deviation y): a product of
the rows of statistics. Resolutions go from one segment to segments of two components, each bound at least as tight as the one
before; pairs whose bound is below a score that the query's ``k`` best already reach are left out, and the survivors of the finest get
their exact product in whole numbers. A resolution that leaves out almost nothing of a run of rows is not asked again in its cell, the finest
always is. On vectors without smooth runs of components the coarse ones bound little, and the work is that of the finest.

Queries meet the rows in a grid of blocks, no side broadcast or gathered. A first part of the blocks gives each query
a score to reach; then the others are searched under it. A cell returns the best ``k`` of each query at most.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; zero and empty
vectors do; vectors are compared with those of their own number of components; ties go to the smaller id; rows of equal id are vectors of
their own, and only the query's own row is not its candidate; with fewer candidates than asked all are returned; components
and scores beyond 64 bits are held at the ends of that range; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import discard, settle, ship

#: Rows of a block of candidates at most on average, and of one while there are few blocks; queries of a block; one part in so many of the blocks gives first scores.
BLOCK, SMALL_BLOCK, FEW_BLOCKS, QUERY_BLOCK, FIRST_PART = 1 << 16, 1 << 12, 16, 1 << 16, 16
#: Rows and queries that are bounded at a time, and pairs that are multiplied at a time.
CHUNK, QUERIES, PAIRS = 4096, 256, 1 << 15
#: A resolution that keeps more than DULL of the pairs is not asked again; below SPARSE, pairs are bounded one by one.
DULL, SPARSE = 0.9, 0.05
#: Bounds are rounded to single precision: they are raised by this part of the product of the lengths.
SLACK = 2e-5


def resolutions(width: int) -> list[int]:
    """Numbers of segments, coarse to fine: powers of two, and last the segments of two components."""
    finest = max(1, -(-width // 2))
    return [s for s in (1 << i for i in range(finest.bit_length())) if s < finest] + [finest]


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows of means and deviations of each segment, times the root of its length: their products bound those of the vectors from above."""
    width = vectors.shape[1]
    if not width:
        return np.zeros((len(vectors), 1), np.float32)
    starts = np.arange(segments) * width // segments
    length = np.diff(np.append(starts, width)).astype(float)
    mean = np.add.reduceat(vectors, starts, axis=1) / length
    off = vectors - np.repeat(mean, length.astype(int), axis=1)
    deviation = np.sqrt(np.add.reduceat(off * off, starts, axis=1))
    return np.concatenate((mean * np.sqrt(length), deviation), axis=1).astype(np.float32)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer arrays, held at the ends of the 64-bit range."""
    widest = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0)) * max(left.shape[1], 1)
    if widest < 2.0**53:
        return np.einsum("ij,ij->i", left.astype(float), right.astype(float)).astype(np.int64)
    totals = (left.astype(object) * right.astype(object)).sum(axis=1) if left.shape[1] else np.zeros(len(left), object)
    return np.array([min(max(int(t), -(1 << 63)), (1 << 63) - 1) for t in totals], np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


class _Best:
    """The ``k`` best (score, id, row) of each query of a run."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        query, score, ids, row = (np.concatenate(x) for x in zip((self.query, self.score, self.id, self.row), (query, score, ids, row), strict=True))
        order = np.lexsort((row, ids, ~score, query))  # ~x = -x - 1 falls as x rises, and the least number has one
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.query, self.score, self.id, self.row = query[order], score[order], ids[order], row[order]

    def reached(self, n: int) -> np.ndarray:
        """The score of each query's k-th, minus infinity where there are fewer."""
        out = np.full(n, -np.inf)
        last = np.flatnonzero(np.bincount(self.query, minlength=n) == self.k)
        out[last] = self.score[np.searchsorted(self.query, last, "right") - 1]
        return out


def _searched(k: int):
    """Arrow function of a cell: each query's ``k`` best rows of those that reach its score."""

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * 6]
        if rows.num_rows and queries.num_rows:
            vectors, asked = _matrix(rows.column("v")), _matrix(queries.column("v"))
            names, ids = (rows.column(c).to_numpy() for c in ("row", "id"))
            askers, ask_ids, least = (queries.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "least"))
            levels = resolutions(vectors.shape[1])
            size = np.linalg.norm(vectors.astype(float), axis=1).astype(np.float32) * np.float32(SLACK)
            dull: set[int] = set()
            for c in range(0, len(vectors), CHUNK):
                part = slice(c, c + CHUNK)
                codes = {s: statistics(vectors[part].astype(float), s) for s in levels if s not in dull}
                if not c:
                    best = {a: _Best(k) for a in range(0, len(asked), QUERIES)}
                for a, top in best.items():
                    mine = slice(a, a + QUERIES)
                    own = asked[mine].astype(float)
                    reach = np.maximum(np.where(np.isnan(least[mine]), -np.inf, least[mine]), top.reached(len(own)))
                    slack = np.linalg.norm(own, axis=1).astype(np.float32)[:, None] * size[None, part]
                    i = j = None
                    for s in [s for s in levels if s not in dull]:
                        query_codes = statistics(own, s)
                        # A bound that is not a number leaves nothing out.
                        if i is None:
                            bound = query_codes @ codes[s].T + slack
                            alive = ~(bound < reach[:, None])
                            share = alive.mean()
                            if share > DULL and s != levels[-1] and np.isfinite(reach).any():
                                dull.add(s)
                            if share < SPARSE:
                                i, j = np.nonzero(alive)
                        else:
                            keep = ~(np.einsum("ij,ij->i", query_codes[i], codes[s][j]) + slack[i, j] < reach[i])
                            i, j = i[keep], j[keep]
                    if i is None:
                        # The rows of best bound first: their exact products raise what others must reach.
                        n = min(k + 1, bound.shape[1])
                        j = np.argpartition(-bound, n - 1, axis=1)[:, :n].ravel()
                        i = np.repeat(np.arange(len(own)), n)
                        sound = names[part][j] != askers[mine][i]
                        score = exact(vectors[part][j[sound]], asked[mine][i[sound]])
                        seed = _Best(k)
                        seed.add(i[sound], score, ids[part][j[sound]], names[part][j[sound]])
                        reach = np.maximum(reach, seed.reached(len(own)))
                        i, j = np.nonzero(alive & ~(bound < reach[:, None]))
                    sound = names[part][j] != askers[mine][i]
                    i, j = i[sound], j[sound]
                    for p in range(0, len(i), PAIRS):
                        x, y = i[p : p + PAIRS], j[p : p + PAIRS]
                        score = exact(vectors[part][y], asked[mine][x])
                        enough = ~(score < reach[x])
                        top.add(x[enough], score[enough], ids[part][y[enough]], names[part][y[enough]])
            for a, top in best.items():
                found.append([askers[a + top.query], ask_ids[a + top.query], top.id, top.row, top.score, np.full(len(top.query), len(vectors))])
        return pa.table(dict(zip(("query", "query_id", "vec_id", "row", "score", "met"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return cell


def quantised(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down to whole numbers."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of largest whole-number inner product with each query."""
    spark = vectors.sparkSession
    ship(spark)
    spent: list[str] = []
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = "id is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    rows = given.where(sound).select(F.monotonically_increasing_id().alias("row"), "id", F.size("x").alias("d"), quantised(F.col("x"), scale).alias("v"), "q")
    rows = settle(rows, "whole", spent)
    counts = {r["d"]: (r["n"], r["asked"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).collect()}
    shape = {d: (max(-(-n // BLOCK), min(-(-n // SMALL_BLOCK), FEW_BLOCKS)), max(1, -(-m // QUERY_BLOCK))) for d, (n, m) in counts.items()} or {0: (1, 1)}
    size = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for d, s in shape.items() for x in (d, s[i])]), F.col("d"))
    # Blocks are hashes of rows, so that equal vectors and ids spread evenly.
    first = F.ceil(size(0) / FIRST_PART).cast("int")
    placed = rows.select("d", F.pmod(F.xxhash64("row"), size(0)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), size(1) - 1)).alias("qb"), "row", "id", "v", first.alias("first"))
    asked = rows.where("q").select("row", "id", "d", "v", F.pmod(F.xxhash64("row", F.lit(1)), size(1)).cast("int").alias("qb"), size(0).alias("blocks"), first.alias("first"))
    asked = settle(asked, "queries", spent)
    cell = ["d", "b", "qb"]
    shown = "query long, query_id long, vec_id long, row long, score long, met long"
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")

    def searched(blocks: DataFrame, queries: DataFrame) -> DataFrame:
        return blocks.drop("first").groupBy(cell).cogroup(queries.select(*cell, "row", "id", "v", "least").groupBy(cell)).applyInArrow(_searched(k), shown)

    begun = asked.withColumns({"b": F.explode(F.sequence(F.lit(0), F.col("first") - 1)), "least": F.lit(float("-inf"))})
    some = searched(placed.where("b < first"), begun).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    some = settle(some, "first", spent)
    reach = some.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("least"))
    later = asked.where("blocks > first").join(reach, "row", "left").withColumn("b", F.explode(F.sequence(F.col("first"), F.col("blocks") - 1)))
    rest = searched(placed.where("b >= first"), later)
    every = some.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = settle(every.select("query_id", "rank", "vec_id", "score"), "found")
    discard(spark, spent)
    return out
