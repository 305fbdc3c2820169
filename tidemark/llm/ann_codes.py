"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors are scaled to length one, turned by a random rotation (fixed seed) into ``BITS_EACH`` times as many coordinates, and known by the
signs of these: the code, packed in bytes, with two scalars, the vector's length and the mean size of the turned coordinates. A turned
query times the signs, divided by that correction, estimates the inner product, with an error of ``WIDTH`` standard errors at most
(about one true neighbour in 30,000 lies beyond it).

Codes are made once and stored. A stated set of queries meets all rows in a grid of blocks, so that no side is
broadcast or gathered and any cell can be redone alone, twice: first on codes alone, for the best estimates of each query over all
blocks, whose exact products give a score that the ``k`` nearest reach; then every row whose estimate and error reach
that score is reranked with the exact product in double precision, and no other row is. The work is queries times rows of
one-bit products, as the bounds leave nothing out unseen; what is reranked is a few rows in a hundred and
falls with the number of rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id (an answer needs a
name); vectors are compared with those of their own number of components; ties go to the smaller id; rows of equal id are
vectors of their own, and only the query's own row is not its candidate; with fewer candidates than asked all are returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import discard, settle, ship

#: Coordinates, and so bits of a code, for each component of a vector.
BITS_EACH = 8
WIDTH = 4.0
SEED = 20240229
#: Rows of a block of candidates at most on average, and of one while there are few blocks; queries of a block.
BLOCK, SMALL_BLOCK, FEW_BLOCKS, QUERY_BLOCK = 1 << 16, 1 << 12, 16, 1 << 13
#: Codes that are unpacked at a time.
CHUNK = 4096


@lru_cache(maxsize=8)
def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal rows that turn vectors of ``width`` components into ``BITS_EACH * width`` coordinates, from the QR decomposition of normal draws."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((BITS_EACH * width, width)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes: rows x bytes, lengths, corrections) of vectors of one width."""
    length = np.linalg.norm(vectors, axis=1)
    turned = vectors / length[:, None] @ rotation(vectors.shape[1])
    # The code is the unit vector of the signs over sqrt(bits); its product with the vector's own direction is the correction.
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(queries: np.ndarray, codes: np.ndarray, corrections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated products: queries x rows, error bound of each row) of unit queries with unit vectors known by their codes."""
    turned = (queries @ rotation(queries.shape[1])).astype(np.float32)
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    signs *= 2
    signs -= 1
    value = turned @ signs.T / (np.sqrt(bits) * corrections).astype(np.float32)
    return value, WIDTH * np.sqrt(np.maximum(1 - corrections**2, 0)) / corrections / np.sqrt(max(bits - 1, 1)) + 1e-5


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products in double precision, component after component."""
    total = np.zeros(len(vectors))
    for j in range(len(query)):
        total += vectors[:, j] * query[j]
    return total


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, d, v, q) with code, length and correction."""
    for batch in batches:
        widths = batch.column(2).to_numpy()
        for d in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == d))
            codes, length, own = encode(_matrix(part.column(3)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)], names=[*batch.schema.names, "code", "length", "own"])


def _likely(k: int):
    """Arrow function of a cell: the ``k`` best estimates of each query."""

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query": [np.zeros(0, np.int64)], "row": [np.zeros(0, np.int64)], "value": [np.zeros(0)]}
        if rows.num_rows and queries.num_rows:
            names, length, own = (rows.column(c).to_numpy() for c in ("row", "length", "own"))
            codes, vectors, askers = _codes(rows.column("code")), _matrix(queries.column("v")), queries.column("row").to_numpy()
            norms = np.linalg.norm(vectors, axis=1)
            vectors = vectors / norms[:, None]
            for a in range(0, len(vectors), 512):
                best = np.full((len(vectors[a : a + 512]), 0), 0.0)
                at = best.astype(np.int64)
                for c in range(0, len(codes), CHUNK):
                    value = estimate(vectors[a : a + 512], codes[c : c + CHUNK], own[c : c + CHUNK])[0] * length[c : c + CHUNK]
                    value[askers[a : a + 512, None] == names[None, c : c + CHUNK]] = -np.inf
                    best = np.concatenate((best, value), axis=1)
                    at = np.concatenate((at, np.broadcast_to(np.arange(c, c + value.shape[1]), value.shape)), axis=1)
                    if best.shape[1] > k:
                        top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                        best, at = np.take_along_axis(best, top, 1), np.take_along_axis(at, top, 1)
                sound = best > -np.inf
                found["query"].append(np.broadcast_to(askers[a : a + 512, None], best.shape)[sound])
                found["row"].append(names[at[sound]])
                found["value"].append((best * norms[a : a + 512, None])[sound])
        return pa.table({c: np.concatenate(x) for c, x in found.items()})

    return cell


def _reranked(k: int):
    """Arrow function of a cell: the exact products of the rows that may reach a query's score, its ``k`` best of them."""

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query": [np.zeros(0, np.int64)], "query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)], "tested": [np.zeros(0, np.int64)]}
        if rows.num_rows and queries.num_rows:
            names, ids, length, own = (rows.column(c).to_numpy() for c in ("row", "id", "length", "own"))
            codes, full, vectors = _codes(rows.column("code")), _matrix(rows.column("v")), _matrix(queries.column("v"))
            askers, ask_ids, least = (queries.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "least"))
            norms = np.linalg.norm(vectors, axis=1)
            for a in range(0, len(vectors), 512):
                part = slice(a, a + 512)
                may = []
                for c in range(0, len(codes), CHUNK):
                    value, error = estimate(vectors[part] / norms[part, None], codes[c : c + CHUNK], own[c : c + CHUNK])
                    may.append((value + error) * length[c : c + CHUNK] * norms[part, None] >= least[part, None])
                may = np.concatenate(may, axis=1)
                for i in range(len(may)):
                    at = np.flatnonzero(may[i])
                    at = at[names[at] != askers[a + i]]
                    if not len(at):
                        continue
                    exact = products(full[at], vectors[a + i])
                    order = np.lexsort((ids[at], -exact))[:k]
                    for c, x in (("query", np.full(len(order), askers[a + i])), ("query_id", np.full(len(order), ask_ids[a + i])), ("vec_id", ids[at][order]), ("score", exact[order]), ("tested", np.eye(1, len(order), dtype=np.int64)[0] * len(at))):
                        found[c].append(x)
        return pa.table({c: np.concatenate(x) for c, x in found.items()})

    return cell


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_reranked) of the ``k`` rows of largest inner product with each query."""
    spark = vectors.sparkSession
    ship(spark)
    spent: list[str] = []
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.where(sound).select(F.monotonically_increasing_id().alias("row"), "id", F.size("v").alias("d"), "v", "q")
    rows = settle(rows.mapInArrow(_encoded, "row long, id long, d int, v array<double>, q boolean, code binary, length double, own double"), "codes", spent)
    counts = {r["d"]: (r["n"], r["asked"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).collect()}
    shape = {d: (max(-(-n // BLOCK), min(-(-n // SMALL_BLOCK), FEW_BLOCKS)), max(1, -(-m // QUERY_BLOCK))) for d, (n, m) in counts.items()} or {0: (1, 1)}
    size = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for d, s in shape.items() for x in (d, s[i])]), F.col("d"))
    # Blocks are hashes of rows, so that equal vectors and ids spread evenly; every block of queries meets every block of rows of its width.
    spread = F.explode(F.sequence(F.lit(0), size(1) - 1)).alias("qb")
    own_block = F.pmod(F.xxhash64("row"), size(0)).cast("int").alias("b")
    asked = settle(rows.where("q").select("row", "id", "d", "v", F.pmod(F.xxhash64("row", F.lit(1)), size(1)).cast("int").alias("qb")), "queries", spent)
    blocks = F.explode(F.sequence(F.lit(0), size(0) - 1)).alias("b")
    cell = ["d", "b", "qb"]
    codes = rows.select("d", own_block, spread, "row", "code", "length", "own")
    best = codes.groupBy(cell).cogroup(asked.select("d", blocks, "qb", "row", "v").groupBy(cell)).applyInArrow(_likely(k), "query long, row long, value double")
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value"), "row"))).where(F.col("n") <= k)
    pairs = settle(first.select("query", "row"), "likely", spent).join(rows.select("row", "v"), "row").select("query", "v")
    exact = F.aggregate(F.arrays_zip(F.col("v"), F.col("w")), F.lit(0.0), lambda s, x: s + x["v"] * x["w"])
    reach = pairs.join(asked.select(F.col("row").alias("query"), F.col("v").alias("w")), "query").groupBy("query").agg(F.min(exact).alias("least"), F.count("*").alias("n"))
    reach = settle(reach.select(F.col("query").alias("row"), F.when(F.col("n") == k, F.col("least")).otherwise(-np.inf).alias("least")), "reach", spent)
    asked = asked.join(reach, "row").select("d", blocks, "qb", "row", "id", "v", "least")
    full = rows.select("d", own_block, spread, "row", "id", "v", "code", "length", "own")
    found = full.groupBy(cell).cogroup(asked.groupBy(cell)).applyInArrow(_reranked(k), "query long, query_id long, vec_id long, score double, tested long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumns({"rank": F.row_number().over(order), "n_reranked": F.sum("tested").over(Window.partitionBy("query"))}).where(F.col("rank") <= k)
    out = settle(ranked.select("query_id", "rank", "vec_id", "score", "n_reranked"), "nearest")
    discard(spark, spent)
    return out
