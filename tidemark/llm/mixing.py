"""Mixing sources to target weights with soft domain membership.

A classifier learnt from a bounded sample of a labelled table (``MAX_TRAINING_ROWS`` smallest hashes of the id) gives every
document posteriors over the domains: boosted trees, one against the rest, over document statistics and the evidence
of words that are far more frequent in one domain. Words are counted by bucket, domain and fold in Spark; the trees learn from the evidence
of the other folds, so that a text's own words do not speak for it. Nonnegative rates then bring the expected tokens of each domain to their
targets: least squares on the domain totals with a small pull towards rate 1, solved by projected gradient steps that are scaled by the
curvature of the documents in play (those of positive rate). All steps lie in the span of the posteriors, so a rate is the projection of
1 less the posteriors times the sum of the steps, one number for each domain: an iteration is one aggregation of a few numbers, whatever came
before it. A step is halved until the objective falls, and iterations end when its gradient is nought (to ``TOLERANCE``): the
rates are then the least-squares ones, and ``remaining_miss`` in each row, the largest miss of a share that is left, is no larger than the
documents at hand and the pull make it. Targets that no nonnegative rates meet so keep a miss of some size.

Edge cases: a null text is empty and counts one token (the end of the text); labels with null domain are left out; a
domain without labels has posterior 0 and its target cannot be met (the others share what is left in proportion);
with no labels at all every posterior is equal; repeated rows each have their rate; of repeated ids of labelled texts the one of smallest
hash is learnt from; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.quality_classifier import FEATURES, Forest, fit_forest, statistics
from tidemark.llm.storage import settle, ship
from tidemark.llm.textbatch import Texts, slices

MAX_TRAINING_ROWS = 8_000
BUCKETS = 1 << 16
#: Standard errors by which a word's share in a domain must pass its share elsewhere to be evidence.
EVIDENCE = 6.0
FOLDS = 4
PULL = 1e-6
#: Steps end long before ITERATIONS unless numbers break down; TOLERANCE is that of the gradient, in shares of all tokens.
ITERATIONS, TOLERANCE = 60, 1e-8
#: Parts of a step that are tried at once.
HALVINGS = (1.0, 0.5, 0.25, 0.125, 0.03125, 0.0078125)


def _buckets(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, word bucket) of each distinct word of each text."""
    n = len(x)
    code = np.repeat(np.arange(n, dtype=np.int64), x.word_counts()) * BUCKETS + (x.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    return np.divmod(pd.unique(code), BUCKETS)


@dataclass
class DomainModel:
    """Posteriors over ``domains`` from word evidence (buckets x domains) and one forest for each domain."""

    domains: tuple[str, ...]
    evidence: np.ndarray
    forests: list[Forest] = field(default_factory=list)

    def features(self, x: Texts) -> np.ndarray:
        text, bucket = _buckets(x)
        words = [np.bincount(text, self.evidence[bucket, k], len(x)) for k in range(len(self.domains))]
        return np.column_stack([statistics(x), *words])

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        if not self.forests:
            return np.full((len(rows), len(self.domains)), 1 / len(self.domains))
        p = np.column_stack([f.score(rows) if f is not None else np.zeros(len(rows)) for f in self.forests])
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> DomainModel:
    """Learns from at most ``max_rows`` rows of ``labels``, whose column ``domain`` names one of ``domains``."""
    named = F.array_position(F.array(*[F.lit(d) for d in domains]), domain).cast("int") - 1
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), named.alias("_domain")).where("_id is not null and _domain >= 0").distinct()
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_domain").limit(max_rows).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # At most max_rows pairs of integers, so it may be broadcast whatever the size of the labels.
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_domain", "_fold", "_id", F.xxhash64("_text").alias("_hash"))
    n_domains = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros((FOLDS, n_domains, BUCKETS + 1), np.int64)  # the last place counts texts
        for batch in batches:
            domain, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for row, x in slices(batch.column(0)):
                text, bucket = _buckets(x)
                np.add.at(here, (fold[row + text], domain[row + text], bucket), 1)
                np.add.at(here, (fold[row : row + len(x)], domain[row : row + len(x)], BUCKETS), 1)
        f, d, b = np.nonzero(here)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (f, d, b, here[f, d, b])], names=["f", "d", "b", "n"])

    counts = np.zeros((FOLDS, n_domains, BUCKETS + 1))
    # At most folds x domains x buckets rows.
    for r in texts.mapInArrow(count, "f long, d long, b long, n long").groupBy("f", "d", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["f"], r["d"], r["b"]] = r["n"]
    everything = counts.sum(0)
    if not everything[:, BUCKETS].sum():
        return DomainModel(domains, np.zeros((BUCKETS, n_domains)))
    others = [_evidence(everything - counts[f]) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for row, x in slices(batch.column(0)):
                text, bucket = _buckets(x)
                own = np.stack(others)[fold[row + text], bucket]
                words = [np.bincount(text, own[:, k], len(x)) for k in range(n_domains)]
                yield pa.RecordBatch.from_arrays([pa.array(list(np.column_stack([statistics(x), *words]))), *(batch.column(c).slice(row, len(x)) for c in (1, 3, 4))], names=["x", "_domain", "_id", "_hash"])

    kind = dict(texts.dtypes)["_id"]
    one = texts.mapInArrow(measure, f"x array<double>, _domain int, _id {kind}, _hash long").groupBy("_id", "_domain").agg(F.min(F.struct("_hash", "x")).alias("m"))
    found = one.select("m.x", "_domain").collect()
    rows, y = np.array([r["x"] for r in found], float), np.array([r["_domain"] for r in found])
    order = np.lexsort((y, *rows.T))
    model = DomainModel(domains, _evidence(everything))
    model.forests = [fit_forest(rows[order], (y[order] == k).astype(float), trees=60) if (y == k).any() else None for k in range(n_domains)]
    return model


def _evidence(counts: np.ndarray) -> np.ndarray:
    """Logarithms by which words speak for a domain (buckets x domains), from texts that hold them (domains x buckets, and all texts last)."""
    size, here = counts[:, -1], counts[:, :-1].T
    total, out = here.sum(1), np.zeros((len(counts[0]) - 1, len(size)))
    for k in range(len(size)):
        p, q = (here[:, k] + 0.5) / (size[k] + 1), (total - here[:, k] + 0.5) / (size.sum() - size[k] + 1)
        error = np.sqrt(p * (1 - np.minimum(p, 1)) / (size[k] + 1) + q * (1 - np.minimum(q, 1)) / (size.sum() - size[k] + 1))
        out[:, k] = np.where(p - q > EVIDENCE * error, np.log(p / q), 0)
    return out


def domain_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words and the end) and posteriors (array, in the order of the domains)."""
    docs = docs.drop(*[c for c in docs.columns if c in ("n_tokens", "posteriors")])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p = [], []
            for _, x in slices(batch.column(column)):
                tokens.append(x.word_counts() + 1)
                p += list(model.posteriors(model.features(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def replay(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents of posteriors ``p`` after the given steps, twice: as they are, and as the next step starts from them."""
    rate = np.maximum(0, 1 - p @ np.sum(steps, axis=0)) if len(steps) else np.ones(len(p))
    return np.stack([rate, rate])


def _measured(points: list[np.ndarray]):
    """Arrow function of rows (n_tokens, posteriors): for each point (a sum of steps) half the weighted squares of rates, the domains' totals, and their curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(points[0])
        out = np.zeros((len(points), 1 + width + width * width))
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(len(tokens), width)
            for k, point in enumerate(points):
                rate = np.maximum(0, 1 - p @ point)
                play = p * (tokens * (rate > 0))[:, None]
                out[k] += np.concatenate(([(tokens * rate * rate).sum() / 2], (tokens * rate) @ p, (play.T @ p).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(out.reshape(1, -1)))], names=["s"])

    return run


def solve_rates(members: DataFrame, targets: np.ndarray, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, pull: float = PULL) -> tuple[list[np.ndarray], float]:
    """(steps, from which :func:`replay` gives every document's rate; the largest miss that is left).

    ``targets``: shares of all tokens, one for each domain.
    """
    members = members.select("n_tokens", "posteriors")
    total, width = float(members.agg(F.sum("n_tokens")).first()[0] or 0), len(targets)
    if not total:
        return [], float(np.abs(targets).max()) if width else 0.0
    steps: list[np.ndarray] = []
    points, least = [np.zeros(width)], np.inf
    while True:
        parts = [r[0] for r in members.mapInArrow(_measured(points), "s array<double>").collect()]
        # Exact sums, so that the order in which tasks end does not show.
        sums = np.array([math.fsum(c) for c in zip(*parts, strict=True)]).reshape(len(points), -1) / total
        value = sums[:, 0] + np.array([x @ targets + pull / 2 * x @ x for x in points])
        best = int(np.argmin(value))
        if value[best] >= least:  # as low as doubles can tell
            break
        if least < np.inf:
            steps.append(points[best] - at)
        at, least, now = points[best], value[best], sums[best, 1 : 1 + width]
        gradient = targets + pull * at - now
        left = float(np.abs(now - targets).max())
        if np.abs(gradient).max() <= tolerance or len(steps) >= iterations:
            break
        curvature = sums[best, 1 + width :].reshape(width, width) + pull * np.eye(width)
        direction = -np.linalg.solve(curvature, gradient)
        points = [at + direction * f for f in HALVINGS]
    return steps, left


def with_rates(members: DataFrame, steps: list[np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """``members`` with rate and copies: the whole part of the rate, and one more with the odds of the rest by hash of the id."""
    column = members.columns.index("posteriors")
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(p, steps)[0])], names=schema.names)

    odds = F.pmod(F.xxhash64(F.col(id_col), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rated = members.mapInArrow(run, schema)
    return rated.withColumn("copies", (F.floor("rate") + (odds < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix_to_targets(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", relative: bool = False, row_col: str | None = None) -> DataFrame:
    """(id, n_tokens, posteriors, rate, copies, remaining_miss) of every row.

    ``targets``: the domains' shares of all tokens, or with ``relative`` factors of the shares they have now; scaled to sum 1.
    ``row_col``: a key of rows whose ids may be null or repeated; it is returned too and rounds their rates in place of the id.
    """
    ship(docs.sparkSession)
    domains = tuple(targets)
    model = fit_domains(docs, labels, domain, domains, id_col, text_col)
    members = domain_posteriors(docs.select(id_col, text_col, *([row_col] if row_col else [])), model, text_col).drop(text_col)
    members = settle(members, "members", texts=True)
    share = np.array([targets[d] for d in domains], float)
    if relative:
        p = members.agg(*[F.sum(F.col("n_tokens") * F.col("posteriors")[k]) for k in range(len(domains))]).first()
        share = share * np.array([v or 0.0 for v in p])
    if share.sum() > 0:
        share = share / share.sum()
    steps, left = solve_rates(members, share)
    return with_rates(members, steps, row_col or id_col).withColumn("remaining_miss", F.lit(left))
