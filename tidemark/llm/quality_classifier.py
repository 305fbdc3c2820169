"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a short vector of statistics (byte classes, word and line shapes, repetition), worked out for whole
Arrow batches in numpy. Trees are grown on histograms of binned statistics of a bounded sample of labelled rows
(``max_rows``, the smallest hashes of doc_id, so the same rows every time) and kept as flat arrays
that score a batch level by level without a Python loop over rows. Scoring is one scan with no shuffle.

Edge cases: a null text counts as empty, and an empty text has statistics (zeros) and a score; labels that are null
are left out; with no labelled rows at all every score is 0.5, with one class only it is near that class;
repeated rows get equal scores; an empty table gives an empty result; extra columns are kept, one named
score or predicted is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textbatch import Texts, slices

MAX_TRAINING_ROWS = 20_000

#: Byte classes; each byte of a text is counted in one of them.
_CLASS_NAMES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "excl", "symbol", "bracket", "quote", "other", "lead", "tail", "control")
_CLASS = np.full(256, _CLASS_NAMES.index("other"), np.uint8)
for _name, _bytes in {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": b" \t",
    "newline": b"\n\r\x0b\x0c",
    "stop": b".?",
    "comma": b",;:-",
    "excl": b"!",
    "symbol": b"#*$%&|<>",
    "bracket": b"()[]{}",
    "quote": b"'\"`",
    "lead": range(0xC0, 0x100),
    "tail": range(0x80, 0xC0),
    "control": [*range(0x09), *range(0x0E, 0x20), 0x7F],
}.items():
    _CLASS[list(_bytes)] = _CLASS_NAMES.index(_name)
_K = len(_CLASS_NAMES)

FEATURES = (
    *(f"share_{c}" for c in _CLASS_NAMES if c != "tail"),
    "log_words",
    "mean_word_bytes",
    "word_bytes_sd",
    "long_words",
    "short_words",
    "distinct_words",
    "words_per_line",
    "repeat_pairs",
)


def statistics(x: Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(x)
    sizes = np.diff(x.offsets)
    doc_of_byte = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(doc_of_byte * _K + _CLASS[x.data], minlength=n * _K).reshape(n, _K).astype(np.float64)
    del doc_of_byte
    chars = np.maximum(counts.sum(1) - counts[:, _CLASS_NAMES.index("tail")], 1)
    words = x.word_counts()
    per_word = np.maximum(words, 1).astype(np.float64)
    doc_of_word = np.repeat(np.arange(n, dtype=np.int64), words)
    length = (x.ends - x.starts).astype(np.float64)
    mean = np.bincount(doc_of_word, length, n) / per_word
    square = np.bincount(doc_of_word, length * length, n) / per_word
    hashes = x.hashes()

    def distinct(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Different values of each text; ranks keep text and value in one sortable integer."""
        if not len(values):
            return np.zeros(n)
        bits = max(1, int(n - 1).bit_length())
        key = np.sort((docs.astype(np.uint64) << np.uint64(64 - bits)) | (values >> np.uint64(bits)))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        return np.bincount((key[first] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)

    pairs = np.flatnonzero(doc_of_word[1:] == doc_of_word[:-1]) if len(doc_of_word) else np.zeros(0, np.int64)
    pair_hash = hashes[pairs] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs + 1] if len(pairs) else np.zeros(0, np.uint64)
    n_pairs = np.maximum(words - 1, 1)
    shares = [counts[:, i] / chars for i, c in enumerate(_CLASS_NAMES) if c != "tail"]
    return np.column_stack(
        [
            *shares,
            np.log1p(words),
            mean,
            np.sqrt(np.maximum(square - mean * mean, 0)),
            np.bincount(doc_of_word, length > 12, n) / per_word,
            np.bincount(doc_of_word, length <= 3, n) / per_word,
            distinct(hashes, doc_of_word) / per_word,
            words / (counts[:, _CLASS_NAMES.index("newline")] + 1),
            np.where(words > 1, 1 - distinct(pair_hash * np.uint64(0xD6E8FEB86659FD93), doc_of_word[pairs]) / n_pairs, 0),
        ]
    )


@dataclass
class Forest:
    """Complete binary trees in flat arrays: node k of a tree has children 2k+1 and 2k+2."""

    prior: float
    depth: int
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.full(len(rows), self.prior), np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -500, 500)))


def fit_forest(rows: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_weight: float = 2.0) -> Forest:
    """Boosted trees on the logistic loss, split on histograms of at most ``bins`` quantile bins a statistic."""
    n = len(label)
    inner, leaves = 2**depth - 1, 2**depth
    positives = float(label.sum())
    prior = float(np.log((positives + 1) / (n - positives + 1)))
    forest = Forest(prior, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if not 0 < positives < n:
        return Forest(prior, depth, forest.feature[:0], forest.threshold[:0], forest.leaf[:0])
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)])
    flat = binned + np.arange(width) * bins
    margin = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - label, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, here = 2**level - 1, 2**level
            key = ((node - base)[:, None] * (width * bins) + flat).ravel()
            size = here * width * bins
            g = np.bincount(key, np.repeat(gradient, width), size).reshape(here, width, bins).cumsum(2)
            h = np.bincount(key, np.repeat(hessian, width), size).reshape(here, width, bins).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < min_weight) | (h_all - h < min_weight)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    forest.feature[t, base + k], forest.threshold[t, base + k] = j, edges[j][b]
            node = 2 * node + 1 + (rows[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node])
        g = np.bincount(node - inner, gradient, leaves)
        h = np.bincount(node - inner, hessian, leaves)
        forest.leaf[t] = -rate * g / (h + l2)
        margin += forest.leaf[t, node - inner]
    return forest


def _free_names(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Forest:
    """Learns from at most ``max_rows`` rows of ``labels``: those with the smallest hashes of ``id_col``."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sample = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct().orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    # At most max_rows pairs of numbers, so it may be broadcast whatever the size of the labels.
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_id", "_label", F.xxhash64("_text").alias("_hash"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(x))), *(batch.column(c).slice(row, len(x)) for c in (1, 2, 3))], names=["x", "_id", "_label", "_hash"])

    # Of rows of one id the one of smallest hash of the text counts, so that at most max_rows come to the driver, always the same.
    kind = dict(texts.dtypes)["_id"]
    one = texts.mapInArrow(measure, f"x array<double>, _id {kind}, _label int, _hash long").groupBy("_id", "_label").agg(F.min(F.struct("_hash", "x")).alias("m"))
    found = one.select("m.x", "_label").collect()
    rows = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    label = np.array([r["_label"] for r in found], float)
    order = np.lexsort((label, *rows.T)) if len(rows) else np.zeros(0, np.int64)
    return fit_forest(rows[order], label[order])


def score_quality(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int)."""
    docs = _free_names(docs, "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    column = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forest.score(statistics(x)) for _, x in slices(batch.column(column))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(score, schema)
