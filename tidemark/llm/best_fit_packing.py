"""Best-fit packing of tokenised documents into sequences of fixed capacity, by large-item matching.

A document is its token ids and a closing id; one longer than the capacity is cut into pieces. Pieces above a
third of the capacity stand at most twice in a bin: from the largest down each is matched with the largest that still fits
beside it. Smaller pieces then go, from the largest down, where the remaining gap is smallest, and open new bins last.

Only lengths matter to the packing and there are at most ``capacity`` of them, so the plan is made on the
histogram of lengths (a bounded table, whatever the number of documents) as runs: "the pieces of length s of ranks
r..r+n lie m to a bin from bin b on, at offset o". Each piece finds its place from its rank among the pieces of its length; ranks
come from counts of salted groups, so a length that a third of all pieces share is no hot spot.

Tokens: pieces of text between white space (and between ASCII letters or digits and other ASCII signs, where the tokenizer
always splits too, and at ASCII digits) are encoded once and remembered in each worker, at most ``REMEMBERED_BYTES`` of them. A
tokenizer that does not split there encodes whole texts.

Edge cases: null and empty texts are the closing id alone; repeated rows are packed as often as they occur; equal
lengths are ranked by id, piece and checksum, and rows equal in these are interchangeable; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import threading
import time
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import settle, ship
from tidemark.llm.textbatch import Texts, give_back, slices

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Bytes of remembered pieces in a worker; the pieces met longest ago are let go beyond it.
REMEMBERED_BYTES = 32 << 20
IDLE = 15.0
#: Bytes of text that are encoded at a time.
SLICE = 1 << 19
#: A length of more pieces than this is ranked in salted groups of about so many.
ROWS_EACH = 50_000


def default_tokenizer() -> str:
    """The path of the public vocabulary file; needed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# Byte kinds for cuts inside words: 1 ASCII letters, 2 ASCII signs but the apostrophe, 3 ASCII digits, 0 all else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 3
_KIND[[b for b in range(33, 127) if not _KIND[b] and b != 39]] = 2


#: Latin-1 letters as the characters by which byte-level vocabularies write their UTF-8 bytes: printable bytes stand for themselves, others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LATIN = {c: "".join(_SIGN[b] for b in chr(c).encode()) for c in range(128, 256)}


def _splits_words(path: str) -> bool:
    """Whether the tokenizer treats every word, run of letters, run of signs and digit by itself, in lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return "Lowercase" in normal and cuts.get("behavior") == "Removed" and cuts.get("invert") is True and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cuts.get("pattern", {}).get("Regex", "")


class Encoder:
    """Token ids of texts, with the ids of the pieces met last at hand: sorted hashes beside flat arrays of ids, at most ``room`` bytes."""

    def __init__(self, path: str, room: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece, self.room, self.clock = _splits_words(path), room, 0
        give_back()  # what reading the file took
        self.hash, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.ids, self.at, self.size, self.met))

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        # Of Latin letters only, the lower-case piece is one word to the model; all else goes through every step of the tokenizer.
        tokens = self.tokenizer.model.tokenize
        found = [[t.id for t in tokens(p.lower().translate(_LATIN))] if p.isalpha() and max(p) < "\u0100" else None for p in pieces]
        other = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = e.ids
        size = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        place = np.searchsorted(self.hash, hashes)
        self.ids = np.concatenate((self.ids, ids))
        for name, new in (("hash", hashes), ("at", at), ("size", size), ("met", np.full(len(size), self.clock, np.int32))):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        if self.held() > self.room:
            self.let_go()

    def let_go(self) -> None:
        """Keeps what was met in this call and, of the rest, the half that was met last."""
        keep = self.met >= min(self.clock, int(np.median(self.met)) + 1)
        self.hash, at, self.size, self.met = self.hash[keep], self.at[keep], self.size[keep], self.met[keep]
        self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.ids = self.ids[np.arange(self.size.sum()) + np.repeat(at - self.at, self.size)]

    def encode(self, x: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins and the last ends)."""
        data = x.data
        if not self.by_piece:
            return self._whole(x, range(len(x)), np.zeros(0, np.int32), np.zeros(len(x) + 1, np.int64))
        self.clock += 1
        inside = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            kind = _KIND[data]
            # A cut where letters, signs and digits meet and between digits; it must lie within a word of the same text.
            inside[1:-1] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 3))
        inside[x.starts] = True
        starts = np.flatnonzero(inside)
        ends = np.minimum(x.ends[np.searchsorted(x.starts, starts, "right") - 1], np.append(starts[1:], len(data))) if len(starts) else starts
        pieces = Texts.__new__(Texts)
        pieces.data, pieces.offsets, pieces.starts, pieces.ends = data, x.offsets, starts, ends
        inverse, different = pd.factorize(pieces.hashes())
        at = np.searchsorted(self.hash, different)
        known = self.hash[np.minimum(at, len(self.hash) - 1)] == different if len(self.hash) else np.zeros(len(different), bool)
        if not known.all():
            raw, new = data.tobytes(), np.flatnonzero(~known)
            first = np.zeros(len(different), np.int64)
            first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
            new = new[np.argsort(different[new])]
            self.met[at[known]] = self.clock
            self.learn(different[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new].tolist()])
            at = np.searchsorted(self.hash, different)
        self.met[at] = self.clock
        size = self.size[at][inverse]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.at[at][inverse] - total[:-1], size)]
        bounds = total[np.searchsorted(starts, x.offsets)]
        marks = [i for i in range(len(x)) if b"<|" in data[x.offsets[i] : x.offsets[i + 1]].tobytes()] if b"<|" in data.tobytes() else []
        # Texts that may hold the strings of special tokens, which lie across the cuts.
        return self._whole(x, marks, ids, bounds) if marks else (ids, bounds)

    def _whole(self, x: Texts, which: Iterable[int], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` and ``bounds`` with the texts ``which`` encoded as wholes."""
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(x))]
        for i in which:
            text = x.data[x.offsets[i] : x.offsets[i + 1]].tobytes().decode("utf-8", "replace")
            parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


_encoders: dict[str, Encoder] = {}
_last_use = 0.0


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget_when_idle() -> None:
    """Gives a worker's memory back when no task has encoded for ``IDLE`` seconds; a task at work has its encoder in hand."""
    global _last_use
    _last_use = time.monotonic()
    timer = threading.Timer(IDLE, lambda: _encoders.clear() if time.monotonic() - _last_use >= IDLE else None)
    timer.daemon = True
    timer.start()


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        try:
            yield from pieces(encoder, batches)
        finally:
            _forget_when_idle()
            give_back()

    def pieces(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in slices(batch.column(1), SLICE):
                ids, bounds = encoder.encode(x)
                ids = ids.astype("<u4")
                doc, piece, start, length, check = [], [], [], [], []
                for i in range(len(x)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(CLOSING_ID))
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        doc.append(row + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        check.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, check))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces to a bin, offset), in order of length and rank."""
    left = {s: n for s, n in histogram.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    bins = 0

    def place(s: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((s, rank[s], first, each, offset))
        rank[s] += n
        left[s] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] >= 1 + (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, bins, 1, 0)
            if b is not None:
                place(b, n, bins, 1, a)
            gaps[capacity - a - (b or 0)].append((bins, n))
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((bins, n))
                bins += n
                continue
            first, n = gaps[gap].pop()
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            place(s, full * each, first, each, capacity - gap)
            gaps[gap - each * s].append((first, full))
            if full < n:
                gaps[gap].append((first + full, n - full))
            if not gaps[gap]:
                del gaps[gap]
    return sorted(runs)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    ship(docs.sparkSession)
    pieces = settle(token_pieces(docs, id_col, text_col, capacity, tokenizer), "pieces", texts=True)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs = packing_plan(histogram, capacity)
    # Lengths that many pieces share are ranked in salted groups; the table of these grows with the pieces, one row for ROWS_EACH.
    salts = {s: -(-n // ROWS_EACH) for s, n in histogram.items() if n > ROWS_EACH}
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in salts.items() for x in kv]), F.col("length").cast("int")), F.lit(1))) if salts else F.lit(0).cast("long")
    salted = pieces.withColumn("salt", salt)
    within = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    if salts:
        counts = {(r[0], r[1]): r[2] for r in salted.where(F.col("length").isin(list(salts))).groupBy("length", "salt").count().collect()}
        before, rows = defaultdict(int), []
        for s, k in sorted(counts):
            rows.append((s, k, before[s]))
            before[s] += counts[s, k]
        ranks = pieces.sparkSession.createDataFrame(rows, "length long, salt long, before long")
        within = within.join(ranks, ["length", "salt"], "left")
    else:
        within = within.withColumn("before", F.lit(None).cast("long"))
    ranked = within.select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("nth") - 1).alias("rank"))

    table = np.array(runs, np.int64).reshape(len(runs), 5)
    key = (table[:, 0] << 44) + table[:, 1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth = rank - table[run, 1]
            each = table[run, 3]
            sequence = table[run, 2] + nth // np.maximum(each, 1)
            offset = table[run, 4] + nth % np.maximum(each, 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
