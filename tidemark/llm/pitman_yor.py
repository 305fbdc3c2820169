"""Language-model scoring with a hierarchical Pitman-Yor model of three levels over words.

The two words before a token are its restaurant; all restaurants of the same last word share that word's restaurant as their parent, and
these share the restaurant of single words, whose own parent is uniform over the known words and one unknown word. What is seated are
numbers of tables: given all others, those of a dish have the weights of generalised Stirling numbers, from which they are drawn by
Gibbs sampling (in the limit of many customers for dishes of more than ``EXACT``). In each of ``ROUNDS`` rounds
the restaurants of two and of one word are seated together against the root's probabilities (at first uniform), then
the root anew against the exact sums of their tables. Scores average the predictive probabilities of the kept sweeps of the last round.

How it is spread: texts are read in runs of some million bytes. A run sends its distinct triples, with the texts that hold them, to *sites* by
the last word, so that a site has whole trees of restaurants (words are told by 56 bits, words before a context by 32); a triple that very many texts of a run hold leaves its text list
behind and only asks for its probability. The restaurants behind a word of more than ``ROOM`` training tokens (and of more than one in 2**20
of all, so at most 2**20 words) are dealt to sites in *parts*, classes of the words before it, as many as keep to ``ROOM`` tokens on
average; starts of texts, which have one word before and so no restaurant of two, are dealt by id. All parts share the word's restaurant: in the
first round each part seats against its own share of it, then the customers of all parts are summed, its tables are seated anew on the exact sums, and in the
next round each part sees those of all others as they were. Parts depend on the counts and words alone. What sites tell each other are rows (site, word,
tables) and (site, part's word, word, customers), summed by word and sent back with the root's probability. Random numbers are hashes of the words that
they are for, so scores do not depend on partitions or on the number of sites, and not on ids.

Edge cases: null and blank texts are one token, the end; a table with no training text gives every token the
probability of the unknown word; repeated rows are scored and counted as often as they occur; an empty table gives an empty
result; null ids stay null; other columns are not read. A single context of two words is not split: its distinct
next words, not its tokens, must fit in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import settle, ship, shuffle_partitions
from tidemark.llm.textbatch import give_back, mix, slices

#: Discounts and strengths of restaurants of two words, of one word, and of the root.
DISCOUNT, STRENGTH = (0.9, 0.8, 0.6), (0.5, 1.0, 1.0)
#: Sweeps of the last round, those of it that do not count, and those of earlier rounds.
ROUNDS, SWEEPS, BURN_IN, EARLY = 2, 6, 2, 2
RUN_BYTES = 10 << 20
SITE_TOKENS = 2_200_000
#: A triple that more tokens of a run hold keeps its text list there.
HOT = 256
#: Training tokens of a word from which its restaurants of two words are dealt to sites in parts.
ROOM = 200_000
#: Customers of a dish up to which its tables are drawn from their exact weights; from there on from the limit of these for many
#: customers, and from a normal distribution where ``FEW`` tables or more are expected.
EXACT, FEW = 48, 16

END, START = (int(x) >> 8 for x in mix(np.array([1, 2], np.uint64)))
_STEP = np.uint64(0x9E3779B97F4A7C15)

_ROW = pa.schema([("site", pa.int32()), ("run", pa.int64()), ("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("flags", "tokens", "hot_each", "hot_text", "keys", "before", "mids", "parts", "each_mid", "u", "w", "each", "text", "hot_id", "hot_count")])
_PART = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("flags", "tokens", "hot_each", "hot_text", "text", "score", "base", "known", "hot_id", "hot_score", "hot_base", "hot_known")])
#: Rows of sites: of words (part 0), or of words after a word that lies in parts (parts from 1; count: 0, tables: the part's customers).
_SUMS = "parent int, all_customers long, all_tables long"
_WORDS = "site int, part int, word long, count long, tables long"


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _pack(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest needs, the bytes of a place together under a Huffman code; floats as they are. The first byte says which."""
    if values.dtype.kind not in "iu":
        return values.dtype.char.encode() + values.tobytes()
    top = int(values.max()) if len(values) else 0
    values = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return values.dtype.char.encode() + code.compress(planes) + code.flush()


def _unpack(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    kind = np.dtype(data[:1].decode())
    if kind.kind == "f":
        return np.frombuffer(data, kind, offset=1)
    planes = np.frombuffer(zlib.decompress(data[1:], -15), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their steps, all lowest bytes first, as many as the largest needs, the highest under a Huffman code; before them how many bytes and keys."""
    steps = np.diff(keys, prepend=np.uint64(0))
    n = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:n])
    code = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return bytes([n]) + len(keys).to_bytes(4, "little") + planes[:-1].tobytes() + code.compress(planes[-1].tobytes()) + code.flush()


def _unpack_keys(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, count = data[0], int.from_bytes(data[1:5], "little")
    high = 5 + (n - 1) * count
    steps = np.zeros((count, 8), np.uint8)
    steps[:, : n - 1] = np.frombuffer(data, np.uint8, (n - 1) * count, 5).reshape(n - 1, count).T
    steps[:, n - 1] = np.frombuffer(zlib.decompress(data[high:], -15), np.uint8)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


@cache
def stirling(discount: float, n: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of ``n`` customers at 1..n tables."""
    if n == 1:
        return np.zeros(1)
    last = stirling(discount, n - 1)
    stay = last + np.log(n - 1 - discount * np.arange(1, n))
    return np.logaddexp(np.append(stay, -np.inf), np.append(-np.inf, last))


def draw(names: np.ndarray, turn: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the names and the turn only."""
    h = mix(names + np.array([turn + 1], np.uint64) * _STEP)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def seat(customers: np.ndarray, others: np.ndarray, parent: tuple[np.ndarray, ...], discount: float, strength: float, names: np.ndarray, turn: int) -> np.ndarray:
    """Tables of each dish, drawn given the tables of the other dishes in its restaurant and the parent's probabilities.

    ``parent``: the probability of the dish, or (that of a first table, and a numerator and a denominator that each table raises by one).
    """
    tables = (customers > 0).astype(np.float64)
    large = customers > EXACT
    for n in np.unique(customers[(customers > 1) & ~large]).tolist():
        at = np.flatnonzero(customers == n)
        tables[at] = _drawn(stirling(discount, n), at, others, parent, discount, strength, names, turn)
    at = np.flatnonzero(large)
    if len(at):
        # Where customers are many, tables hardly depend on their number: rising table by table as often as tables of one customer go.
        n = customers[at]
        p = lambda t: parent[0][at] if len(parent) == 1 else (parent[1][at] + t) / (parent[2][at] + t)
        low, high = np.zeros(len(at)), n.astype(np.float64)
        for _ in range(50):
            t = (low + high) / 2
            more = (strength + discount * (others[at] + t)) * p(t) * n > discount * t * (n - discount * t)
            low, high = np.where(more, t, low), np.where(more, high, t)
        rest = np.maximum(1 - p(low), 1e-9)
        mean = low + 1 / rest
        z = np.sqrt(-2 * np.log(draw(names[at], 1000 + turn))) * np.cos(2 * np.pi * draw(names[at], 2000 + turn))
        tables[at] = np.clip(np.rint(mean + z * np.sqrt(np.maximum(mean - 1, 0) / rest)), 1, n)
        few = at[mean < FEW]
        if len(few):
            k = np.arange(1, 4 * FEW + 1)
            limit = np.concatenate(([0.0], -np.cumsum(np.log(k[:-1] * discount))))
            tables[few] = np.minimum(_drawn(limit, few, others, parent, discount, strength, names, turn), customers[few])
    return tables


def _drawn(ways: np.ndarray, at: np.ndarray, others: np.ndarray, parent: tuple[np.ndarray, ...], discount: float, strength: float, names: np.ndarray, turn: int) -> np.ndarray:
    """Numbers of tables of the dishes ``at``, with the logarithms of the ``ways`` to sit at 1, 2, .. tables."""
    out = np.empty(len(at))
    for a in range(0, len(at), 1 << 15):
        here, n = at[a : a + (1 << 15)], len(ways)
        steps = np.log(strength + discount * (others[here, None] + np.arange(n))) + np.log(parent[0][here, None])
        if len(parent) > 1:
            more = np.arange(1, n)
            steps[:, 1:] += np.log((parent[1][here, None] + more) / (parent[2][here, None] + more)) - np.log(parent[0][here, None])
        weight = np.cumsum(steps, axis=1) + ways
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        out[a : a + (1 << 15)] = 1 + (weight < (draw(names[here], turn) * weight[:, -1])[:, None]).sum(1)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, train, hashes of all words, words of each text) of about RUN_BYTES of text at a time."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def run() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        ids, *arrays = zip(*held, strict=True)
        held.clear()
        return pa.concat_arrays(ids), *(np.concatenate(a) for a in arrays)

    for batch in batches:
        for row, x in slices(batch.column(2)):
            n = len(x)
            held.append((batch.column(0).slice(row, n), batch.column(1).slice(row, n).to_numpy(zero_copy_only=False).astype(bool), x.hashes() >> np.uint64(8), x.word_counts()))
            size += len(x.data)
            if size >= RUN_BYTES:
                yield run()
                size = 0
    if held:
        yield run()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training tokens) of each run."""
    for _, train, words, counts in _runs(batches):
        code, keys = pd.factorize(words)
        count = np.bincount(code, np.repeat(train, counts), len(keys)).astype(np.int64)
        keys, count = np.append(keys, np.uint64(END)), np.append(count, train.sum())
        some = count > 0
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(count[some])], names=["word", "count"])


def _codes(values: np.ndarray, by_name: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(small codes, different values), which rise with the codes if asked."""
    codes, different = pd.factorize(values)
    if not by_name:
        return codes.astype(np.int32), different
    order = np.argsort(different)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[codes], different[order]


def _sorted_triples(m: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each different triple in that order)."""
    if max(len(m) and int(x.max()) for x in (u, w)) < 1 << 21 and (len(m) and int(m.max())) < 1 << 21:
        packed = m.astype(np.int64)
        for x in (u, w):
            packed <<= 21
            packed |= x
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        return order, np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(m) else order
    order = np.lexsort((w, u, m))
    m, u, w = m[order], u[order], w[order]
    return order, np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))


def _scatter(sites: int, split: np.ndarray, classes: np.ndarray):
    """Arrow function: (id, train, text) to the rows that sites get. ``split``: sorted words, the start among them, in as many parts as ``classes`` says."""
    offsets = np.cumsum(classes) - classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for ids, train, words, counts in _runs(batches):
            number += 1
            n_texts, n = len(counts), len(words) + len(counts)
            ends = np.cumsum(counts + 1) - 1
            first = ends - counts
            token, is_end = np.empty(n, np.uint64), np.zeros(n, bool)
            is_end[ends] = True
            token[is_end], token[~is_end] = END, words
            named = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            v, u = np.empty(n, np.uint64), np.empty(n, np.uint64)
            v[1:], u[2:] = token[:-1], token[:-2]
            u[first[counts > 0] + 1] = START
            v[first], u[first] = START, mix(named + _STEP)
            mid = v.copy()
            at = np.minimum(np.searchsorted(split, v), len(split) - 1)
            many = np.flatnonzero(split[at] == v)
            at = at[many]
            part = mix(u[many] + np.uint64(7)) % classes[at]
            mid[many] += _STEP * part
            u[first] = START
            del v, is_end, words
            m, mids = _codes(mix(mid) >> np.uint64(16))
            parts = np.zeros(len(mids), np.int64)
            parts[m[many]] = (offsets[at] + part).astype(np.int64) + 1
            del mid, at, many, part
            u, before = _codes(mix(u) >> np.uint64(32), by_name=True)
            w, keys = _codes(token, by_name=True)
            del token
            # Restaurants in order of site, then name.
            site = (mids % np.uint64(sites)).astype(np.int64)
            rank = np.lexsort((mids, site))
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            site, mids, parts, m = site[rank], mids[rank], parts[rank], place.astype(np.int32)[m]
            text = np.repeat(np.arange(n_texts, dtype=np.int32), counts + 1)
            order, start = _sorted_triples(m, u, w)
            text, each = text[order], np.diff(np.append(start, n))
            m, u, w = (x[order[start]] for x in (m, u, w))
            del order
            hot = each > HOT
            hot_id = np.cumsum(hot) - 1
            weight = np.add.reduceat(train[text].astype(np.int64), start)
            in_text = np.repeat(~hot, each)
            flags = np.packbits(train).tobytes()
            head = {"site": int(number % sites), "run": number, "flags": flags, "tokens": _pack(counts + 1), "hot_each": _pack(each[hot]), "hot_text": _pack(text[~in_text])}
            yield pa.RecordBatch.from_arrays([pa.array([head.get(f.name)], f.type) if f.name != "ids" else pa.ListArray.from_arrays(pa.array([0, n_texts], pa.int32()), ids) for f in _ROW], schema=_ROW)
            # Bounds of the sites among restaurants, triples and text lists.
            of_mid = np.searchsorted(site, np.arange(sites + 1))
            of_triple = np.searchsorted(m, of_mid)
            warm = np.where(hot, 0, each)
            lists, warm_text = np.concatenate(([0], np.cumsum(warm))), text[in_text]
            for s in np.flatnonzero(np.diff(of_triple)).tolist():
                a, b = of_triple[s], of_triple[s + 1]
                (after, local_w), (first_u, local_u) = _local(w[a:b], keys), _local(u[a:b], before)
                # Within a restaurant of one word the words before rise: their steps are sent.
                steps, begins = np.diff(local_u, prepend=0), np.diff(m[a:b], prepend=-1) != 0
                steps[begins] = local_u[begins]
                row = {"site": s, "run": number, "flags": flags, "keys": _pack_keys(after), "before": _pack_keys(first_u), "mids": _pack_keys(mids[of_mid[s] : of_mid[s + 1]]), "parts": _pack(parts[of_mid[s] : of_mid[s + 1]])}
                row |= {"each_mid": _pack(np.bincount(m[a:b] - of_mid[s], minlength=of_mid[s + 1] - of_mid[s])), "u": _pack(steps), "w": _pack(local_w), "each": _pack(warm[a:b]), "text": _pack(warm_text[lists[a] : lists[b]])}
                boiling = hot[a:b]
                if boiling.any():
                    row |= {"hot_id": _pack(hot_id[a:b][boiling]), "hot_count": _pack(weight[a:b][boiling])}
                yield pa.RecordBatch.from_pylist([row], _ROW)
            del m, u, w, text, each, start, hot, hot_id, weight, in_text, warm, lists, warm_text
            give_back()

    return run


def _local(codes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names that the codes use, in order as all names are, the place among these of each code)."""
    used, local = np.unique(codes, return_inverse=True)
    return names[used], local


class _Site:
    """The trees of restaurants of one site: triples of (restaurant of one word, word before, word) with their training tokens.

    ``part``: for each restaurant of one word the number of the part that it is, 0 for whole ones; ``start``: whether it is the start of texts,
    which has no restaurants of two words.
    """

    part = start = None

    def __init__(self, table: pa.Table, split: np.ndarray, bounds: np.ndarray):
        self.rows = sorted((r for r in table.drop_columns(["ids", "tokens", "hot_each", "hot_text"]).to_pylist() if r["keys"] is not None), key=lambda r: r["run"])
        keys, before, mids, parts, m, u, w, count, at_key, at_u, at_mid = [], [], [], [], [], [], [], [], 0, 0, 0
        for r in self.rows:
            keys.append(_unpack_keys(r.pop("keys")))
            before.append(_unpack_keys(r.pop("before")))
            mids.append(_unpack_keys(r.pop("mids")))
            parts.append(_unpack(r.pop("parts")))
            each_mid, steps = _unpack(r.pop("each_mid")), _unpack(r.pop("u"))
            m.append(np.repeat(np.arange(len(mids[-1])) + at_mid, each_mid))
            summed, begins = np.cumsum(steps), np.cumsum(each_mid) - each_mid
            u.append(summed - np.repeat(summed[begins] - steps[begins], each_mid) + at_u)
            w.append(_unpack(r.pop("w")) + at_key)
            at_key, at_u, at_mid = at_key + len(keys[-1]), at_u + len(before[-1]), at_mid + len(mids[-1])
            each, text = _unpack(r["each"]), _unpack(r["text"])
            train = np.unpackbits(np.frombuffer(r.pop("flags"), np.uint8)).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(train[text])))
            stop = np.cumsum(each)
            here = sums[stop] - sums[stop - each]
            here[each == 0] = _unpack(r.pop("hot_count"))
            count.append(here)
        names = lambda parts: pd.factorize(np.concatenate([np.zeros(0, np.uint64), *parts]))
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        (code, self.keys), (ucode, self.before), (mcode, self.mids) = names(keys), names(before), names(mids)
        self.part = np.zeros(len(self.mids), np.int64)
        self.part[mcode] = join(parts)
        self.start = _parents(self.part, bounds) == int(np.searchsorted(split, np.uint64(START))) + 1
        small = lambda codes, parts: codes.astype(np.int32)[join(parts)]
        m, u, w = small(mcode, m), small(ucode, u), small(code, w)
        del keys, before, mids, parts, code, ucode, mcode
        order, start = _sorted_triples(m, u, w)
        of = np.empty(len(order), np.int32)
        of[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(order))))
        at = 0
        for r in self.rows:
            n = len(_unpack(r["each"]))
            r["triple"], at = of[at : at + n], at + n
        self.count = np.bincount(of, join(count), len(start)).astype(np.int32)
        self.m, self.u, self.w = (x[order[start]] for x in (m, u, w))
        del m, u, w, order, count
        # Restaurants of two words, and dishes of restaurants of one word.
        self.context = np.cumsum(np.concatenate(([False], (self.m[1:] != self.m[:-1]) | (self.u[1:] != self.u[:-1]))), dtype=np.int32) if len(start) else self.m
        dish, name = pd.factorize(self.m.astype(np.int64) * len(self.keys) + self.w)
        self.dish = dish.astype(np.int32)
        self.dish_m, self.dish_w = np.divmod(name, len(self.keys))
        del dish, name, start
        give_back()

    def sample(self, root: np.ndarray, sweeps: int, burn_in: int, others: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(mean probability of each triple, tables of each dish of one word at last) given the root's probability of each word.

        Of dishes in parts the customers come out instead of tables. ``others``, as of :meth:`of_other_parts`: what the restaurants hold beside these parts.
        """
        n3, big, last, n_contexts = self.count, self.dish, len(self.dish_m), int(self.context[-1]) + 1 if len(self.m) else 0
        if not len(self.m):
            return np.zeros(0), np.zeros(0)
        name2 = mix(self.mids[self.dish_m] * np.uint64(3) + self.keys[self.dish_w])
        name3 = mix(name2[big] + self.before[self.u] * _STEP)
        (d3, d2, _), (s3, s2, _) = DISCOUNT, STRENGTH
        flat = np.zeros(len(n3), bool) if self.start is None else self.start[self.m]
        in_part = np.zeros(last, bool) if self.part is None else self.part[self.dish_m] > 0
        seated = in_part & (others is not None)
        more_n2, whole_t2, rest_n2, rest_t2 = others if others is not None else (0.0, np.zeros(last), 0.0, 0.0)
        t3 = np.where(flat, n3, n3 > 0).astype(np.float32)
        several = np.flatnonzero((n3 > 1) & ~flat)
        base = root[self.dish_w]
        n2 = np.bincount(big, t3, last) + more_n2
        t2 = (n2 > 0).astype(np.float64)
        t2[seated] = np.minimum(whole_t2, n2)[seated]
        mass3 = s3 + np.bincount(self.context, n3, n_contexts)
        mean = np.zeros(len(n3))

        def parent() -> np.ndarray:
            inside, tables = np.bincount(self.dish_m, n2, len(self.mids)) + rest_n2, np.bincount(self.dish_m, t2, len(self.mids)) + rest_t2
            return (n2 - d2 * t2 + (s2 + d2 * tables[self.dish_m]) * base) / (s2 + inside[self.dish_m])

        for sweep in range(sweeps):
            # Two halves of the dishes in turn, each given the tables of the other.
            for half in range(2):
                mine = several[draw(name3[several], 100_000 + sweep) < 0.5] if half else several[draw(name3[several], 100_000 + sweep) >= 0.5]
                dish, open3 = big[mine], np.bincount(self.context, t3, n_contexts)
                inside, tables = ((np.bincount(self.dish_m, x, len(self.mids)) + y)[self.dish_m[dish]] for x, y in ((n2, rest_n2), (t2, rest_t2)))
                # The parent as it is without this dish's own customers.
                rest = n2[dish] - t3[mine]
                kept = np.where(rest > 0, np.maximum(t2[dish] * rest / n2[dish], 1), 0)
                tables = tables - t2[dish] + kept
                bottom = s2 + inside - t3[mine]
                top = rest - d2 * np.maximum(kept, 1) + (s2 + d2 * (tables + (rest == 0))) * base[dish]
                first = np.where(rest > 0, top, (s2 + d2 * tables) * base[dish]) / bottom
                t3[mine] = seat(n3[mine], open3[self.context[mine]] - t3[mine], (first, top, bottom), d3, s3, name3[mine], 2 * sweep + half)
                n2 = np.bincount(big, t3, last) + more_n2
                t2 = np.maximum(np.minimum(t2, n2), n2 > 0)
                t2[seated] = np.minimum(whole_t2, n2)[seated]
            more = np.flatnonzero((n2 > 1) & ~seated)
            for half in range(2):
                mine = more[draw(name2[more], 100_000 + sweep) < 0.5] if half else more[draw(name2[more], 100_000 + sweep) >= 0.5]
                open2 = np.bincount(self.dish_m, t2, len(self.mids)) + rest_t2
                t2[mine] = seat(n2[mine].astype(np.int64), open2[self.dish_m[mine]] - t2[mine], (base[mine],), d2, s2, name2[mine], 2 * sweep + half)
            t2[n2 <= 1] = n2[n2 <= 1]
            if sweep >= burn_in:
                open3, p2 = s3 + d3 * np.bincount(self.context, t3, n_contexts), parent()
                for a in range(0, len(mean), 1 << 18):
                    at = slice(a, a + (1 << 18))
                    c = self.context[at]
                    above = p2[big[at]]
                    mean[at] += np.where(flat[at], above, (n3[at] - d3 * t3[at].astype(np.float64) + open3[c] * above) / mass3[c]) / (sweeps - burn_in)
        return mean, np.where(in_part, n2 - more_n2, t2)

    def words(self, site: int, tables: np.ndarray) -> pa.Table:
        """Rows of every word that a triple of the site ends in, and of every dish of a restaurant in parts."""
        count = np.bincount(self.w, self.count, len(self.keys)).astype(np.int64)
        part = self.part[self.dish_m]
        # Rows in order of part and word take less room.
        apart = np.flatnonzero(part)
        apart = apart[np.lexsort((self.keys[self.dish_w[apart]], part[apart]))]
        words = np.bincount(self.dish_w, np.where(part > 0, 0, tables), len(self.keys))
        there = np.zeros(len(self.keys), bool)
        there[self.w] = True
        whole = np.flatnonzero(there)
        whole = whole[np.argsort(self.keys[whole])]
        both = lambda a, b: np.concatenate([a, b])
        number = both(np.zeros(len(whole), np.int32), part[apart].astype(np.int32))
        columns = {"word": self.keys[both(whole, self.dish_w[apart])].view(np.int64), "count": both(count[whole], np.zeros(len(apart), np.int64)), "tables": both(words[whole], tables[apart]).astype(np.int64)}
        return pa.table({"site": pa.array(np.full(len(number), site, np.int32)), "part": number, **columns})

    def looked_up(self, reply: pa.Table, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(the root's probability, the training tokens) of each word of the site."""
        reply = reply.filter(pa.compute.equal(reply.column("part"), 0))
        at = _places(self.keys, reply.column("word").to_numpy().view(np.uint64))
        out = np.zeros((2, len(self.keys)))
        for k, c in enumerate(("count", "customers")):
            out[k, at] = reply.column(c).to_numpy()
        # The sums of all words are the same in every row.
        all_customers, all_tables = (float(reply.column(c)[0].as_py()) if len(reply) else 0.0 for c in ("all_customers", "all_tables"))
        d, s = DISCOUNT[2], STRENGTH[2]
        return (out[1] / 10 + (s + d * all_tables) / (known + 1)) / (s + all_customers), out[0]

    def of_other_parts(self, reply: pa.Table) -> tuple[np.ndarray, ...]:
        """(customers of other parts, tables of all) of each dish, (customers, tables) of dishes that are not at this site of each restaurant."""
        reply = reply.filter(pa.compute.greater(reply.column("part"), 0))
        column = lambda name: reply.column(name).to_numpy().astype(np.float64)
        m = _places(self.part, reply.column("part").to_numpy())
        word = _places(self.keys, reply.column("word").to_numpy().view(np.uint64))
        dish = _places(self.dish_m * len(self.keys) + self.dish_w, m * len(self.keys) + word)
        more, tables, rest = np.zeros(len(self.dish_m)), np.zeros(len(self.dish_m)), np.zeros((2, len(self.mids)))
        own, seated = np.divmod(reply.column("tables").to_numpy(), 1 << 32)
        more[dish], tables[dish] = column("customers"), seated
        rest[:, m] = column("all_customers"), column("all_tables")
        rest[0] -= np.bincount(m, column("customers") + own, len(self.mids))
        rest[1] -= np.bincount(m, seated, len(self.mids))
        return more, tables, *rest


def _places(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the names are that are wanted; every one is there."""
    order = np.argsort(names)
    return order[np.searchsorted(names, wanted, sorter=order)]


def _first_tables(known: int, split: np.ndarray, bounds: np.ndarray):
    """Arrow function of a site: its words' tables in the first round, against a uniform root."""

    def run(own: pa.Table) -> pa.Table:
        site = _Site(own, split, bounds)
        out = site.words(own.column("site")[0].as_py(), site.sample(np.full(len(site.keys), 1 / (known + 1)), EARLY, 0)[1])
        del site
        give_back()
        return out

    return run


def _next_tables(known: int, split: np.ndarray, bounds: np.ndarray):
    def run(own: pa.Table, reply: pa.Table) -> pa.Table:
        site = _Site(own, split, bounds)
        out = site.words(own.column("site")[0].as_py(), site.sample(site.looked_up(reply, known)[0], EARLY, 0, site.of_other_parts(reply))[1])
        del site
        give_back()
        return out

    return run


def _score(known: int, split: np.ndarray, bounds: np.ndarray):
    def run(own: pa.Table, reply: pa.Table) -> pa.Table:
        out = [{"run": r["run"], "ids": r["ids"], **{c: r[c] for c in ("flags", "tokens", "hot_each", "hot_text")}} for r in own.filter(pa.compute.is_null(own.column("keys"))).to_pylist()]
        site = _Site(own, split, bounds)
        root, count = site.looked_up(reply, known)
        p, _ = site.sample(root, SWEEPS, BURN_IN, site.of_other_parts(reply))
        log_p, log_base, seen = np.log10(p), np.log10(count + 1)[site.w], count[site.w] > 0
        for r in site.rows:
            each = _unpack(r["each"])
            triple, hot = np.repeat(r["triple"], each), r["triple"][each == 0]
            code, text = pd.factorize(_unpack(r["text"]))
            part = {"run": r["run"], "text": _pack(text), "known": _pack(np.bincount(code, seen[triple], len(text)).astype(np.int64))}
            part |= {"score": _pack(np.bincount(code, log_p[triple], len(text)).astype(np.float32)), "base": _pack(np.bincount(code, log_base[triple], len(text)))}
            if len(hot):
                part |= {"hot_id": r["hot_id"], "hot_score": _pack(log_p[hot]), "hot_base": _pack(log_base[hot]), "hot_known": _pack(seen[hot].astype(np.int64))}
            out.append(part)
        del site, root, count, p, log_p, log_base, seen
        table = pa.Table.from_pylist(out, _PART)
        give_back()
        return table

    return run


_RESULT = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _gather(tokens_known: tuple[int, int]):
    """Arrow function: the parts of one run, summed for each of its texts."""
    total, known = tokens_known

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["ids"] is not None, r["text"] or b"", r["score"] or b""))
        head = rows.pop()
        n = len(head["ids"])
        sums = np.zeros((3, n))
        hot_each, hot_text = _unpack(head["hot_each"]), _unpack(head["hot_text"])
        hot = np.zeros((3, len(hot_each)))
        for r in rows:
            text = _unpack(r["text"])
            for k, c in enumerate(("score", "base", "known")):
                sums[k, text] += _unpack(r[c])
                if r["hot_id"]:
                    hot[k, _unpack(r["hot_id"])] = _unpack(r[f"hot_{c}"])
        if len(hot_each):
            for k in range(3):
                sums[k] += np.bincount(hot_text, np.repeat(hot[k], hot_each), n)
        tokens, train = _unpack(head["tokens"]), np.unpackbits(np.frombuffer(head["flags"], np.uint8))[:n] > 0
        columns = [pa.array(head["ids"], pa.int64()), pa.array(train), pa.array(tokens), pa.array(np.round(sums[2]).astype(np.int64)), pa.array(np.full(n, total)), pa.array(sums[1] - tokens * np.log10(total + known + 1)), pa.array(sums[0])]
        return pa.Table.from_arrays(columns, schema=_RESULT)

    return run


def _parents(part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The place, from 1, of the word whose restaurant a part belongs to; 0 for the root."""
    return np.where(part > 0, np.searchsorted(bounds, part - 1, "right") + 1, 0)


def _dishes(bounds: np.ndarray):
    """Arrow function: (parent, dishes with a customer) of restaurants in parts; all rows of a word are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for batch in batches:
            part, word, tables = (batch.column(k).to_numpy() for k in (1, 2, 4))
            some = (part > 0) & (tables > 0)
            parent, word = _parents(part[some], bounds), word[some].view(np.uint64)
            found.append((parent, mix(word + parent.view(np.uint64) * _STEP)))
            if len(found) > 256:
                found = [_different(found)]
        parent, open_ = np.unique(_different(found)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(parent.astype(np.int32)), pa.array(open_.astype(np.int64)), pa.array(open_.astype(np.int64))], names=["parent", "all_customers", "all_tables"])

    return run


def _different(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(parent, hash) of each different hash."""
    parent, name = (np.concatenate(x) for x in zip(*pairs, strict=True))
    name, at = np.unique(name, return_index=True)
    return parent[at], name


def _by_part(bounds: np.ndarray):
    """Arrow function: sums of parents for each of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent = batch.column(0).to_numpy()
            parts = [range(int(bounds[p - 2]) + 1 if p > 1 else 1, int(bounds[p - 1]) + 1) if p else range(1) for p in parent.tolist()]
            part = np.array([x for r in parts for x in r], np.int32)
            of = np.repeat(np.arange(len(parent)), [len(r) for r in parts])
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(batch.column(k).to_numpy()[of]) for k in (1, 2))], names=["part", "all_customers", "all_tables"])

    return run


def _upper_tables(known: int, turn: int, split: np.ndarray, bounds: np.ndarray, sums: bool):
    """Arrow function over all rows of some words: tables in the restaurants that lie in parts, drawn from all parts' customers, then in the root.

    With ``sums`` the customers and tables of each restaurant come out (root: 0), else what is answered to each row: of a word its training tokens and, in
    tenths, its customers in the root less the discounts; in a part the other parts' customers, and the part's own (times 2**32) beside the tables of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        site, part, word, count, tables, open_ = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((part, word))
        site, part, word, count, tables, open_ = (x[order] for x in (site, part, word, count, tables, open_))
        parent = _parents(part, bounds)
        first_word = np.concatenate(([True], word[1:] != word[:-1]))
        first = first_word | np.concatenate(([True], parent[1:] != parent[:-1]))
        at, at_word = np.flatnonzero(first), np.flatnonzero(first_word)
        of, of_word = np.cumsum(first) - 1, np.cumsum(first_word) - 1
        customers, above, name = np.add.reduceat(tables, at), parent[at], word[at].view(np.uint64)
        drawn, apart = np.zeros(len(at)), np.flatnonzero(above)
        up = lambda n, k, level, names, t: seat(n, np.maximum(open_[k] - 1, 0), (np.full(len(n), 1 / (known + 1)),), DISCOUNT[level], STRENGTH[level], names, t)
        if len(apart):
            drawn[apart] = up(customers[apart], at[apart], 1, mix(split[above[apart] - 1] * np.uint64(3) + name[apart]), 50 + turn)
        # A word's first dish is the root's, whose customers are the tables of all others.
        mine = above == 0
        customers[mine] = np.bincount(of_word[at], np.where(mine, customers, drawn), len(at_word)).astype(np.int64)
        drawn[mine] = up(customers[mine], at[mine], 2, name[mine], 100 + turn)
        drawn = drawn.astype(np.int64)
        if sums:
            restaurants, which = np.unique(above, return_inverse=True)
            both = (np.bincount(which, x).astype(np.int64) for x in (customers, drawn))
            yield pa.RecordBatch.from_arrays([pa.array(restaurants.astype(np.int32)), *map(pa.array, both)], names=["parent", "all_customers", "all_tables"])
            return
        whole = np.add.reduceat(count, at_word)[of_word]
        customers, drawn, plain = customers[of], drawn[of], part == 0
        answer = np.where(plain, customers * 10 - drawn * round(10 * DISCOUNT[2]), customers - tables)
        columns = [site, part, word, np.where(plain, whole, 0), answer, np.where(plain, 0, tables * (1 << 32) + drawn)]
        order = np.argsort(part, kind="stable")
        columns = [x[order] for x in columns]
        yield from pa.table(columns, names=["site", "part", "word", "count", "customers", "tables"]).to_batches(1 << 14)

    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` says who is learnt from."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    words = settle(docs.mapInArrow(_count_words, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "words")
    total, known = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # At most 2**20 words have such a share of all tokens.
    split = [(r[0] % (1 << 64), -(-r[1] // ROOM)) for r in words.where(F.col("count") > max(ROOM, total >> 20)).collect()]
    split, classes = (np.array(c, np.uint64) for c in zip(*sorted([*split, (START, -(-max(rows, 1) // ROOM))]), strict=True))
    bounds = np.cumsum(classes).astype(np.int64)
    sites = shuffle_partitions(spark, size // 6, SITE_TOKENS)
    sent = docs.mapInArrow(_scatter(sites, split, classes), _ddl(_ROW)).repartition(sites, "site")
    asked = sent.groupBy("site").applyInArrow(_first_tables(known, split, bounds), _WORDS)
    all_sums = [F.sum(c).alias(c) for c in ("all_customers", "all_tables")]
    for turn in range(1, ROUNDS):
        if turn > 1:
            asked = sent.groupBy("site").cogroup(reply.groupBy("site")).applyInArrow(_next_tables(known, split, bounds), _WORDS)
        # Read three times, and by Python functions that take every column, so that Spark makes this exchange once.
        dealt = asked.repartition(sites, "word")
        # Tables of upper restaurants before: those of the turn before, or one for each dish (of the root: known words). A row for each part.
        before = dealt.mapInArrow(_dishes(bounds), _SUMS).groupBy("parent").agg(*all_sums).mapInArrow(_by_part(bounds), _SUMS.replace("parent", "part")) if turn == 1 else sums
        before = before.select("part", F.col("all_tables").alias("open"))
        open_ = F.coalesce("open", F.when(F.col("part") == 0, known).otherwise(0)).cast("long")
        opened = dealt.join(F.broadcast(before), "part", "left").select(*dealt.columns, open_.alias("open"))
        sums = opened.mapInArrow(_upper_tables(known, turn, split, bounds, True), _SUMS).groupBy("parent").agg(*all_sums).mapInArrow(_by_part(bounds), _SUMS.replace("parent", "part"))
        answers = opened.mapInArrow(_upper_tables(known, turn, split, bounds, False), "site int, part int, word long, count long, customers long, tables long")
        reply = answers.repartition(sites, "site").join(F.broadcast(sums), "part")
    parts = sent.groupBy("site").cogroup(reply.groupBy("site")).applyInArrow(_score(known, split, bounds), _ddl(_PART))
    return parts.groupBy("run").applyInArrow(_gather((total, known)), "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
