"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

Texts with equal shingle sets are one *node*. Nodes of the same or the next size band that share a key lie in one *tile* and are
candidates, but within a tile they are not paired with each other:

1. The keys are the smallest shingle hashes in SKETCH parts of the hash space. Every node is compared with one leader
   of each of its tiles, which joins nearly all copies into components, g near copies for about g comparisons.
2. The keys are prefix shingles: order all shingles in one fixed way, and two sets of similarity 3/4 or more share
   one of the first n // 4 + 1 shingles of each, so nothing is missed. The order puts shingles that many texts hold last (a
   bounded table of them is gathered from all texts; it changes only the order, so speed but never the
   result). Only keys that several components share matter. Every node is compared with the most typical node of its tiles.
3. Of what still differs, only the nodes outside the largest component of a tile are compared with its other
   components, each pair at the first key that it shares and only if the places in the order leave room for enough overlap.

A pair whose nodes are already in one component needs no test, so the components are exact. A comparison first bounds the
overlap by bit counts of hashed bitmaps (each bit of one that the other lacks is a shingle that it lacks), then intersects
the sorted arrays.

Edge cases: null and blank texts have no shingles and are linked with nothing; texts of fewer words than a shingle
are one shingle; repeated rows and equal doc_ids are kept row by row (a component's name is the smallest non-null
doc_id in it); an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import connected_components
from tidemark.llm.storage import discard, settle, ship
from tidemark.llm.textbatch import Texts, give_back, mix, slices

WIDTH = 5
#: Most frequent shingles that are ordered last, at most so many (2 MB).
FREQUENT = 1 << 18
#: A shingle is proposed as frequent where so many sets of a run of CHUNK shingles hold it.
FREQUENT_IN_CHUNK = 3
CHUNK = 2_000_000
#: Parts of the hash space whose smallest shingles find most copies cheaply.
SKETCH = 8
#: Rows (of two or a few integers) of a side joined to texts that may be broadcast; beyond it the texts are shuffled.
BROADCAST_ROWS = 250_000
#: Keys of a node before a key that are compared to see whether a pair was met already.
EARLIER = 4
#: Names of sets that a task remembers at least before it gives the keys of a copy again.
SEEN_ROWS = 10_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(x: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = x.hashes(), x.first
    n = len(h)
    if n >= width:
        window = h[: n - width + 1].copy()
        for j in range(1, width):
            window *= _STEP
            window += h[j : n - width + 1 + j]
        window = mix(window)
    out = []
    for i in range(len(x)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            s = np.sort(window[a : b - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in h[a:b]:
                    value = value * _STEP + w
            s = mix(np.array([value], np.uint64))
        else:
            s = h[:0]
        out.append(s)
    return out


def signature(shingles: np.ndarray) -> int:
    """A 64-bit name of a set of shingles; with the set's size it identifies the set."""
    if not len(shingles):
        return 0
    total = mix(shingles ^ np.uint64(len(shingles))).sum(dtype=np.uint64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest shingle of each part of the hash space that has one; ``shingles`` is sorted."""
    bounds = np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - (SKETCH - 1).bit_length())
    at = np.searchsorted(shingles, bounds)
    return shingles[np.unique(at[at < len(shingles)])].view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A hashed bitmap of a set with two to four bits a shingle, in 64-bit words."""
    bits = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def overlap_bound(n1: int, map1: np.ndarray, n2: int, map2: np.ndarray) -> int:
    """At least the size of the intersection of two sets, from their sizes and bitmaps."""
    width = min(len(map1), len(map2))
    # Low bits of a hash place a shingle, so a wider bitmap folds onto a narrower one.
    map1, map2 = (np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in (map1, map2))
    return min(n1 - int(np.bitwise_count(map1 & ~map2).sum()), n2 - int(np.bitwise_count(map2 & ~map1).sum()))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, that is 7 * intersection >= 3 * (sizes)."""
    need = 3 * (len(a) + len(b))
    if 7 * min(len(a), len(b)) < need:
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return 7 * int((a[at] == b).sum()) >= need


def size_band_edges(most: int) -> np.ndarray:
    """First sizes of bands such that sets of similarity 3/4 lie in the same or in neighbouring bands."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(4 * edges[-1] // 3 + 1)
    return np.array(edges, np.int64)


_EDGES = size_band_edges(1 << 40)


def _survey(docs: DataFrame, note: list[str]) -> DataFrame:
    """(doc_id, key, n, node, sketch, bits, null, null) of every text and (null, .., shingle, texts) of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held, seen = 0, set()

        def frequent() -> pa.RecordBatch | None:
            nonlocal held
            values, counts = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            kept.clear()
            seen.clear()
            held = 0
            often = counts >= FREQUENT_IN_CHUNK
            values, counts = values[often], counts[often].astype(np.int64)
            nulls = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.nulls(len(values), pa.list_(pa.int64())), pa.nulls(len(values), pa.binary()), pa.array(values.view(np.int64)), pa.array(counts)], names=names) if len(values) else None

        for batch in batches:
            for row, x in slices(batch.column(2)):
                sets = shingle_sets(x)
                nodes = [signature(s) for s in sets]
                for s, node in zip(sets, nodes, strict=True):
                    if len(s) and node not in seen:
                        seen.add(node)
                        kept.append(s)
                        held += len(s)
                nulls = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), batch.column(1).slice(row, len(x)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), nulls, nulls], names=names)
                if held >= CHUNK and (out := frequent()):
                    yield out
        if out := frequent():
            yield out
        give_back()

    names = ["doc_id", "key", "n", "node", "sketch", "bits", "shingle", "texts"]
    return settle(docs.select("_id", "_key", "_text").mapInArrow(run, "doc_id long, key long, n long, node long, sketch array<long>, bits binary, shingle long, texts long"), "survey", note, texts=True)


def _contested_prefixes(docs: DataFrame, components: DataFrame, frequent: np.ndarray, note: list[str]) -> DataFrame:
    """(shingle, node, component, n, place) for the prefix shingles that more than one component has.

    Of a frequent shingle the components are compared by partial sums (there are at most FREQUENT of them); any other is in few sets, so
    that a window over its rows is small.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN_ROWS:
                seen.clear()
            known, components = batch.column(1), batch.column(2)
            for row, x in slices(batch.column(0)):
                h, node, component, n, place, common = [], [], [], [], [], []
                for i, s in enumerate(shingle_sets(x)):
                    if not len(s) or (name := signature(s)) in seen:
                        continue
                    seen.add(name)
                    k, rare = len(s) // 4 + 1, len(s)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        often = frequent[at] == s
                        rare = len(s) - int(often.sum())
                        s = np.concatenate((s[~often], s[often]))
                    h.append(s[:k])
                    node.append(np.full(k, name, np.int64))
                    component.append(np.full(k, components[row + i].as_py() if known[row + i].as_py() == name else name, np.int64))
                    n.append(np.full(k, len(s), np.int32))
                    place.append(np.arange(k, dtype=np.int32))
                    common.append(place[-1] >= rare)
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (node, component, n, place, common))], names=names)
        give_back()

    names = ["shingle", "node", "component", "n", "place", "common"]
    if components.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        components = F.broadcast(components)
    docs = docs.join(components, "_key", "left").select("_text", "node", "component")
    spent: list[str] = []
    rows = settle(docs.mapInArrow(prefixes, "shingle long, node long, component long, n int, place int, common boolean"), "prefixes", spent, texts=True)
    hot = rows.where("common").groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
    hot = settle(hot, "hot", spent)
    every = Window.partitionBy("shingle")
    rare = rows.where("not common").withColumns({"least": F.min("component").over(every), "most": F.max("component").over(every)}).where("least < most")
    found = rare.select(*names[:5]).union(rows.where("common").join(F.broadcast(hot), "shingle").select(*names[:5]))
    # A text can stand in several tasks; its rows are the same in all of them.
    found = settle(found.dropDuplicates(["shingle", "node"]), "contested", note)
    discard(docs.sparkSession, spent)
    return found


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, note: list[str]) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. ``nodes``: (node, n, bits, key), the key of one text that has the node."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2, bits1, bits2 = (batch.column(i) for i in range(2, 6))
            n1, n2, keep = n1.to_pylist(), n2.to_pylist(), []
            for i in range(batch.num_rows):
                bound = overlap_bound(n1[i], np.frombuffer(bits1[i].as_buffer(), np.uint64), n2[i], np.frombuffer(bits2[i].as_buffer(), np.uint64))
                keep.append(7 * bound >= 3 * (n1[i] + n2[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    spent: list[str] = []
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)
    pairs = settle(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long"), "pairs", spent)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", F.col("key").alias("_key")), "node")
    wanted = settle(wanted, "wanted", spent)
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "_key").select("_text", "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for row, x in slices(batch.column(0)):
                found = [(name, s.tobytes()) for s, name in zip(shingle_sets(x), names[row : row + len(x)], strict=True) if len(s) and signature(s) == name]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["node", "body"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, mine, other = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            found, last, leader = [], None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, leader = a[i], np.frombuffer(mine[i].as_buffer(), np.uint64)
                found.append(linked(leader, np.frombuffer(other[i].as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found, pa.bool_()))
        give_back()

    # One body for each node, whatever the number of its pairs.
    bodies = settle(texts.mapInArrow(sets, "node long, body binary").dropDuplicates(["node"]), "sets", spent, texts=True)
    both = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("other")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("mine")), "a")
    links = settle(both.select("a", "b", "mine", "other").mapInArrow(compare, "a long, b long").distinct(), "links", note)
    discard(docs.sparkSession, spent)
    return links


#: Sizes and places in the order leave room for enough overlap if this is the first shingle in common.
_MAY_LINK = "7 * (1 + least({0} - {1} - 1, {2} - {3} - 1)) >= 3 * ({0} + {2})"


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    # A row's key brings rows of later tables back to their text; doc_ids may be null or repeated.
    docs = docs.withColumn("_key", F.xxhash64("_id", "_text"))
    kept: list[str] = []
    spent: list[str] = []
    survey = _survey(docs, spent)
    rows = settle(survey.where("n is not null").select("doc_id", "key", "n", "node"), "rows", kept)
    often = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("texts").alias("texts"))
    often = [r[0] for r in often.orderBy(F.desc("texts"), "shingle").limit(FREQUENT).select("shingle").collect()]
    frequent = np.sort(np.array(often, np.int64).view(np.uint64))
    nodes = settle(survey.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "nodes", spent)
    tile = F.explode(F.array(F.col("band") - 1, F.col("band")))

    # 1. Everyone against the leader of each tile of sketch keys.
    tiles = nodes.withColumn("band", _band("n")).select("node", "n", "band", F.explode("sketch").alias("key")).withColumn("tile", tile)
    leaders = tiles.groupBy("key", "tile").agg(F.min(F.struct("node", "n")).alias("l"), F.max("node").alias("top")).where("l.node < top")
    leaders = settle(leaders.select("key", "tile", F.col("l.node").alias("a"), F.col("l.n").alias("an")), "tiles", spent)
    near = tiles.join(leaders, ["key", "tile"]).where("node <> a and 4 * least(n, an) >= 3 * greatest(n, an)")
    links = _verify(docs, nodes, near.select("a", F.col("node").alias("b")).distinct(), spent)
    first = settle(connected_components(links), "components", spent)

    # 2. Everyone against the most typical node of each tile of prefix keys: the one that has the key first, with the fewest rare shingles.
    joined = settle(rows.select(F.col("key").alias("_key"), "node").join(first, "node").distinct(), "joined", spent)
    prefixes = _contested_prefixes(docs, joined, frequent, spent)
    tiles = prefixes.withColumn("band", _band("n")).withColumn("tile", tile).drop("band")
    typical = tiles.groupBy("shingle", "tile").agg(F.min(F.struct("place", "node", "n", "component")).alias("l")).select("shingle", "tile", F.col("l.node").alias("a"), F.col("l.n").alias("an"), F.col("l.place").alias("ap"), F.col("l.component").alias("ac"))
    near = tiles.join(settle(typical, "typical", spent), ["shingle", "tile"]).where("component <> ac").where(_MAY_LINK.format("n", "place", "an", "ap"))
    links = _verify(docs, nodes, near.select("a", F.col("node").alias("b")).distinct(), spent)
    second = settle(_merged(first, links, spent), "components", spent)

    # 3. What is outside the largest component of a tile against the tile's other components. A pair that shares an earlier key too
    # is met there: the keys before this one, a few, tell it in nearly all cases. By the sizes and places of two sets that may link, one
    # of them has the key within its first seventh, so that late holders of a key are never compared with each other.
    earlier = F.collect_list("shingle").over(Window.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1))
    placed = prefixes.withColumn("before", earlier).join(second.withColumnRenamed("component", "old"), "node", "left")
    placed = placed.withColumn("component", F.coalesce("old", "component")).drop("old").withColumn("band", _band("n")).withColumn("tile", tile).drop("band")
    counted = placed.groupBy("shingle", "tile", "component").agg(F.count("*").alias("members"))
    largest = counted.groupBy("shingle", "tile").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = placed.join(settle(largest, "largest", spent), ["shingle", "tile"]).withColumns({"minor": F.expr("component <> main"), "early": F.expr("7 * place <= n")})
    mixed = settle(mixed, "mixed", spent)
    one = mixed.where("early").select("shingle", "tile", F.col("node").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("component").alias("ac"), F.col("before").alias("ab"), F.col("minor").alias("am"))
    apart = f"component <> ac and not arrays_overlap(before, ab) and {_MAY_LINK.format('n', 'place', 'an', 'ap')}"
    across = mixed.join(one.where("am"), ["shingle", "tile"]).where(f"{apart} and (a < node or not (minor and early))").select("a", "node")
    across = across.union(mixed.where("minor and not early").join(one.where("not am"), ["shingle", "tile"]).where(apart).select("a", "node"))
    more = _verify(docs, nodes, across.select("a", F.col("node").alias("b")).distinct(), spent)
    last = settle(_merged(second, more, spent), "components", spent)

    # Names: the smallest doc_id of a component, brought back to each row.
    member = nodes.select("node", "n", "rep").join(last, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = settle(member.select("node", "n", "component", "rep"), "members", spent)
    names = settle(member.groupBy("component").agg(F.min("rep").alias("component_id")), "names", spent)
    member = settle(member.join(names, "component").select("node", "n", "component_id"), "named", kept)
    discard(spark, spent)
    full = rows.where("n > 0").join(member, ["node", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _merged(components: DataFrame, links: DataFrame, note: list[str]) -> DataFrame:
    """(node, component) after more links between nodes; nodes that no link ever touched are not listed."""
    named = components.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(named, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    joined = settle(connected_components(ends).select(F.col("node").alias("_o"), F.col("component").alias("_j")), "joined", note)
    known = components.join(joined, F.col("component") == F.col("_o"), "left").select("node", F.coalesce("_j", "component").alias("component"))
    new = joined.join(components.select(F.col("component").alias("_o")).distinct(), "_o", "left_anti").select(F.col("_o").alias("node"), F.col("_j").alias("component"))
    return known.union(new)


def _band(n: str) -> Column:
    """The size band of a set, by bisection of the edges written as one expression."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(n) < int(_EDGES[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return search(0, len(_EDGES))
