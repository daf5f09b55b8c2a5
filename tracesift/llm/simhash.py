"""SimHash fingerprints, all pairs within a Hamming radius by vantage-point trees, and their components.

A fingerprint has 64 bits.  Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // PARTS`` bits within at least one of ``PARTS`` disjoint groups of bits, so one tree is built
over the distances within each group.  A tree halves the fingerprints by their distance to a vantage
point again and again.  Every fingerprint is stored in one leaf and asked for in each leaf that the
triangle bound cannot rule out; a leaf goes on halving in memory, by the same bound.  The top of the
trees is fitted on a bounded sample, which only decides how evenly the shards are filled: the pairs
found are exact.  What a shard returns is a spanning forest of its links, never all pairs.

Inputs: a null text and a text without words have fingerprint zero, and are linked like any other.
Null ids are kept, and are no component's id unless all ids of the component are null.  Repeated ids
and rows all stay.  An empty table gives an empty table; other columns of the input are ignored.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.common import chunks, frugal, give_back, tabled, written

BITS = 64
#: Groups of bits, with a tree for each.
PARTS = 3
#: Distinct fingerprints that the top of a tree is fitted on, at most.
SAMPLE = 100_000
#: Distinct fingerprints that a shard should store, about.
LEAF = 1 << 16
#: Fingerprints below which a leaf compares all with all.
SMALL = 128
#: Pairs compared at a time.
BLOCK = 1 << 20


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The bits that are set in over half of the hashes of a text's shingles."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return 0
    ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
    digest = xxhash.xxh64_intdigest
    if len(ends) + 1 <= shingle:
        return digest(words, seed)
    first = [0, *(ends[: len(ends) + 1 - (shingle - 1)] + 1).tolist()]
    last = [*ends[shingle - 1 :].tolist(), len(words)]
    hashes = np.array([digest(words[a:b], seed) for a, b in zip(first, last, strict=False)], ">u8")
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        some = hashes[start : start + BLOCK]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 4, seed: int = 42, rows: bool = False) -> DataFrame:
    """``id`` (the key) and ``fp`` (the fingerprint as a signed long) of every row; with ``rows`` the whole row, too."""
    held = docs.select(
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{key}`").cast("long").alias("id"),
        *([F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns))).alias("row")] if rows else []),
    )
    schema = T.StructType([*held.schema.fields[1:], T.StructField("fp", T.LongType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()]
            made = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], schema.names)

    return held.mapInArrow(run, schema)


def part_masks(parts: int = PARTS) -> list[int]:
    """Disjoint groups of neighbouring bits."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def distance(values: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ point) & mask)


def split(values: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage point among ``values`` and the distance that halves them; None if none separates them."""
    for point in values[:: max(1, len(values) // 4)][:4]:
        away = distance(values, point, mask)
        middle = int(np.sort(away)[(len(away) - 1) // 2])
        if middle == away.max():
            middle -= 1
        if middle >= away.min():
            return point, middle
    return None


def fit(sample: np.ndarray, mask: np.uint64, depth: int) -> list[tuple[int, int, int, int]]:
    """The top of a tree: nodes (vantage point, middle, near child, far child); leaves have middle -1 and their number."""
    nodes: list[tuple[int, int, int, int]] = []

    def grow(values: np.ndarray, left: int) -> int:
        own = len(nodes)
        nodes.append((0, -1, 0, 0))
        cut = split(values, mask) if left and len(values) > 16 else None
        if cut:
            point, middle = cut
            near = distance(values, point, mask) <= middle
            nodes[own] = (int(point), middle, grow(values[near], left - 1), grow(values[~near], left - 1))
        return own

    grow(sample, depth)
    return nodes


def leaves(nodes: list, values: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaf, places of the fingerprints that it must be asked for, and whether it stores them."""
    todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, places, home = todo.pop()
        point, middle, near, far = nodes[node]
        if middle < 0:
            yield node, places, home
            continue
        away = distance(values[places], np.uint64(point), mask).astype(np.int64)
        for child, inside, reached in ((near, away <= middle, away - radius <= middle), (far, away > middle, away + radius > middle)):
            if reached.any():
                todo.append((child, places[reached], (home & inside)[reached]))


class Links:
    """Components of places 0 to n - 1, each named by its smallest place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.root, above := self.root[self.root]):
                self.root = above


def search(values: np.ndarray, home: np.ndarray, mask: np.uint64, part_radius: int, radius: int) -> np.ndarray:
    """Component (smallest place) of each value, by the pairs of which one is stored here."""
    links = Links(len(values))
    todo = [(np.flatnonzero(home), np.arange(len(values)))]
    while todo:
        stored, asked = todo.pop()
        cut = split(values[stored], mask) if len(stored) > SMALL else None
        if cut:
            point, middle = cut
            s, q = distance(values[stored], point, mask), distance(values[asked], point, mask).astype(np.int64)
            todo.append((stored[s <= middle], asked[q - part_radius <= middle]))
            todo.append((stored[s > middle], asked[q + part_radius > middle]))
            continue
        wide = max(1, BLOCK // max(1, len(asked)))
        for start in range(0, len(stored), wide):
            some = stored[start : start + wide]
            for begin in range(0, len(asked), BLOCK):
                others = asked[begin : begin + BLOCK]
                a, b = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[others][None, :]) <= radius)
                if len(a) > len(some):  # more than each with itself
                    links.add(some[a], others[b])
    return links.root


def near_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints whose components are those of all pairs within ``radius``.

    ``prints`` holds distinct values in column ``fp``.
    """
    n = prints.count()
    sample = prints.sample(min(1.0, SAMPLE / max(1, n)), seed=7).limit(SAMPLE).toArrow().column("fp")
    values = np.sort(sample.to_numpy().astype(np.int64)).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    masks, inner = part_masks(), radius // PARTS
    trees = [fit(values, np.uint64(mask), depth) for mask in masks]
    first = np.cumsum([0, *map(len, trees)]).tolist()  # number of each tree's first node

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for mask, nodes, start in zip(masks, trees, first, strict=False):
                for leaf, places, home in leaves(nodes, own, np.uint64(mask), inner):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(places), start + leaf, np.int32)), pa.array(own[places].view(np.int64)), pa.array(home)],
                        ["leaf", "fp", "home"],
                    )

    def find(shard: pa.Table) -> pa.Table:
        leaf, own = shard.column("leaf")[0].as_py(), shard.column("fp").to_numpy().view(np.uint64)
        part = max(i for i in range(PARTS) if first[i] <= leaf)
        root = search(own, shard.column("home").to_numpy(), np.uint64(masks[part]), inner, radius)
        linked = root != np.arange(len(own))
        give_back()
        return pa.table({"a": own[linked].view(np.int64), "b": own[root[linked]].view(np.int64)})

    dealt = prints.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(find, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: one root for all nodes that the links ``a``, ``b`` join.

    In each round every node points to the first of its neighbours and itself in a random order, and the links
    are redrawn between what is pointed to.  That leaves three quarters of the nodes at most on average, in
    chains as well as in stars; then the rounds' pointers are chained.
    """
    rounds, left = [], tabled(links.where("a <> b"), "links")
    while not left.isEmpty():
        order = [F.xxhash64(F.col(c), F.lit(len(rounds))) for c in ("node", "other")]
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        first = both.groupBy("node").agg(F.min_by("other", order[1]).alias("other"))
        up = tabled(first.select("node", F.when(order[0] < order[1], F.col("node")).otherwise(F.col("other")).alias("root")), "pointers")
        rounds.append(up)
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in ("a", "b")]
        moved = reduce(lambda df, end: df.join(end, end.columns[0]), ends, left)
        moved = moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = tabled(moved.where("a <> b").distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for i, up in enumerate(rounds[1:], 1):
        step = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        found = tabled(found, "roots") if i % 4 == 0 else found  # plans stay short
    return found


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``root`` (equal for the fingerprints of a component) and ``component_id`` of every distinct fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # written, so that Spark may split a large component over several tasks when it joins the two
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str, text: str, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key that links reach) of every row."""
    prints = written(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    return prints.join(grouped(prints, radius), "fp").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str, text: str, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Of every component the row with the smallest key (null last), then the smallest hash of its text."""
    prints = written(fingerprints(docs, key, text, shingle, seed, rows=True), "fingerprints")
    at = docs.columns.index(text)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64(f"row._{at}"), F.xxhash64("row"))
    kept = prints.join(grouped(prints, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min_by("row", order).alias("row"))
    return kept.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)))
