"""Removal of every byte inside a string of ``width`` bytes that also starts earlier in the corpus.

Whole copies of a text are told by their MD5 and need no search.  In every other text each window of
``width`` bytes names an anchor: the place within it whose next ``ANCHOR`` bytes have the smallest hash,
the leftmost of several.  Equal windows name the same place, so a window can only repeat if its anchor's
bytes do.  Anchors that occur once are dropped; about each other one the bytes of its windows are taken
along, and all occurrences of the same bytes meet.  There they are sorted in both directions, as suffixes
from the anchor on and as reversed prefixes before it, deep-shallow: multikey quicksort to a shallow depth,
then a blind trie for every group that is still equal.  Two windows are equal if they fall into the same
group of prefixes as deep as they reach to the left and of suffixes as deep as they reach to the right; of
equal windows all but the first are removed.  Hashes only decide what is compared.

Before anything meets, occurrences with equal surroundings within a piece of work are reduced to the first
one, as the others are known to repeat it; so a passage of which the corpus is full reaches the task that
sorts it once for each piece of work, not once for each document.  An anchor with more than ``HOT`` occurrences
(a phrase that many texts hold between different words) is not sorted: its windows are told apart one by one by
their MD5 and meet by that, so no task holds all occurrences of one anchor.

Order: by key, null keys last; texts of one key by their MD5 (those without a key by a hash of the text).
Inputs: a null text counts as empty and, like one of under ``width`` bytes, loses nothing.  Of equal rows
all but one are copies.  Every row is kept; an empty table gives an empty table; other columns come along
as they are, whatever their names.  Texts of any length are taken whole.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.common import chunks, frugal, written

#: Bytes hashed at a place, a power of two; a window has ``width - ANCHOR + 1`` places to choose from.
ANCHOR = 16
#: Depth in bytes, and bytes compared at a time, of the quicksort.
SHALLOW, STEP = 48, 8
#: Places of a text hashed at a time.
PIECE = 1 << 20
#: Occurrences sorted together, about.
GROUPS = 20_000
#: Occurrences of an anchor beyond which its windows meet one by one.
HOT = 20_000
#: Bytes of a window's MD5 in the place of an anchor's hash, and after it in the place of the surroundings.
DIGEST = 8
#: Windows of such anchors that a task remembers, and rows that it holds.
REMEMBERED, HELD = 1 << 20, 1 << 17
#: Added to the number of a text without a key, which comes last.
KEYLESS = 1 << 30

_RANDOM = np.random.default_rng(20240607)
_BYTE_HASH = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = np.uint64(21)

_ANCHORS = "h long, slot long, n int, place long, salt int, alike int"
_SPANS = "slot long, n int, start int, end int"


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on."""
    h, size, factor = _BYTE_HASH[data], 1, 0
    while size < ANCHOR:
        h = h[:-size] * _FACTORS[factor] + h[size:]
        size, factor = 2 * size, factor + 1
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _FACTORS[-1]
    return h ^ (h >> np.uint64(29))


def hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The same hash at some places only."""
    h, factor = _BYTE_HASH[data[places[:, None] + np.arange(ANCHOR)]], 0
    while h.shape[1] > 1:
        h, factor = h[:, ::2] * _FACTORS[factor] + h[:, 1::2], factor + 1
    return mixed(h[:, 0])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(text: bytes, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, place, and least and greatest distance from the start of a window to it, of each anchor."""
    for begin in range(0, len(text) - width + 1, PIECE):
        h = hashes(np.frombuffer(text, np.uint8)[begin : begin + PIECE + width - 1])
        mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
        ranked = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        chosen = (sliding_minimum(ranked, width - ANCHOR + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        at = chosen[first]
        yield h[at].view(np.int64), at + begin, at - last, at - first


def find_anchors(texts: DataFrame, width: int) -> DataFrame:
    """All anchors.  ``alike``: how many its piece of work has of it; all of those but one are salted apart."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            parts = []
            for slot, n, text in zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "text")), strict=True):
                for h, at, low, high in anchors(text.encode("utf-8", "surrogatepass"), width):
                    parts.append((h, np.full(len(h), slot), np.full(len(h), n, np.int32), at << 16 | low << 8 | high))
            if not parts:
                continue
            h, slot, n, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
            _, first, which, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            alike = counts[which].astype(np.int32)
            salt = np.where(first[which] == np.arange(len(h)), 0, 1 + np.arange(len(h)) % (1 << 20)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (h, slot, n, place, salt, alike)], ["h", "slot", "n", "place", "salt", "alike"])

    return texts.select("row", "slot", "n", "text").mapInArrow(run, _ANCHORS)


def repeated(found: DataFrame) -> DataFrame:
    """The anchors whose hash occurs twice or more.  ``hot``: more than ``HOT`` times."""
    counted = found.withColumn("many", F.count("*").over(Window.partitionBy("h", "salt")))
    again = counted.where((F.col("alike") > 1) | (F.col("many") > 1))
    # those without salt stand for all of their pieces of work
    totals = found.where("salt = 0").groupBy(F.col("h").alias("hot_h")).agg(F.sum("alike").alias("total"))
    # written, so that Spark knows their size and broadcasts them only if they are few enough
    hot = written(totals.where(F.col("total") > HOT), "hot-anchors")
    marked = again.join(hot, F.col("h") == F.col("hot_h"), "left")
    return marked.select("slot", "n", "place", F.col("hot_h").isNotNull().alias("hot"))


def surroundings(texts: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Each repeated anchor with the bytes of its windows; ``around`` is null in rows that are spans already.

    A hot anchor has a row for each of its windows: half of the window's MD5 as ``h``, the other half as ``around``.
    """
    gathered = found.groupBy("slot").agg(F.collect_list(F.struct("n", "place", "hot")).alias("found"))
    schema = "h long, slot long, n int, at int, high int, around binary"

    def made(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
            ["h", "slot", "n", "at", "high", "around"],
        )

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("slot", "n", "text")), batch.column("found"), strict=True)
            ordered = sorted(rows, key=lambda r: (r[1] >= KEYLESS, r[0], r[1]))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            known, windows = set(), set()
            for slot, n, text, own in ordered:
                data = text.encode("utf-8", "surrogatepass")
                numbers, places, hot = (own.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.flatnonzero(numbers == n)
                order = order[np.argsort(places[order], kind="stable")]
                place, hot = places[order], hot[order].tolist()
                at, low, high = place >> 16, (place >> 8) & 0xFF, place & 0xFF
                h = hashes_at(np.frombuffer(data, np.uint8), at).view(np.int64)
                earlier = []
                for one, x, begin, end, reach, often in zip(*(a.tolist() for a in (h, at, at - high, at - low + width, high)), hot, strict=True):
                    around = data[begin:end]
                    if (around, reach) in known:  # all its windows start earlier, too
                        earlier.append((begin, end))
                        continue
                    known.add((around, reach))
                    for row in own_windows(data, x, begin, end, width, windows, earlier) if often else [(one, reach, around)]:
                        for column, value in zip(out, (row[0], slot, n, x, *row[1:]), strict=True):
                            column.append(value)
                    if len(out[0]) > HELD:
                        yield made(out)
                        out = ([], [], [], [], [], [])
                for begin, end in merged(earlier):
                    for column, value in zip(out, ((slot * 31 + begin) & 0x7FFFFFFF, slot, n, begin, end, None), strict=True):
                        column.append(value)
            yield made(out)

    return texts.select("row", "slot", "n", "text").join(gathered, "slot").mapInArrow(run, schema)


def own_windows(data: bytes, at: int, begin: int, end: int, width: int, windows: set[bytes], earlier: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """Both halves of the MD5 of each window about the anchor at ``at``, with the distance to it in between; those of
    ``windows`` are added to ``earlier`` instead."""
    for start in range(begin, end - width + 1):
        digest = hashlib.md5(data[start : start + width], usedforsecurity=False).digest()
        if digest in windows:
            earlier.append((start, start + width))
            continue
        if len(windows) >= REMEMBERED:
            windows.clear()
        windows.add(digest)
        yield int.from_bytes(digest[:DIGEST], "little", signed=True), at - start, digest[DIGEST:]


def blind_trie(strings: list[bytes], items: list[int], depth: int) -> list[int]:
    """``items`` in the order of their strings, which are alike up to ``depth``.

    An inner node holds a place and a child for each byte there.  A string is led down by those bytes alone,
    is compared with one string below, and then joins or splits the edge at which the two part.
    """
    root: list | tuple = [items[0]]  # a leaf: equal strings; an inner node: (place, children)

    def byte_at(text: bytes, place: int) -> int:
        return text[place] if place < len(text) else -1

    for item in items[1:]:
        text, node = strings[item], root
        while isinstance(node, tuple):
            node = node[1].get(byte_at(text, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        if text == other:
            node.append(item)
            continue
        part = common(text, other, depth)
        above, node = None, root
        while isinstance(node, tuple) and node[0] < part:
            above, node = node, node[1][byte_at(text, node[0])]
        if isinstance(node, tuple) and node[0] == part:
            node[1][byte_at(text, part)] = [item]
            continue
        split = (part, {byte_at(other, part): node, byte_at(text, part): [item]})
        if above is None:
            root = split
        else:
            above[1][byte_at(text, above[0])] = split
    ordered, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            ordered += node
    return ordered


def common(a: bytes, b: bytes, depth: int) -> int:
    """Length of the common start of two different strings that agree up to ``depth``."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[depth:n], "big") ^ int.from_bytes(b[depth:n], "big")
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], items: list[int], depth: int = 0) -> list[int]:
    """``items`` in the order of their strings: multikey quicksort, and blind tries from ``SHALLOW`` on."""
    ordered, todo = [], [(items, depth)]
    while todo:
        items, depth = todo.pop()
        if len(items) < 2:
            ordered += items
        elif depth >= SHALLOW:
            ordered += blind_trie(strings, items, depth)
        else:
            pivot = strings[items[len(items) // 2]][depth : depth + STEP]
            less, same, more = [], [], []
            for item in items:
                piece = strings[item][depth : depth + STEP]
                (same if piece == pivot else less if piece < pivot else more).append(item)
            # strings that end within this step are equal
            todo += [(more, depth), (same, depth + STEP if len(pivot) == STEP else SHALLOW), (less, depth)]
    return ordered


def sorted_groups(strings: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All items, group by group in sorted order, and the length that each shares with the one before; -1 at
    the start of a group."""
    order = [i for group in groups for i in deep_shallow(strings, group)]
    longest = max(map(len, strings))
    table = np.frombuffer(b"".join(strings[i].ljust(longest + 1, b"\0") for i in order), np.uint8).reshape(len(order), -1)
    sizes = np.array([len(strings[i]) for i in order])
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        alike = table[1:] == table[:-1]
        alike[:, -1] = False
        shared[1:] = np.minimum(alike.argmin(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    shared[np.cumsum([0, *map(len, groups[:-1])])] = -1
    return np.array(order), shared


def later_windows(h: list[int], rank: np.ndarray, high: np.ndarray, around: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Occurrences with a window that also starts earlier, and the greatest and least distance from the start of
    such a window to the anchor."""
    members: dict[int, list[int]] = {}
    for i, one in enumerate(h):
        members.setdefault(one, []).append(i)
    groups = [group for group in members.values() if len(group) > 1]
    none = np.zeros(0, np.int64)
    if not groups:
        return none, none, none
    reach = high.tolist()
    low = high - (np.array([len(a) for a in around]) - width)
    depth = {}
    for name, strings in (("right", [a[r:] for a, r in zip(around, reach, strict=True)]), ("left", [a[:r][::-1] for a, r in zip(around, reach, strict=True)])):
        order, shared = sorted_groups(strings, groups)
        depth[name] = order, shared
    most, least = np.full(len(high), -1), np.full(len(high), width)
    label = {name: np.full(len(high), -1) for name in depth}
    for offset in range(width - ANCHOR + 1):
        for name, deep in (("left", offset), ("right", width - offset)):
            order, shared = depth[name]
            label[name][order] = np.cumsum(shared < deep)
        own = np.flatnonzero((low <= offset) & (offset <= high) & (label["left"] >= 0))
        if len(own) < 2:
            continue
        kind = label["left"][own] * (len(high) + 1) + label["right"][own]
        order = np.lexsort((rank[own], kind))
        again = own[order[1:][kind[order[1:]] == kind[order[:-1]]]]
        most[again] = np.maximum(most[again], offset)
        least[again] = np.minimum(least[again], offset)
    found = np.flatnonzero(most >= 0)
    return found, most[found], least[found]


def repeated_spans(occurrences: DataFrame, width: int) -> DataFrame:
    """``slot``, ``n``, ``start``, ``end``: bytes inside windows that start earlier, too."""
    dealt = occurrences.repartition("h").sortWithinPartitions("h")

    def spans(table: pa.Table) -> pa.RecordBatch:
        h, slot, n, at, high = (table.column(c).to_numpy() for c in ("h", "slot", "n", "at", "high"))
        order = np.lexsort((at, n, slot, n >= KEYLESS))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        alone = pc.equal(pc.binary_length(table.column("around")), DIGEST).to_numpy()
        own, some = np.flatnonzero(~alone), np.flatnonzero(alone)
        none = np.zeros(0, np.int64)
        found, most, least = none, none, none
        if len(own):
            around = table.column("around").take(pa.array(own)).to_pylist()
            found, most, least = later_windows(h[own].tolist(), rank[own], high[own].astype(np.int64), around, width)
            found = own[found]
        if len(some):
            rest = np.frombuffer(b"".join(table.column("around").take(pa.array(some)).to_pylist()), np.int64)
            order = np.lexsort((rank[some], rest, h[some]))
            again = (np.diff(h[some][order]) == 0) & (np.diff(rest[order]) == 0)
            later = some[order[1:][again]]
            found, most, least = (np.concatenate(both) for both in ((found, later), (most, high[later]), (least, high[later])))
        return pa.RecordBatch.from_arrays(
            [pa.array(slot[found]), pa.array(n[found]), pa.array((at[found] - most).astype(np.int32)), pa.array((at[found] - least + width).astype(np.int32))],
            ["slot", "n", "start", "end"],
        )

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            known = batch.column("around").is_null()
            yield pa.RecordBatch.from_arrays([c for c in batch.filter(known).select(["slot", "n", "at", "high"]).columns], ["slot", "n", "start", "end"])
            batch = batch.filter(batch.column("around").is_valid())
            while batch.num_rows:
                if rows < GROUPS:
                    some = batch.slice(0, GROUPS)
                elif held[-1].column("h")[-1] == batch.column("h")[0]:  # the last group goes on
                    h = batch.column("h").to_numpy()
                    some = batch.slice(0, int(np.searchsorted(h, h[0], "right")))
                else:
                    yield spans(pa.Table.from_batches(held))
                    held, rows = [], 0
                    continue
                held.append(some)
                rows += some.num_rows
                batch = batch.slice(some.num_rows)
        if held:
            yield spans(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, _SPANS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(edge for span in spans for edge in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends."""
    def start_of(place: int, step: int) -> int:
        while 0 < place < len(data) and data[place] & 0xC0 == 0x80:
            place += step
        return place

    aligned = [(start_of(a, 1), start_of(b, -1)) for a, b in spans]
    return [(a, b) for a, b in aligned if a < b]


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with ``slot`` (the key, or a hash of the text) and ``n`` (number of the row in its slot)."""
    others = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    made = docs.select(
        F.struct(*others).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.xxhash64(f"`{text}`")).alias("slot"),
        F.col(f"`{key}`").isNull().alias("keyless"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", F.col("row").dropFields(f"_{docs.columns.index(text)}") if len(docs.columns) > 1 else F.lit(None).cast("int"))
    made = made.withColumns({"content": F.unhex(F.md5("text")), "bytes": F.octet_length("text")})
    number = F.row_number().over(Window.partitionBy("slot").orderBy("keyless", "content"))
    return made.withColumn("n", (number + F.when(F.col("keyless"), KEYLESS).otherwise(0)).cast("int")).drop("keyless")


def remove_repeats(docs: DataFrame, key: str, text: str, width: int = 100) -> DataFrame:
    """Every row with its text cut, and ``spans`` (removed bytes as start and end), ``kept`` (what is left, as
    bytes) and ``n_bytes``.  The text loses whole characters only; one that is removed in part stays."""
    if not ANCHOR <= width < ANCHOR + 256:  # a distance within a window is packed into a byte
        raise ValueError(f"width must be from {ANCHOR} to {ANCHOR + 255}")
    rows = numbered(docs, key, text)
    order = F.struct((F.col("n") >= KEYLESS).alias("keyless"), "slot", "n")
    sizes = rows.select("slot", "n", "content", "bytes")
    # written, so that Spark may split the copies of one text over several tasks when it joins them
    first = written(sizes.groupBy("content").agg(F.min(order).alias("first")), "first-copies")
    copies = sizes.join(first, "content").where((F.col("first.slot") != F.col("slot")) | (F.col("first.n") != F.col("n")))
    copies = copies.select("slot", "n", F.lit(0).alias("start"), F.col("bytes").alias("end"))
    copied = copies.groupBy("slot").agg(F.collect_set("n").alias("copied"))
    # all three readings of the texts take the same columns, so that Spark deals the texts out by slot once
    texts = rows.select("row", "slot", "n", "text")
    own = texts.join(copied, "slot", "left").where(F.col("copied").isNull() | ~F.array_contains("copied", F.col("n")))
    occurrences = surroundings(texts, repeated(find_anchors(own, width)), width)
    spans = repeated_spans(occurrences, width).union(copies.where(F.col("end") >= width))
    removed = spans.groupBy("slot").agg(F.collect_list(F.struct("n", "start", "end")).alias("removed"))
    joined = texts.join(removed, "slot", "left")
    row = joined.schema["row"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [row, *(T.StructField(n, t) for n, t in (("text", T.StringType()), ("spans", T.ArrayType(span)), ("kept", T.BinaryType()), ("n_bytes", T.LongType())))]
    )

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in chunks(batches, "text"):
            texts, kept, removed, sizes = [], [], [], []
            for n, whole, found in zip(*(batch.column(c).to_pylist() for c in ("n", "text", "removed")), strict=True):
                data = whole.encode("utf-8", "surrogatepass")
                spans = merged([(s["start"], s["end"]) for s in found or () if s["n"] == n])
                texts.append(without(data, whole_characters(data, spans)).decode("utf-8", "surrogatepass") if spans else whole)
                kept.append(without(data, spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(removed, kind), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())],
                schema.names,
            )

    done = joined.mapInArrow(cut, schema)
    columns = [F.col("text").alias(c) if c == text else F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)]
    return done.select(*columns, "spans", "kept", "n_bytes")
