"""A positional inverted index of a corpus, and exact phrase and proximity search for test items in it.

``build`` cuts the corpus into segments of bounded size.  A segment lists its documents, its terms with
their counts, and for every term the places at which it occurs; the documents of a segment share one
numbering of places, with a hole after each document.  ``search`` writes the test items to the shared folder, where
tasks read them in blocks of bounded size, so they don't pass through the driver; the index is read once, and a
segment is searched for one block after the other.  In each segment a window of which any term is missing is done
with; of the others the postings are intersected, moved by their offsets, from the rarest term on.

Inputs: null and empty texts have no words, and are in the index as documents of no words.  Rows with
equal or null keys are documents of their own.  Test items without words have no windows; repeated item
ids count once, and an item whose id is null hits words but is not listed.  An empty corpus or test set
gives no rows or no hits; other columns are ignored.  A text of any length is indexed whole.
"""

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.byte_bpe import Numbers
from tracesift.llm.common import chunks, frugal, written
from tracesift.sources.scratch import file_system, shared_path

#: Bytes of text in a segment, about; a longer text has a segment of its own.
SEGMENT_BYTES = 8 << 20
#: Bytes of test items that a task searches for together, about; a longer item has a block of its own.
BLOCK_BYTES = 4 << 20

_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

_INDEX = "segment string, keys array<{}>, n_words array<int>, terms array<binary>, counts array<int>, postings binary"
_HITS = "segment string, place int, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places, rising within each term, as steps; equal bytes of all steps stand together and are compressed."""
    steps = np.diff(places, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = places[first]
    return zstandard.ZstdCompressor(level=1).compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes, counts: np.ndarray) -> "Postings":
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    sums, first = np.cumsum(steps), np.cumsum(counts) - counts
    before = sums[first] - steps[first]
    return Postings(sums - np.repeat(before, counts), counts)


def segment(keys: pa.Array, texts: list[str | None]) -> dict:
    numbers = Numbers()
    flat: list[int] = []
    ends = []
    for text in texts:
        flat.extend(map(numbers.__getitem__, words_of(text)))
        ends.append(len(flat))
    sizes = np.diff(np.array(ends, np.int64), prepend=0)
    places = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)  # a hole after each document
    terms = np.array(flat, np.int64)
    counts = np.bincount(terms, minlength=len(numbers))
    packed = pack(np.sort(terms << 32 | places) & 0xFFFFFFFF, counts) if len(flat) else b""
    return {"segment": uuid.uuid4().hex, "keys": keys, "n_words": sizes, "terms": list(numbers), "counts": counts, "postings": packed}


def build(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index as a written table: a row per segment, its documents in the order of ``keys``."""
    held = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = {"n_words": pa.int32(), "terms": pa.binary(), "counts": pa.int32()}

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SEGMENT_BYTES):
            made = segment(batch.column("key"), batch.column("text").to_pylist())
            lists = kinds | {"keys": batch.column("key").type}
            columns = [pa.array([made[c]], pa.list_(lists[c]) if c in lists else None) for c in made]
            yield pa.RecordBatch.from_arrays(columns, list(made))

    return written(held.mapInArrow(run, _INDEX.format(held.schema["key"].dataType.simpleString())), "phrase-index")


class Windows:
    """The windows of a block of test items, as places in the list of the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        numbers, self.width = Numbers(), width
        self.items = [item for item, _ in items]
        words = [list(map(numbers.__getitem__, words_of(text))) for _, text in items]
        self.terms = pa.array(list(numbers), pa.binary())
        self.words = np.array([t for own in words for t in own], np.int32)
        n = np.array([len(own) for own in words], np.int64)
        windows = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
        self.item = np.repeat(np.arange(len(n)), windows).astype(np.int32)
        within = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.first = ((np.cumsum(n) - n)[self.item] + within).astype(np.int32)
        self.size = np.minimum(n, width)[self.item].astype(np.int32)

    def matches(self, terms: pa.Array, counts: np.ndarray, postings: bytes, slop: int) -> Iterator[tuple]:
        """Items, first and last-plus-one places of the windows' matches in a segment."""
        if not len(counts) or not len(self.item):
            return
        at = pc.fill_null(pc.index_in(self.terms, value_set=terms), -1).to_numpy().astype(np.int64)
        many = np.where(at >= 0, counts[at], 0)
        postings_of = None
        for begin in range(0, len(self.item), 50_000):
            some = slice(begin, begin + 50_000)
            offset = np.arange(self.width)
            filled = offset < self.size[some, None]
            window = self.words[np.where(filled, self.first[some, None] + offset, self.first[some, None])]
            possible = np.flatnonzero((many[window] > 0).all(axis=1))
            if not len(possible):
                continue
            postings_of = postings_of or unpack(postings, counts)
            item, size, ids = self.item[some][possible], self.size[some][possible], at[window[possible]]
            lengths = np.where(filled[possible], many[window[possible]], np.iinfo(np.int64).max)
            if slop:
                found = [(w, *nearby([postings_of.places(t) for t in ids[w, : size[w]]], slop)) for w in range(len(ids))]
                w = np.concatenate([np.full(len(a), w) for w, a, _ in found])
                start, end = (np.concatenate([f[i] for f in found]) for i in (1, 2))
            else:
                w, start = postings_of.phrases(ids, size, np.argsort(lengths, axis=1, kind="stable"))
                end = start + size[w]
            yield item[w], start, end


class Tests:
    """The windows of a written table of test items, block by block; a table of one block stays in memory."""

    def __init__(self, folder: str, width: int, block_bytes: int):
        self.folder, self.width, self.block_bytes = folder, width, block_bytes
        self.only: list[Windows] | None = None

    def blocks(self) -> Iterator[Windows]:
        if self.only is not None:
            yield from self.only
            return
        made, last = 0, None
        for block in self._items():
            made, last = made + 1, Windows(block, self.width)
            yield last
        if made < 2:
            self.only = [last] if last else []

    def _items(self) -> Iterator[list[tuple[str | None, str | None]]]:
        import pyarrow.dataset as ds

        system, place = file_system(self.folder)
        block, size = [], 0
        for batch in ds.dataset(place, filesystem=system, format="parquet").to_batches(batch_size=256):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.append((item, text))
                size += len(text or "")
                if size >= self.block_bytes:
                    yield block
                    block, size = [], 0
        if block:
            yield block


@lru_cache(maxsize=2)
def tests_of(folder: str, width: int, block_bytes: int) -> Tests:
    return Tests(folder, width, block_bytes)


class Postings:
    """The places of each term of a segment, and both as one rising list of numbers."""

    def __init__(self, places: np.ndarray, counts: np.ndarray):
        self.all, self.counts, self.first = places, counts, np.cumsum(counts) - counts
        self.both = np.repeat(np.arange(len(counts)) << 32, counts) | places

    def places(self, term: int) -> np.ndarray:
        return self.all[self.first[term] : self.first[term] + self.counts[term]]

    def phrases(self, ids: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows, and the places where their terms stand one after the other.

        ``order`` lists a window's offsets from its rarest term on: that term's places, moved by its offset,
        are looked up in the next list, what remains in the one after it, and so on.
        """
        n = np.arange(len(ids))
        rarest = ids[n, order[:, 0]]
        w = np.repeat(n, self.counts[rarest])
        nth = np.arange(len(w)) - np.repeat(np.cumsum(self.counts[rarest]) - self.counts[rarest], self.counts[rarest])
        start = self.all[self.first[rarest][w] + nth] - order[w, 0]
        keep = start >= 0
        w, start = w[keep], start[keep]
        for j in range(1, order.shape[1]):
            offset = order[w, j]
            wanted = ids[w, offset] << 32 | (start + offset)
            there = np.searchsorted(self.both, wanted)
            keep = (self.both[np.minimum(there, len(self.both) - 1)] == wanted) | (j >= size[w])
            w, start = w[keep], start[keep]
        return w, start


def nearby(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms stand in order with at most ``slop`` other places between; from each place of the rarest
    term the nearest terms are taken on either side."""
    rarest = min(range(len(lists)), key=lambda i: len(lists[i]))
    starts = ends = lists[rarest]
    for i in range(rarest + 1, len(lists)):
        there = np.searchsorted(lists[i], ends, "right")
        keep = there < len(lists[i])
        starts, ends = starts[keep], lists[i][there[keep]]
    for i in range(rarest - 1, -1, -1):
        there = np.searchsorted(lists[i], starts, "left") - 1
        keep = there >= 0
        starts, ends = lists[i][there[keep]], ends[keep]
    near = ends - starts < len(lists) + slop
    return starts[near], ends[near] + 1


def joined(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Spans that overlap or touch made one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts[new], reach[last], strict=True)]


def hits_in(name: str, sizes: np.ndarray, found: Iterator[tuple], items: list[str | None]) -> dict:
    """Hit documents of a segment: their spans of words and the items found in them."""
    base = np.cumsum(sizes + 1) - (sizes + 1)
    parts = list(found)
    out = {"segment": [], "place": [], "spans": [], "items": []}
    if parts:
        item, start, end = (np.concatenate([part[i] for part in parts]) for i in range(3))
        doc = np.searchsorted(base, start, "right") - 1
        inside = end <= base[doc] + sizes[doc]
        item, start, end, doc = item[inside], start[inside], end[inside], doc[inside]
        order = np.argsort(doc, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
            d = int(doc[own[0]])
            out["segment"].append(name)
            out["place"].append(d)
            out["spans"].append(joined(start[own] - base[d], end[own] - base[d]))
            out["items"].append(sorted({items[i] for i in np.unique(item[own]).tolist()} - {None}))
    return out


def search(index: DataFrame, items: DataFrame, item_key: str, text: str, width: int = 13, slop: int = 0) -> DataFrame:
    """Documents in which windows of ``width`` consecutive item words occur: ``segment``, ``place`` (in the
    segment's list of documents), ``spans`` of hit words, ``items``.  With ``slop`` the words of a window may
    have so many others between them.  A document has a row for each block of items that hits it.
    """
    folder, block_bytes = shared_path(items.sparkSession, "test-items"), BLOCK_BYTES
    items.select(F.col(f"`{item_key}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).write.parquet(folder)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = {"segment": pa.string(), "place": pa.int32(), "spans": pa.list_(span), "items": pa.list_(pa.string())}

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = tests_of(folder, width, block_bytes)
        for batch in batches:
            for windows in tests.blocks():
                for i in range(batch.num_rows):
                    name, sizes, terms, counts, postings = (column[i] for column in batch.columns)
                    counts = counts.values.to_numpy().astype(np.int64)
                    found = windows.matches(terms.values, counts, postings.as_py(), slop)
                    hits = hits_in(name.as_py(), sizes.values.to_numpy().astype(np.int64), found, windows.items)
                    yield pa.RecordBatch.from_arrays([pa.array(hits[c], kinds[c]) for c in kinds], list(kinds))

    return index.select("segment", "n_words", "terms", "counts", "postings").mapInArrow(run, _HITS)


def n_covered(spans: Column) -> Column:
    """Words that spans cover."""
    places = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    return F.size(F.array_distinct(places)).cast("long")


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = 13) -> DataFrame:
    """A row per document: ``key``, ``n_words``, ``n_hit`` words inside occurring windows, and the ``items`` (ids
    as strings, sorted) that they are from."""
    index = build(docs, key, text)
    hits = search(index, items, item_key, item_text, width).groupBy("segment", "place").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("keys", "n_words")).alias("place", "_doc"))
    return rows.join(hits, ["segment", "place"], "left").select(
        F.col("_doc.keys").alias(key),
        F.col("_doc.n_words").cast("long").alias("n_words"),
        F.when(F.col("spans").isNull(), 0).otherwise(n_covered(F.col("spans"))).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are inside windows of the test set."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
