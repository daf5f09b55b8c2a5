"""Texts whose sets of word shingles are alike, by SimHash and vantage-point trees, with an exact check.

The shingles of a text are its runs of five words (lower-cased; a shorter text is one shingle).  Texts of equal sets are one
class.  Two classes are linked if their sets have a Jaccard similarity of 0.8 or more.  Candidates come from

- the SimHash fingerprints of the sets: those within 4 bits, by the vantage-point trees of ``simhash``; and
- since texts of 0.8 differ in about 10 of 64 bits, where such trees prune next to nothing, also from the beginnings of the
  sets.  All shingles have one order, rare ones first; of two sets of a similarity of 0.8 or more the first fifths share a shingle.

The beginnings are compared twice.  First each class with the leaders of the classes that share its shingles: ``ORDERS`` of any
classes, and the two that share the largest parts of their beginnings, as a text does that others are copies of.  That joins large
groups of near copies by few comparisons, though most copies are less alike than each is to its original.  Then every pair that shares a shingle and that no
chain of links has joined so far, unless the places of the shared shingles and the sizes rule 0.8 out, or the parity marks do: a set's shingles
toggle one of ``MARKS`` bits each, so two sets differ in as many shingles as their marks in bits, at least.  The join that finds the
pairs judges the marks, so that of a large group of copies that are not quite alike it hands on next to nothing.  Large sets fill
these marks, so their beginnings are longer by a few shingles, and two must share that many more; and they have wide marks
besides, two to four bits for each shingle, by which a pair is judged before its sets are made and moved.  So no pair of 0.8 or more
stays apart.

Every candidate pair is checked: the shingle sets of both are made again from a text of each class and intersected.  Only links
that pass count, so nothing is joined that isn't alike.

Texts are not written again: the table is read for the sketches, for the texts of pairs and for the rows that stay, so it must give
the same rows each time, as files do.  Tables in between go as soon as the links are known.

Inputs: null texts and texts without words are one class.  Repeated ids and rows all are in their class; null ids come last.
An empty table gives an empty table; all columns come along as they are, whatever their names.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.llm import simhash
from tracesift.llm.common import chunks, frugal, passing, tabled

#: Distinct texts, about, that common shingles are counted in, and common shingles that come last in the order, at most.  They
#: decide how many pairs are compared in vain; the pairs found are exact whatever the order.
SAMPLE, COMMON = 10_000, 200_000
#: Orders in which classes that share a shingle have a leader.
ORDERS = 4
#: Bits of a set's parity marks, a power of two from 64 on.  They decide how many pairs are compared in vain.
MARKS = 1024
#: Shingles of a set for each of which its beginning has one more, and a pair must share one more.
MORE = 256
#: Holders of a shingle from which on their marks are compared, too; fewer make few pairs.
FEW = 4
#: Bits of the bitmap by which texts that no pair needs are left out before a join, at most; beyond a sixteenth as many needed texts
#: more others come along.
MOST_MARKS = 1 << 25
#: Hashes whose bits are counted at a time.
_PIECE = 1 << 14


def shingles(text: str | None, size: int, seed: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], np.uint64))


def class_of(own: np.ndarray) -> bytes:
    """The name of a set of shingles."""
    return xxhash.xxh128_digest(own.tobytes())


def fingerprint(own: np.ndarray) -> int:
    if not len(own):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(own), _PIECE):
        counts += np.unpackbits(own[start : start + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(own)).tobytes(), "big")


def parity_marks(own: np.ndarray, bits: int = MARKS) -> np.ndarray:
    """Which of ``bits`` classes of hashes hold an odd number of the shingles, as bits of 64-bit integers."""
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_marks(own: np.ndarray) -> bytes | None:
    """Parity marks of two to four bits for each shingle; none if ``MARKS`` are as many."""
    return parity_marks(own, 1 << (2 * len(own) - 1).bit_length()).tobytes() if 2 * len(own) > MARKS else None


def differing(one: bytes, other: bytes) -> int:
    """Shingles in which two sets differ, at least, by their wide marks.  Halves of marks added are the marks of half the width."""
    x, y = sorted((np.frombuffer(m, np.uint64) for m in (one, other)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def beginning(own: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """As many shingles, in the order of all, as two sets of a similarity of ``least`` can't both have without sharing one, and one more for each ``MORE``."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(common):
        values, ranks = common
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        rank = np.where(values[at] == own, ranks[at].astype(np.int64), 0)
    return own[np.argsort(rank, kind="stable")][: len(own) - _needed(least, len(own)) + 1 + len(own) // MORE]


def _needed(least: float, n: int) -> int:
    """Shingles that a set of ``n`` shares with any other of a similarity of ``least``, at least."""
    return int(np.ceil(least * n - 1e-9))


def common_shingles(docs: DataFrame, text: str, size: int, seed: int) -> np.ndarray:
    """The shingles that several texts of a sample hold, ascending, and their ranks from 1, the most frequent last."""
    own = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = own.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size, seed).view(np.int64))], ["shingle"])

    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow().column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return np.stack([found[order], (len(found) - order).astype(np.uint64)]) if len(found) else np.empty(0, np.uint64)


def sketches(docs: DataFrame, key: str, text: str, size: int, seed: int, least: float = 0.8) -> DataFrame:
    """``id``, ``class``, ``fp``, ``n`` (shingles), ``marks``, ``wide`` (marks) and ``first`` (those that the set begins with) of every row, beside the whole ``row``."""
    common = common_shingles(docs, text, size, seed)

    @frugal
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [_sketched(c.column("text"), common, size, seed, least) for c in chunks([pa.record_batch([column], ["text"])], "text")]
            yield pa.concat_arrays(parts) if parts else pa.array([], _SKETCH)

    # a function of the text alone: where it isn't asked for, the rows don't go through Python
    sketch = F.arrow_udf(run, "class binary, fp long, n int, marks array<bigint>, wide binary, first array<bigint>")
    own = sketch(F.col(f"`{text}`").cast("string")).alias("made")
    held = docs.select(F.col(f"`{key}`").cast("long").alias("id"), _row(docs).alias("row"), own)
    return held.select("id", "row", *(F.col(f"made.{c}").alias(c) for c in _SKETCH.names))


_SKETCH = pa.struct([("class", pa.binary()), ("fp", pa.int64()), ("n", pa.int32()), ("marks", pa.list_(pa.int64())), ("wide", pa.binary()), ("first", pa.list_(pa.int64()))])


def _sketched(texts: pa.Array, common: np.ndarray, size: int, seed: int, least: float) -> pa.StructArray:
    sets = [shingles(t, size, seed) for t in texts.to_pylist()]
    prints = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64), pa.int64())
    first = pa.array([beginning(s, common, least).view(np.int64) for s in sets], pa.list_(pa.int64()))
    marks = pa.array([parity_marks(s) for s in sets], pa.list_(pa.int64()))
    wide = pa.array([wide_marks(s) for s in sets], pa.binary())
    made = [pa.array([class_of(s) for s in sets], pa.binary()), prints, pa.array([len(s) for s in sets], pa.int32()), marks, wide, first]
    return pa.StructArray.from_arrays(made, fields=list(_SKETCH))


def _row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))


def _digest(text: Column) -> Column:
    """What names a text; null and empty ones are of one class."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _classes(rows: DataFrame, text_at: int, *others: Column) -> DataFrame:
    """Each class once, with the ``digest`` of one of its texts."""
    return rows.groupBy("class").agg(*(F.first(c).alias(c) for c in _SKETCH.names[1:]), F.min(_digest(F.col(f"row._{text_at}"))).alias("digest"), *others)


def likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """All rows whose ``column`` is a value of ``wanted``, and few others: a join behind it moves few rows in vain.

    The values' hashes are marked in a bitmap of ``MOST_MARKS`` bits at most, in pieces of 4 KB.
    """
    marks = max(1 << 15, min(MOST_MARKS, 1 << (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(marks))
    piece, bit = F.shiftright(place, 15).alias("_piece"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("_bit")
    marked = wanted.select(piece, bit).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = rows.select("*", piece, bit).join(F.broadcast(marked), "_piece").where(F.getbit(byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")) == 1)
    return found.select(*rows.columns)


def shared_shingles(classes: DataFrame, least: float = 0.8) -> DataFrame:
    """``shingle``, ``short``, ``leader`` and ``early`` of every shingle of a beginning that other beginnings hold, too.

    ``short`` stands for the class; should two classes have the same, both are compared.  ``early`` tells whether a set of no
    more shingles than another of a similarity of ``least`` may share this one as one of the first with it.
    """
    # two numbers and a bit and no more: this is the largest shuffle
    placed = classes.select(F.posexplode("first").alias("at", "shingle"), F.xxhash64("class").alias("short"), "n")
    early = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - F.lit(1e-6)) + _more(F.col("n"))
    placed = placed.select("shingle", "short", early.alias("early"))
    alike = Window.partitionBy("shingle")
    order = F.struct(F.xxhash64(F.pmod("shingle", F.lit(ORDERS)), "short").alias("order"), "short")
    return placed.select("*", F.count("*").over(alike).alias("holders"), F.min(order).over(alike)["short"].alias("leader")).where("holders > 1").drop("holders")


def _more(n: Column) -> Column:
    """Shingles that a pair must share beyond the first, if ``n`` are in the smaller set."""
    return F.floor(n / F.lit(MORE))


def candidate_pairs(classes: DataFrame, shared: DataFrame, radius: int, least: float = 0.8) -> DataFrame:
    """``a``, ``b``: pairs of classes to be compared first, each once."""
    # fingerprints within the radius, each by the first class that has it; and classes that share one
    first = tabled(classes.groupBy("fp").agg(F.min("class").alias("first")), "fingerprints-of-classes")
    same = classes.join(first, "fp").select(F.col("class").alias("a"), F.col("first").alias("b"))
    links = simhash.near_links(first.select("fp"), radius)
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"class_{c}")) for c in ("a", "b")]
    near = links.join(ends[0], "a").join(ends[1], "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    # what shares little with a leader is left to the second comparison
    sizes = classes.groupBy(F.xxhash64("class").alias("short")).agg(F.min("n").alias("n"))
    part = shared.groupBy("short").agg(F.count("*").alias("c")).join(sizes, "short").select("short", (F.col("c") / F.col("n")).alias("part"))
    most = Window.partitionBy("shingle").orderBy(F.desc("part"), "short").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leaders = F.array("leader", F.first("short").over(most), F.nth_value("short", 2).over(most))
    led = shared.join(part, "short").select("short", leaders.alias("leaders")).select("short", F.explode(F.array_distinct("leaders")).alias("leader"))
    led = led.where("short <> leader").groupBy("short", "leader").agg(F.count("*").alias("c")).join(sizes, "short").where("50 * c >= n")
    every = same.union(near).union(_named(led.select(F.col("short").alias("a"), F.col("leader").alias("b")), classes, least)).where("a <> b")
    return possible(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, least)


def remaining_pairs(classes: DataFrame, shared: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: all pairs of classes of different roots whose beginnings leave a similarity of ``least`` possible."""
    rooted = classes.select(F.xxhash64("class").alias("short"), "class", "n", "marks").join(roots.withColumnRenamed("node", "class"), "class", "left")
    # classes that share a name of 64 bits have no size, and a root that no other has, so that none is ruled out or taken for joined
    alone = F.count("*") == 1
    root = F.when(alone, F.xxhash64(F.min(F.coalesce("root", "class")))).otherwise(F.xxhash64("short"))
    of = tabled(rooted.groupBy("short").agg(F.when(alone, F.min("n")).alias("n"), root.alias("root"), F.when(alone, F.first("marks")).alias("marks")), "unlinked")
    held = shared.select("shingle", "short", "early").join(of.select("short", "n", "root"), "short")
    # shingles of which all holders are joined are done
    several = held.groupBy("shingle").agg(F.min("root").alias("lowest"), F.max("root").alias("highest"), F.count("*").alias("holders")).where("lowest <> highest")
    marked = of.select(F.col("short").alias("of"), *_marks())
    names = marked.columns[1:]
    held = held.join(several.select("shingle", "holders"), "shingle")
    held = held.join(marked, (F.col("short") == F.col("of")) & (F.col("holders") >= FEW), "left").drop("of", "holders")
    held = tabled(held, "shared-by-unlinked")
    a, b = (held.select("shingle", *(F.col(c).alias(f"{c}_{end}") for c in ("short", "early", "n", "root", *names))) for end in "ab")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    known = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    fits = ~known | (small >= F.lit(least) * large - F.lit(1e-9))
    # the first shingles that two sets share come early in the smaller one, or in both: one that comes late doesn't count
    first = (F.col("early_a") | (F.col("n_a") > F.col("n_b"))) & (F.col("early_b") | (F.col("n_b") > F.col("n_a")))
    both = a.join(b, "shingle").where((F.col("root_a") != F.col("root_b")) & (F.col("short_a") < F.col("short_b")) & fits & (~known | first) & _near(least))
    pairs = both.groupBy(F.col("short_a").alias("a"), F.col("short_b").alias("b")).agg(F.count("*").alias("often"), F.min(F.when(known, small)).alias("n"))
    enough = pairs.where(F.col("n").isNull() | (F.col("often") > _more(F.col("n")))).select("a", "b")
    return possible(_named(enough, classes, least).where("a <> b").distinct(), classes, least)


def _marks() -> list[Column]:
    """A column for each 64 bits: expressions on these are compiled."""
    return [F.col("marks")[i].alias(f"m{i}") for i in range(MARKS // 64)]


def _near(least: float) -> Column:
    """Whether the marks of ``a`` and ``b`` leave a similarity of ``least`` possible; so do marks or sizes that aren't known."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(MARKS // 64)])
    return F.coalesce(apart <= _apart(least), F.lit(True))


def _apart(least: float) -> Column:
    """Shingles in which sets of ``n_a`` and ``n_b`` differ, at most, if their similarity is ``least`` or more."""
    return F.lit((1 - least) / (1 + least)) * (F.col("n_a") + F.col("n_b")) + F.lit(1e-6)


def _named(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The classes of pairs of short names, without the pairs that their marks rule out."""
    held = classes.select(F.xxhash64("class").alias("short"), "class", "n", *_marks())
    ends = [held.select(F.col("short").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in held.columns[1:])) for c in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b").where(_near(least))
    return both.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def possible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs of classes without those that their sizes or wide marks rule out."""
    ends = [classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b")]
    sized = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - F.lit(1e-9))

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, *marks = (batch.column(c).to_pylist() for c in ("most", "wide_a", "wide_b"))
            left = [not (x and y) or differing(x, y) <= most for most, x, y in zip(sizes, *marks, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(left, pa.bool_()))

    return sized.select("a", "b", _apart(least).alias("most"), "wide_a", "wide_b").mapInArrow(judge, "a binary, b binary")


def checked(pairs: DataFrame, texts: DataFrame, size: int, seed: int, least: float, put: Callable[..., DataFrame] = tabled) -> DataFrame:
    """The pairs whose sets have a similarity of ``least`` or more.  ``texts`` has a ``text`` of each ``class`` in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = [shingles(t, size, seed).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.list_(pa.int64()))], ["class", "own"])

    # written, so that Spark may split the pairs of one class over several tasks when it joins them
    made = tabled(texts.select("class", "text"), "shingle-sets", run, "class binary, own array<bigint>")
    sets = [made.select(F.col("class").alias(c), F.col("own").alias(f"own_{c}")) for c in ("a", "b")]
    both = pairs.join(sets[0], "a").join(sets[1], "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, other in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = (s.values.to_numpy() for s in (one, other))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(shared >= least * (len(x) + len(y) - shared) if shared else False)
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return put(both.select("a", "b", "own_a", "own_b"), "links-of-classes", compare, "a binary, b binary")


def classed(rows: DataFrame, text_at: int, size: int, seed: int, radius: int, least: float) -> DataFrame:
    """``class`` and ``root``: one root for all classes that links join."""
    with passing() as lasting:
        return _rooted(tabled(_classes(rows, text_at), "classes"), rows, text_at, size, seed, radius, least, lasting)


def _rooted(found: DataFrame, rows: DataFrame, text_at: int, size: int, seed: int, radius: int, least: float, put: Callable[..., DataFrame]) -> DataFrame:
    shared, classes = tabled(shared_shingles(found, least), "shared-shingles"), found.select("class", "fp", "n", "marks", "wide", "digest")
    texts = rows.select(F.col(f"row._{text_at}").cast("string").alias("text")).select(_digest(F.col("text")).alias("digest"), "text")

    def links(pairs: DataFrame) -> DataFrame:
        with passing() as lasting:
            needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
            wanted = tabled(classes.select("class", "digest").join(needed, "class"), "wanted-texts")
            own = likely(texts, "digest", wanted).groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest")
            return checked(pairs, own, size, seed, least, lasting)

    first = links(tabled(candidate_pairs(classes, shared, radius, least), "candidate-pairs"))
    roots = simhash.components(first)
    rest = tabled(remaining_pairs(classes, shared, roots, least), "remaining-pairs")
    if not rest.isEmpty():
        roots = simhash.components(first.union(links(rest)))
    every = classes.select("class").join(roots.withColumnRenamed("node", "class"), "class", "left")
    return put(every.select("class", F.coalesce("root", "class").alias("root")), "roots-of-classes")


def one_of_each(docs: DataFrame, key: str, text: str, size: int = 5, least: float = 0.8, radius: int = 4, seed: int = 42) -> DataFrame:
    """Of texts that links join the row with the smallest key (null last), then the smallest hash of its text."""
    at = docs.columns.index(text)
    rows = sketches(docs, key, text, size, seed, least)
    # what orders the rows names them, too: those that it can't tell apart are equal
    order = [F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.xxhash64(f"row._{at}"), F.xxhash64("row")]
    names = [f"_o{i}" for i in range(len(order))]
    order = [o.alias(n) for o, n in zip(order, names, strict=True)]
    with passing() as lasting:
        classes = tabled(_classes(rows, at, F.min(F.struct(*order)).alias("order")), "classes")
        roots = _rooted(classes, rows, at, size, seed, radius, least, tabled)
        firsts = classes.select("class", "order").join(roots, "class").groupBy("root").agg(F.min("order").alias("order"))
        chosen = lasting(firsts.select(*(F.col(f"order.{n}").alias(n) for n in names)), "chosen-rows")
    kept = rows.select("row", *order).join(chosen, names, "left_semi").dropDuplicates(names)
    return kept.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)))
