"""Hard negatives of anchors in a table of vectors, by vertical scans of columnar blocks.

Components are made integers; a row's score is its integer inner product with the anchor.  Rows are kept in blocks,
each a column for every dimension, with the least and the largest value of each.  An anchor reads a block's dimensions in
the descending order of its own magnitudes.  What the dimensions not yet read can still add lies between the
sums of their least and largest contributions, so after every few dimensions rows that can't be in the result
any more leave the candidate bitmap; once few are left only their values are read.  Scores of what stays are exact.

Two scans: the first finds every anchor's positives, the nearest rows of its own label; the second finds, for each score of a
positive, the nearest rows of other labels whose scores lie in the window that this score opens.  In a scan every block
meets every chunk of anchors in a task of its own, as rows of one join key; a task returns a few rows for each
anchor and block, and Spark ranks those.  No key is a label or a vector, so a label or a vector of any share of the rows
makes nothing hot; ties on a bound stay candidates.  What moves is every block once for each chunk of ``ANCHORS`` anchors,
and every chunk once for each block of ``ROWS`` rows.

Inputs: a row with a null label, a null vector, or a null or non-finite component takes no part.  A null id is no
anchor; among equal scores it comes last.  Vectors of different lengths are compared over the dimensions that both have.
Components beyond 2^26 after scaling count as that.  Repeated rows are rows of their own: only the anchor's own row is left
out of its positives, and a repeated anchor gives its rows again.  Other columns are ignored, whatever their names.  Empty
tables, and anchors without positives or without rows in a window, give no rows.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.llm.common import frugal, written

#: Rows of a block, anchors of a chunk, and dimensions read between two looks at the bounds.
ROWS, ANCHORS, STEP = 16_384, 4_096, 8
#: Components of greater size count as this; sums of products then fit 64 bits.
LARGEST = 1 << 26
LAST = np.iinfo(np.int64).max

BLOCKS = "block string, ids array<bigint>, labels array<int>, dims int, columns binary"


# --- blocks -----------------------------------------------------------------


def build_blocks(df: DataFrame, row_id: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """Blocks of rows, in the order of label and id, a column of 32-bit integers for each dimension."""
    rows = df.select(row_id.cast("long").alias("id"), label.cast("int").alias("label"), vector.cast("array<double>").alias("vector"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.and_(pc.is_valid(table["label"]), pc.is_valid(table["vector"])))
            for at in range(0, table.num_rows, ROWS):
                part = table.slice(at, ROWS)
                if n + part.num_rows > ROWS:
                    yield _block(held, number, scale)
                    held, n, number = [], 0, number + 1
                held.append(part)
                n += part.num_rows
        if n:
            yield _block(held, number, scale)

    return rows.mapInArrow(run, BLOCKS)


def _block(parts: list[pa.Table], number: int, scale: int) -> pa.RecordBatch:
    table = pa.concat_tables(parts).combine_chunks()
    lists = table["vector"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    child = lists.flatten()
    values = child.to_numpy(zero_copy_only=False).astype(float)  # null: not a number
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    dims = int(lengths.max(initial=0))
    columns = np.zeros((dims, len(lengths)))
    columns[place, owner] = values
    whole = np.isfinite(columns).all(axis=0) if dims else np.ones(len(lengths), bool)
    columns[:, ~whole] = 0
    ids, labels = table["id"].combine_chunks(), table["label"].to_numpy()
    order = np.lexsort((pc.fill_null(ids, LAST).to_numpy(), labels))
    order = order[whole[order]]
    made = np.clip(np.floor(columns[:, order] * scale), -LARGEST, LARGEST).astype("<i4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{TaskContext.get().partitionId()}-{number}"]),
            pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
            pa.array([labels[order].tolist()], pa.list_(pa.int32())),
            pa.array([dims], pa.int32()),
            pa.array([made.tobytes()], pa.binary()),
        ],
        ["block", "ids", "labels", "dims", "columns"],
    )


class Block:
    """A block as its task reads it: columns, bounds, and the rows of each label."""

    def __init__(self, row: dict):
        self.name = row["block"]
        self.shown = row["ids"]
        self.ids = np.array([LAST if i is None else i for i in self.shown], np.int64)
        labels = np.array(row["labels"], np.int64)
        self.columns = np.frombuffer(row["columns"], "<i4").reshape(row["dims"], len(labels)).astype(np.int64)
        names, starts = np.unique(labels, return_index=True)
        self.ranges = {int(k): (int(a), int(b)) for k, a, b in zip(names, starts, np.append(starts, len(labels))[1:], strict=True)} if len(labels) else {}
        self.bounds: dict = {}

    def part(self, label: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The columns of all rows or of a label's, with the least and largest value of each."""
        if label not in self.bounds:
            a, b = self.ranges[label] if label is not None else (0, len(self.ids))
            columns = self.columns[:, a:b]
            self.bounds[label] = columns, columns.min(axis=1, initial=LARGEST), columns.max(axis=1, initial=-LARGEST)
        return self.bounds[label]


# --- the scan ---------------------------------------------------------------

#: From partial sums, the bitmap, and what is left to add at least and at most: the new bitmap.
Keep = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]


def vertical(columns: np.ndarray, lows: np.ndarray, highs: np.ndarray, anchor: np.ndarray, alive: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows that ``keep`` has not excluded by the bounds of unread dimensions."""
    dims = min(len(columns), len(anchor))
    order = np.argsort(-np.abs(anchor[:dims]), kind="stable")
    weights = anchor[order]
    at_most = np.maximum(weights * lows[order], weights * highs[order])
    at_least = np.minimum(weights * lows[order], weights * highs[order])
    rest_most = np.concatenate((np.cumsum(at_most[::-1])[::-1], [0]))
    rest_least = np.concatenate((np.cumsum(at_least[::-1])[::-1], [0]))
    rows = None  # all, as long as the bitmap is dense
    sums = np.zeros(columns.shape[1], np.int64)
    for k, d in enumerate(order, 1):
        column = columns[d] if rows is None else columns[d, rows]
        sums += column * weights[k - 1]
        if k % STEP and k < dims:
            continue
        alive = keep(sums, alive, int(rest_least[k]), int(rest_most[k]))
        left = np.count_nonzero(alive)
        if not left:
            break
        if left * 4 <= len(alive):
            rows = np.flatnonzero(alive) if rows is None else rows[alive]
            sums, alive = sums[alive], np.ones(left, bool)
    if not dims:
        alive = keep(sums, alive, 0, 0)
    places = np.flatnonzero(alive) if rows is None else rows[alive]
    return places, sums[alive]


def nearest(number: int) -> Keep:
    """Rows that may be among the nearest so many."""

    def keep(sums: np.ndarray, alive: np.ndarray, least: int, most: int) -> np.ndarray:
        live = sums[alive]
        if len(live) <= number or most - least >= live.max() - live.min() and most > least:
            return alive
        return alive & (sums >= np.partition(live, len(live) - number)[len(live) - number] - (most - least))

    return keep


def within(windows: list[tuple[int, int]], number: int) -> Keep:
    """Rows that may be among the nearest so many of one of the windows of scores."""
    lowest, highest, widest = min(a for a, _ in windows), max(b for _, b in windows), max(b - a for a, b in windows)

    def keep(sums: np.ndarray, alive: np.ndarray, least: int, most: int) -> np.ndarray:
        if most - least > widest and sums.min() + most >= lowest and sums.max() + least <= highest:
            return alive
        kept = np.zeros(len(alive), bool)
        for low, high in windows:
            sure = alive & (sums + least >= low) & (sums + most <= high)
            if (n := np.count_nonzero(sure)) >= number:
                low = max(low, int(np.partition(sums[sure], n - number)[n - number]) + least)
            kept |= alive & (sums + most >= low) & (sums + least <= high)
        return kept

    return keep


def ranked(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, number: int) -> np.ndarray:
    """The first so many by descending score, then id."""
    return np.lexsort((ids[places], -scores))[:number]


# --- joins ------------------------------------------------------------------

ANCHOR = "struct<block:string,place:int,id:bigint,label:int,vector:array<int>,scores:array<bigint>>"
FOUND = "block string, place int, of bigint, score bigint, id bigint"


def find_anchors(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``every``, with the place they have in their block."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                places = [i for i, v in enumerate(block.shown) if v is not None and v % every == 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.name] * len(places), pa.string()),
                        pa.array(places, pa.int32()),
                        pa.array([block.shown[p] for p in places], pa.int64()),
                        pa.array([row["labels"][p] for p in places], pa.int32()),
                        pa.array([block.columns[:, p].tolist() for p in places], pa.list_(pa.int32())),
                    ],
                    ["block", "place", "id", "label", "vector"],
                )

    return blocks.mapInArrow(run, "block string, place int, id bigint, label int, vector array<int>")


def scan(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int, search: Callable[[Block, dict], Iterator[tuple]]) -> DataFrame:
    """What ``search`` finds for each anchor in each block."""
    chunks = max(1, -(-n_anchors // ANCHORS))
    slots = max(1, n_blocks)
    fields = [F.col(c) if c in anchors.columns else F.lit(None).alias(c) for c in ("block", "place", "id", "label", "vector", "scores")]
    chunk = F.pmod(F.xxhash64("block", "place"), F.lit(chunks)).alias("chunk")
    packed = anchors.select(chunk, F.struct(*fields).cast(ANCHOR).alias("anchor")).groupBy("chunk").agg(F.collect_list("anchor").alias("anchors"))
    left = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = packed.select("chunk", "anchors", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("at"))

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        """A block, or a few with the same slot, and a chunk of anchors."""
        found: list[tuple] = []
        if own.num_rows and others.num_rows:
            wanted = [{**a, "vector": np.array(a["vector"], np.int64)} for a in others["anchors"][0].as_py()]
            for i in range(own.num_rows):
                block = Block({c: own[c][i].as_py() for c in ("block", "ids", "labels", "dims", "columns")})
                if len(block.ids):
                    found += [(a["block"], a["place"], *x) for a in wanted for x in search(block, a)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*found, strict=True)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "place", "of", "score", "id"])

    return left.groupBy("slot", "part").cogroup(right.groupBy("at", "chunk")).applyInArrow(meet, FOUND)


def first(found: DataFrame, by: list[str], number: int) -> DataFrame:
    """The first rows of each group by score and id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)


def mine(
    df: DataFrame, row_id: Column, label: Column, vector: Column, every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``; their positives the first ``positives`` other rows of the same label;
    a positive's negatives the first ``negatives`` rows of other labels from ``low`` to ``high`` hundredths of its score.
    """
    blocks = written(build_blocks(df, row_id, label, vector, scale), "blocks")
    anchors = written(find_anchors(blocks, every), "anchors")
    sizes = blocks.count(), anchors.count()

    def search_positives(block: Block, anchor: dict) -> Iterator[tuple]:
        if anchor["label"] not in block.ranges:
            return
        start, end = block.ranges[anchor["label"]]
        alive = np.ones(end - start, bool)
        if anchor["block"] == block.name:
            alive[anchor["place"] - start] = False
        places, scores = vertical(*block.part(anchor["label"]), anchor["vector"], alive, nearest(positives))
        for i in ranked(places, scores, block.ids[start:end], positives):
            yield None, int(scores[i]), block.shown[start + places[i]]

    def window(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def search_negatives(block: Block, anchor: dict) -> Iterator[tuple]:
        windows = {s: window(s) for s in set(anchor["scores"]) if window(s)[0] <= window(s)[1]}
        if not windows:
            return
        alive = np.ones(len(block.ids), bool)
        start, end = block.ranges.get(anchor["label"], (0, 0))
        alive[start:end] = False
        places, scores = vertical(*block.part(), anchor["vector"], alive, within(list(windows.values()), negatives))
        for score, (a, b) in windows.items():
            inside = (scores >= a) & (scores <= b)
            own, exact = places[inside], scores[inside]
            for i in ranked(own, exact, block.ids, negatives):
                yield score, int(exact[i]), block.shown[own[i]]

    near = first(scan(blocks, anchors, *sizes, search_positives), ["block", "place"], positives)
    near = written(near.select("block", "place", "score", F.col("id").alias("positive_id")), "positives")
    scored = near.groupBy("block", "place").agg(F.collect_set("score").alias("scores"))
    wanted = anchors.join(scored, ["block", "place"])
    hard = first(scan(blocks, wanted, *sizes, search_negatives), ["block", "place", "of"], negatives)
    hard = hard.select("block", "place", F.col("of").alias("score"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"), "rank")
    joined = near.join(hard, ["block", "place", "score"]).join(anchors.select("block", "place", F.col("id").alias("anchor_id")), ["block", "place"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
