"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad.  A line's score comes from its own features and those of the lines
beside it; two transition weights tie neighbours together.  The weights are fitted on labelled documents,
each line bearing its document's label.  A document's quality is the mean of its lines' marginal
probabilities of being good, weighted by their length in bytes.

Inputs: a null text counts as empty, and an empty text is one line of no characters, so it has a score as
well.  Labels that are null are left out; a document labelled twice has the smaller label.  Without any
label all scores are 0.5.  Null and repeated keys and rows are kept; an empty table gives an empty table;
other columns are ignored.  A text of any length, with any number of lines, is scored whole.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.common import chunks, frugal, written

#: Labelled documents that the weights are fitted on, at most, and lines of those.
SAMPLE_DOCUMENTS = 4_000
SAMPLE_LINES = 200_000
#: Steps of the fit, and how strongly weights are held small.
STEPS, PENALTY = 150, 1e-4

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes([*range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGITS = bytes(range(0x30, 0x3A))
_STOPS = b".,;:?"
_MARKS = b"!|"
_SYMBOLS = b"#*$%&<>{}[]=+~^\\/_@"

#: What is known of a line; the share of capitals, of digits, of sentence marks, of ! and |, of symbols;
#: words that repeat the one before, words seen before in the line; words that are very long; whether it
#: has hardly any words; whether the same line came before; whether it is blank.
FEATURES = ("upper", "digits", "stops", "marks", "symbols", "repeated", "old", "long", "short", "again", "blank")


def share(line: bytes, members: bytes) -> int:
    return len(line) - len(line.translate(None, members))


def line_features(text: str | None) -> tuple[array, array]:
    """The features of all lines, one after the other, and the lines' lengths in bytes."""
    rows, sizes, before = array("d"), array("q"), set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words, n = line.split(), max(1, len(line))
        w, upper = max(1, len(words)), share(line, _UPPER)
        rows.extend(
            (
                upper / max(1, upper + share(line, _LOWER)),
                share(line, _DIGITS) / n,
                10 * share(line, _STOPS) / n,
                5 * share(line, _MARKS) / n,
                5 * share(line, _SYMBOLS) / n,
                sum(map(bytes.__eq__, words, words[1:])) / w,
                1 - len(set(words)) / w if words else 0.0,
                sum(len(x) > 30 for x in words) / w,
                float(len(words) < 4),
                float(line in before),
                float(not words),
            )
        )
        sizes.append(len(line))
        before.add(line)
    return rows, sizes


def with_neighbours(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after (zero at either end), and a one."""
    first = np.cumsum(sizes) - sizes
    before, after = np.roll(rows, 1, axis=0), np.roll(rows, -1, axis=0)
    before[first] = 0
    after[first + sizes - 1] = 0
    return np.hstack([rows, before, after, np.ones((len(rows), 1))])


class Chain:
    """Lines of several documents, walked side by side, the longest documents first."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        self.first, self.size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        self.steps = int(sizes.max(initial=0))

    def at(self, step: int) -> np.ndarray:
        """The lines numbered ``step`` within their documents."""
        return self.first[: np.searchsorted(-self.size, -step, "left")] + step

    def messages(self, scores: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good from the lines up to each line, and from those after it; ``ties[i, j]`` is the
        weight of a line of state j after one of state i."""
        ahead, back = scores.copy(), np.zeros_like(scores)
        for step in range(1, self.steps):
            own = self.at(step)
            odds = ahead[own - 1]
            ahead[own] += np.logaddexp(ties[0, 1], ties[1, 1] + odds) - np.logaddexp(ties[0, 0], ties[1, 0] + odds)
        for step in range(self.steps - 1, 0, -1):
            own = self.at(step)
            odds = scores[own] + back[own]
            back[own - 1] = np.logaddexp(ties[1, 0], ties[1, 1] + odds) - np.logaddexp(ties[0, 0], ties[0, 1] + odds)
        return ahead, back


def logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the ties, by gradient ascent on the likelihood of the labels."""
    inputs = with_neighbours(rows, sizes) if len(rows) else np.zeros((0, 3 * len(FEATURES) + 1))
    weights, ties = np.zeros(inputs.shape[1]), np.zeros((2, 2))
    if not len(rows):
        return weights, ties
    chain, state = Chain(sizes), np.repeat(labels, sizes).astype(float)
    inner = np.setdiff1d(np.arange(len(rows)), chain.first)  # lines with one before them
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[inner - 1].astype(int), state[inner].astype(int)), 1)
    moment, spread = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, STEPS + 1):
        scores = inputs @ weights
        ahead, back = chain.messages(scores, ties)
        slope = inputs.T @ (state - logistic(ahead + back))
        pairs = np.stack(
            [ties[i, j] + i * ahead[inner - 1] + j * (scores[inner] + back[inner]) for i in (0, 1) for j in (0, 1)]
        )
        pairs = np.exp(pairs - pairs.max(axis=0, initial=-np.inf)) if len(inner) else pairs
        expected = (pairs / pairs.sum(axis=0)).sum(axis=1) if len(inner) else np.zeros(4)
        slope = np.concatenate([slope, seen.ravel() - expected]) / len(rows)
        slope -= PENALTY * np.concatenate([weights, ties.ravel()])
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        move = 0.1 * moment / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        weights, ties = weights + move[:-4], ties + move[-4:].reshape(2, 2)
    return weights, ties


def gathered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of several texts, lines a text, and bytes a line."""
    found = [line_features(text) for text in texts]
    rows = np.concatenate([np.frombuffer(own, np.float64) for own, _ in found]).reshape(-1, len(FEATURES))
    return rows, np.array([len(own) for _, own in found], np.int64), np.concatenate([np.frombuffer(own, np.int64) for _, own in found])


def held_out(key: Column) -> Column:
    """Rows kept from the fit: a fifth, by the CRC of the key's text (null: empty)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def sample_labels(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """The first ``most`` labelled keys outside the held-out fifth, in the order of their hash."""
    own = F.col(f"`{key}`")
    known = labels.where(own.isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(own))
    known = known.groupBy(own.alias("key")).agg(F.min(f"`{label}`").cast("int").alias("label"))
    return known.withColumn("hash", F.xxhash64("key")).orderBy("hash", "key").limit(most)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on a bounded sample of the labelled documents: in the order of their keys' hash, as many as have
    ``most_lines`` lines together.  Which they are is found on Spark, and does not depend on how the table is dealt out; only
    their features come to the driver.  A document of more lines than the bound takes no part in the fit."""
    picked = sample_labels(labels, key, label, SAMPLE_DOCUMENTS)
    held = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(picked, "key")
    held = held.select("key", "hash", F.md5(F.coalesce("text", F.lit(""))).alias("content"), "label", "text")
    schema = T.StructType([*held.schema.fields[:-1], *T._parse_datatype_string("lines bigint, rows array<double>").fields])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [gathered([t])[0] for t in batch.column("text").to_pylist()]
            sizes, rows = [len(f) for f in found], [f.ravel().tolist() if len(f) <= most_lines else [] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], schema.names)

    made = written(held.mapInArrow(run, schema), "line-features")
    order = Window.orderBy("hash", "key", "content")  # of at most SAMPLE_DOCUMENTS keys, without their features
    sized = made.where(F.col("lines") <= most_lines).select("key", "content", "hash", "lines").groupBy("key", "content", "hash").agg(F.sum("lines").alias("lines"))
    total = F.sum("lines").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fitting = sized.withColumn("total", total).where(F.col("total") <= most_lines).select("key", "content")
    chosen = made.where(F.col("lines") <= most_lines).join(fitting, ["key", "content"]).orderBy("hash", "key", "content").select("label", "lines", "rows").toArrow()
    flat = np.array(chosen.column("rows").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, len(FEATURES))
    return fit(flat, chosen.column("lines").to_numpy().astype(np.int64), chosen.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, keys: list[str], text: str, weights: np.ndarray, ties: np.ndarray) -> DataFrame:
    """``keys`` and ``score`` (0 to 1, higher is better) of every document."""
    named = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
    held = docs.select(named.alias("keys"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([held.schema["keys"], T.StructField("score", T.DoubleType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows, sizes, weight = gathered(batch.column("text").to_pylist())
            chain = Chain(sizes)
            ahead, back = chain.messages(with_neighbours(rows, sizes) @ weights, ties)
            first = np.cumsum(sizes) - sizes
            weight = np.where(np.repeat(np.add.reduceat(weight, first), sizes) > 0, weight, 1)
            good = np.add.reduceat(logistic(ahead + back) * weight, first) / np.add.reduceat(weight, first)
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(good)], schema.names)

    scored = held.mapInArrow(run, schema)
    return scored.select(*(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), "score")
