"""Quality rules: statistics of documents, and decision lists learned from labelled statistics.

A decision list is an ordered list of rules; a rule is a conjunction of thresholds and drops what it
covers, and what no rule covers is kept.  Rules are learned by sequential covering: a rule grows, a
threshold at a time, on two thirds of the documents that are left, is pruned on the other third, and is
taken if it is precise enough there; the documents it covers go and the next rule is grown.  A list is
written out as one ordered conditional expression.

Inputs: null and empty texts have no words and all-zero statistics.  Null labels are left out; a document
labelled twice has the smaller label.  Without labels of both kinds the list is empty and keeps all.  Null
and repeated keys and rows are kept; an empty table gives an empty table; other columns are ignored.
Texts are read whole, whatever their length.
"""

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.byte_bpe import Numbers
from tracesift.llm.common import chunks, frugal
from tracesift.llm.line_crf import sample_labels

#: Labelled documents that rules are learned from, at most.
SAMPLE_DOCUMENTS = 20_000
#: Thresholds tried for a statistic, rules in a list, thresholds in a rule.
CUTS, RULES, CONDITIONS = 64, 16, 4
#: Share of the greatest gain that counts as nearly as much.
NEARLY = 0.8
#: Share of dropped documents that must be bad where a rule is pruned.
PRECISION = 0.9

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_echoes")

#: What thresholds are set on: shares of the statistics, as SQL and by name.
MEASURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "echoes": "n_echoes / greatest(n_words, 1)",
}

_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``STATISTICS``, in that order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0, 0, len(data) - len(data.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0, 0)
    solid = data.translate(None, _SPACE)
    continued = int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(solid) - continued,
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, _CAPITALS)),
        data.count(b"!") + data.count(b"|"),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more in the text, the first time included."""
    if len(words) < 4:
        return 0
    numbers = Numbers()
    ids = np.array(list(map(numbers.__getitem__, words)), np.int64)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for offset in range(3):
        covered[offset : offset + len(twice)] |= twice
    return int(covered.sum())


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the statistics of every text."""
    held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = np.array([statistics_of(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(STATISTICS)))],
                ["key", *STATISTICS],
            )

    made = held.mapInArrow(run, "key long, " + ", ".join(f"{name} long" for name in STATISTICS))
    return made.withColumnRenamed("key", key)


def measured(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, *(F.expr(sql).cast("double").alias(name) for name, sql in MEASURES.items()))


#: A threshold: measure, whether values above it (or else up to it) are meant, and the value.
Condition = tuple[str, bool, float]


def covered(values: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    n = len(next(iter(values.values())))
    return reduce(and_, [values[m] > t if above else values[m] <= t for m, above, t in rule], np.ones(n, bool))


def grow(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the threshold that gains the most information on the bad documents, until only those are covered.

    Of thresholds that gain nearly as much the one in the widest gap between values is taken: it is the
    likeliest to hold for other documents.
    """
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        before = np.log2((inside & bad).sum() / inside.sum())
        tried: list[tuple[float, float, Condition]] = []
        for measure, all_values in values.items():
            own, own_bad = all_values[inside], bad[inside]
            seen = np.unique(own)
            places = np.unique(np.searchsorted(seen, np.quantile(own, np.linspace(0, 1, CUTS + 1), method="lower")))[:-1]
            for low, high in zip(seen[places], seen[places + 1], strict=True):
                up = own > low
                for above, some in ((True, up), (False, ~up)):
                    hit = (some & own_bad).sum()
                    gain = hit * (np.log2(hit / some.sum()) - before) if hit else 0.0
                    if gain > 1e-9:
                        tried.append((gain, (high - low) / (seen[-1] - seen[0]), (measure, above, float((low + high) / 2))))
        if not tried:
            break
        most = max(tried)[0]
        _, _, choice = max((t for t in tried if t[0] >= NEARLY * most), key=lambda t: (t[1], t[0]))
        rule.append(choice)
        inside &= covered(values, [choice])
    return rule


def prune(rule: list[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], float]:
    """The start of the rule with the best balance of bad and good documents, and its precision."""
    best, kept, precision = -np.inf, rule, 0.0
    for n in range(1, len(rule) + 1):
        some = covered(values, rule[:n])
        hit, missed = (some & bad).sum(), (some & ~bad).sum()
        worth = (hit - missed) / max(1, hit + missed)
        if hit and worth > best:
            best, kept, precision = worth, rule[:n], hit / (hit + missed)
    return kept, precision


def learn(values: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """An ordered list of rules that drop; every third document serves to prune, whatever its order in the input."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    third = np.zeros(len(bad), bool)
    for kind in (True, False):
        third[np.flatnonzero(bad == kind)[::3]] = True
    while len(rules) < RULES and (left & bad & ~third).any() and (left & ~bad & ~third).any():
        growing, pruning = left & ~third, left & third
        rule = grow({m: v[growing] for m, v in values.items()}, bad[growing])
        if not rule:
            break
        rule, precision = prune(rule, {m: v[pruning] for m, v in values.items()}, bad[pruning])
        if precision < PRECISION:
            break
        rules.append(rule)
        left &= ~covered(values, rule)
    return rules


def train(stats: DataFrame, labels: DataFrame, key: str, label: str) -> list[list[Condition]]:
    """Rules learned from a bounded sample of labelled documents outside the held-out fifth."""
    picked = sample_labels(labels, key, label, SAMPLE_DOCUMENTS)
    rows = measured(stats.withColumnRenamed(key, "key").join(picked.select("key"), "key", "left_semi"), "key").join(picked, "key")
    found = rows.limit(SAMPLE_DOCUMENTS).toPandas().sort_values("key", kind="stable")
    if not len(found):
        return []
    return learn({m: found[m].to_numpy(float) for m in MEASURES}, (found["label"] == 0).to_numpy())


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression over the statistics: false for what a rule covers."""
    chosen: Column | None = None
    for rule in rules:
        parts = [F.expr(f"{MEASURES[m]} {'>' if above else '<='} {t!r}D") for m, above, t in rule]
        test = reduce(and_, parts)
        chosen = F.when(test, False) if chosen is None else chosen.when(test, False)
    return F.lit(True) if chosen is None else chosen.otherwise(True)


def base_failed() -> Column:
    """Hardly any words, or most of them in repeated windows."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
