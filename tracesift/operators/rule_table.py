"""Rules that come as a table: which of them may match which text.

The checked table is written to the shared folder once, and tasks read it there themselves, so no rule passes through the
driver and nothing is broadcast.  A task puts the anchors of the rules into automatons, whose cost for a text does not
depend on their number, and keeps them for the tasks that follow in the same worker.  A longer table is searched for in
blocks of bounded size, one after the other, for every batch of texts; the texts are read once either way.

A text gets the rules with an anchor in it as an array column, in the order of the table.  Nothing is joined, exploded
or put together again, so an anchor that most texts hold makes no key hot, and rows need no number.
"""

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions.validators import VALIDATORS
from tracesift.operators.rules import token_regex
from tracesift.sources.scratch import file_system, shared_path

#: Bytes of anchors in one automaton, about.
BLOCK_BYTES = 8 << 20

RULES = "array<struct<ord:int,kind:string,validator:string,regex:string>>"


def checked(table: DataFrame) -> DataFrame:
    """``ord, kind, validator, regex, anchors`` of every rule; a rule that can't be used fails here, by its id."""
    bad = table.where(
        F.col("ord").isNull() | F.col("id").isNull() | F.col("pattern").isNull() | ~F.coalesce("validator", F.lit("none")).isin(*VALIDATORS)
    ).take(1)
    if bad:
        raise ValueError(f"rule {bad[0]['id']}: without ord, id or pattern, or unknown validator {bad[0]['validator']!r}")
    left, right = token_regex("\0").split("\0")
    regex = F.concat(F.lit(left), F.col("pattern"), F.lit(right))
    rules = table.select(
        F.col("ord").cast("int").alias("ord"),
        F.col("id").alias("kind"),
        F.coalesce("validator", F.lit("none")).alias("validator"),
        regex.alias("regex"),
        F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"),
    )
    try:
        rules.agg(F.max(F.regexp_count(F.lit(""), F.col("regex")))).collect()
    except PySparkException as error:
        # the message has the expression that can't be compiled as a SQL string
        quoted = F.replace(F.replace(regex, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        told = (error.getMessageParameters() or {}).get("value", "")
        named = table.where(quoted == F.lit(told[1:-1])).select("id", "pattern").take(1)
        if named:
            raise ValueError(f"rule {named[0]['id']}: bad pattern {named[0]['pattern']!r}") from None
        raise
    return rules


class Block:
    """Some rules, and an automaton of their anchors."""

    def __init__(self, rules: pa.Table):
        import ahocorasick

        self.rules = pa.StructArray.from_arrays([rules.column(c).combine_chunks() for c in ("ord", "kind", "validator", "regex")], ["ord", "kind", "validator", "regex"])
        self.always: list[int] = []
        owners: dict[str, list[int]] = {}
        for i, anchors in enumerate(rules.column("anchors").to_pylist()):
            if not anchors or any(not a for a in anchors):  # without anchors it is tried on every text
                self.always.append(i)
            else:
                for anchor in anchors:
                    owners.setdefault(anchor, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for anchor, own in owners.items():
            self.automaton.add_word(anchor, own)
        if owners:
            self.automaton.make_automaton()
        self.find = self.automaton.iter if owners else lambda text: ()

    def matching(self, text: str) -> list[int]:
        """Places of the rules with an anchor in the text, in the order of the block."""
        seen: dict[int, list[int]] = {}
        for _, own in self.find(text):
            seen[id(own)] = own
        return sorted({*self.always, *(i for own in seen.values() for i in own)})


class Finder:
    """The rules of a written table, block by block; a table of one block stays in memory."""

    def __init__(self, folder: str, block_bytes: int):
        self.folder, self.block_bytes = folder, block_bytes
        self.only: list[Block] | None = None

    def blocks(self) -> Iterator[Block]:
        if self.only is not None:
            yield from self.only
            return
        last, several = None, False
        for part in self._parts():
            if last is not None:
                several = True
            last = Block(part)
            yield last
        if not several:
            self.only = [last] if last else []

    def _parts(self) -> Iterator[pa.Table]:
        """The rules in order of ``ord``, cut where the anchors of a block would grow too large."""
        import pyarrow.dataset as ds

        system, place = file_system(self.folder)
        held, size = [], 0
        for batch in ds.dataset(place, filesystem=system, format="parquet").to_batches(batch_size=1024):
            if batch.num_rows:
                held.append(batch)
                size += batch.column("anchors").nbytes
            if size >= self.block_bytes:
                yield pa.Table.from_batches(held).sort_by("ord")
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).sort_by("ord")

    def of_texts(self, texts: list[str | None]) -> pa.Array:
        """The rules of each text."""
        parts, found = [], [[] for _ in texts]
        base = 0
        for block in self.blocks():
            for own, text in zip(found, texts, strict=True):
                if text:
                    own += [base + i for i in block.matching(text)]
            needed = sorted({i for own in found for i in own if i >= base})
            moved = {i: base + k for k, i in enumerate(needed)}
            for own in found:
                own[:] = [moved.get(i, i) for i in own]
            parts.append(block.rules.take(pa.array([i - base for i in needed], pa.int64())))
            base += len(needed)
        if not parts:
            return pa.nulls(len(texts), KIND)
        offsets = [0]
        for own in found:
            offsets.append(offsets[-1] + len(own))
        places = pa.array([i for own in found for i in own], pa.int64())
        rules = pa.chunked_array(parts).take(places).combine_chunks()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rules).cast(KIND)


KIND = pa.list_(pa.struct([("ord", pa.int32()), ("kind", pa.string()), ("validator", pa.string()), ("regex", pa.string())]))


@lru_cache(maxsize=2)
def finder(folder: str, block_bytes: int) -> Finder:
    return Finder(folder, block_bytes)


def rules_of(text: Column, table: DataFrame) -> Column:
    """The rules of the table that may match a text, as an array in the order of ``ord``."""
    folder, block_bytes = shared_path(table.sparkSession, "rules"), BLOCK_BYTES
    checked(table).write.parquet(folder)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = finder(folder, block_bytes)
        for batch in batches:
            yield tool.of_texts(batch.to_pylist())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.array_sort(F.arrow_udf(run, RULES)(text))
