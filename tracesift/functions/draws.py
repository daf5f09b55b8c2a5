"""Repeatable random picks from a row's id, as Column expressions.

A pick is a function of ``(seed, id, tag)`` through MD5, so a generated table
does not depend on how it was partitioned, and a lost task makes the same rows
again.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions.folds import let

CHARS_PER_HASH = 8


class Draws:
    def __init__(self, seed: int, row_id: Column):
        self._prefix = F.concat(F.lit(f"{seed}:"), row_id.cast("string"), F.lit(":"))

    def _hash(self, tag: Column) -> Column:
        return F.md5(F.concat(self._prefix, tag))

    def below(self, tag, n) -> Column:
        """A whole number from 0 to ``n - 1``; tag and n may be columns."""
        return _number(F.substring(self._hash(_lit(tag)), 1, 8)) % _lit(n)

    def pick(self, tag, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), self.below(tag, len(options)).cast("int") + 1)

    def chars(self, tag, alphabet, k) -> Column:
        """``k`` characters from an alphabet; all three may be columns."""
        tag, alphabet, k = _lit(tag), _lit(alphabet), _lit(k).cast("int")
        hashes = F.transform(
            F.sequence(F.lit(0), F.floor((k + CHARS_PER_HASH - 1) / CHARS_PER_HASH).cast("int")),
            lambda block: self._hash(F.concat(tag, F.lit("."), block.cast("string"))),
        )

        def letter(block, i):
            code = F.substr(F.get(block, F.floor(i / CHARS_PER_HASH).cast("int")), i % CHARS_PER_HASH * 4 + 1, F.lit(4))
            return F.substr(alphabet, (_number(code) % F.length(alphabet)).cast("int") + 1, F.lit(1))

        places = F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1)
        letters = let(hashes, lambda block: F.transform(places, lambda i: letter(block, i)))
        return F.when(k > 0, F.array_join(letters, "")).otherwise("")


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("bigint")


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
