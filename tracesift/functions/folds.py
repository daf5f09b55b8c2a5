"""Array-column helpers: naming a sub-expression, and a near-linear running fold.

``aggregate`` copies its whole state at every step.  A state that grows with the
array is quadratic, so the state here is a list of plain numbers, and the array
is folded in chunks of about the square root of its length.  That keeps a row
with hundreds of thousands of matches affordable.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, advance: Callable[[Column, Column], Column]) -> Column:
    """The BIGINT position after each item, as an array.

    The position starts at 0; ``advance(position, item)`` gives the next one.
    """

    def cut(a):
        size = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(MIN_CHUNK)).cast("int")
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), size),
            lambda first: F.slice(a, first, size),
        )

    def state(pos, out):
        return F.struct(pos.alias("pos"), out.alias("out"))

    def step(acc, item):
        return let(advance(acc["pos"], item), lambda pos: state(pos, F.concat(acc["out"], F.array(pos))))

    def fold_chunk(acc, chunk):
        return F.aggregate(
            chunk,
            state(acc["pos"], F.array().cast("array<bigint>")),
            step,
            lambda a: state(a["pos"], F.concat(acc["out"], F.array(a["out"]))),
        )

    start = state(F.lit(0).cast("bigint"), F.array().cast("array<array<bigint>>"))
    return F.aggregate(let(items, cut), start, fold_chunk, lambda acc: F.flatten(acc["out"]))


def compute_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus new columns, each computed exactly once per row.

    A later filter on a column of a plain projection is moved below it and takes
    a copy of the whole expression along; through a generator it is not moved.
    Filters on the kept columns still reach the source.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
