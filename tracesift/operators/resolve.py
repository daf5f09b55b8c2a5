"""Overlap resolution within a row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions.folds import let, running


def resolve(candidates: Column) -> Column:
    """Earliest start first, then the longest, then the earlier rule; keep a
    candidate if it starts at or after the end of the last one kept.

    The candidate struct is laid out so that its natural order is this order.
    """
    return let(F.sort_array(candidates), lambda ordered: let(_kept_ends(ordered), lambda ends: _keep(ordered, ends)))


def _kept_ends(ordered: Column) -> Column:
    """After each candidate, the end of the last one kept so far."""
    spans = F.transform(ordered, lambda c: F.struct(c["start"].alias("start"), (-c["neg_end"]).alias("end")))
    return running(spans, lambda end, s: F.when(s["start"] >= end, s["end"]).otherwise(end))


def _keep(ordered: Column, ends: Column) -> Column:
    def moved(_, i):
        return F.get(ends, i) != F.coalesce(F.get(ends, i - 1), F.lit(0))

    return F.transform(
        F.filter(ordered, moved),
        lambda c: F.struct(
            c["kind"].alias("kind"),
            c["value"].alias("value"),
            c["start"].alias("start"),
            (-c["neg_end"]).alias("end"),
        ),
    )
