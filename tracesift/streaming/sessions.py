"""Scan texts that arrive in pieces on a stream, such as the output of a tool or a growing chat turn.

A secret may be cut anywhere.  The state of a session is the open end of its text: what follows the last character
that no match holds and that is, to every rule, like the end of the text (``pieces.SEPARATORS``).  Up to there nothing
that arrives later can change what is found, so it is closed: it goes on as a segment with its place in the session's text, and is
scanned like any other text.  What stays open is as long as the longest run without such a character.

A call of Python for each session and batch would cost far more than its work, so sessions are dealt to ``BUCKETS`` groups by
the hash of their keys, and a call advances all sessions of a group that got something.  A group's state is that of its sessions.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracesift.operators.pieces import SEPARATORS
from tracesift.operators.rules import Rule
from tracesift.operators.scan import FIELDS, scan_column

#: The open end, where it starts in bytes, the piece that is due, and pieces that came before their turn, as JSON.
STATE = "open string, offset bigint, due bigint, early string"
#: Groups that sessions are dealt to.
BUCKETS = 4096
#: Keys of these types come back from their printed form as they were; sessions by others are a group each.
_PRINTED = (T.StringType, T.BooleanType, T.IntegralType, T.DateType)


#: The piece that is due of a session that has ended: it stays known, so that a piece that comes again finds it closed.
ENDED = 1 << 62


def _advanced(session: list, arrived: list[tuple[int, str, bool]], ended: bool = False) -> tuple[str, list]:
    """What is closed of a session by the pieces that arrived, and its state then; ``ended`` closes it."""
    tail, offset, due, early = session
    for number, own, is_last in arrived:
        if number >= due:
            early[str(number)] = [own, bool(is_last)]
    parts = [tail]
    while not ended and str(due) in early:
        own, ended = early.pop(str(due))
        parts.append(own)
        due += 1
    whole = "".join(parts)
    closed = len(whole) if ended else 1 + max(whole.rfind(c) for c in SEPARATORS)
    then = offset + len(whole[:closed].encode())
    return whole[:closed], ["", then, ENDED, {}] if ended else [whole[closed:], then, due, early]


def _by_buckets(held: DataFrame, names: list[str]) -> DataFrame:
    """Closed segments: ``session`` (its keys as JSON), ``offset`` and ``text``."""
    session = F.to_json(F.array(*(F.col(n).cast("string") for n in names)))
    dealt = held.select(session.alias("session"), "number", "text", "last").withColumn("bucket", F.pmod(F.xxhash64("session"), F.lit(BUCKETS)))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        arrived: dict[str, list] = {}
        for frame in frames:
            for name, *piece in zip(frame["session"], frame["number"], frame["text"], frame["last"], strict=True):
                arrived.setdefault(name, []).append(piece)
        sessions = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for name, pieces in arrived.items():
            before = sessions.get(name, ["", 0, 0, {}])
            offset = before[1]
            closed, sessions[name] = _advanced(before, pieces)
            if closed:
                rows.append((name, offset, closed))
        state.update((json.dumps(sessions),))
        if rows:
            yield pd.DataFrame(rows, columns=["session", "offset", "text"])

    made = "session string, offset bigint, text string"
    return dealt.groupBy("bucket").applyInPandasWithState(advance, made, "sessions string", "append", GroupStateTimeout.NoTimeout)


def close_segments(pieces: DataFrame, keys: list[str], number: str, text: str, last: str, idle: str | None = None) -> DataFrame:
    """Closed segments of each session: ``keys``, ``offset`` (bytes) and ``text``.

    ``number`` counts a session's pieces from 0; a piece may arrive before its turn and is then kept until those before it
    are there.  One that arrives again is left out.  ``last`` is true in the piece that ends the session, which closes all.
    With ``idle`` (a duration), a session is closed, as far as it is there without a gap, when nothing came for so long.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    held = pieces.select(
        *(_column(pieces, k).alias(n) for k, n in zip(keys, names, strict=True)),
        _column(pieces, number).cast("bigint").alias("number"),
        F.coalesce(_column(pieces, text), F.lit("")).alias("text"),
        F.coalesce(_column(pieces, last), F.lit(False)).alias("last"),
    ).where("number IS NOT NULL")
    made = T.StructType([*(held.schema[n] for n in names), T.StructField("offset", T.LongType()), T.StructField("text", T.StringType())])
    milliseconds = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, offset, due, kept = state.get if state.exists else ("", 0, 0, "{}")
        arrived = [r for frame in frames for r in zip(frame["number"], frame["text"], frame["last"], strict=True)]
        closed, (tail, then, due, early) = _advanced([tail, offset, due, json.loads(kept)], arrived, state.hasTimedOut)
        state.update((tail, then, due, json.dumps(early)))
        if milliseconds is not None and due != ENDED:
            state.setTimeoutDuration(milliseconds)
        if closed:
            yield pd.DataFrame([(*key, offset, closed)], columns=[*names, "offset", "text"])

    if milliseconds is None and all(isinstance(made[n].dataType, _PRINTED) for n in names):
        found = _by_buckets(held, names)
        printed = F.from_json("session", "array<string>")
        return found.select(*(printed[i].cast(made[n].dataType).alias(k) for i, (n, k) in enumerate(zip(names, keys, strict=True))), "offset", "text")
    timeout = GroupStateTimeout.NoTimeout if milliseconds is None else GroupStateTimeout.ProcessingTimeTimeout
    segments = held.groupBy(*names).applyInPandasWithState(advance, made, STATE, "append", timeout)
    return segments.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "offset", "text")


def scan_sessions(
    pieces: DataFrame, keys: list[str], number: str, text: str, last: str, idle: str | None = None, rules: list[Rule] | None = None
) -> DataFrame:
    """The findings of each session's whole text, with byte offsets in it, as a stream in append mode."""
    segments = close_segments(pieces, keys, number, text, last, idle)
    named = [f"_s{i}" for i in range(len(keys))]
    inner = segments.toDF(*named, "_offset", "_segment")
    found = scan_column(inner, [*named, "_offset"], "_segment", rules)
    moved = {"start": F.col("start") + F.col("_offset"), "end": F.col("end") + F.col("_offset")}
    return found.select(*(F.col(n).alias(k) for n, k in zip(named, keys, strict=True)), *(moved.get(f, F.col(f)).alias(f) for f in FIELDS))


def _column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
