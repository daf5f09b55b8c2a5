"""Licenses by conditional compression of candidate blocks, confirmed by exact differences in wording.

Every template has anchors, words of which any place that holds it has one at least.  About each anchor in a text lies a
candidate block, as many words to either side as the longest template has; blocks that overlap are one.  A block is
compressed alone, and with every template as a raw dictionary.  The templates are ranked by the bytes that
they save, and confirmed in that order, word by word: a template is there where the block has all words of it, in order
and at most a tenth missing, and no word that names a version or a variant is among the missing or stands between.  Lines
don't matter.  Of places that overlap the one whose template saves more stays; of readings of one template that with the
fewest differences, then the longest.  A block may hold many licenses.

No template is left out for its rank or its saving.  The ranking is followed to its end, or until all anchors of the block
lie in confirmed places: what else could be read there would hold one of them, and overlap.  ``n_candidates`` counts the
blocks that were compressed.

Inputs: null and empty texts have no candidates.  Rows are scanned one by one, so null and repeated keys and
repeated rows stay as they are; an empty table gives an empty table; other columns are ignored.  A text of
any length is scanned whole.
"""

import difflib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import chunks, frugal
from tracesift.llm.license_data import TEMPLATES

#: Share of a template's words that a block may lack.
MISSING = 0.1

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Words that tell licenses of one family apart; any number does, too.
_TELLING = frozenset("mit apache gnu general lesser affero bsd mozilla mpl cc cc0 by sa nc nd attribution sharealike noncommercial noderivatives only later".split())

#: Of those, what goes on with a notice on the line after it.
_GOING_ON = frozenset("only later sa nc nd sharealike noncommercial noderivatives".split())
_TOKEN = re.compile(_WORD.pattern.encode())
#: What ends a notice: a stop before a space, or an empty line.
_STOP = re.compile(rb"[.:;!?][\"')\]]*\s|\n\s*\n")

_ALONE = zstandard.ZstdCompressor(level=3, write_content_size=False)

_FOUND = "key long, n_candidates int, found array<struct<license:string,start:int,end:int,saving:double,missing:int,extra:int>>"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def telling(word: str) -> bool:
    return word in _TELLING or word[0].isdigit()


@lru_cache(maxsize=1)
def compressors() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    made = []
    for name, text in TEMPLATES:
        dictionary = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, words_of(text), zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_dict_id=False)))
    return made


def differences(template: list[str], block: list[str]) -> tuple[int, int] | None:
    """Words of the template that the block lacks and words that stand between; None if it is not the template."""
    pieces = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not pieces:
        return None
    begin, end = pieces[0].b, pieces[-1].b + pieces[-1].size
    inside = {i for m in pieces for i in range(m.a, m.a + m.size)}
    matched = {i for m in pieces for i in range(m.b, m.b + m.size)}
    missing = [w for i, w in enumerate(template) if i not in inside]
    extra = [w for i, w in enumerate(block[begin:end], begin) if i not in matched]
    # a variant may also be named right after the words of the template
    after = block[end : end + 2]
    if len(missing) > MISSING * len(template) or any(map(telling, missing + extra + after)):
        return None
    return len(missing), len(extra)


@lru_cache(maxsize=1)
def anchors() -> tuple[list[bytes], re.Pattern[bytes], dict[bytes, list[tuple[int, list[int]]]]]:
    """Anchors, a pattern of them, and of each the templates that it stands for with its places in them."""
    used: dict[bytes, list[tuple[int, list[int]]]] = {}
    for i, (_, template, _) in enumerate(compressors()):
        own = sorted({w for w in template if w.isalpha()}, key=lambda w: (-len(w), w))
        some = int(MISSING * len(template))
        # more words than may be missing, or one that may not
        chosen = own[:1] if not some else [w for w in own if telling(w)][:1] or own[: some + 1]
        for word in chosen:
            used.setdefault(word.encode(), []).append((i, [q for q, w in enumerate(template) if w == word]))
    words = sorted(used, key=len, reverse=True)
    return words, re.compile(rb"(?<![a-z0-9])(?:" + b"|".join(words) + rb")(?![a-z0-9])"), used


def neighbours(data: bytes, start: int, end: int) -> tuple[list[tuple[str, int, int]], int]:
    """The word at ``start`` with those about it, as many as the longest template has; and its place among them."""
    reach = max(len(t) for _, t, _ in compressors())
    after: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(data, start):
        after.append((m[0].decode(), *m.span()))
        if len(after) > reach + 2:
            break
    before: list[tuple[str, int, int]] = []
    size = 16 * reach
    while True:
        begin = max(0, start - size)
        before = [(m[0].decode(), *m.span()) for m in _TOKEN.finditer(data, begin, start)]
        if begin == 0 or len(before) > reach:  # the first may be cut
            break
        size *= 4
    before = before[-reach:]
    return before + after, len(before)


def steps(template: list[str], words: list[str], limit: int) -> list[tuple[int, int, int]]:
    """All ways to read ``template`` from the start of ``words`` on: words missing, extra and read over."""
    where: dict[str, list[int]] = {}
    wall, ahead = [0] * (len(words) + 1), len(words)
    for i in range(len(words) - 1, -1, -1):
        wall[i + 1] = ahead
        ahead = i if telling(words[i]) else ahead
    wall[0] = ahead
    for i, word in enumerate(words):
        where.setdefault(word, []).append(i)
    # words read over, and the fewest of the template that are missing then
    states = {0: 0}
    for word in template:
        after: dict[int, int] = {}
        for at, missing in states.items():
            if missing < limit and not telling(word):
                after[at] = min(missing + 1, after.get(at, limit + 1))
            places = where.get(word, [])
            for place in places[bisect(places, at - 1) :]:
                if place > wall[at]:
                    break
                after[place + 1] = min(missing, after.get(place + 1, limit + 1))
        states = after
    return [(missing, at - (len(template) - missing), at) for at, missing in states.items()]


def goes_on(data: bytes, words: list[tuple[str, int, int]], last: int) -> bool:
    """Whether one of the two words after a notice names a variant of it."""
    end = words[last][2]
    for word, start, _ in words[last + 1 : last + 3]:
        between = data[end:start]
        if _STOP.search(between):
            return False
        if word in _GOING_ON if b"\n" in between else telling(word):
            return True
    return False


def alignment(data: bytes, words: list[tuple[str, int, int]], at: int, template: list[str], places: list[int]) -> tuple[int, int, int, int] | None:
    """Words missing and extra, first and last word, of the best reading of the template with its anchor at ``at``."""
    plain = [w for w, _, _ in words]
    limit = int(MISSING * len(template))
    reach = at + 1 + max(len(t) for _, t, _ in compressors())
    best = None
    for q in places:
        first = at - q
        if first >= 0 and plain[first : first + len(template)] == template:
            if not goes_on(data, words, first + len(template) - 1):
                return 0, 0, first, first + len(template) - 1
            continue
        left = steps(template[:q][::-1], plain[:at][::-1], limit)
        right = steps(template[q + 1 :], plain[at + 1 : reach], limit) if left else []
        right = [r for r in right if not goes_on(data, words, at + r[2])]
        for before, extra, back in left:
            for after, more, on in right:
                if before + after <= limit:
                    one = before + after, extra + more, at - back, at + on
                    best = min(best or one, one, key=lambda o: (o[0] + o[1], o[2] - o[3], o))
    return best


class Block(NamedTuple):
    """A candidate block: its bytes in the text, its words, and the places of anchors among them."""

    start: int
    end: int
    words: list[tuple[str, int, int]]
    anchors: list[int]


def blocks(data: bytes) -> Iterator[Block]:
    """The candidate blocks of a text in lower case."""
    literals, pattern, used = anchors()
    if not any(word in data for word in literals):
        return
    reach = max(len(t) for _, t, _ in compressors())
    spans: list[list[int]] = []
    for m in pattern.finditer(data):
        words, at = neighbours(data, *m.span())
        start, end = words[max(0, at - reach)][1], words[min(len(words) - 1, at + reach + 2)][2]
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for start, end in spans:
        words = [(m[0].decode(), *m.span()) for m in _TOKEN.finditer(data, start, end)]
        held = [i for i, (w, _, _) in enumerate(words) if w.encode() in used]
        if held:
            yield Block(start, end, words, held)


def compressed(data: bytes) -> tuple[int, list[int]]:
    """Bytes of a block compressed alone, and with each template."""
    return len(_ALONE.compress(data)), [len(tool.compress(data)) for _, _, tool in compressors()]


def saved(data: bytes) -> list[int]:
    """Bytes that each template saves of a compressed block."""
    alone, conditional = compressed(data)
    return [alone - n for n in conditional]


def readings(data: bytes, block: Block, i: int) -> list[tuple[int, int, int, int]]:
    """Words missing and extra, start and end in the text, of the places of a block where a template stands."""
    _, template, _ = compressors()[i]
    used = anchors()[2]
    reach = max(len(t) for _, t, _ in compressors())
    found, done = set(), 0
    for at in block.anchors:
        places = [q for own, q in used[block.words[at][0].encode()] if own == i]
        if not places or block.words[at][1] < done:
            continue
        first = max(0, at - reach)
        words = block.words[first : at + reach + 3]
        lacking = Counter(template) - Counter(w for w, _, _ in words)
        if lacking.total() > MISSING * len(template) or any(map(telling, lacking)):
            continue
        best = alignment(data, words, at - first, template, places[0])
        if best:
            missing, extra, begin, last = best
            found.add((missing, extra, words[begin][1], words[last][2]))
            if missing + extra == 0:
                done = words[last][2]
    return sorted(found, key=lambda f: (f[0] + f[1], f[2] - f[3], f))


def confirmed(data: bytes, block: Block) -> list[dict]:
    """The licenses of a block, in order: the ranking by compression is confirmed from its top on."""
    savings = saved(data[block.start : block.end])
    open_anchors = {block.words[i][1] for i in block.anchors}
    starts: list[int] = []
    kept: list[dict] = []
    for i in sorted(range(len(savings)), key=lambda i: (-savings[i], i)):
        for missing, extra, start, end in readings(data, block, i):
            at = bisect(starts, start)
            if (at and kept[at - 1]["end"] > start) or (at < len(kept) and kept[at]["start"] < end):
                continue
            starts.insert(at, start)
            alone, conditional = compressed(data[start:end])
            kept.insert(at, {"license": compressors()[i][0], "start": start, "end": end, "saving": round(1 - conditional[i] / alone, 6), "missing": missing, "extra": extra})
            open_anchors = {a for a in open_anchors if not start <= a < end}
        if not open_anchors:
            break
    return kept


def identify(block: bytes) -> tuple[str, float, int, int] | None:
    """License, saving, and words missing and extra, of the best notice that a block holds."""
    found = sorted(scan_data(block)[1], key=lambda f: (f["missing"] + f["extra"], f["start"] - f["end"], -f["saving"]))
    return (found[0]["license"], found[0]["saving"], found[0]["missing"], found[0]["extra"]) if found else None


def scan_data(data: bytes) -> tuple[int, list[dict]]:
    lower = data.lower()
    made = [confirmed(lower, block) for block in blocks(lower)]
    return len(made), [f for found in made for f in found]


def scan_text(text: str | None) -> tuple[int, list[dict]]:
    return scan_data((text or "").encode("utf-8", "surrogatepass"))


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_candidates`` and ``found`` (license, bytes of the notice, saving and differences) of every text."""
    held = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    numbers = [("start", pa.int32()), ("end", pa.int32()), ("saving", pa.float64()), ("missing", pa.int32()), ("extra", pa.int32())]
    kind = pa.list_(pa.struct([("license", pa.string()), *numbers]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [scan_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([n for n, _ in found], pa.int32()), pa.array([f for _, f in found], kind)],
                ["key", "n_candidates", "found"],
            )

    return held.mapInArrow(run, _FOUND).withColumnRenamed("key", key)
