"""Two tokenizers' tokens of the same texts, cut where both end, with corpus-wide link counts.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a SentencePiece model with byte fallback that
adds a space before a text; A gets that space written out, so both cover the same bytes.

Coarse cuts are the ends of the libraries' own spans: character offsets of A, byte spans of B's proto (the
immutable proto of older releases is gone; ``return_type="proto"`` took its place).  A span says nothing about the
place inside a character, so a token of A that ends inside one, and a byte-fallback token of B, is refined: it ends
as many bytes behind the token before it as it decodes to.  Where tokens of A and B end together a group ends, and
these two tokens are a link.

A text is handled in words: it is cut before a single space between two word characters (or a mark and a word
character).  A's pattern starts a match there, and no piece of B has a space behind another character (checked when the
model is loaded; a model that has one gets whole texts), so no merge crosses, both tokenizers end a token there, and
the words' tokens in a row are those of the text.  Words are many, distinct ones fewer: a task aligns the distinct words of
a chunk of texts, many in one call.  A chunk is a row of a written table, with its distinct pairs and the texts' groups
and links; the pairs are summed over the corpus, and their counts go back to the chunks that hold them.  So what is
shuffled for a frequent pair is a row for each chunk, not for each of its links.

Inputs: a text that is null or empty, or which the tokens of A or of B don't spell byte by byte, has no tokens: zeros
and an empty string, and no part in the counts.  Rows are handled one by one: repeated keys and rows count each, null
keys are kept, and other columns are ignored, whatever their names.  An empty table gives an empty table.  A text of
any length is aligned whole; it makes up its own chunk.
"""

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.byte_bpe import byte_characters
from tracesift.llm.common import chunks, give_back, tabled

#: A single space that no merge of either tokenizer crosses.
CUT = re.compile(r"""(?<=[\w.,;:!?)"']) (?=\w)""")
#: What a word begins and ends with if others can stand beside it.
FIRST, LAST = re.compile(r"\w"), re.compile(r"""[\w.,;:!?)"']""")
#: Texts of words that can stand side by side in one call have about so many characters; a longer word stands alone.
CALL = 1 << 16
#: Words whose alignment a task remembers from chunk to chunk; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Text of a chunk.
CHUNK_BYTES = 4 << 20
#: Words whose links are counted at a time; a longer text is counted whole.
COUNTED = 1 << 15

DOC = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,pairs:array<int>,counts:array<int>>"
PAIR = "struct<a:int,b:int,n:bigint>"


class Aligned(NamedTuple):
    """Words side by side: tokens of A and of B, groups, links of each; the links of all; and whether A and B spell them."""

    n_a: list[int]
    n_b: list[int]
    n_links: list[int]
    groups: list[str]
    links: np.ndarray
    spelled: tuple[bytes, bytes] | None


class Aligner:
    """Both tokenizers, with the bytes and the printed ids of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        of_a = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_a = [of_a.get(i, b"") for i in range(max(of_a, default=-1) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        fallback = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if own else p.replace("▁", " ").encode() for p, own in zip(pieces, fallback, strict=True)]
        self.fallback = np.array(fallback, bool)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in part], np.int64) for part in (self.bytes_a, self.bytes_b))
        self.names = {end: np.array([f"{i}{end}" for i in range(max(len(self.bytes_a), len(pieces)))], object) for end in ",|;\n"}
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)

    def words(self, text: str) -> list[str]:
        return [text] if self.whole else CUT.split(text)

    def calls(self, words: list[str]) -> Iterator[list[str]]:
        """Words in groups that can stand side by side."""
        held, size = [], 0
        for word in words:
            # letters and numbers are word characters, so most words need no search
            if self.whole or len(word) > CALL or not (word.isalnum() or FIRST.match(word) and LAST.match(word[-1])):
                yield [word]
                continue
            held.append(word)
            size += len(word) + 1
            if size > CALL:
                yield held
                held, size = [], 0
        if held:
            yield held

    def align(self, words: list[str]) -> Aligned:
        text = " " + " ".join(words)
        data = text.encode()
        encoding = self.a.encode(text, add_special_tokens=False)
        ids_a = np.array(encoding.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        inside = np.append(spans[1:, 0] < spans[:-1, 1], False)[: len(ids_a)]  # the next token begins in the same character
        ends_a = refined(byte_places(text)[spans[:, 1]], inside, self.sizes_a[ids_a])
        pieces = [(p.id, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        ids_b, ends_b = np.fromiter(chain.from_iterable(pieces), np.int64, 2 * len(pieces)).reshape(-1, 2).T.copy()
        ends_b = refined(ends_b + 1, self.fallback[ids_b], self.sizes_b[ids_b])  # B's spans leave out the added space
        listed_a, listed_b = ids_a.tolist(), ids_b.tolist()
        spelled = b"".join([self.bytes_a[i] for i in listed_a]), b"".join([self.bytes_b[i] for i in listed_b])
        if spelled != (data, data):
            return Aligned([len(ids_a)], [len(ids_b)], [0], [""], np.empty(0, np.int64), spelled)
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        of_word = np.searchsorted(ends_a[last_a], ends)
        if not (ends_a[last_a][of_word] == ends).all():
            raise ValueError("a token crosses the words of " + repr(text[:200]))
        # the tokens of a group in a row, A's and then B's
        printed = np.empty(len(ids_a) + len(ids_b), object)
        at_a = np.arange(len(ids_a)) + np.append(0, last_b + 1)[np.searchsorted(last_a, np.arange(len(ids_a)))]
        at_b = np.arange(len(ids_b)) + (last_a + 1)[np.searchsorted(last_b, np.arange(len(ids_b)))]
        printed[at_a], printed[at_b] = self.names[","][ids_a], self.names[","][ids_b]
        printed[at_a[last_a]], printed[at_b[last_b]] = self.names["|"][ids_a[last_a]], self.names[";"][ids_b[last_b]]
        printed[at_b[last_b[of_word]]] = self.names["\n"][ids_b[last_b[of_word]]]
        return Aligned(
            np.diff(last_a[of_word], prepend=-1).tolist(),
            np.diff(last_b[of_word], prepend=-1).tolist(),
            np.diff(of_word, prepend=-1).tolist(),
            "".join(printed.tolist()).split("\n")[:-1],
            ids_a[last_a] << 32 | ids_b[last_b],
            None,
        )


def byte_places(text: str) -> np.ndarray:
    """The byte at which each character starts, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))


def refined(ends: np.ndarray, coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes.  A ``coarse`` one ends as many bytes behind the token before it as it decodes to."""
    if not coarse.any():
        return ends
    fine = np.maximum.accumulate(np.where(coarse, -1, np.arange(len(ends))))
    total = np.cumsum(sizes)
    start = np.where(fine < 0, 0, ends[fine] - total[fine])
    return np.where(coarse, start + total, ends)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Words:
    """What the tokenizers make of the words that a task has met: by place, tokens of both, groups, and numbers of linked pairs."""

    def __init__(self, tool: Aligner):
        self.tool = tool
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_links, self.links = (array("i") for _ in range(4))
        self.starts = array("q")
        self.pairs: dict[int, int] = {}
        self.spelled: dict[int, tuple[bytes, bytes]] = {}

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """The places of each text's words; none if the tokenizers don't spell the text."""
        if len(self.places) > REMEMBERED:
            self.forget()
        known, places = len(self.places), self.places
        read = [np.array([places.setdefault(w, len(places)) for w in self.tool.words(t)] if t else [], np.int64) for t in texts]
        new = list(islice(places, known, None))
        for column in (self.n_a, self.n_b, self.n_links, self.starts):
            column.extend([0] * len(new))
        self.groups += [""] * len(new)
        for words in self.tool.calls(new):
            made = self.tool.align(words)
            if made.spelled and len(words) > 1:
                for word in words:
                    self.keep([word], self.tool.align([word]))
            else:
                self.keep(words, made)
        return [t if self._spells(t) else t[:0] for t in read] if self.spelled else read

    def keep(self, words: list[str], made: Aligned) -> None:
        at = len(self.links)
        for i, *values in zip(map(self.places.get, words), made.n_a, made.n_b, made.n_links, made.groups, strict=True):
            self.n_a[i], self.n_b[i], self.n_links[i], self.groups[i] = values
            self.starts[i] = at
            at += values[2]
        if made.spelled:
            self.spelled[self.places[words[0]]] = made.spelled
        distinct, which = np.unique(made.links, return_inverse=True)
        numbers = np.array([self.pairs.setdefault(p, len(self.pairs)) for p in distinct.tolist()], np.int32)
        self.links.frombytes(numbers[which].tobytes())

    def _spells(self, text: np.ndarray) -> bool:
        """Whether A and B both spell the text: their words do, or what they spell falls into place when joined."""
        places = text.tolist()
        if not any(i in self.spelled for i in places):
            return True
        words = list(self.places)
        parts = [(" " + words[i]).encode() for i in places]
        sides = (b"".join(self.spelled[i][side] if i in self.spelled else p for i, p in zip(places, parts, strict=True)) for side in (0, 1))
        return all(side == b"".join(parts) for side in sides)

    def rows(self, texts: list[np.ndarray]) -> tuple[list[pa.Array], list[str], list[pa.Array]]:
        """Of each text counts, distinct pairs and how often; their groups; and the pairs of all, with how often."""
        n_a, n_b, n_links, starts, links = (np.frombuffer(x, x.typecode) for x in (self.n_a, self.n_b, self.n_links, self.starts, self.links))
        often, found = np.zeros(len(self.pairs), np.int64), []
        for some in _blocks(texts):
            flat = np.concatenate(some)
            linked = links[_ranges(starts[flat], n_links[flat])].astype(np.int64)
            owner = np.repeat(np.repeat(np.arange(len(some)), [len(t) for t in some]), n_links[flat])
            distinct, counts = np.unique(owner * max(1, len(often)) + linked, return_counts=True)
            owner, linked = np.divmod(distinct, max(1, len(often)))
            np.add.at(often, linked, counts)
            found.append((np.bincount(owner, minlength=len(some)), linked.astype(np.int32), counts.astype(np.int32)))
        sizes, linked, counts = (np.concatenate([*x, np.empty(0, np.int32)]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        held = np.flatnonzero(often)
        number = (np.cumsum(often > 0) - 1).astype(np.int32)  # among the pairs of these texts
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        of_text = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (number[linked], counts)]

        def total(values: np.ndarray) -> pa.Array:
            return pa.array(np.array([values[t].sum() for t in texts], np.int64))

        groups = [";".join([self.groups[i] for i in t.tolist()]) for t in texts]
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))[held]
        ids = [pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(often[held], pa.int64())]
        return [total(n_a), total(n_b), total(n_links), total(n_links), *of_text], groups, ids


def _blocks(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in a row that have about ``COUNTED`` words."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= COUNTED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _chunk_rows(df: DataFrame, keys: list[str], text: str, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """A table with a row for each chunk of texts: keys, counts and linked pairs of each, their groups (packed), and the distinct pairs."""
    rows = df.select(F.struct(*(_column(df, k).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys"), _column(df, text).alias("text"))
    doc = T.StructType([rows.schema["keys"], *T._parse_datatype_string(DOC).fields])
    schema = T.StructType(
        [
            T.StructField("chunk", T.StringType()),
            T.StructField("docs", T.ArrayType(doc)),
            T.StructField("groups", T.BinaryType()),
            T.StructField("pairs", T.ArrayType(T._parse_datatype_string(PAIR))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(aligner(path_a, path_b))
        for number, batch in enumerate(chunks(batches, "text", chunk_bytes)):
            columns, groups, pairs = words.rows(words.read(batch.column("text").to_pylist()))
            held = batch.column("keys")
            docs = pa.StructArray.from_arrays([held.cast(_nullable(held.type)), *columns], doc.names)
            packed = _packed(groups)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{TaskContext.get().partitionId()}-{number}"]),
                    _one_list(docs),
                    pa.array([packed], pa.binary()),
                    _one_list(pa.StructArray.from_arrays(pairs, ["a", "b", "n"])),
                ],
                schema.names,
            )
            del held, columns, groups, pairs, docs, packed
            give_back()

    return tabled(rows, "aligned", run, schema)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with fields that may be null: a null struct's are, whatever Spark says of them, and Arrow doesn't write them otherwise."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return kind


def _packed(lines: list[str]) -> bytes:
    """The lines compressed, without a second copy of them; they are ASCII."""
    made = zstandard.ZstdCompressor().compressobj(size=sum(map(len, lines)) + max(0, len(lines) - 1))
    return b"".join([*(made.compress(("\n" * (i > 0) + line).encode()) for i, line in enumerate(lines)), made.flush()])


def _column(df: DataFrame, name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pair_counts(table: DataFrame) -> DataFrame:
    """``a, b, count`` of every linked pair, and whether it is the highest of its ``b``."""
    pairs = table.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = tabled(pairs, "pairs")
    # a row for each id of B's vocabulary at most, which bounds what a join may broadcast
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(df: DataFrame, keys: list[str], text: str, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every row's ``keys``, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and of B up to each common end.  ``n_best`` counts the links whose
    pair has the highest corpus-wide count of its B id, ``count_sum`` sums these counts over all links.  The vocabulary
    files are at the same paths on all machines.  ``chunk_bytes`` is about the text that a task holds at a time.
    """
    table = _chunk_rows(df, keys, text, path_a, path_b, chunk_bytes)
    held = table.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("i", "pair")).select("of", "i", "pair.a", "pair.b")
    counts = held.join(pair_counts(table), ["a", "b"]).select("of", "i", "count", "best")
    kinds = [("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint"), ("groups", "string")]
    names = [n for n, _ in kinds]
    schema = T.StructType([T.StructField("keys", table.schema["docs"].dataType.elementType["keys"].dataType), *T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in kinds)).fields])

    def finish(chunk: pa.Table, counted: pa.Table) -> pa.Table:
        """The rows of a chunk, by the corpus-wide counts of its pairs."""
        docs = chunk.column("docs").combine_chunks().flatten()
        order = np.argsort(counted.column("i").to_numpy())
        count = counted.column("count").to_numpy()[order]
        best = counted.column("best").to_numpy()[order].astype(np.int64)
        pairs, often = (docs.field(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "counts"))
        ends = np.cumsum(np.diff(docs.field("pairs").offsets.to_numpy()))

        def total(values: np.ndarray) -> pa.Array:
            sums = np.append(0, np.cumsum(values[pairs] * often))
            return pa.array(np.diff(sums[ends], prepend=0))

        counts = [docs.field(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
        groups = zstandard.decompress(chunk.column("groups")[0].as_py()).decode().split("\n")
        return pa.Table.from_arrays([docs.field("keys"), *counts, total(best), total(count), pa.array(groups, pa.string())], ["keys", *names])

    done = table.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(finish, schema)
    return done.select(*(F.col(f"keys.k{i}").alias(k) for i, k in enumerate(keys)), *names)
