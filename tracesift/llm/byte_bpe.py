"""Byte-level BPE: encoding by a rank file with the tokenizers library, and decoding.

A text is cut into the matches of a pattern; each match becomes tokens by itself,
so a match seen before need not be encoded again.  The library works on characters:
every byte stands for one printable character (``byte_characters``), and tokens are
strings of those.  Decoding looks the ids up in the reversed table and joins bytes
before it reads characters, so a character split over tokens comes out whole.

Inputs: a null text counts as empty; an empty text has no tokens.  Rows are handled
one by one: repeated keys and rows stay as they are, null keys are kept, an empty
table gives an empty table, and other columns of the input are ignored.  A text of any
length is encoded whole.
"""

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.llm.common import chunks, frugal

#: Matches whose tokens a task remembers; beyond it the memory starts anew.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    table = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """The tokenizer of a rank file.  Any two neighbours whose bytes together are a token may merge, lowest id first."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, character = read_ranks(path), byte_characters()

        def spelled(token: bytes) -> str:
            return "".join(character[b] for b in token)

        merges = [
            (spelled(token[:i]), spelled(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocabulary = {spelled(token): rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = matcher(pattern)
        self.known, self.packed = Numbers(), []

    def forget(self) -> None:
        self.known, self.packed = Numbers(), []

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, packed = self.known, self.packed
        numbers = [list(map(known.__getitem__, self.find(text))) for text in texts]
        new = list(islice(known, len(packed), None))
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            packed += [array("I", made.ids).tobytes() for made in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return [b"".join([packed[i] for i in own]) for own in numbers]


class Numbers(dict):
    """A number for each key, in the order in which keys are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in a text.

    Texts within Latin-1 take the standard library's engine, in which the classes of
    letters, numbers and white space are short lists.  Texts with characters that only
    the newest Unicode versions assign take the tokenizers library's own splitter, so that
    no two versions of the character tables disagree.
    """
    from tokenizers import Regex, pre_tokenizers

    newest = pre_tokenizers.Split(Regex(pattern), "isolated")
    latin = [chr(c) for c in range(256)]
    general = regex.compile(pattern)
    short = pattern
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        members = "".join(f"\\x{ord(c):02x}" for c in latin if regex.fullmatch(name, c))
        short = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m, members=members: m[1] + members, short)
        short = short.replace(name, f"[{members}]").replace("\\S", f"[^{members}]" if name == "\\s" else "\\S")
    narrow = re.compile(short) if "\\p" not in short else general

    def find(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return [part for part, _ in newest.pre_tokenize_str(text)]
            return general.findall(text)
        return narrow.findall(text)

    return find


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; an id without a token has none."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def offsets(text: str, packed: bytes, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of each token; tokens that share a split character both cover it."""
    ids = np.frombuffer(packed, "<u4")
    ends = np.cumsum([len(table[i]) for i in ids.tolist()], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return character[starts], character[ends - 1] + 1


def encode(
    docs: DataFrame, keys: list[str], text: str, path: str, pattern: str, with_offsets: bool = False, with_data: bool = False
) -> DataFrame:
    """``keys``, ``n_tokens``, ``packed`` (the ids as little-endian unsigned 32-bit integers) and, if asked
    for, ``starts`` and ``ends`` (characters of the text that each token covers) and ``data`` (what the ids
    decode to, in the same pass)."""
    held = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    fields = [*held.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("packed", T.BinaryType())]
    if with_offsets:
        fields += [T.StructField(name, T.ArrayType(T.LongType())) for name in ("starts", "ends")]
    if with_data:
        fields.append(T.StructField("data", T.BinaryType()))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in chunks(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            packed = own.encode(texts)
            columns = [batch.column(i) for i in range(len(keys))]
            columns += [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            if with_offsets:
                found = [offsets(t, p, token_bytes(path)) for t, p in zip(texts, packed, strict=True)]
                columns += [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            if with_data:
                columns.append(pa.array([joined(p, token_bytes(path)) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        own.forget()

    return held.mapInArrow(run, T.StructType(fields))


def joined(packed: bytes, table: list[bytes]) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()])


def decode(tokens: DataFrame, keys: list[str], packed: str, path: str) -> DataFrame:
    """``keys``, ``packed`` and ``data``, the bytes that the ids stand for (null ids: null).

    ``data.cast("string")`` is the text; ids cut within a character leave its bytes incomplete.
    """
    held = tokens.select(*keys, F.col(packed).alias("packed"))
    schema = T.StructType([*held.schema.fields, T.StructField("data", T.BinaryType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in chunks(batches, "packed"):
            data = [None if p is None else joined(p, table) for p in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], schema.names)

    return held.mapInArrow(run, schema)
