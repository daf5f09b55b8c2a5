"""Aligned tokens against whole texts given to the libraries, all pairs of ends compared."""

import hashlib
import os
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import odd
from tracesift.llm import token_align
from tracesift.llm.byte_bpe import byte_characters
from tracesift.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES

PATHS = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)

#: Marks between words, split characters, control strings, and texts that one of the tokenizers changes.
HARD = [
    "a▁b c", " lead  two", "x y it's 's ok", "<|endoftext|> <s> <0x41> </s>", "ﬁ Å é é 漢字漢 😀😀 𓀀𓀁", "  \u0085 \x1c z", " ", "\n\n a",
    "½ Ⅷ ² x² y_ z", "word. Next, \"q\" 'b' ) c", "a" * 5000 + " b", "᠎ ​ q", "ｆｕｌｌ　width", "� ﻿ b", "a b c d",
]


def whole(rows):
    tool_a, tool_b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tool_a.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    made, counted = [], Counter()
    for key, text in rows:
        data = (" " + (text or "")).encode()
        ids = (tool_a.encode(data.decode(), add_special_tokens=False).ids, tool_b.encode(text)) if text else ([], [])
        pieces = [tool_b.id_to_piece(i) for i in ids[1]]
        parts = (
            [bytes(byte_of[c] for c in tool_a.id_to_token(i)) for i in ids[0]],
            [bytes.fromhex(p[3:5]) if tool_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces, strict=True)],
        )
        if any(b"".join(p) != data for p in parts):
            ids, parts = ([], []), ([], [])
        ends = [list(running_ends(p)) for p in parts]
        groups, links, at = [], [], [0, 0]
        common = set(ends[1])
        for i, end in enumerate(ends[0]):
            if end in common:
                j = ends[1].index(end, at[1])
                groups.append("|".join(",".join(map(str, own[a : b + 1])) for own, a, b in zip(ids, at, (i, j), strict=True)))
                links.append((ids[0][i], ids[1][j]))
                at = [i + 1, j + 1]
        counted.update(links)
        made.append((key, len(ids[0]), len(ids[1]), groups, links))
    best: dict = {}
    for (_, b), n in counted.items():
        best[b] = max(n, best.get(b, 0))
    return Counter(
        (key, n_a, n_b, len(groups), len(links), sum(counted[x] == best[x[1]] for x in links), sum(counted[x] for x in links), ";".join(groups))
        for key, n_a, n_b, groups, links in made
    )


def running_ends(parts):
    at = 0
    for part in parts:
        at += len(part)
        yield at


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter()
    for row, n in whole(rows).items():
        want[(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")] += n
    assert Counter(map(tuple, QUERIES["op13_token_align"](spark, sf_dir).collect())) == want


@pytest.mark.parametrize("limit", [1, 4 << 20])
def test_odd_rows(spark, limit):
    """Also with a chunk for each text, whose counts come together over chunks."""
    rows = odd.odd_texts() + list(enumerate(HARD, 90)) + [(90, HARD[0]), (91, None), (92, HARD[4])]
    got = token_align.align(odd.documents(spark, rows), ["doc_id"], "text", *PATHS, chunk_bytes=limit)
    assert Counter(map(tuple, got.collect())) == whole(rows)


def test_empty_tables_and_odd_names(spark):
    assert token_align.align(odd.documents(spark, []), ["doc_id"], "text", *PATHS).count() == 0
    table = spark.createDataFrame([("a", 1, "one two"), (None, 2, None), ("a", 1, "")], "`k.x` string, _text int, `the text` string")
    got = token_align.align(table, ["k.x", "_text"], "the text", *PATHS)
    assert got.columns[:2] == ["k.x", "_text"]
    assert sorted((r[0] or "", r[1], r.n_a) for r in got.collect()) == [("", 2, 0), ("a", 1, 0), ("a", 1, 2)]
    keys_named = spark.createDataFrame([(1, 2, "x")], "keys int, chunk int, groups_ string")
    assert token_align.align(keys_named, ["keys", "chunk"], "groups_", *PATHS).collect()[0][:2] == (1, 2)


def test_words_of_a_task_are_aligned_once(monkeypatch):
    """As many distinct words as four chunks hold; those of the first come again at the end."""
    parts = [" ".join(f"{chr(97 + k)}{i:x}" for i in range(70_000)) for k in range(4)]
    words, met = token_align.Words(token_align.aligner(*PATHS)), []
    monkeypatch.setattr(words.tool, "align", lambda some, align=words.tool.align: met.append(len(some)) or align(some))
    first, *_, last = [words.rows(words.read([part]))[1] for part in [*parts, parts[0]]]
    assert sum(met) == 280_000 and first == last


def test_counting_the_links_of_a_chunk_takes_little_memory():
    """300 texts of 2,000 words, of which a task has met 5,000: the words' places take 5 MB, what is counted 40 bytes for each word at most."""
    words = token_align.Words(token_align.aligner(*PATHS))
    read = words.read([" ".join(f"w{(i * k) % 5000:x}" for k in range(1, 2001)) for i in range(1, 301)])
    whole = [words.rows([text])[0][:4] for text in read]
    tracemalloc.start()
    counts, groups, pairs = words.rows(read)
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, groups))
    tracemalloc.stop()
    assert peak < 40 * 300 * 2000
    assert [c.to_pylist() for c in counts[:4]] == [[w[i][0].as_py() for w in whole] for i in range(4)]
    assert sum(counts[5].flatten().to_pylist()) == sum(pairs[2].to_pylist()) == sum(counts[3].to_pylist())


def test_tables_in_between_start_no_programs(spark):
    """Hadoop's local file system starts programs for each file that it makes, and leaves a checksum beside it."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id LONG, text STRING")
    assert token_align.align(docs, ["doc_id"], "text", *PATHS).count() == 20
    made = {name.rsplit("-", 1)[0]: os.listdir(os.path.join(folder, name)) for name in set(os.listdir(folder)) - before}
    assert set(made) == {"aligned", "pairs"} and not [file for files in made.values() for file in files if file.endswith(".crc")]


@pytest.mark.parametrize("lines", [[], [""], ["", ""], ["1,2|3", "", "4|5,6"]])
def test_packed_groups_are_read_again(lines):
    assert token_align.zstandard.decompress(token_align._packed(lines)).decode() == "\n".join(lines)


def test_keys_of_any_type(spark):
    """Also null structs of fields that are never null."""
    kinds = ["STRUCT(1 AS x, ARRAY('q') AS y)", "ARRAY(STRUCT(1 AS x))", "MAP('a', STRUCT(1 AS x))", "TIMESTAMP_NTZ'1500-01-02 03:04:05'", "CAST(1.25 AS DECIMAL(20,3))", "INTERVAL '1 02:03:04' DAY TO SECOND"]
    docs = spark.range(2).selectExpr(*(f"IF(id = 1, NULL, {k}) AS k{i}" for i, k in enumerate(kinds)), "'one two' AS t")
    keys = docs.columns[:-1]
    got = token_align.align(docs, keys, "t", *PATHS).select(*keys)
    assert got.dtypes == docs.dtypes[:-1] and sorted(map(str, got.collect())) == sorted(map(str, docs.select(*keys).collect()))
