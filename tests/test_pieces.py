"""Texts and files in pieces, and sessions on a stream, against whole scans."""

import datetime
import random
import re
import re._parser as parser
from collections import Counter

import pytest

from tests import brute
from tests.test_scan import CARD, EDGES, GH, GL, GL_LONG, IBAN, KEY
from tracesift.operators import rule_data as data
from tracesift.operators.pieces import MARGIN, SEPARATORS, cut_after, cut_texts, scan_pieces
from tracesift.operators.scan import scan_column
from tracesift.sources.readers import read_text_lines, read_text_pieces
from tracesift.sources.writers import write_blocks
from tracesift.streaming.scan_stream import start_append
from tracesift.streaming import sessions
from tracesift.streaming.sessions import scan_sessions

PATTERNS = [p for _, p, _ in data.TOKEN_RULES] + [data.IBAN_BODY, data.CARD_BODY, data.PHONE_BODY]


def mixtures(seed, n, most):
    rng = random.Random(seed)
    atoms = [
        GH, GL, GL_LONG, CARD, IBAN, KEY, KEY + KEY, "abc1Q~" + "z" * 33, "~bc2Q~" + "z" * 31, "012-34-5678", "(415) 555-2671", "+1-415-555-2671", "0612345678",
        "alice.smith@mail.io", "a-b@c-d.e-f.org", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "AB12 ABCD ", "12-34-", "12 34 56", "é", "漢字", "٣", "😀",
        "_", "-", ".", "~", " ", " ", " ", "/", ":", "=", "\n", ",", "@", "+", "(", "x", "9", "A", "hvs." + "q" * 90, "EAAM" + "b" * 130, "sk_live_" + "z" * 30,
    ]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(1, most))) for _ in range(n)]


def scanned(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, text STRING")
    out = [[] for _ in texts]
    for r in scan_pieces(cut_texts(df, ["id"], "text", size), ["id"]).orderBy("id", "start").collect():
        out[r.id].append((r.kind, r.value, r.start, r.end))
    return out


def test_no_match_is_longer_than_the_margin_or_holds_a_separator():
    assert max(parser.parse(p).getwidth()[1] for p in PATTERNS) < MARGIN
    for separator in SEPARATORS:
        assert not re.match(r"\w", separator) and separator not in data.TOKEN_GLUE + "._"

        def admits(tree):
            for op, arg in tree:
                if op is parser.LITERAL and arg == ord(separator):
                    return True
                if op is parser.IN and re.match(_class(arg), separator):
                    return True
                parts = arg if isinstance(arg, (list, tuple, parser.SubPattern)) else []
                for part in parts:
                    subs = part if isinstance(part, list) else [part]
                    if any(isinstance(s, parser.SubPattern) and admits(s) for s in subs):
                        return True
            return False

        assert not [p for p in PATTERNS if admits(parser.parse(p))], separator


def _class(items):
    """A class again as an expression."""
    out = ""
    for op, arg in items:
        if op is parser.LITERAL:
            out += re.escape(chr(arg))
        elif op is parser.RANGE:
            out += f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}"
        elif op is parser.CATEGORY:
            out += {parser.CATEGORY_DIGIT: r"\d", parser.CATEGORY_WORD: r"\w", parser.CATEGORY_SPACE: r"\s"}[arg]
        else:
            raise AssertionError(op)
    return f"[{out}]"


@pytest.mark.parametrize("size", [1, 40, 1024])
def test_pieces_equal_the_definition(spark, size):
    texts = [*EDGES.values(), *mixtures(size, 700, 14), *("".join(mixtures(i, 60, 14)) for i in range(6)), "", None]
    for text, rows in zip(texts, scanned(spark, texts, size), strict=True):
        assert rows == brute.scan(text or ""), text


@pytest.mark.parametrize("alphabet", ["0123456789 -", "01 +().-", "AB12 ", "ab.@-_%+é1", "05-٣ _.(", "SKghp_-.~0a="])
def test_soup_in_the_smallest_pieces(spark, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(500)]
    for text, rows in zip(texts, scanned(spark, texts, 1), strict=True):
        assert rows == brute.scan(text), text


def test_a_rejected_match_over_a_border_still_uses_up_its_text(spark):
    filler = "word " * 203  # the border of the first kilobyte falls into the number
    text = f"{filler}{CARD} 123 and {filler} {KEY}{KEY} {filler}"
    assert cut_after(text.encode(), 1024) not in (0, 1024)
    assert scanned(spark, [text], 1024)[0] == brute.scan(text)


def test_matches_of_one_text_are_not_gathered(spark):
    """Ten thousand findings of one text come from many small islands."""
    text = " ".join(f"n{i}@mail.io,{i:04d}-55-1234" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "id BIGINT, text STRING")
    got = scan_pieces(cut_texts(df, ["id"], "text", 4096), ["id"])
    want = {(r.kind, r.value, r.start, r.end) for r in scan_column(df, ["id"], "text").collect()}
    assert {tuple(r)[1:] for r in got.collect()} == want and len(want) >= 5000


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_and_piece_is_read_once(spark, tmp_path, split):
    files = {"a.txt": "one\n\ntwo\r\nthree\n", "b.txt": "no end", "sub/c.txt": "\n\né漢字 x\n" + "long " * 50 + "\nlast", "empty.txt": "", "_hidden": "x\n", "d.txt": "\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((r.file.removeprefix(f"{tmp_path}/"), r.offset, r.text) for r in read_text_lines(spark, str(tmp_path), split).collect())
    want = []
    for name, text in files.items():
        at = 0
        for line in text.encode().split(b"\n")[: None if text and not text.endswith("\n") else -1]:
            want += [] if name == "_hidden" else [(name, at, line.decode())]
            at += len(line) + 1
    assert got == sorted(want)
    for size in (1, 10, 1 << 20):
        pieces = sorted(map(tuple, read_text_pieces(spark, str(tmp_path), size, split).collect()))
        for name, text in files.items():
            own = [p for p in pieces if p[0] == f"{tmp_path}/{name}"]
            assert "".join(p[3] for p in own) == ("" if name == "_hidden" else text)
            for _, offset, before, piece, after in own:
                raw = text.encode()
                assert raw[:offset].decode()[-1:] == before and raw[offset:].decode().startswith(piece + after)


def test_a_file_without_lines_in_pieces_equals_the_whole(spark, tmp_path):
    text = "".join(mixtures(3, 400, 14)).replace("\n", " ")
    (tmp_path / "one.txt").write_text(text)
    found = scan_pieces(read_text_pieces(spark, str(tmp_path), 1024, 5000), ["file"]).orderBy("start").collect()
    assert [tuple(r)[1:] for r in found] == brute.scan(text)
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe")
    with pytest.raises(Exception, match="INVALID_UTF8.*byte 3"):
        read_text_pieces(spark, str(tmp_path), 1024).collect()
    with pytest.raises(Exception, match="nowhere"):
        read_text_lines(spark, str(tmp_path / "nowhere")).collect()


SENT = "session STRING, number INT, piece STRING, last BOOLEAN"


def test_sessions_over_batches_and_restarts_equal_the_whole(spark, tmp_path):
    """Pieces cut anywhere, out of order, twice, in several batches with a restart after each."""
    rng = random.Random(5)
    texts = {f"s{i}": "".join(mixtures(i, 8, 10)) for i in range(12)} | {"é": f"déjà {GH} ü {CARD}", "none": ""}
    rows = []
    for session, text in texts.items():
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(9))})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])] or [""]
        rows += [(session, n, p, n == len(parts) - 1) for n, p in enumerate(parts)]
    rng.shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for at in range(0, len(rows), 40):
        spark.createDataFrame(rows[at : at + 40] + rows[:3], SENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SENT).option("maxFilesPerTrigger", 1).parquet(source)
        start_append(scan_sessions(stream, ["session"], "number", "piece", "last"), out, state, availableNow=True).awaitTermination()
    want = sorted((s, *f) for s, text in texts.items() for f in brute.scan(text))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) > 40


def test_an_open_session_gives_what_is_closed(spark, tmp_path):
    rows = [("a", 0, f"x {GH}\n tail {GH[:9]}", False), ("a", 1, GH[9:], False), ("b", 1, "late", True), ("c", None, "lost", True), (None, 0, f"{CARD}\n", None)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, SENT).write.parquet(source)
    stream = spark.readStream.schema(SENT).parquet(source)
    start_append(scan_sessions(stream, ["session"], "number", "piece", "last"), out, availableNow=True).awaitTermination()
    got = {(r.session, r.kind, r.start) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "github-pat", 2), (None, "credit_card", 0)}


def test_many_sessions_are_few_calls(spark, tmp_path):
    """Of thousands of sessions each gets its own findings, by no more calls of Python than there are buckets."""
    keys = "a BIGINT, b STRING, `c.d` DATE"
    own = [(2**60 + i if i else None, f'"é\\{i % 50}', datetime.date(2024, 1, 1 + i % 28)) for i in range(6000)]
    rows = [(*key, n, p, n == 1) for i, key in enumerate(own) for n, p in enumerate((f"{i} {GH[:9]}", GH[9:]))]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows, f"{keys}, number INT, piece STRING, last BOOLEAN").repartition(2, "number").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = start_append(scan_sessions(stream, ["a", "b", "c.d"], "number", "piece", "last"), out, state, availableNow=True)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= sessions.BUCKETS
    got = Counter((r.a, r.b, r["c.d"]) for r in spark.read.parquet(out).collect())
    assert got == Counter(own)


def test_pieces_of_a_table_with_odd_names(spark):
    df = spark.createDataFrame([(1, "x", f"a b {GH}"), (None, "y", f"{CARD} é")], "`k.1` INT, m STRING, `text` STRING")
    found = scan_pieces(cut_texts(df, ["k.1", "m"], "text", 2), ["k.1", "m"])
    assert {tuple(r) for r in found.collect()} == {(1, "x", "github-pat", GH, 4, 44), (None, "y", "credit_card", CARD, 0, 16)}


def test_blocks_are_written_by_the_tasks(spark, tmp_path):
    rows = [(1, "a\nb"), (1, ""), (2, "é"), (1, "c")]
    df = spark.createDataFrame(rows, "block LONG, text STRING").coalesce(1)
    write_blocks(df.sortWithinPartitions("block", "text"), f"file://{tmp_path}/made")
    write_blocks(df.where("false"), f"file://{tmp_path}/none")
    found = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"made/block=1/part.txt": b"\na\nb\nc\n", "made/block=2/part.txt": "é\n".encode()}
    assert read_text_pieces(spark, f"{tmp_path}/none").count() == 0
