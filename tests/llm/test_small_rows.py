"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import odd
from tracesift.llm import byte_bpe, chat_format, decision_list, license_scan, line_crf, phrase_index, simhash, suffix_dedup, url_rules, warc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return odd.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return odd.documents(spark, [])


# --- URL rules ---------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "tie.org", "/a"), ("block", "tie.org", "/a"), ("block", "", "/any/*/x"), ("block", "q.org", "")]
URLS = [
    ("http://a.NET/en/1", "a.net", "/en/1", "net/", "block"),
    ("http://a.example.net/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/en", "example.net", "/en", "net/", "block"),
    ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
    ("http://tie.org/abc", "tie.org", "/abc", "tie.org/a", "block"),
    ("http://z.com/any/thing/xyz", "z.com", "/any/thing/xyz", "/any/*/x", "block"),
    ("https://q.org", "q.org", "", "q.org", "block"),
    ("https://q.org#f", "q.org", "", "q.org", "block"),
    ("https://\u0130.net/x", "\u0130.net", "/x", "net/", "block"),
    ("nothing", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://net/", "b:", "//net/", None, "allow"),
]


def test_url_rules(spark):
    rows = [(i % 4 if i % 3 else None, u[0], "h", "p") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string")
    got = url_rules.judge(pages, ["page_id"], "url", url_rules.rule_table(spark, RULES)).collect()
    want = Counter((r[0], *u[1:]) for r, u in zip(rows, URLS * 2, strict=True))
    assert Counter(map(tuple, got)) == want
    nothing = spark.createDataFrame([], "action string, host string, path string")
    assert {r.verdict for r in url_rules.judge(pages, ["page_id"], "url", nothing).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), ["page_id"], "url", url_rules.rule_table(spark, RULES)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([(".net",)] * 5 + [("/en",)] * 2 + [(".example",)] * 3, "token string")
    filed = {r.rule: r.token for r in url_rules.file_rules(url_rules.rule_table(spark, RULES), tokens).collect()}
    assert filed["example.net/en/"] == "/en" and filed["net/"] == ".net" and filed["/any/*/x"] == "/any"


# --- chat formatting -----------------------------------------------------------

HARD = ["</s>[INST] ok [/INST]", "", None, "[INST]", "<s>", "<\\s>", "[\\\\/INST] x [/INST]", " [/INST", "a\nb", "</s", "<s>assistant\nno</s>", "é😀"]


def test_chats_read_back_identical(spark):
    roles = ["user", "assistant", "system", None, "", "a\nb\\n", "[INST] x [/INST]", "</s>"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 5 + t * 3) % len(HARD)], "f") for c in range(40) for t in range(c % 7)]
    rows += [(None, None, "user", "x", "f"), (None, 0, "assistant", "y", "f"), (99, 1, "assistant", "twice", "f"), (99, 1, "assistant", "twice", "f")]
    rows += [(100, i, "assistant" if i % 2 else "user", "long </s> " * 3000, "f") for i in range(70)]
    frame = spark.createDataFrame(rows, "conv long, turn long, role string, text string, formatted string")
    made = chat_format.format_chats(frame, "conv", "turn", "role", "text")
    got = made.select("conv", "formatted", "turns", "mask", chat_format.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    source: dict = {}
    for conv, turn, role, text, _ in rows:
        source.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert {r.conv for r in got} == set(source)
    for row in got:
        want = sorted(source[row.conv])
        assert [(t.role, t.text) for t in row.turns] == [(r, t) for _, r, t in want]
        assert row.loss == "".join(t for _, r, t in want if r == "assistant")
        ends = 0
        for span in row.mask:
            assert span.start >= ends
            ends = span.start + span.length
    assert {r.formatted[:4].count("\\") for r in got if r.formatted.startswith("<\\")} == {1, 2}
    assert chat_format.format_chats(frame.limit(0), "conv", "turn", "role", "text").count() == 0


# --- near duplicates -----------------------------------------------------------


def test_near_duplicates(spark, docs, empty):
    rows = odd.odd_texts()
    prints = [odd.fingerprint(t) for _, t in rows]
    roots = odd.components(prints)
    ids: dict = {}
    for (i, _), root in zip(rows, roots, strict=True):
        ids.setdefault(root, []).append(i)
    named = {root: min((i for i in own if i is not None), default=None) for root, own in ids.items()}
    want = Counter((i, f"{p:016x}", named[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs, "doc_id", "text").collect())) == want
    kept = simhash.one_of_each(docs, "doc_id", "text")
    assert kept.columns == docs.columns and kept.count() == len(named)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(named.values())
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == simhash.one_of_each(empty, "doc_id", "text").count() == 0


@pytest.mark.parametrize("leaf", [8, 100])
def test_shards_lose_no_pair(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(leaf)
    values = [int(v) for v in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for v in values[:80]:
        for flips in (2, 4, 5):
            near = v
            for b in rng.choice(64, flips, replace=False):
                near ^= 1 << int(b)
            values.append(near)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(frame)).collect()}
    got = [roots.get(v, v) for v in signed]
    want = odd.components(values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (600, 600)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and roots[502] == roots[501] == roots[500] != roots[0]


# --- WARC ------------------------------------------------------------------------


def test_archives(spark):
    big = "<p>é</p>" * 300_000
    pages = [(1, "http://a.b/x", "<p>1</p>"), (2, "http://a.b/x", "<p>1</p>"), (0, "ftp://z", "<p>1</p>"), (4, None, None), (3, "", ""), (None, "http://a.b/y\r\nX: z", "u"), (None, "n", "<p>1</p>"), (6, "http://a.b/x", big), (7, "u", "u"), (7, "u", "u"), (8, "http://c/", "WARC/1.1\r\n\r\n")]
    frame = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, `key` string")
    entries = warc.write_archives(frame, "page_id", "url", "html")
    index = warc.build_index(entries, parts=3)
    found = warc.look_up(index, frame.select(warc.url_key(F.col("url")).alias("key")))
    got = Counter((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_records(found).collect())
    first: dict = {}
    for page, _, html in pages:
        first.setdefault(html or "", []).append(page)
    first = {h: min((p for p in own if p is not None), default=None) for h, own in first.items()}
    import base64

    want = Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = page == first[html or ""]
        want[page, "response" if same else "revisit", len(data), digest, None if same else first[html or ""]] += 1
    assert got == want
    payloads = {r.page_id: r.payload for r in warc.read_records(found).collect() if r.record_type == "response"}
    assert payloads[6] == big.encode() and payloads[8] == b"WARC/1.1\r\n\r\n"
    one = spark.createDataFrame([("b,a)/x",), ("nobody)",), (None,)], "key string")
    assert sorted(r.page_id for r in warc.look_up(index, one).collect()) == [1, 2, 6]
    nothing = warc.build_index(warc.write_archives(frame.limit(0), "page_id", "url", "html"))
    assert warc.read_records(warc.look_up(nothing, one)).count() == 0


def test_keys_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 3)
    rows = [(f"k{i % 7}", i, "f", i, 1) for i in range(200)] + [("k3", 1000 + i, "f", i, 1) for i in range(50)]
    index = warc.build_index(spark.createDataFrame(rows, "key string, page_id long, file string, offset long, length long").coalesce(1), parts=5)
    keys = spark.createDataFrame([("k3",), ("k6",), ("a",), ("z",)], "key string")
    got = sorted(r.page_id for r in warc.look_up(index, keys).collect())
    assert got == sorted(r[1] for r in rows if r[0] in ("k3", "k6"))


# --- quality ---------------------------------------------------------------------


def test_quality_scores(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (7, 1), (12, 0), (13, 0), (13, 1), (11, None), (None, 0), (777, 1)], "doc_id long, quality int")
    weights, ties = line_crf.train(docs, labels, "doc_id", "text", "quality")
    got = line_crf.score(docs, ["doc_id"], "text", weights, ties).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd.odd_texts())
    assert all(0 <= r.score <= 1 for r in got)
    assert line_crf.score(empty, ["doc_id"], "text", weights, ties).count() == 0
    none = line_crf.train(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in line_crf.score(docs, ["doc_id"], "text", *none).collect()} == {0.5}


def test_marginals_equal_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    sizes, ties = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    scores = rng.normal(size=8)
    ahead, back = line_crf.Chain(sizes).messages(scores, ties)
    want, at = [], 0
    for n in sizes:
        own = scores[at : at + n]
        weight = {p: np.exp(own @ np.array(p) + sum(ties[a, b] for a, b in zip(p, p[1:], strict=False))) for p in product((0, 1), repeat=int(n))}
        want += [sum(w for p, w in weight.items() if p[i]) / sum(weight.values()) for i in range(n)]
        at += n
    assert np.allclose(line_crf.logistic(ahead + back), want)


def test_statistics_and_rules(spark, docs, empty):
    got = decision_list.statistics(docs, "doc_id", "text").select("doc_id", *decision_list.STATISTICS[:5]).collect()
    assert Counter(map(tuple, got)) == Counter((i, *odd.base_statistics(t)) for i, t in odd.odd_texts())
    stats = decision_list.statistics(docs, "doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (12, 0)], "doc_id long, quality int")
    assert stats.select(decision_list.verdict([])).distinct().collect()[0][0] is True
    assert decision_list.train(stats, labels.limit(0), "doc_id", "quality") == []
    assert decision_list.statistics(empty, "doc_id", "text").count() == 0
    rule = [[("symbols_a_word", True, 0.5), ("words", True, 2.0)], [("words", False, 0.0)]]
    kept = {(r.doc_id, r.n_words): r.v for r in stats.select("doc_id", "n_words", decision_list.verdict(rule).alias("v")).collect()}
    assert not kept[2, 0] and kept[1, 3] and not kept[12, 120]


def test_rules_are_learned_in_order():
    rng = np.random.default_rng(0)
    n = 3000
    values = {m: rng.random(n) for m in decision_list.MEASURES}
    bad = (values["symbols_a_word"] > 0.8) | ((values["echoes"] > 0.6) & (values["words"] <= 0.5))
    rules = decision_list.learn(values, bad)
    drop = np.zeros(n, bool)
    for rule in rules:
        drop |= decision_list.covered(values, rule)
    assert (drop == bad).mean() > 0.97 and rules[0][0][0] == "symbols_a_word"


# --- phrases -----------------------------------------------------------------------


def test_contamination(spark, docs, empty):
    passage = odd.prose(3, 40)
    items = [(1, passage), (10, passage.upper()), (2, odd.prose(1, 200)), (3, "A b c"), (4, ""), (5, None), (1, passage), (None, "another text of five"), (6, "zz yy")]
    tests = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, `key` string")
    got = phrase_index.contamination(docs, "doc_id", "text", tests, "item_id", "text").collect()
    named = [(i, t) for i, t in items if i is not None]
    want = Counter()
    for i, text in odd.odd_texts():
        n, hit, _ = odd.contamination(text, items)
        want[i, n, hit, tuple(odd.contamination(text, named)[2])] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert phrase_index.contamination(empty, "doc_id", "text", tests, "item_id", "text").count() == 0
    clean = phrase_index.contamination(docs, "doc_id", "text", tests.limit(0), "item_id", "text")
    assert {(r.n_hit, len(r["items"])) for r in clean.collect()} == {(0, 0)}


def test_blocks_of_items_and_proximity(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, odd.prose(3, 40)) for i in range(5)] + [(9, "another of five")], "item_id long, text string")
    index = phrase_index.build(docs, "doc_id", "text")
    whole = phrase_index.search(index, items, "item_id", "text")
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 1)
    parts = phrase_index.search(index, items, "item_id", "text")
    def by_place(hits):
        out = {}
        for r in hits.collect():
            out.setdefault((r.segment, r.place), set()).update(r["items"])
        return out

    assert by_place(whole) == by_place(parts) and len(by_place(whole)) == 3
    near = by_place(phrase_index.search(index, items, "item_id", "text", slop=1))
    assert any("9" in found for found in near.values()) and not any("9" in found for found in by_place(whole).values())


# --- tokens ------------------------------------------------------------------------


def test_tokens(spark, docs, empty):
    made = byte_bpe.encode(docs, ["doc_id"], "text", PATH, public_tokenizers.PATTERN, with_offsets=True)
    back = byte_bpe.decode(made, ["doc_id", "n_tokens", "starts", "ends"], "packed", PATH).collect()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    want = Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd.odd_texts())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.packed, "<u4").tolist()), bytes(r.data)) for r in back) == want
    once = byte_bpe.encode(docs, ["doc_id"], "text", PATH, public_tokenizers.PATTERN, with_data=True).collect()
    assert Counter((r.doc_id, bytes(r.packed), bytes(r.data)) for r in once) == Counter((r.doc_id, bytes(r.packed), bytes(r.data)) for r in back)
    table = byte_bpe.token_bytes(PATH)
    for row in back:
        text = bytes(row.data).decode()
        for token, a, b in list(zip(np.frombuffer(row.packed, "<u4").tolist(), row.starts, row.ends, strict=True))[:500]:
            assert table[token] in text[a:b].encode()
    assert byte_bpe.encode(empty, ["doc_id"], "text", PATH, public_tokenizers.PATTERN).count() == 0


def test_matches_equal_the_library_on_any_characters():
    import random

    rng = random.Random(5)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    ranges = [(1, 0x7F), (1, 0xFF), (1, 0x3FF), (0x400, 0xD7FF), (0xE000, 0x1FFFF)]
    texts = ["".join(chr(rng.randint(*rng.choice(ranges))) * rng.choice([1, 1, 3]) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    got = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN).encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in got] == [own.encode_ordinary(t) for t in texts]


# --- repeated strings ----------------------------------------------------------------


def test_repeats(spark, docs, empty):
    rows = odd.odd_texts()
    want = Counter()
    for (i, text), flags in zip(rows, odd.removed(rows), strict=True):
        data = (text or "").encode()
        want[i, len(data), json.dumps(odd.spans(flags)), bytes(b for b, f in zip(data, flags, strict=True) if not f)] += 1
    made = suffix_dedup.remove_repeats(docs, "doc_id", "text")
    assert made.columns[: len(docs.columns)] == docs.columns
    got = made.collect()
    assert Counter((r.doc_id, r.n_bytes, json.dumps([(s.start, s.end) for s in r.spans]), bytes(r.kept)) for r in got) == want
    assert {(r["row"], r["slot.n"], r.score) for r in got} == {("r", "d", 0.1)}
    assert suffix_dedup.remove_repeats(empty, "doc_id", "text").count() == 0


def test_cuts_leave_whole_characters():
    data = "aéb".encode()
    assert suffix_dedup.whole_characters(data, [(0, 2)]) == [(0, 1)]
    assert suffix_dedup.whole_characters(data, [(2, 4)]) == [(3, 4)]
    assert suffix_dedup.whole_characters(data, [(2, 3)]) == []
    assert suffix_dedup.whole_characters(data, [(0, 4)]) == [(0, 4)]


def test_random_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUPS", 7)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    import random

    rng = random.Random(11)
    pieces = [odd.prose(100 + i, 30) for i in range(8)] + ["ab" * 150, "z" * 130]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 40) :][: rng.randint(60, 400)] for _ in range(rng.randint(1, 6)))) for i in range(60)]
    flags = odd.removed(rows)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(odd.documents(spark, rows).repartition(5), "doc_id", "text").collect()}
    assert got == {i: bytes(b for b, f in zip(t.encode(), own, strict=True) if not f) for (i, t), own in zip(rows, flags, strict=True)}


def test_deep_shallow_order():
    import random

    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 5, 48, 60, 100]))) for _ in range(200)]
    base = [b"x" * 60 + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    strings += base + base[:30] + [s[: rng.randint(0, 100)] for s in base]
    items = list(range(len(strings)))
    assert [strings[i] for i in suffix_dedup.deep_shallow(strings, items)] == sorted(strings)
    assert [strings[i] for i in suffix_dedup.blind_trie(strings, items, 0)] == sorted(strings)


def test_no_task_holds_a_frequent_phrase(spark, monkeypatch):
    """Occurrences of a phrase between different words meet in small groups, and the same bytes are removed."""
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    phrase = "read the terms of use before you go on, thank you for coming by and come again"
    rows = [(i, f"{odd.prose(i, 12)} {phrase} {odd.prose(1000 + i % 290, 12)}") for i in range(300)]
    rows += [(None, f"{odd.prose(7, 9)} {phrase} {odd.prose(1007, 12)}"), (300, f"{odd.prose(5, 30)} {phrase} {odd.prose(8, 30)}"), (4, rows[9][1] + phrase)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = suffix_dedup.numbered(docs, "doc_id", "text").select("row", "slot", "n", "text")
    met = suffix_dedup.surroundings(texts, suffix_dedup.repeated(suffix_dedup.find_anchors(texts, 100)), 100)
    assert max(r["count"] for r in met.where("around is not null").groupBy("h").count().collect()) <= 30
    got = suffix_dedup.remove_repeats(docs, "doc_id", "text", width=100).collect()
    want = Counter((i, len(t.encode()), tuple(odd.spans(f))) for (i, t), f in zip(rows, odd.removed(rows), strict=True))
    assert Counter((r.doc_id, r.n_bytes, tuple((x.start, x.end) for x in r.spans)) for r in got) == want
    assert sum(bool(spans) for _, _, spans in want) > 5


# --- licenses --------------------------------------------------------------------------


def test_licenses(spark, docs, empty):
    got = license_scan.scan(docs, "doc_id", "text").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd.odd_texts())
    assert {r.doc_id: [f.license for f in r.found] for r in got if r.found} == {14: ["CC-BY-NC-4.0"]}
    assert license_scan.scan(empty, "doc_id", "text").count() == 0


def test_every_notice_and_no_other_version():
    for name, text in license_scan.TEMPLATES:
        for block in (text, f"Well. {text} Thanks.", text.upper()):
            known = license_scan.identify(block.encode())
            assert known and known[0] == name and known[2:] == (0, 0)
    long_notice = license_scan.TEMPLATES[2][1]
    assert license_scan.identify(long_notice.replace("without limitation ", "").encode())[0] == "MIT"
    for other in ("Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY-NC-XX 3.0.", "We lost our license yesterday."):
        assert license_scan.identify(other.encode()) is None
    broken = "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); copyright\n"
    assert [f["license"] for f in license_scan.scan_text(broken)[1]] in ([], ["Apache-2.0"])


def test_a_found_license_is_the_best_of_all_templates():
    """Ranking by compression finds what comparing every template word by word finds."""
    for _, text in license_scan.TEMPLATES:
        block = f"Note: {text}"
        words = license_scan.words_of(block)
        full = [(sum(d), n) for n, t, _ in license_scan.compressors() if (d := license_scan.differences(t, words))]
        assert license_scan.identify(block.encode())[0] == min(full)[1]


def test_notices_broken_over_lines():
    """Every template at 72 columns inside other prose, plain and as comments, is found once, whole and exactly."""
    other = "the river was long and the people of the town went by it every day\n"
    for name, text in license_scan.TEMPLATES:
        for mark in ("", "# ", " * "):
            lines = textwrap.fill(text, 72, initial_indent=mark, subsequent_indent=mark, break_long_words=False)
            for about in (other, other + "\n"):
                whole = about * 2 + lines + "\n" + about
                found = license_scan.scan_text(whole)[1]
                assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, 0, 0)]
                assert license_scan.words_of(whole.encode()[found[0]["start"] : found[0]["end"]].decode()) == license_scan.words_of(text)
        short = textwrap.fill(text, 20, break_long_words=False)
        assert [f["license"] for f in license_scan.scan_text(odd.prose(6, 30) + "\n" + short)[1]] == [name]
    gpl = "This work is licensed under the GNU General Public License, version 2"
    assert [f["license"] for f in license_scan.scan_text(f"{gpl}\nor later")[1]] == []
    assert [f["license"] for f in license_scan.scan_text(f"{gpl}\n3 more things")[1]] == ["GPL-2.0"]


def test_notices_inside_paragraphs():
    """Every template far inside one line, two in one line, and one that others are more alike to, are found exactly."""
    before, after = odd.prose(7, 300), odd.prose(8, 5000)
    for name, text in license_scan.TEMPLATES:
        for lead in ("x" * 40, before, before * 20):
            found = license_scan.scan_text(f"{lead} {text} {after}")[1]
            assert [(f["license"], f["missing"], f["extra"]) for f in found] == [(name, 0, 0)]
        for other, second in license_scan.TEMPLATES:
            found = license_scan.scan_text(f"{lead} {text} {second} {before} {text}")[1]
            assert [f["license"] for f in found] == [name, other, name]
    # one word missing, one too many, beside a whole notice of the same license
    changed = license_scan.TEMPLATES[2][1].replace("without limitation ", "").replace("sublicense", "sublicense again")
    found = license_scan.scan_text(f"{before} {changed} {license_scan.TEMPLATES[2][1]}")[1]
    assert [(f["license"], f["missing"], f["extra"]) for f in found] == [("MIT", 2, 1), ("MIT", 0, 0)]


def test_the_ranking_by_compression_decides(monkeypatch):
    """A short notice is also the start of a longer one: what saves more bytes wins.  Without the savings it doesn't."""
    short, text = license_scan.TEMPLATES[3][1], license_scan.TEMPLATES[4][1]
    assert text.startswith(short[:-1])
    found = license_scan.scan_text(f"Note. {text} End.")[1]
    assert [(f["start"], f["end"]) for f in found] == [(6, 6 + len(text))]
    ranked = sorted(zip(license_scan.saved(text.lower().encode()), license_scan.TEMPLATES), reverse=True)
    assert ranked[0][1][1] == text
    monkeypatch.setattr(license_scan, "saved", lambda data: [0] * len(license_scan.TEMPLATES))
    assert [f["end"] for f in license_scan.scan_text(f"Note. {text} End.")[1]] == [6 + len(short) - 1]


def test_every_template_is_compressed_with_every_block(monkeypatch):
    seen = []
    real = license_scan.compressed
    monkeypatch.setattr(license_scan, "compressed", lambda data: seen.append(real(data)) or seen[-1])
    n, found = license_scan.scan_text(f"the license was lost {odd.prose(3, 200)} {license_scan.TEMPLATES[0][1]}\n{odd.prose(4, 200)} gnu")
    assert n >= 1 and len(found) == 1 and len(seen) == n + 1
    assert all(len(each) == len(license_scan.TEMPLATES) for _, each in seen)


# --- samples, blocks and names ------------------------------------------------------------


def test_the_fit_does_not_depend_on_partitions_or_order(spark):
    docs = spark.createDataFrame([(i, odd.prose(i, 20) + ("\n### $$$" * (i % 3))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int")
    made = []
    for parts, most in ((1, 40), (50, 40)):
        some = docs.repartition(parts).orderBy(F.col("doc_id") % 7) if parts == 1 else docs.repartition(parts)
        made.append(line_crf.train(some, labels.repartition(parts), "doc_id", "text", "quality", most))
    assert all((a == b).all() for a, b in zip(*made, strict=True))
    whole = line_crf.train(docs, labels, "doc_id", "text", "quality")
    assert not (whole[0] == made[0][0]).all()  # the bound did bind
    none = line_crf.train(docs, labels, "doc_id", "text", "quality", 0)
    assert not none[0].any()


def test_keys_of_any_name(spark):
    """Dots, and names that the operators use themselves."""
    for key, text in (("a.b", "_text"), ("keys", "text"), ("_text", "b.c"), ("key", "hash")):
        docs = spark.createDataFrame([(1, "Licensed under CC BY 4.0.\n" + odd.prose(3, 40)), (2, None)], f"`{key}` long, `{text}` string")
        labels = spark.createDataFrame([(1, 1), (2, 0)], f"`{key}` long, `label.x` int")
        weights, ties = line_crf.train(docs, labels, key, text, "label.x")
        scored = line_crf.score(docs, [key], text, weights, ties)
        assert scored.columns == [key, "score"] and scored.count() == 2
        found = phrase_index.contamination(docs, key, text, docs, key, text)
        assert sorted((r[0], r.n_words == r.n_hit) for r in found.collect()) == [(1, True), (2, True)]
        assert [len(r.found) for r in license_scan.scan(docs, key, text).orderBy("n_candidates").collect()] == [0, 1]
