"""The registered queries without SQL, and the pipeline, against brute force over the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_point
import corpus_pipeline
from tests.llm import odd
from tracesift.llm import byte_bpe, license_scan, similar_texts, suffix_dedup
from tracesift.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_one_query_for_each_operator():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_point.queries()


def test_simhash(spark, sf_dir):
    rows = texts(spark, sf_dir)
    prints = [odd.fingerprint(t) for _, t in rows]
    roots = odd.components(prints)
    least: dict = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(i, least.get(root, i))
    want = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, QUERIES["op3_simhash"](spark, sf_dir).collect())) == want


def test_quality_on_documents_kept_from_the_fit(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_line_crf"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in kept if q], [s for s, q in kept if not q]
    order = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert order > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_rules_on_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op7_decision_list"](spark, folder).collect()}
    for i, text in texts(spark, folder):
        n, chars, symbols, lines, repeats = odd.base_statistics(text)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(rows[i].kept, q) for i, q in labels.items() if i in rows and not rows[i].base_failed and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([k for k, q in judged if q]) > 0.97 and np.mean([not k for k, q in judged if not q] or [1]) > 0.7


def test_tokens(spark, sf_dir, library):
    want = Counter()
    for i, text in texts(spark, sf_dir):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, QUERIES["op8_byte_bpe"](spark, sf_dir).collect())) == want


def test_repeats(spark, sf_dir):
    rows = texts(spark, sf_dir)
    want = Counter()
    for (i, text), flags in zip(rows, odd.removed(rows), strict=True):
        data = (text or "").encode()
        left = bytes(b for b, f in zip(data, flags, strict=True) if not f)
        want[i, len(data), sum(flags), len(odd.spans(flags)), hashlib.sha256(left).hexdigest()] += 1
    assert Counter(map(tuple, QUERIES["op9_suffix_dedup"](spark, sf_dir).collect())) == want


def test_licenses(spark):
    """Every line is compared with every template word by word; none is missed for its size when compressed."""
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, folder).collect()}
    hits = 0
    for i, text in texts(spark, folder):
        found = set()
        for line in (text or "").split("\n"):
            words = license_scan.words_of(line)
            match = [(sum(d), -len(t), n) for n, t, _ in license_scan.compressors() if (d := license_scan.differences(t, words))]
            found |= {min(match)[2]} if match else set()
        assert rows[i].licenses == ",".join(sorted(found))
        hits += len(found)
    assert hits > 10


def check_stages(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name == "byte_level_bpe":
            want = Counter()
            for i, text in before:
                ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
                want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
            assert Counter(tuple(r) for r in made.drop("ids").collect()) == want
            break
        assert made.columns == docs.columns
        rows = made.collect()
        after = [(r.doc_id, r.text) for r in rows]
        if name == "quality_classifier":
            assert not Counter(after) - Counter(before)
        elif name == "simhash_near_dedup":
            roots = odd.similar_components([t for _, t in before])
            groups: dict = {}
            for row, root in zip(before, roots, strict=True):
                groups.setdefault(root, []).append(row)
            assert len(after) == len(groups)
            least = Counter(min((i for i, _ in own if i is not None), default=None) for own in groups.values())
            assert Counter(i for i, _ in after) == least and not Counter(after) - Counter(before)
        elif name == "suffix_array_dedup":
            want = Counter()
            for (i, text), flags in zip(before, odd.removed(before), strict=True):
                data = (text or "").encode()
                cut = suffix_dedup.whole_characters(data, odd.spans(flags))
                want[i, suffix_dedup.without(data, cut).decode()] += 1
            assert Counter(after) == want
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            clean = [(i, t) for i, t in before if (c := odd.contamination(t, items))[1] == 0 or 20 * c[1] < c[0]]
            assert Counter(after) == Counter(clean)
        kept.append(len(after))
        docs = spark.createDataFrame(rows, docs.schema)
        before = after
    return kept


def test_pipeline_stage_by_stage(spark, sf_dir, library):
    kept = check_stages(spark, sf_dir, library)
    assert kept[0] < 200 and kept[1] < kept[0] and kept[3] < kept[2]
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.count() == kept[-1]


def test_pipeline_on_odd_rows(spark, tmp_path, library):
    """Nulls, empty and long texts, repeated rows and clashing columns, with and without labels and test items."""
    odd.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (10, 1, 0), (12, 0, 0), (13, 0, 0), (None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = spark.createDataFrame([(1, odd.prose(3, 40)), (None, "zz"), (3, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    check_stages(spark, str(tmp_path), library)


def test_pipeline_on_empty_tables(spark, tmp_path):
    odd.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def readable(template, words):
    """Whether a text's words hold the template, by a plain search over places and words left out."""
    telling = lambda w: w[0].isdigit() or w in license_scan._TELLING
    limit = int(0.1 * len(template))
    ends = set()
    # all states (words of the template done, place behind the last word read, words missing)
    states = {(i, p + 1, i) for i in range(limit + 1) for p, w in enumerate(words) if w == template[i] and not any(map(telling, template[:i]))}
    states = {(i + 1, p, missing) for i, p, missing in states}
    seen = set(states)
    while states:
        after = set()
        for i, p, missing in states:
            if i == len(template):
                ends.add(p)
                continue
            if missing < limit and not telling(template[i]):
                after.add((i + 1, p, missing + 1))
            for q in range(p, len(words)):
                if words[q] == template[i]:
                    after.add((i + 1, q + 1, missing))
                if telling(words[q]):
                    break
        states = after - seen
        seen |= states
    return ends


def test_licenses_against_a_plain_search(spark):
    """Licenses found in whole documents are those that a search without anchors, blocks or compression can read."""
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, folder).collect()}
    templates = [(n, re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())) for n, t in license_scan.TEMPLATES]
    hits = 0
    for i, text in texts(spark, folder):
        words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", (text or "").lower())
        bag = set(words)
        names = set()
        for name, template in templates:
            if sum(w not in bag for w in template) <= 0.1 * len(template) and readable(template, words):
                names.add(name)
        assert set(filter(None, rows[i].licenses.split(","))) == names, i
        hits += len(names)
    assert hits > 10


def test_similar_texts_of_a_larger_table(spark):
    """Against the similarity of all pairs that share a shingle: nothing is joined that isn't alike, and of the pairs of different
    texts at least nine in ten are together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, odd.shingle_set(r.text)) for r in docs.collect()]
    holders: dict = {}
    for i, (_, own) in enumerate(rows):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    pairs = {(a, b) for held in holders.values() for k, b in enumerate(held) for a in held[:k]}
    alike = [(a, b) for a, b in pairs if 5 * len(rows[a][1] & rows[b][1]) >= 4 * len(rows[a][1] | rows[b][1])]
    sketched = similar_texts.sketches(docs, "doc_id", "text", 5, 42)
    roots = similar_texts.classed(sketched, docs.columns.index("text"), 5, 42, 4, 0.8)
    of = {r.id: r.root for r in sketched.select("id", "class").join(roots, "class").collect()}
    found = [(a, b) for a, b in alike if of[rows[a][0]] == of[rows[b][0]]]
    different = [(a, b) for a, b in alike if rows[a][1] != rows[b][1]]
    assert len(different) >= 10 and len(set(found) & set(different)) >= 0.9 * len(different)
    assert len(found) - len(set(found) & set(different)) == len(alike) - len(different)
    # groups are those of the links alone
    assert len(set(of.values())) >= len(set(odd.similar_components([r.text for r in docs.collect()])))
