"""Near duplicates among many texts that are nearly near duplicates."""

import os
import random
import shutil

import numpy as np
import pytest

from tests.llm import odd
from tracesift.llm import common, similar_texts
from tracesift.llm.common import written


def test_no_pair_is_lost_among_texts_that_are_nearly_alike(spark):
    """Texts of different groups have a similarity of 0.75, the two of a group one of 0.82."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))

    def tail(name, n):
        return " ".join(f"{name}.{i}" for i in range(n))

    rows = [(2 * g + v, f"{base} {tail(f'g{g}', 10)} {tail(f'v{g}.{v}', 22)}") for g in range(60) for v in (0, 1)]
    roots = odd.similar_components([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(8)
    kept = similar_texts.one_of_each(docs, "doc_id", "text")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots)) == list(range(0, 120, 2))


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",").count("shuffle_")


def test_neither_shuffle_files_nor_tables_in_between_stay(spark):
    rows = [(i, f"{' '.join(f'w{i % 40}.{k}' for k in range(60))} {i % 3}") for i in range(200)]
    docs = written(spark.createDataFrame(rows, "doc_id LONG, text STRING"), "some-texts")
    folder = spark.conf.get("spark.checkpoint.dir")
    tables, files = set(os.listdir(folder)), shuffle_files(spark)
    kept = similar_texts.one_of_each(docs, "doc_id", "text")
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - tables} == {"chosen-rows"}
    assert shuffle_files(spark) <= files
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_tables_in_between_start_no_programs(spark):
    """Hadoop's local file system starts programs for each file that it makes, and leaves a checksum beside it."""
    rows = [(i, f"{' '.join(f'x{i % 40}.{k}' for k in range(60))} {i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    sketched = written(similar_texts.sketches(docs, "doc_id", "text", 5, 42), "some-sketches")
    folder, made = spark.conf.get("spark.checkpoint.dir"), []

    def kept(path):
        made.extend((name, file) for file in os.listdir(path) for name in [os.path.basename(path).rsplit("-", 1)[0]])

    before = set(os.listdir(folder))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "remove", kept)
        similar_texts.classed(sketched, docs.columns.index("text"), 5, 42, 4, 0.8).count()
    for path in set(os.listdir(folder)) - before:
        kept(os.path.join(folder, path))
    assert {"classes", "shared-shingles", "candidate-pairs", "shingle-sets", "links", "pointers", "roots-of-classes"} <= {name for name, _ in made}
    assert not [file for _, file in made if file.endswith(".crc")]


def test_a_table_has_each_row_once_though_a_task_ran_twice(spark):
    rows = spark.range(100, numPartitions=4).selectExpr("id", "IF(id % 9 = 0, NULL, CAST(id AS STRING)) AS t", "ARRAY(id, NULL) AS a", "CAST(CONCAT('b', id) AS BINARY) AS b", "STRUCT(id > 5 AS c, ARRAY(id) AS d) AS s")
    table = common.tabled(rows, "some-table")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    files = sorted(os.listdir(folder))
    shutil.copy(os.path.join(folder, files[0]), os.path.join(folder, "_" + files[0].removeprefix("part-").removesuffix(".parquet")))  # of an attempt that doesn't count
    again = spark.read.schema(rows.schema).parquet(folder)
    assert len(files) == 4 and table.dtypes == rows.dtypes
    assert sorted(map(str, table.collect())) == sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    none = common.tabled(rows.where("id < 0"), "no-rows")
    assert none.isEmpty() and none.dtypes == rows.dtypes


def test_equal_rows_leave_one(spark):
    rows = [(None, "a b"), (None, "a b"), (None, None), (0, ""), (0, ""), (7, "a b c d e f"), (7, "a b c d e f"), (7, "A b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    kept = [tuple(r) for r in similar_texts.one_of_each(docs, "doc_id", "text").collect()]
    assert len(kept) == 3 and (None, "a b") in kept and (0, "") in kept and {i for i, _ in kept} == {None, 0, 7}


def test_no_wanted_row_is_left_out_before_a_join(spark):
    rows = spark.range(50_000).selectExpr("concat('t', id) AS digest", "id")
    wanted = rows.where("id % 7 = 0").select("digest")
    found = {r.id for r in similar_texts.likely(rows, "digest", wanted).collect()}
    needed = set(range(0, 50_000, 7))
    assert found >= needed and len(found - needed) < 0.1 * (50_000 - len(needed))
    assert similar_texts.likely(rows, "digest", wanted.where("false")).count() == 0


def test_pairs_of_a_group_that_is_not_alike_are_not_handed_on(spark):
    """A family of 150 texts: those of one pair have a similarity of 0.82, all others one of 0.75, and all share most of what they begin with."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(2 * g + v, " ".join([*base, *(f"g{g}.{i}" for i in range(10)), *(f"v{g}.{v}.{i}" for i in range(22))])) for g in range(75) for v in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = written(similar_texts._classes(similar_texts.sketches(docs, "doc_id", "text", 5, 42), 1), "some-classes")
    shared = written(similar_texts.shared_shingles(found), "some-shared")
    none = spark.createDataFrame([], "node binary, root binary")
    pairs = similar_texts.remaining_pairs(found.drop("first"), shared, none, 0.8)
    name = {similar_texts.class_of(similar_texts.shingles(t, 5, 42)): i for i, t in rows}
    got = {frozenset((name[bytes(r.a)], name[bytes(r.b)])) for r in pairs.collect()}
    assert {frozenset((2 * g, 2 * g + 1)) for g in range(75)} <= got
    assert len(got) < 10 * len(rows)  # of 11,175 pairs


def found_and_shared(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = written(similar_texts._classes(similar_texts.sketches(docs, "doc_id", "text", 5, 42), 1), "some-classes")
    name = {similar_texts.class_of(similar_texts.shingles(t, 5, 42)): i for i, t in rows}
    return found, written(similar_texts.shared_shingles(found), "some-shared"), lambda pairs: {frozenset((name[bytes(r.a)], name[bytes(r.b)])) for r in pairs.collect()}


@pytest.mark.parametrize("part", [40, 2000])
def test_pairs_of_long_texts_that_are_not_alike_are_not_handed_on(spark, part, monkeypatch):
    """Twelve texts of 3,000 words have a passage in common; each has one other of a similarity of 0.82."""
    monkeypatch.setattr(similar_texts, "SAMPLE", 0)  # the passage comes as early as any
    rng = random.Random(7)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(part)], []
    for g in range(6):
        own = [f"g{g}.{i}" for i in range(3000 - part)]
        rows += [(2 * g + v, " ".join([*base, *own, *(f"v{g}.{v}.{i}" for i in range(320))])) for v in (0, 1)]
    found, shared, named = found_and_shared(spark, rows)
    none = spark.createDataFrame([], "node binary, root binary")
    assert named(similar_texts.remaining_pairs(found.drop("first"), shared, none, 0.8)) == {frozenset((2 * g, 2 * g + 1)) for g in range(6)}


def test_copies_that_are_less_alike_than_each_is_to_the_original_meet_it_first(spark):
    """Each of 150 copies has 0.84 with the original, 0.7 with most of the others."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(words))]
    for copy in range(1, 151):
        other = list(words)
        for k in range(5):
            other[60 * k + rng.randrange(5, 55)] = f"c{copy}.{k}"
        rows.append((copy, " ".join(other)))
    found, shared, named = found_and_shared(spark, rows)
    classes = found.select("class", "fp", "n", "marks", "wide", "digest")
    assert named(similar_texts.candidate_pairs(classes, shared, 4)) >= {frozenset((0, copy)) for copy in range(1, 151)}


def test_wide_marks_count_no_more_than_the_difference():
    rng = np.random.default_rng(9)
    for n, m, both in [(5000, 4300, 4000), (1100, 1000, 900), (2048, 2047, 2000), (4000, 4000, 10), (513, 640, 500)]:
        u = rng.permutation(np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64)))
        x, y = np.sort(u[:n]), np.sort(np.concatenate([u[:both], u[n : n + m - both]]))
        apart = similar_texts.differing(similar_texts.wide_marks(x), similar_texts.wide_marks(y))
        assert 0.3 * (n + m - 2 * both) < apart <= n + m - 2 * both
    assert similar_texts.wide_marks(u[:512]) is None
