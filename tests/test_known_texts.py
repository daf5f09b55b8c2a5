"""Texts scanned once, batches written once, examples scored as they are written."""

import json

from pyspark.sql import functions as F

from tests import brute
from tests.test_scan import CARD, EDGES, GH
from tracesift.operators.known_texts import read_store, scan_known, store_part
from tracesift.operators.rules import builtin_rules
from tracesift.operators.scan import scan_column, select_rules
from tracesift.plans.evaluate import accuracy, write_scored
from tracesift.sources.readers import read_examples
from tracesift.streaming.batch_sink import read_lines, start_batches, write_batch


def test_known_texts_are_not_scanned_again(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = [*EDGES.values(), None]
    df = spark.createDataFrame(list(enumerate(texts)) * 3 + [(None, GH)], "`a.id` BIGINT, text STRING")
    want = sorted((i, *f) for i, t in list(enumerate(texts)) * 3 for f in brute.scan(t or ""))
    distinct = len({t for t in texts if t is not None})

    def rows(found):
        return sorted(tuple(r) for r in found.collect() if r[0] is not None)

    half = scan_known(df.where("`a.id` % 2 = 0"), ["a.id"], "text", store)
    assert (half.new, half.known) == (len({t for t in texts[::2] if t is not None}), 0)
    whole = scan_known(df, ["a.id"], "text", store)
    assert whole.new + whole.known == distinct and whole.known == half.new
    assert rows(whole.findings) == want
    again = scan_known(df, ["a.id"], "text", store)
    assert (again.new, again.known) == (0, distinct) and rows(again.findings) == want
    assert [r.kind for r in again.findings.where("`a.id` IS NULL").collect()] == ["github-pat"]
    # other rules know nothing yet
    cards = scan_known(df, ["a.id"], "text", store, select_rules(["credit_card"]))
    assert cards.new == distinct and {r.kind for r in cards.findings.collect()} == {"credit_card"}
    assert read_store(spark, store_part(store, builtin_rules())).count() == distinct
    assert scan_known(df.limit(0), ["a.id"], "text", store)[1:] == (0, 0)


def test_a_text_stored_twice_counts_once(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, GH), (2, "clean")], "id INT, text STRING")
    scan_known(df, ["id"], "text", store)
    part = store_part(store, builtin_rules())
    spark.read.parquet(part).write.mode("append").parquet(part + "-copy")
    spark.read.parquet(part + "-copy").write.mode("append").parquet(part)
    assert scan_known(df, ["id"], "text", store).findings.count() == 1


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id INT, text STRING"
    for i in range(3):
        spark.createDataFrame([(i, f"é call n{i}@mail.io or {CARD}")], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_batches(scan_column(stream, ["id"], "text"), out, availableNow=True).awaitTermination()

    def state():
        lines = sorted(json.dumps(json.loads(r.value)) for r in read_lines(spark, out).collect())
        return lines, sorted(tuple(r) for r in spark.read.parquet(f"{out}/table").drop("batch").collect())

    run()
    lines, rows = state()
    assert len(lines) == len(rows) == 6 and rows[0] == (0, "credit_card", CARD, 22, 38)
    assert list(json.loads(lines[0])) == ["kind", "value", "start", "end"]
    run()  # nothing new
    write_batch(scan_column(spark.read.parquet(source).where("id = 1"), ["id"], "text"), 7, out)
    write_batch(scan_column(spark.read.parquet(source).where("id = 1"), ["id"], "text"), 7, out)
    again = state()
    assert len(again[0]) == len(again[1]) == 8


def test_scored_as_written(spark, tmp_path):
    label = "array<struct<kind:string,value:string>>"
    rows = [(f"a {GH}", [("github-pat", GH)]), ("none", []), ("x@y.org", []), (CARD, [("credit_card", CARD), ("credit_card", CARD)])]
    examples = spark.createDataFrame(rows, f"text STRING, expected {label}")
    assert [tuple(r) for r in write_scored(examples, str(tmp_path / "a")).collect()] == [(3, 4, 75.0)]
    back = read_examples(spark, str(tmp_path / "a"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, examples.collect()))
    assert [tuple(r) for r in accuracy(back).collect()] == [(3, 4, 75.0)]
    assert [tuple(r) for r in write_scored(examples.where(F.lit(False)), str(tmp_path / "b")).collect()] == [(0, 0, 0.0)]
