from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import brute
from tracesift.plans.corpus import generate, labelled_examples
from tracesift.plans.evaluate import accuracy, compare, mismatches, require_exact, require_found
from tracesift.sources.readers import read_examples, read_text_lines, read_whole_texts
from tracesift.sources.writers import write_examples, write_findings, write_findings_json
from tracesift.operators.scan import scan_column, select_rules
from tracesift.plans.queries import QUERIES


def test_mix_and_labels(spark):
    rows = generate(spark, 1000).orderBy("id").collect()
    kinds = Counter(r.expected[0].kind if r.expected else None for r in rows)
    assert [kinds[k] for k in ("iban", "phone", "email", "credit_card", None)] == [100, 100, 100, 100, 300]
    assert len(kinds) > 60
    assert all(r.expected[0].value in r.text for r in rows if r.expected)
    assert all(brute.iban(r.expected[0].value) for r in rows[::10]) and all(brute.luhn(r.expected[0].value) for r in rows[3::10])


def test_same_rows_however_partitioned(spark):
    ids = spark.range(300)
    a = labelled_examples(ids.repartition(7), "id", 5).orderBy("id").collect()
    assert a == labelled_examples(ids.coalesce(1), "id", 5).orderBy("id").collect()
    other = labelled_examples(ids, "id", 4).orderBy("id").collect()
    assert sum(x.text != y.text for x, y in zip(a, other)) > 200


def test_accuracy_is_full_and_equals_definition(spark):
    examples = generate(spark, 1000, 42)
    row = accuracy(examples).first()
    assert (row.ok, row.total, row.accuracy_pct) == (1000, 1000, 100.0)
    assert mismatches(examples).count() == 0
    for r in examples.limit(300).collect():
        assert {f[:2] for f in brute.scan(r.text)} == {(e.kind, e.value) for e in r.expected}


def test_scoring(spark):
    none = F.array().cast("array<struct<kind:string,value:string>>")
    examples = generate(spark, 90).withColumn("expected", F.when(F.col("id") < 30, none).otherwise(F.col("expected")))
    row = accuracy(examples).first()
    assert (row.ok, row.total, row.accuracy_pct) == (69, 90, 76.67)
    wrong = mismatches(examples).collect()
    assert len(wrong) == 21 and all(r.want == [] and r.got for r in wrong)
    with pytest.raises(Exception, match="69 of 90 examples match"):
        require_exact(examples).collect()
    with pytest.raises(Exception, match="examples match"):
        require_exact(examples).count()
    with pytest.raises(Exception, match="examples match"):
        require_exact(examples).select("accuracy_pct").collect()
    assert require_exact(generate(spark, 40)).first().ok == 40
    assert accuracy(examples.filter("id < 0")).first().accuracy_pct == 0.0
    twice = generate(spark, 1).withColumn("expected", F.concat("expected", "expected"))
    assert compare(twice).first().ok


def test_lines_that_hold_a_value_by_chance(spark, tmp_path):
    spark.range(88640, 88660).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    row = QUERIES["eval_exact"](spark, str(tmp_path)).first()
    assert tuple(row) == (19, 20, 95.0)  # as the SQL counts them
    with pytest.raises(Exception, match="20 in 40 examples are not found"):
        require_found(generate(spark, 40), select_rules(["iban", "phone", "email"])[:2]).count()
    assert require_found(generate(spark, 0)).first().accuracy_pct == 0.0


def test_examples_as_files(spark, tmp_path):
    path = str(tmp_path / "examples")
    examples = generate(spark, 200)
    write_examples(examples, path)
    assert read_examples(spark, path).exceptAll(examples.drop("id")).count() == 0
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"text":"a","expected":[]}\n\n   \n{"text":"b","expected":[{"kind":"k","value":"v"}]}\n')
    assert [r.text for r in read_examples(spark, str(lines)).collect()] == ["a", "b"]
    lines.write_text('{"text":"a","expected":[]}\n{"text":')
    with pytest.raises(Exception):
        read_examples(spark, str(lines)).collect()
    lines.write_text('{"text":"a"}\n')
    with pytest.raises(Exception, match="example without expected"):
        read_examples(spark, str(lines)).collect()
    for label in ('{"kind":"k"}', '{"value":"v"}', "{}"):
        lines.write_text('{"text":"a","expected":[]}\n{"text":"a","expected":[' + label + "]}\n")
        with pytest.raises(Exception, match="label without kind or value in .*lines.jsonl"):
            read_examples(spark, str(lines)).collect()


def test_text_files(spark, tmp_path):
    text = "é a@b.com\n\n4111111111111111\nx"
    (tmp_path / "one.txt").write_text(text)
    whole = scan_column(read_whole_texts(spark, str(tmp_path)), ["file"], "text").drop("file")
    assert sorted(map(tuple, whole.collect())) == sorted(brute.scan(text))
    by_line = scan_column(read_text_lines(spark, str(tmp_path)), ["file"], "text")
    assert {(r.kind, r.value) for r in by_line.collect()} == {f[:2] for f in brute.scan(text)}
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe")
    with pytest.raises(Exception, match="INVALID_UTF8"):
        read_text_lines(spark, str(tmp_path)).collect()


def test_findings_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "é" a@b.com')], "id INT, text STRING")
    found = scan_column(df, ["id"], "text")
    write_findings_json(found, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"kind":"email","value":"a@b.com","start":9,"end":16}'
    write_findings(found, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).collect() == found.collect()
