from tracesift.operators.scan import scan_column
from tracesift.plans.planted import plant_edges
from tracesift.streaming.scan_stream import start_scan


def test_stream_equals_batch_over_several_batches_and_a_restart(spark, sf_dir, tmp_path):
    docs = plant_edges(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")

    def run():
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        start_scan(stream, ["doc_id"], "text", out, state, availableNow=True).awaitTermination()

    first.repartition(3).write.parquet(source)
    run()
    second.repartition(2).write.mode("append").parquet(source)
    run()
    want = sorted(map(tuple, scan_column(docs, ["doc_id"], "text").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_a_restart_without_a_given_checkpoint_loses_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id BIGINT, text STRING"
    for number in (1, 2, 3):
        spark.createDataFrame([(number, f"call n{number}@mail.io")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_scan(stream, ["id"], "text", out, availableNow=True).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(1, number + 1))


def test_stream_of_a_folder_table_equals_the_batch_scan(spark, sf_dir, tmp_path):
    from tracesift.plans.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["scan_stream"](spark, str(tmp_path)).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["scan_documents"](spark, sf_dir).collect()))
