"""Findings of a stream as JSON lines and as a table, written together for each batch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracesift.sources.writers import finding_json


def write_batch(found: DataFrame, batch: int, output: str) -> None:
    """One batch of findings, under its number: ``output/lines`` (JSON) and ``output/table`` (Parquet, with the keys).

    A batch that comes again, as after a failure, replaces what it wrote before, so each finding is there once.
    """
    held = found.persist()
    try:
        held.select(finding_json().alias("value")).write.mode("overwrite").text(f"{output}/lines/batch={batch}")
        held.write.mode("overwrite").parquet(f"{output}/table/batch={batch}")
    finally:
        held.unpersist()


def start_batches(found: DataFrame, output: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream of findings batch by batch; the checkpoint is beside the output unless another place is named."""
    writer = found.writeStream.outputMode("append").foreachBatch(lambda df, batch: write_batch(df, batch, output.rstrip("/")))
    writer = writer.option("checkpointLocation", checkpoint or output.rstrip("/") + "-checkpoint")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_lines(spark, output: str) -> DataFrame:
    """All JSON lines written so far, with their batch."""
    return spark.read.text(f"{output}/lines").select("value", F.col("batch").cast("bigint").alias("batch"))
