"""Scan a stream: the same projection, stateless, in append mode."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracesift.operators.rules import Rule
from tracesift.operators.scan import scan_column


def start_scan(
    stream: DataFrame,
    keys: list[str],
    text: str,
    output: str,
    checkpoint: str | None = None,
    rules: list[Rule] | None = None,
    **trigger,
) -> StreamingQuery:
    """Write the findings of a streaming DataFrame to Parquet.

    The file sink and the checkpoint together give each input row's findings
    exactly once, also after a restart: the checkpoint belongs to the output and
    is beside it (``output`` with ``-checkpoint`` added) unless another place is
    named, which must then be the same at every start.  ``trigger`` is passed on,
    for example ``availableNow=True``.
    """
    return start_append(scan_column(stream, keys, text, rules), output, checkpoint, **trigger)


def start_append(found: DataFrame, output: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Append a stream of findings to Parquet files, each once, also after a restart from the checkpoint."""
    writer = (
        found.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint or output.rstrip("/") + "-checkpoint")
    )
    return (writer.trigger(**trigger) if trigger else writer).start()
