"""Findings and labelled-example sinks."""

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.sources.scratch import file_system


def finding_json() -> Column:
    """One finding as a JSON object: kind, value, start, end."""
    return F.to_json(F.struct("kind", "value", "start", "end"))


def findings_lines(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and one JSON line per finding."""
    return findings.select(*keys, finding_json().alias("line"))


def write_findings_json(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with exactly kind, value, start and end."""
    findings.select(finding_json().alias("value")).write.mode(mode).text(path)


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, with the row keys."""
    findings.write.mode(mode).parquet(path)


def write_examples(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with text and expected."""
    examples.select("text", "expected").write.mode(mode).json(path)


def write_blocks(rows: DataFrame, path: str) -> None:
    """Text files ``block=N/part.txt`` of rows ``block`` and ``text``, a line for each; a block's rows follow each other in one partition.

    Tasks write them through the file systems that Arrow knows.  Spark's writer sets the rights of each local file by programs
    that it starts, which takes most of the time when files are many.  A file gets its name when it is whole, so a task may run again.
    """
    system, place = file_system(path)
    system.create_dir(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(path)
        lines = ((b, t) for batch in batches for b, t in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True))
        files = 0
        for block, own in groupby(lines, lambda line: line[0]):
            folder = f"{place}/block={'__HIVE_DEFAULT_PARTITION__' if block is None else block}"
            system.create_dir(folder)
            with system.open_output_stream(made := f"{folder}/.part-{uuid.uuid4().hex}") as out:
                for _, text in own:
                    out.write((text or b"") + b"\n")
            system.move(made, f"{folder}/part.txt")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    rows.select("block", rows["text"].cast("binary").alias("text")).mapInArrow(run, "files long").groupBy().sum("files").collect()
