"""Scan every distinct text once, over rows and over runs.

A store holds the findings of each text that was ever scanned, under the SHA-256 of the text; clean texts are in it too, with
none.  New input is brought down to its distinct texts, those in the store are left out by an anti join of digests, and only
the rest is scanned and added.  Then every row gets the findings of its digest.  Texts are shuffled once at most, and
copies of one text come together before that, in the tasks that read them; the rows that are joined carry keys and
digests only, with one stored row for each digest, so Spark may split those of a frequent text over tasks.

The store belongs to the rules: other rules use another part of it.  A run that fails adds nothing, as the new part is
written in one commit; two runs that add the same text at the same time leave it twice, and it still counts once.
"""

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.operators.rules import Rule, builtin_rules
from tracesift.operators.scan import FIELDS, FINDINGS, with_findings
from tracesift.sources.scratch import file_system, shared_path

STORE = f"digest BINARY, findings {FINDINGS}"


class Scanned(NamedTuple):
    """``keys`` and the findings of all rows; and how many texts were scanned for them, and how many were known."""

    findings: DataFrame
    new: int
    known: int


def store_part(store: str, rules: list[Rule]) -> str:
    """Where the texts scanned by these rules are."""
    told = repr([(r.ord, r.kind, r.regex, r.validator, r.any_digit) for r in rules])
    return f"{store.rstrip('/')}/rules={hashlib.sha256(told.encode()).hexdigest()[:16]}"


def read_store(spark: SparkSession, part: str) -> DataFrame:
    """One row for each digest in the store."""
    from pyarrow import fs

    system, place = file_system(part)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).parquet(part).groupBy("digest").agg(F.first("findings").alias("findings"))


def scan_known(df: DataFrame, keys: list[str], text: str, store: str, rules: list[Rule] | None = None) -> Scanned:
    """The findings of every row, as ``scan_column`` gives them; texts that the store knows are not scanned again.

    A null text has no findings and is not stored.
    """
    spark = df.sparkSession
    rules = builtin_rules() if rules is None else rules
    part = store_part(store, rules)
    names = [f"_k{i}" for i in range(len(keys))]
    body = _column(df, text)
    rows = df.where(body.isNotNull()).select(*(_column(df, k).alias(n) for k, n in zip(keys, names, strict=True)), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("text"))
    distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
    new = distinct.join(read_store(spark, part).select("digest"), "digest", "left_anti")
    fresh = shared_path(spark, "new-texts")
    with_findings(new, "text", rules).select("digest", "findings").write.parquet(fresh)
    added = spark.read.schema(STORE).parquet(fresh)
    n_new = added.count()
    if n_new:
        added.write.mode("append").parquet(part)
    stored = read_store(spark, part)
    n_known = rows.select("digest").distinct().count() - n_new
    found = rows.select(*names, "digest").join(stored.where(F.size("findings") > 0), "digest")
    flat = found.select(*names, F.inline("findings"))
    return Scanned(flat.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *FIELDS), n_new, n_known)


def _column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
