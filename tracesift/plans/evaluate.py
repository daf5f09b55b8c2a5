"""Score the detector on labelled examples."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracesift.operators.rules import Rule
from tracesift.operators.scan import with_findings
from tracesift.sources.writers import write_examples


def label_set(labels: Column) -> Column:
    """Distinct ``(kind, value)`` pairs in a fixed order; offsets are ignored."""
    pairs = F.transform(labels, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    return F.sort_array(F.array_distinct(pairs))


def compare(examples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Each example with ``want``, ``got`` and ``ok``, whether the two sets are equal."""
    found = with_findings(examples, "text", rules, "_found")
    sets = found.withColumns({"want": label_set(F.col("expected")), "got": label_set(F.col("_found"))})
    return sets.drop("_found").withColumn("ok", F.col("want") == F.col("got"))


def mismatches(examples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The examples whose findings are not exactly the expected ones."""
    return compare(examples, rules).filter(~F.col("ok")).drop("ok", "expected")


def accuracy(examples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row: ``ok``, ``total`` and ``accuracy_pct`` to two places (0 if empty)."""
    return _with_percent(compare(examples, rules).agg(F.count_if("ok").alias("ok"), F.count("*").alias("total")))


def require_exact(examples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The accuracy row, or a failed job if any example differs, whatever is read of the row."""
    message = F.format_string("%d of %d examples match", F.col("ok"), F.col("total"))
    exact = F.when(F.col("ok") == F.col("total"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return accuracy(examples, rules).where(exact)


def require_found(examples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The accuracy row, or a failed job if an expected value of any example is not found, whatever is read of the row.

    What is found besides counts against the accuracy only: among very many made lines some hold a valid value by chance,
    as a UUID of which sixteen digits in a row pass for a card number.
    """
    scored = compare(examples, rules).withColumn("missed", F.size(F.array_except("want", "got")) > 0)
    counts = scored.agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"), F.count_if("missed").alias("missed"))
    message = F.format_string("expected values of %d in %d examples are not found", F.col("missed"), F.col("total"))
    found = F.when(F.col("missed") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return _with_percent(counts.where(found).drop("missed"))


def _with_percent(counts: DataFrame) -> DataFrame:
    percent = F.round(F.lit(100.0) * F.col("ok") / F.greatest("total", F.lit(1)), 2)
    return counts.withColumn("accuracy_pct", percent)


def write_scored(examples: DataFrame, path: str, rules: list[Rule] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write the examples as JSON lines and score the detector on them in the same pass: the row that ``accuracy`` gives.

    The counts are metrics of the write itself, so the examples are made and scanned once and never read back.
    """
    counts = Observation()
    observed = compare(examples, rules).observe(counts, F.count_if("ok").alias("ok"), F.count("*").alias("total"))
    # a generator keeps the comparison in the plan, of which the file needs nothing
    kept = observed.select("*", F.explode(F.array(F.col("ok"))).alias("_scored")).where(F.col("_scored").isNotNull())
    write_examples(kept, path, mode)
    ok, total = counts.get["ok"], counts.get["total"]
    return examples.sparkSession.createDataFrame([(ok, total, round(100.0 * ok / max(total, 1), 2))], "ok BIGINT, total BIGINT, accuracy_pct DOUBLE")
