"""Scan a text column: text in, flat findings out, no shuffle."""

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions.folds import compute_once
from tracesift.operators import gates
from tracesift.operators.extract import HITS, candidates, hits
from tracesift.operators.resolve import resolve
from tracesift.operators.rule_table import rules_of
from tracesift.operators.rules import Rule, builtin_rules

FINDINGS = "array<struct<kind:string,value:string,start:bigint,end:bigint>>"
FIELDS = ("kind", "value", "start", "end")


def select_rules(kinds: list[str] | None = None) -> list[Rule]:
    """The built-in rules, or those of the given kinds."""
    rules = builtin_rules()
    if kinds is None:
        return rules
    unknown = set(kinds) - {r.kind for r in rules}
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return [r for r in rules if r.kind in kinds]


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out to as many partitions, for a caller who knows that the table has too few splits.

    Matching is bound by CPU, and a small Parquet file is a single task.  Without a number nothing is
    shuffled, whatever the size of the table.
    """
    return df.repartition(partitions) if partitions and not df.isStreaming else df


def column(df: DataFrame, name: str) -> Column:
    """A column by its name, also one with dots in it; a name that is none of them may be a path."""
    return F.col("`" + name.replace("`", "``") + "`") if name in df.columns else F.col(name)


def _keyed(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """The kept columns under names of ours, which meet no name of the features, and the text."""
    names = [f"_k{i}" for i in range(len(keep))]
    kept = [column(df, c).alias(n) for c, n in zip(keep, names, strict=True)]
    return df.select(*kept, column(df, text).alias(gates.TEXT)), names


def _named(names: list[str], keep: list[str]) -> list[Column]:
    return [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]


def _prepared(df: DataFrame, text: str, keep: list[str], rules: list[Rule]) -> tuple[DataFrame, list[str]]:
    keyed, names = _keyed(df, keep, text)
    features = gates.with_features(keyed)
    return features.select(*names, gates.TEXT, gates.OTHER, hits(rules).alias("_hits")), names


@lru_cache(maxsize=2)
def _findings(session: SparkSession) -> Column:
    """The findings of a prepared row; the same expression for every scan, so it
    is put together once per session."""
    return resolve(candidates(F.col(gates.TEXT), F.col(gates.OTHER), F.col("_hits")))


def with_findings(df: DataFrame, text: str, rules: list[Rule] | None = None, name: str = "findings") -> DataFrame:
    """The input plus one array column; a clean or null text gets an empty array.

    A column of that name in the input is replaced.
    """
    keep = [c for c in df.columns if c != name]
    prepared, names = _prepared(df, text, keep, builtin_rules() if rules is None else rules)
    found = compute_once(prepared, names, {"_findings": F.coalesce(_findings(df.sparkSession), F.array().cast(FINDINGS))})
    return found.select(*_named(names, keep), F.col("_findings").alias(name))


def scan_column(
    df: DataFrame,
    keys: list[str],
    text: str,
    rules: list[Rule] | DataFrame | None = None,
    keep_clean: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """One row per finding: ``keys``, ``kind``, ``value``, ``start``, ``end``.

    Offsets are UTF-8 byte offsets, end-exclusive.  With ``keep_clean`` a text
    without findings gives one row with null finding columns.  ``rules`` is a
    list, which is unrolled into the plan (empty: nothing is found), or a rule
    table of any length, as for ``scan_with_rule_table``.
    """
    if taken := set(keys) & set(FIELDS):
        raise ValueError(f"keys named like the columns of a finding: {sorted(taken)}")
    if isinstance(rules, DataFrame):
        return scan_with_rule_table(spread(df, partitions), keys, text, rules, keep_clean)
    prepared, names = _prepared(spread(df, partitions), text, keys, builtin_rules() if rules is None else rules)
    explode = F.inline_outer if keep_clean else F.inline
    return prepared.select(*names, explode(_findings(df.sparkSession))).select(*_named(names, keys), *FIELDS)


def scan_with_rule_table(df: DataFrame, keys: list[str], text: str, table: DataFrame, keep_clean: bool = False) -> DataFrame:
    """Scan with token rules that are only known when the query runs, however many they are.

    ``table`` has ``ord, id, pattern, anchors, validator``.  Each text is searched once for the anchors of all
    rules; the rules found are tried on it where it is.  A rule without anchors is tried on every text.  Nothing is
    shuffled or joined, and a streaming DataFrame may be scanned as well.
    """
    keyed, names = _keyed(df, keys, text)
    ruled = keyed.select(*names, gates.TEXT, rules_of(F.col(gates.TEXT), table).alias("_rules"))

    def hit(rule):
        regex = rule["regex"]
        own = F.struct(rule["ord"].alias("ord"), rule["kind"].alias("kind"), rule["validator"].alias("validator"), regex.alias("regex"), regex.alias("plain_regex"))
        return F.struct(own.alias("rule"), F.regexp_extract_all(gates.TEXT, regex, F.lit(0)).alias("matches"))

    hits_of_row = F.filter(F.transform("_rules", hit), lambda h: F.size(h["matches"]) > 0)
    prepared = ruled.select(*names, gates.TEXT, F.lit(False).alias(gates.OTHER), hits_of_row.cast(HITS).alias("_hits"))
    explode = F.inline_outer if keep_clean else F.inline
    return prepared.select(*names, explode(_findings(df.sparkSession))).select(*_named(names, keys), *FIELDS)


def scan_sources(
    sources: list[tuple[str, DataFrame, list[str], str]], rules: list[Rule] | None = None, partitions: int | None = None
) -> DataFrame:
    """Scan several tables: ``(source, df, keys, text)`` each.

    The keys of a table become one ``row_key`` string, parts joined by ``/``.
    """
    parts = []
    for source, df, keys, text in sources:
        row_key = F.concat_ws("/", *[column(df, k).cast("string") for k in keys])
        parts.append(df.select(F.lit(source).alias("source"), row_key.alias("row_key"), column(df, text).alias("text")))
    return scan_column(reduce(DataFrame.unionByName, parts), ["source", "row_key"], "text", rules, partitions=partitions)
