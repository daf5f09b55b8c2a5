"""URL rules looked up by their rarest literal token.

A rule is a host and the start of a path (``example.net/en/``); it fits the host and all its subdomains.
``*`` in the path stands for any characters.  Every rule is filed under one of its literal tokens, the one
that the fewest URLs have: a label of the host or a whole part of the path between two slashes.  The tokens
of a URL fetch the rules filed under them, and only those run their regular expression.  The longest rule
that fits decides; of equally long ones ``block`` comes first, then the smaller rule.

Inputs: a null URL or one without ``://`` has an empty host and path and no rule fits it but one without
host and path; rules with null host or path count them as empty.  Repeated URLs are judged once, and every
row is kept, with null and repeated keys.  An empty table gives an empty table, an empty rule table lets
everything through.  Only the named key and URL columns are read.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm.common import written

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Verdict where no rule fits.
DEFAULT = "allow"
#: What rules without a literal token are filed under; every URL has it.
ANY = ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from a list of (action, host, path)."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("action", "host", "path"), strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def _marked(parts: Column, mark: str) -> Column:
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))


def url_tokens(host: Column, path: Column) -> Column:
    """Labels of the host and parts of the path, each once and marked by its kind."""
    return F.array_distinct(F.concat(_marked(F.split(host, r"\."), "."), _marked(F.split(path, "/"), "/")))


def rule_tokens(host: Column, path: Column) -> Column:
    """Tokens that every URL under a rule has: not those beside ``*`` nor the open end of the path."""
    parts = F.split(path, "/")
    whole = F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: ~F.contains(p, F.lit("*")))
    return F.array_distinct(F.concat(_marked(F.split(host, r"\."), "."), _marked(whole, "/")))


def rule_regex(host: Column, path: Column) -> Column:
    """The expression for host and path of a URL written one after the other."""
    def quoted(text: Column) -> Column:
        return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))

    before = F.when(host == "", F.lit(r"(?s)^[^/]*")).otherwise(F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), F.lit(r"(?=/|\z)")))
    return F.concat(before, F.replace(quoted(path), F.lit("*"), F.lit(r"\E.*\Q")))


def file_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules, each under the one of its tokens that is rarest in ``tokens`` (column ``token``)."""
    host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    made = rules.select(
        "action",
        F.concat(F.translate(host, _CAPITALS, _CAPITALS.lower()), path).alias("rule"),
        rule_regex(F.translate(host, _CAPITALS, _CAPITALS.lower()), path).alias("regex"),
        rule_tokens(F.translate(host, _CAPITALS, _CAPITALS.lower()), path).alias("tokens"),
    ).distinct()
    each = made.select("action", "rule", "regex", F.explode_outer("tokens").alias("token"))
    # written, as are the verdicts below, so that Spark may split what many URLs share over several tasks
    wanted = written(each.select("token").distinct(), "rule-tokens")
    known = tokens.join(wanted, "token", "left_semi").groupBy("token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token")).getField("token")
    filed = each.join(known, "token", "left").groupBy("action", "rule", "regex").agg(rarest.alias("token"))
    return filed.withColumn("token", F.coalesce("token", F.lit(ANY)))


def judge(pages: DataFrame, keys: list[str], url: str, rules: DataFrame) -> DataFrame:
    """``keys``, ``host``, ``path``, ``rule`` (the one that decides, or null) and ``verdict`` of every row."""
    host, path = host_and_path(F.col(url).cast("string"))
    parted = pages.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], host.alias("host"), path.alias("path"))
    places = parted.select("host", "path").distinct()
    tokens = places.select("host", "path", F.explode(F.concat(F.array(F.lit(ANY)), url_tokens(F.col("host"), F.col("path")))).alias("token"))
    filed = file_rules(rules, tokens)
    candidates = tokens.join(filed, "token")
    fitting = candidates.where(F.rlike(F.concat("host", "path"), F.col("regex")))
    order = F.struct(-F.length("rule"), F.col("action") != "block", F.col("rule"))
    decided = fitting.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("_chosen"))
    return parted.join(written(decided, "url-verdicts"), ["host", "path"], "left").select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)],
        "host",
        "path",
        F.col("_chosen.rule").alias("rule"),
        F.coalesce("_chosen.action", F.lit(DEFAULT)).alias("verdict"),
    )
