"""Candidates: every match of every rule in a text, with byte offsets."""

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions.folds import running
from tracesift.functions.validators import validate
from tracesift.operators import gates
from tracesift.operators.rules import Rule


RULE = "struct<ord:int,kind:string,validator:string,regex:string,plain_regex:string>"
RULE_ARRAY = f"array<{RULE}>"
HITS = f"array<struct<rule:{RULE},matches:array<string>>>"


def _matches(rule: Rule) -> str:
    found = f"regexp_extract_all({gates.TEXT}, {gates.sql_text(_full_regex(rule))}, 0)"
    if rule.any_digit:
        # same result without such digits, in less than half the time
        plain = f"regexp_extract_all({gates.TEXT}, {gates.sql_text(rule.regex)}, 0)"
        found = f"IF({gates.OTHER}, {found}, {plain})"
    return f"CASE WHEN {gates.gate(rule)} THEN {found} END"


def _full_regex(rule: Rule) -> str:
    return "(?U)" + rule.regex if rule.any_digit else rule.regex


def _rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant array, in the order of the list."""
    rows = [
        {"ord": r.ord, "kind": r.kind, "validator": r.validator, "regex": _full_regex(r), "plain_regex": r.regex}
        for r in rules
    ]
    return F.from_json(F.lit(json.dumps(rows)), RULE_ARRAY)


def hits(rules: list[Rule]) -> Column:
    """The rules that matched a row, each with its matches in text order.

    All matches are taken first and checked later: a match that fails its check
    has still used up its part of the text.
    """
    if not rules:
        return F.lit(None).cast(HITS)
    paired = F.arrays_zip(
        _rule_array(rules).alias("rule"), F.expr(f"array({', '.join(map(_matches, rules))})").alias("matches")
    )
    found = F.filter(paired, lambda h: F.size(h["matches"]) > 0)
    return F.when(F.expr(gates.row_gate(rules)), found)


def locate(text: Column, other: Column, hit: Column) -> Column:
    """Checked candidates of one rule.  The context is zero-width, so the text
    between two neighbouring matches is exactly one piece of ``split``."""
    rule, values = hit["rule"], hit["matches"]
    regex = F.when(other, rule["regex"]).otherwise(rule["plain_regex"])
    gaps = F.transform(F.split(text, regex, -1), F.octet_length)
    steps = F.zip_with(
        F.transform(values, F.octet_length), F.slice(gaps, 1, F.size(values)), lambda length, gap: length + gap
    )

    def candidate(value, end):
        return F.struct(
            (end - F.octet_length(value)).alias("start"),
            (-end).alias("neg_end"),
            rule["ord"].alias("ord"),
            rule["kind"].alias("kind"),
            value.alias("value"),
        )

    ends = running(steps, lambda pos, step: pos + step)
    return F.filter(F.zip_with(values, ends, candidate), lambda c: validate(rule["validator"], c["value"]))


def candidates(text: Column, other: Column, row_hits: Column) -> Column:
    """All checked candidates of a row, unordered."""
    return F.flatten(F.transform(row_hits, lambda h: locate(text, other, h)))
