"""The rule table: what to search for, and how each match is checked."""

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions.validators import VALIDATORS
from tracesift.operators import rule_data as data
from tracesift.operators.shape_data import layouts

RULE_SCHEMA = "ord INT, id STRING, pattern STRING, anchors ARRAY<STRING>, validator STRING"

# Local parts longer than this that belong to no address are skipped in one
# step, so that the search stays linear on very long dotted runs.
LONG_RUN = 64

# Zero-width left and right context of a token.  A token may start at the very
# start of the text, or one delimiter past the end of the previous token, hence
# the \G clause.
NOT_AT_PREVIOUS_END = r"(?:\A|(?!\G))"

# Word boundaries are Unicode ones.
_EDGE = r"(?U:\b)"


def token_regex(pattern: str) -> str:
    """A token pattern wrapped so that it is not glued to identifier characters."""
    return f"{NOT_AT_PREVIOUS_END}(?<![{data.TOKEN_GLUE}])(?:{pattern})(?![{data.TOKEN_GLUE}])"


def fast_token_regex(kind: str, pattern: str) -> str:
    """The same for a built-in kind, put so that most positions fail at once.

    A token that starts with an identifier character cannot touch the one
    before it, so the clause for that is left out.  A fixed start is matched
    first, which lets the regex engine skip ahead, and the left context is
    checked after it; otherwise the possible first characters are.
    """
    first = first_characters(kind)
    if re.search(f"[^{data.TOKEN_GLUE}]", first):
        return token_regex(pattern)
    glue, prefix = data.TOKEN_GLUE, fixed_start(pattern)
    if prefix:
        return f"{prefix}(?<![{glue}]{prefix}){pattern[len(prefix):]}(?![{glue}])"
    return f"(?=[{first}])(?<![{glue}])(?:{pattern})(?![{glue}])"


def first_characters(kind: str) -> str:
    """The characters a token of this kind may start with."""
    starts = (layout[0] for layout in layouts(kind))
    return "".join(sorted({c for p in starts for c in (p["alphabet"] or [w[0] for w in p["words"]])}))


def fixed_start(pattern: str) -> str:
    """The literal text a built-in pattern starts with, as written in it."""
    return re.match(r"(?:(?:[A-Za-z0-9_~:/-]|\\\.)+(?![{?*+]))?", pattern).group()


def email_regex() -> str:
    """An address, or a long run of address characters that holds none.

    The domain is one greedy run that may not contain two dots in a row; it is
    the same language as labels joined by dots, without nested repetition.  If
    no address starts at the first word boundary of a run, none starts later in
    it, so a long run may be consumed whole; ``email_valid`` drops it again.
    """
    local, label, tld = data.EMAIL_LOCAL, data.EMAIL_LABEL, data.EMAIL_TLD
    domain = rf"{label}(?:(?!\.\.)[A-Za-z0-9.-])*\.{tld}"
    return rf"{_EDGE}(?:{local}++@{domain}{_EDGE}|{local}{{{LONG_RUN},}}+)"


def word_regex(body: str, first: str) -> str:
    """``first`` is what a match starts with: looking for it before the costlier
    boundary check changes nothing but the time spent."""
    return f"(?={first}){_EDGE}{body}{_EDGE}"


def phone_regex() -> str:
    left, right = data.PHONE_GLUE_LEFT, data.PHONE_GLUE_RIGHT
    return rf"(?=[+(\d]){NOT_AT_PREVIOUS_END}(?<![{left}])(?:{data.PHONE_BODY})(?![{right}])"


@dataclass(frozen=True)
class Rule:
    """One kind of finding.

    ``regex`` is the full zero-width-context expression; with ``any_digit`` its
    digits are those of every script.  ``gate`` names the row feature the rule
    needs (see ``operators.gates``), ``anchors`` the literals of which a match
    contains at least one.
    """

    ord: int
    kind: str
    pattern: str
    regex: str
    anchors: tuple[str, ...] = ()
    validator: str = "none"
    gate: str = "text"
    any_digit: bool = False


# Token kinds that are not one unbroken run of at least 20
# characters, and the row feature they need instead.
_OTHER_TOKEN_GATES = {"private-key-block": "text", "us-ssn": "digits"}


def builtin_rules() -> list[Rule]:
    """70 token rules, then email, iban, credit_card and phone."""
    rules = [
        Rule(i, kind, pattern, fast_token_regex(kind, pattern), tuple(anchors), gate=_OTHER_TOKEN_GATES.get(kind, "runs"))
        for i, (kind, pattern, anchors) in enumerate(data.TOKEN_RULES)
    ]
    n = len(rules)
    email = rf"{data.EMAIL_LOCAL}+@{data.EMAIL_LABEL}+(?:\.{data.EMAIL_LABEL}+)*\.{data.EMAIL_TLD}"
    rules += [
        Rule(n, "email", email, email_regex(), ("@",), "email", "text"),
        Rule(n + 1, "iban", data.IBAN_BODY, word_regex(data.IBAN_BODY, "[A-Z]"), (), "iban", "iban", True),
        Rule(n + 2, "credit_card", data.CARD_BODY, word_regex(data.CARD_BODY, r"\d"), (), "luhn", "card", True),
        Rule(n + 3, "phone", data.PHONE_BODY, phone_regex(), (), "phone", "digits", True),
    ]
    return rules


def _compiles(spark: SparkSession, rules: list[Rule]) -> bool:
    """Whether the regex engine takes all the patterns; one row is read, no table."""
    try:
        spark.range(1).select(F.array(*[F.regexp_count(F.lit(""), F.lit(r.regex)) for r in rules])).collect()
    except PySparkException:
        return False
    return True


def check_rules(spark: SparkSession, rules: list[Rule]) -> list[Rule]:
    """Fail before a job over the texts starts, naming the rule."""
    for rule in rules:
        if rule.validator not in VALIDATORS:
            raise ValueError(f"rule {rule.kind}: unknown validator {rule.validator!r}")
    if rules and not _compiles(spark, rules):
        bad = next((r for r in rules if not _compiles(spark, [r])), rules[0])
        raise ValueError(f"rule {bad.kind}: bad pattern {bad.pattern!r}")
    return rules


def rules_df(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule table as a DataFrame (token rules only, unless given others)."""
    if rules is None:
        rules = builtin_rules()[: len(data.TOKEN_RULES)]
    rows = [(r.ord, r.kind, r.pattern, list(r.anchors), r.validator) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_df(table: DataFrame) -> list[Rule]:
    """Token rules from a user's table (``ord, id, pattern, anchors, validator``), to be unrolled into the plan.

    ``anchors`` may be empty or null: the rule is then tried on every text.  The plan grows by an
    expression for each rule; a long table is better given to ``scan_column`` as it is.
    """
    rows = table.select("ord", "id", "pattern", "anchors", "validator").collect()
    rules = [
        Rule(r.ord, r.id, r.pattern, token_regex(r.pattern), tuple(r.anchors or ()), r.validator or "none")
        for r in sorted(rows, key=lambda r: r.ord)
    ]
    return check_rules(table.sparkSession, rules)


def rule_listing(table: DataFrame) -> DataFrame:
    """One line per rule: the id padded to 36 characters, a space, the pattern."""
    width = F.greatest(F.length("id"), F.lit(36))
    return table.select("ord", F.concat(F.rpad("id", width, F.lit(" ")), F.lit(" "), F.col("pattern")).alias("line"))
