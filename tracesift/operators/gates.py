"""Cheap row features that decide which rules a text needs at all.

Most texts hold nothing to find.  The features below cost a few passes over the
text; a rule's own expression only runs on the rows that pass its gate.  Every
gate is sound: a row it rejects has no valid finding of that rule.
"""

from string import ascii_letters, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.operators.rules import Rule

# Sets are spelled out: the regex engine looks a listed character up in a table,
# but tests ranges one after the other.
_DIGIT, _CAPITAL, _EITHER = f"[{digits}]", f"[{ascii_uppercase}]", f"[{digits}{ascii_uppercase}]"

# Every built-in token rule but two matches a single run of at least 20 of these.
_RUN = f"[{ascii_letters}{digits}_~.+/=:-]"
RUN_LENGTH = 20

# Above this many bytes a text is not cut into words for the run feature.
_SPLIT_LIMIT = 4 << 20

TEXT, RUNS, OTHER, DIGITS, CARD, IBAN = "_text", "_runs", "_other", "_digits", "_card", "_iban"
_NUMBERS = "_numbers"
_FEATURE = {"digits": DIGITS, "card": CARD, "iban": IBAN}

# What must follow the first digit, or the first capital, of a finding.
_EIGHT = f"(?:[ .()-]{{0,2}}{_DIGIT}){{7}}"
_THIRTEEN = f"(?:[ -]?{_DIGIT}){{12}}"
_ACCOUNT = f"{_CAPITAL}{_DIGIT}{{2}}(?: ?{_EITHER}{{4}}){{2}}"


def long_runs(text: Column) -> Column:
    """The words that hold a long token-like run, joined by spaces.

    Cutting at single spaces is far cheaper than searching the whole text for
    runs, and no run crosses a space.  A huge text is not cut; it stands for
    itself.
    """
    words = F.filter(
        F.split(text, " "),
        lambda w: (F.octet_length(w) >= RUN_LENGTH) & w.rlike(f"{_RUN}{{{RUN_LENGTH}}}"),
    )
    return F.when(F.octet_length(text) <= _SPLIT_LIMIT, F.array_join(words, " ")).otherwise(text)


def other_digits(text: Column) -> Column:
    """Whether a text holds digits outside ASCII; the first ones are at U+0660.

    Without them an expression may use ASCII digits and find the same.
    """
    return (F.length(text) != F.octet_length(text)) & text.rlike(r"[\x{660}-\x{10FFFF}&&\p{Nd}]")


def with_features(df: DataFrame) -> DataFrame:
    """Add the row features of a DataFrame whose text is in column ``TEXT``.

    One pass looks for the start of any number or account; the narrower checks
    only run on the rows that pass it.
    """
    body, other, numbers = F.col(TEXT), F.col(OTHER), F.col(_NUMBERS)
    number_start = f"{_EITHER}(?:(?<={_DIGIT}){_EIGHT}|(?<={_CAPITAL}){_ACCOUNT})"
    passes = df.withColumns(
        {RUNS: long_runs(body), OTHER: other_digits(body), _NUMBERS: body.rlike(number_start)}
    )
    return passes.withColumns(
        {
            # eight digits with at most two separators between neighbours
            DIGITS: other | (numbers & body.rlike(_DIGIT + _EIGHT)),
            # thirteen digits with at most one separator between neighbours
            CARD: other | (numbers & body.rlike(_DIGIT + _THIRTEEN)),
            IBAN: numbers & body.rlike(_CAPITAL + _ACCOUNT),
        }
    )


def gate(rule: Rule) -> str:
    """SQL condition: may a row hold a finding of ``rule``?"""
    if rule.gate in _FEATURE:
        return _FEATURE[rule.gate]
    return anchor_condition(RUNS if rule.gate == "runs" else TEXT, rule.anchors)


def anchor_condition(column: str, anchors: tuple[str, ...]) -> str:
    """SQL condition: does the column hold one of the anchors (or are there none)?"""
    return " OR ".join(f"contains({column}, {sql_text(a)})" for a in anchors) or "true"


def row_gate(rules: list[Rule]) -> str:
    """SQL condition: may a row hold any finding at all?"""
    needed = {r.gate for r in rules}
    parts = [gate(r) for r in rules if r.gate == "text"]
    parts += [column for name, column in _FEATURE.items() if name in needed]
    if "runs" in needed:
        parts.append(f"{RUNS} != ''")
    return " OR ".join(parts) or "false"


def sql_text(value: str) -> str:
    """``value`` as a SQL expression, free of escape rules.

    The rule array has hundreds of literals; as SQL text it is one call to the
    JVM, not thousands.
    """
    if "'" not in value:
        return f"r'{value}'"
    return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"
