"""The checks and makers of values as temporary SQL functions, and scans as views, for users of SQL text.

The functions have a RETURN expression, so a query that calls them is planned with built-in functions only.
"""

from pyspark.sql import SparkSession

from tracesift.operators.rules import Rule
from tracesift.operators.scan import scan_column

_DIGIT = "ascii(substring(v, pos, 1))"

#: Name, parameters and type, and expression; each may call those before it.
FUNCTIONS = [
    ("ascii_digits", "(v STRING) RETURNS STRING", "regexp_replace(v, '[^0-9]', '')"),
    ("luhn_valid", "(v STRING) RETURNS BOOLEAN", "coalesce(length(ascii_digits(v)) BETWEEN 13 AND 19 AND luhn_check(ascii_digits(v)), false)"),
    (
        "mod97",
        "(v STRING) RETURNS INT",
        f"aggregate(sequence(1, length(v)), 0, (rem, pos) -> CASE WHEN {_DIGIT} < 58 THEN (rem * 10 + {_DIGIT} - 48) % 97 "
        f"ELSE (rem * 100 + {_DIGIT} - 55) % 97 END)",
    ),
    ("compact", "(v STRING) RETURNS STRING", r"regexp_replace(v, r'(?U)\s', '')"),
    (
        "iban_valid",
        "(v STRING) RETURNS BOOLEAN",
        r"CASE WHEN coalesce(compact(v) RLIKE r'\A[A-Z0-9]{15,34}\z', false) THEN mod97(concat(substr(compact(v), 5), substr(compact(v), 1, 4))) = 1 ELSE false END",
    ),
    (
        "phone_valid",
        "(v STRING) RETURNS BOOLEAN",
        r"coalesce(length(ascii_digits(v)) BETWEEN 8 AND 15 AND (left(v, 1) IN ('+', '(', '0') OR v RLIKE r'(?U)\A\d{3}[ .-]?\d{3}[ .-]?\d{4}\z'), false)",
    ),
    ("iban_check_digits", "(country STRING, account STRING) RETURNS STRING", "lpad(CAST(98 - mod97(concat(account, country, '00')) AS STRING), 2, '0')"),
    ("luhn_complete", "(body STRING) RETURNS STRING", "filter(transform(sequence(0, 9), d -> concat(body, CAST(d AS STRING))), card -> luhn_check(card))[0]"),
    ("spaced4", "(v STRING) RETURNS STRING", "rtrim(regexp_replace(v, '(.{4})', '$1 '))"),
]


def create_functions(spark: SparkSession) -> list[str]:
    """Create or replace the functions in the session; their names."""
    for name, signature, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return [name for name, _, _ in FUNCTIONS]


def create_findings_view(spark: SparkSession, view: str, table: str, keys: list[str], text: str, rules: list[Rule] | None = None) -> None:
    """A temporary view of the findings in a column of a table or view: ``keys``, ``kind``, ``value``, ``start``, ``end``.

    It is a scan of what the table holds when the view is queried; a condition on the keys reaches the table.
    """
    scan_column(spark.table(table), keys, text, rules).createOrReplaceTempView(view)
