"""Checks on a matched value, as Column expressions.

Each function takes a string Column and works on any table column, not only on
findings.  A null value is never valid.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions.folds import let

def ascii_digits(value: Column) -> Column:
    """The ASCII digits of a value, everything else dropped."""
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 to 19 ASCII digits that satisfy the Luhn checksum."""
    digits = ascii_digits(value)
    return F.coalesce(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), F.lit(False))


def mod97(value: Column) -> Column:
    """Remainder mod 97 of a string of ``0-9A-Z``, reading A to Z as 10 to 35."""

    def fold(v):
        def step(rem, pos):
            code = F.ascii(F.substring(v, pos, F.lit(1)))
            return F.when(code < 58, (rem * 10 + code - 48) % 97).otherwise((rem * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(v)), F.lit(0), step)

    return let(value, fold)


def iban_valid(value: Column) -> Column:
    """Mod-97 check of an account number, white space ignored.

    Only ASCII capitals and digits can be valid, 15 to 34 of them.  There is no
    per-country length check.
    """
    compact = F.regexp_replace(value, r"(?U)\s", "")
    rotated = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    shaped = F.coalesce(compact.rlike(r"\A[A-Z0-9]{15,34}\z"), F.lit(False))
    return F.when(shaped, mod97(rotated) == 1).otherwise(F.lit(False))


def phone_valid(value: Column) -> Column:
    """8 to 15 ASCII digits, with a dialling start or the 3-3-4 layout."""
    dialled = value.startswith("+") | value.startswith("(") | value.startswith("0")
    plain = value.rlike(r"(?U)\A\d{3}[ .-]?\d{3}[ .-]?\d{4}\z")
    return F.coalesce(F.length(ascii_digits(value)).between(8, 15) & (dialled | plain), F.lit(False))


def email_valid(value: Column) -> Column:
    """Tells an address from a long address-like run that was skipped whole."""
    return F.coalesce(value.contains("@"), F.lit(False))


def any_valid(value: Column) -> Column:
    """Accepts every value."""
    return value.isNotNull()


# The names a rule table may use.
VALIDATORS = {
    "none": any_valid,
    "email": email_valid,
    "iban": iban_valid,
    "luhn": luhn_valid,
    "phone": phone_valid,
}


def validate(name: Column, value: Column) -> Column:
    """Apply the check whose name is in ``name``; an unknown name fails the job."""
    checks = F.when(name == "none", any_valid(value))
    for known, check in VALIDATORS.items():
        if known != "none":
            checks = checks.when(name == known, check(value))
    return checks.otherwise(F.raise_error(F.concat(F.lit("unknown validator "), F.coalesce(name, F.lit("null")))).cast("boolean"))


def iban_check_digits(country: Column, account: Column) -> Column:
    """The two check digits (02 to 98) that make ``country + digits + account`` valid."""
    remainder = mod97(F.concat(account, country, F.lit("00")))
    return F.lpad((F.lit(98) - remainder).cast("string"), 2, "0")


def luhn_complete(body: Column) -> Column:
    """``body`` plus the one digit that makes the Luhn checksum hold."""
    def complete(b):
        tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string")))
        return F.element_at(F.filter(tries, lambda card: F.call_function("luhn_check", card)), 1)

    return let(body, complete)


def spaced4(value: Column) -> Column:
    """Groups of four characters with a space between groups."""
    return F.rtrim(F.regexp_replace(value, "(.{4})", "$1 "))
