"""Test texts with known findings planted into the text of a table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions.draws import Draws
from tracesift.functions.folds import compute_once
from tracesift.plans.corpus import iban_value, phone_value, token_value

SEED = 7
N_RULES = 70


def _with_text(df: DataFrame, keys: list[str], text: str, planted: dict[str, Column], build) -> DataFrame:
    """Compute the planted values once, then put the new text together."""
    return compute_once(df.select(*keys, text), [*keys, text], planted).select(*keys, build().alias("text"))


def plant_tokens(df: DataFrame, key: str | list[str], text: str, number: Column | None = None) -> DataFrame:
    """A token of rule ``number mod 70`` after each text, then the same token glued
    to an identifier, which is no finding.  The number is the key unless given."""
    keys = [key] if isinstance(key, str) else key
    number = F.col(keys[0]) if number is None else number
    token = token_value(Draws(SEED, number), F.pmod(number, F.lit(N_RULES)))

    def build():
        value = F.col("_token")
        return F.concat(F.col(text), F.lit(" export API_TOKEN="), value, F.lit("\nrejected=x"), value, F.lit("x"))

    return _with_text(df, keys, text, {"_token": token}, build)


def plant_ibans(df: DataFrame, key: str, text: str) -> DataFrame:
    """An account number after each text, and one with two digits swapped in."""
    iban = iban_value(Draws(SEED, F.col(key)))

    def build():
        value = F.col("_iban")
        return F.concat(F.col(text), F.lit("\nIBAN "), value, F.lit(", not "), F.overlay(value, F.lit("00"), 3))

    return _with_text(df, [key], text, {"_iban": iban}, build)


def plant_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """One of fourteen boundary and overlap cases after each text, by ``key mod 14``."""
    draws = Draws(SEED, F.col(key))
    columns = {
        "_a": F.concat(F.lit("ghp_"), draws.chars("edge.a", "0123456789abcdef", 36)),
        "_b": F.concat(F.lit("ghp_"), draws.chars("edge.b", "0123456789abcdef", 36)),
        "_d": draws.chars("edge.d", "0123456789", 9),
        "_phone": phone_value(draws),
    }

    def build():
        a, b, d, phone = (F.col(c) for c in columns)
        key_block = "-----BEGIN EC PRIVATE KEY-----"
        ssn = F.concat(F.lit("0"), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 2), F.lit("-"), F.substring(d, 5, 4))
        long_lab = F.concat(F.lit("glpat-"), F.substring(a, 1, 40), F.lit("."), d)
        cases = [
            F.concat(a, F.lit(","), b),  # one delimiter between two tokens
            F.concat(F.lit("x"), a, F.lit(" "), b, F.lit("_")),  # glued on either side
            F.concat(F.lit("k="), long_lab),  # two kinds from one start
            F.concat(F.lit("ref "), ssn, F.lit(" end")),  # two kinds on one span
            F.lit("pay 4111111111111111 123"),  # a rejected match uses up its text
            F.lit(key_block + key_block + " " + key_block),  # touching blocks
            F.concat(F.lit("déjà vu ✓ "), a, F.lit(" ü "), phone),  # byte offsets
            F.concat(F.lit("é"), a, F.lit("é éFR7630006000011234567890189")),  # an accent touches
            F.lit("FR７630006000011234567890189 and ４１１１111111111111"),  # full-width digits
            F.concat(F.lit("mail a@b.com-x@c.de and .x@y.org, é.q@r.io "), phone),  # resumed addresses
            F.concat(F.lit("id="), phone, F.lit("_"), F.lit(" -"), phone),  # phone context
            F.concat(F.lit("hvs."), a, b, F.lit("0123456789, "), a),  # a token within a token
            F.concat(F.lit("²a@b.com ½"), phone, F.lit(" Ⅷc@d.org")),  # superscripts and fractions touch no word
            F.lit("ⓐa@b.com ⓐ4111111111111111 4111111111111111²"),  # circled letters do
        ]
        number = F.pmod(F.col(key), F.lit(len(cases)))
        chosen = F.when(number == 0, cases[0])
        for i, case in enumerate(cases[1:], 1):
            chosen = chosen.when(number == i, case)
        return F.concat(F.col(text), F.lit("\n"), chosen)

    return _with_text(df, [key], text, columns, build)
