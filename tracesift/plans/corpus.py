"""A labelled corpus as a Spark job: one text and its expected findings per id.

The class of a row is its id mod 10: iban, phone, email, card, three tokens,
three negatives.  Nothing is shuffled, and nothing depends on the partitioning.
"""

import json
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions.draws import Draws
from tracesift.functions.folds import compute_once, let
from tracesift.functions.validators import iban_check_digits, luhn_complete, spaced4
from tracesift.operators import rule_data, shape_data
from tracesift.plans import corpus_data as data

EXAMPLE = "text STRING, expected ARRAY<STRUCT<kind: STRING, value: STRING>>"
_PARTS = "array<array<struct<alphabet:string,words:array<string>,low:int,high:int>>>"
HEX = "0123456789abcdef"


def token_kinds() -> list[str]:
    return [kind for kind, _, _ in rule_data.TOKEN_RULES]


def token_value(draws: Draws, rule: Column, tag: str = "token") -> Column:
    """A value of the token rule with index ``rule``."""
    layouts = F.from_json(
        F.lit(json.dumps([{"layouts": shape_data.layouts(k)} for k in token_kinds()])),
        f"array<struct<layouts:{_PARTS}>>",
    )
    options = F.element_at(layouts, rule.cast("int") + 1)["layouts"]
    layout = F.element_at(options, draws.below(f"{tag}.layout", F.size(options)).cast("int") + 1)

    def part(p, i):
        name = F.concat(F.lit(f"{tag}."), i.cast("string"))
        k = p["low"] + draws.below(F.concat(name, F.lit(".n")), p["high"] - p["low"] + 1)
        word = F.get(p["words"], draws.below(F.concat(name, F.lit(".w")), F.greatest(F.size(p["words"]), F.lit(1))))
        text = F.when(p["alphabet"] == "", F.repeat(word, k.cast("int")))
        return text.otherwise(draws.chars(name, p["alphabet"], k))

    return F.array_join(F.transform(layout, part), "")


def iban_value(draws: Draws) -> Column:
    """A valid account number, half of them in groups of four."""
    country = draws.below("iban.cc", len(data.IBAN_COUNTRIES))
    numbers, capitals = draws.chars("iban.d", digits, 23), draws.chars("iban.u", ascii_uppercase, 4)
    code, account = None, None
    for i, (cc, n_capitals, n_digits) in enumerate(data.IBAN_COUNTRIES):
        bban = F.concat(F.substring(capitals, 1, n_capitals), F.substring(numbers, 1, n_digits))
        if i == 0:
            code, account = F.when(country == i, cc), F.when(country == i, bban)
        else:
            code, account = code.when(country == i, cc), account.when(country == i, bban)
    whole = let(
        F.struct(code.alias("cc"), account.alias("bban")),
        lambda x: F.concat(x["cc"], iban_check_digits(x["cc"], x["bban"]), x["bban"]),
    )
    return _maybe_spaced(draws, "iban.spaced", whole)


def phone_value(draws: Draws) -> Column:
    """One of two French and two North American layouts."""
    area = (F.lit(200) + draws.below("phone.area", 700)).cast("string")
    mobile = F.concat(F.lit("0"), (F.lit(6) + draws.below("phone.mobile", 2)).cast("string"))
    form = draws.below("phone.form", 4)

    def layout(number):
        a, b, c, d = cut(number, 2, 2, 2, 2)
        middle, end = cut(number, 3, 4)
        return (
            F.when(form == 0, F.concat_ws(" ", F.lit("+33 6"), a, b, c, d))
            .when(form == 1, F.concat_ws(" ", mobile, a, b, c, d))
            .when(form == 2, F.concat(F.lit("("), area, F.lit(") "), middle, F.lit("-"), end))
            .otherwise(F.concat_ws("-", F.lit("+1"), area, middle, end))
        )

    return let(draws.chars("phone.d", digits, 8), layout)


def cut(value: Column, *lengths: int) -> list[Column]:
    """Consecutive pieces of a string."""
    starts = [1 + sum(lengths[:i]) for i in range(len(lengths))]
    return [F.substring(value, start, length) for start, length in zip(starts, lengths)]


def email_value(draws: Draws) -> Column:
    return F.concat(
        draws.pick("email.first", data.FIRST_NAMES),
        F.lit("."),
        draws.pick("email.last", data.LAST_NAMES),
        F.lit("@"),
        draws.pick("email.domain", data.DOMAINS),
        F.lit("."),
        draws.pick("email.ending", data.ENDINGS),
    )


def card_value(draws: Draws) -> Column:
    """16 digits with a valid check digit, half of them in groups of four."""
    body = F.concat(draws.pick("card.prefix", data.CARD_PREFIXES), draws.chars("card.d", digits, 15))
    return _maybe_spaced(draws, "card.spaced", luhn_complete(F.substring(body, 1, 15)))


def _maybe_spaced(draws: Draws, tag: str, value: Column) -> Column:
    return F.when(draws.below(tag, 2) == 0, spaced4(value)).otherwise(value)


def in_context(draws: Draws, value: Column) -> Column:
    """The value in one of the context lines."""
    return F.replace(draws.pick("context", data.CONTEXTS), F.lit("{}"), value)


def negative_text(draws: Draws) -> Column:
    """A line with nothing to find, of one of twelve families."""
    number, hexes = draws.chars("neg.d", digits, 12), draws.chars("neg.h", HEX, 64)
    base64 = ascii_uppercase + ascii_lowercase + digits + "+/"

    def line(name, source, *lengths):
        return let(source, lambda s: F.format_string(data.NEGATIVE_LINES[name], *cut(s, *lengths)))

    day = F.lpad((F.lit(1) + draws.below("neg.day", 28)).cast("string"), 2, "0")
    minute = F.lpad(draws.below("neg.minute", 60).cast("string"), 2, "0")
    word = draws.chars("neg.w", ascii_lowercase, 4)
    families = [
        line("order", F.concat(F.substring(number, 1, 6), day, number), 6, 2, 3, 2),
        line("commit", F.concat(word, F.substring(number, 1, 6), minute), 4, 3, 3, 2),
        line("digest", hexes, 64),
        line("hex", hexes, 40),
        line("uuid", hexes, 8, 4, 3, 3, 12),
        draws.pick("neg.lookalike", data.LOOKALIKES),
        draws.pick("neg.plain", data.PLAIN_LINES),
        line("base64", draws.chars("neg.b64", base64, 44), 44),
        line("lock", hexes, 64),
        line("written", number, 7, 2, 3),
        line("merged", number, 4, 2, 3, 2),
        line("weather", number, 2, 1, 2),
    ]
    family = draws.below("neg.family", len(families))
    text = F.when(family == 0, families[0])
    for i, expr in enumerate(families[1:], 1):
        text = text.when(family == i, expr)
    return text


def labelled_examples(ids: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """``id, text, expected`` for every id of a table."""
    row_id = F.col(id_column)
    draws = Draws(seed, F.col("id"))
    group = F.pmod(F.col("id"), F.lit(10))
    rule = draws.below("rule", len(rule_data.TOKEN_RULES))
    kinds = F.array(*map(F.lit, token_kinds()))
    kind = (
        F.when(group == 0, "iban").when(group == 1, "phone").when(group == 2, "email").when(group == 3, "credit_card")
        .when(group <= 6, F.element_at(kinds, rule.cast("int") + 1))
    )
    value = (
        F.when(group == 0, iban_value(draws)).when(group == 1, phone_value(draws)).when(group == 2, email_value(draws))
        .when(group == 3, card_value(draws)).when(group <= 6, token_value(draws, rule))
    )
    valued = compute_once(ids.select(row_id.cast("bigint").alias("id")), ["id"], {"_kind": kind, "_value": value})
    labelled = F.col("_kind").isNotNull()
    label = F.struct(F.col("_kind").alias("kind"), F.col("_value").alias("value"))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return compute_once(
        valued,
        ["id"],
        {
            "text": F.when(labelled, in_context(draws, F.col("_value"))).otherwise(negative_text(draws)),
            "expected": F.when(labelled, F.array(label)).otherwise(none),
        },
    )


def generate(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """``n`` labelled examples."""
    return labelled_examples(spark.range(n), "id", seed)
