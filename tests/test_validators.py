from pyspark.sql import functions as F

from tests import brute
from tracesift.functions import validators as v
from tracesift.functions.folds import running


def _column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r[1] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


IBANS = [
    "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "NL91ABNA0417164300",
    "NL91ABNA0417164301", "GB82WEST1234569876543", "gb82west12345698765432", "", "FR76３0006000011234567890189", "X" * 35,
    "ES91 2100 0418 4502 0005 1332", "éééé12345678901", None,
]


def test_iban(spark):
    got = _column(spark, IBANS, v.iban_valid)
    assert got == [bool(x) and brute.iban(x) for x in IBANS]
    assert got[:4] == [True] * 4 and got[4] is False and got[-1] is False


def test_luhn(spark):
    values = ["4111111111111111", "4111-1111 1111 1111", "4111111111111112", "0" * 12, "0" * 13, "0" * 19, "0" * 20, "a4111111111111111é", "", None]
    assert _column(spark, values, v.luhn_valid) == [bool(x) and brute.luhn(x) for x in values]


def test_phone(spark):
    values = ["+33 6 12 34 56 78", "(415) 555-2671", "0612345678", "415-555-2671", "4155552671", "4155-552671", "12345678", "+1234567", "+1234567890123456", "٤15-555-26711", "415-555-2671\n", None]
    assert _column(spark, values, v.phone_valid) == [bool(x) and brute.phone(x) for x in values]


def test_completion_makes_valid_values(spark):
    bodies = [f"{i * 7919:015d}" for i in range(200)]
    assert all(brute.luhn(x) and len(x) == 16 for x in _column(spark, bodies, v.luhn_complete))
    accounts = [f"BANK{i * 104729:014d}" for i in range(300)]
    checks = _column(spark, accounts, lambda a: v.iban_check_digits(F.lit("GB"), a))
    assert all(2 <= int(c) <= 98 and len(c) == 2 and brute.iban(f"GB{c}{a}") for c, a in zip(checks, accounts))


def test_digits_and_groups(spark):
    assert _column(spark, ["+1 (2)é٣3", ""], v.ascii_digits) == ["123", ""]
    assert _column(spark, ["123456789", "1234", "", "12345678"], v.spaced4) == ["1234 5678 9", "1234", "", "1234 5678"]


def test_running_matches_a_plain_loop(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda x: x).alias("a"))
        items = F.slice("a", 1, n)
        got = df.select(running(items, lambda p, x: p + x)).first()[0]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_sql_functions_equal_the_columns(spark):
    from tracesift.functions import validators as v
    from tracesift.functions.sql_functions import FUNCTIONS, create_functions

    values = [
        "4111 1111 1111 1111", "4111111111111112", "FR76 3000 6000 0112 3456 7890 189", "FR7630006000011234567890188", "GB82 WEST 1234 5698 7654 32", "fr76",
        "+33 6 12 34 56 78", "(415) 555-2671", "415-555-2671", "12.34.56.78", "0123", "٤١٥-555-2671", "", " ", "é", None, "FR７６30006000011234567890189", "1" * 40,
    ]
    assert create_functions(spark) == [name for name, _, _ in FUNCTIONS]
    df = spark.createDataFrame([(x,) for x in values], "v STRING")
    df.createOrReplaceTempView("sql_values")
    checks = {n: getattr(v, n) for n in ("ascii_digits", "luhn_valid", "iban_valid", "phone_valid", "spaced4")}
    want = df.select("v", *(f(F.col("v")).alias(n) for n, f in checks.items())).collect()
    got = spark.sql(f"SELECT v, {', '.join(f'{n}(v) AS {n}' for n in checks)} FROM sql_values").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    made = spark.sql("SELECT iban_check_digits('FR', '30006000011234567890189'), luhn_complete('411111111111111')").first()
    assert tuple(made) == ("76", "4111111111111111")
    plan = spark.sql("SELECT iban_valid(v) FROM sql_values")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Subquery" not in plan
