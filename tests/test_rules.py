"""Every rule: a planted value is found whole, a near miss is not."""

import re
from re import _constants as sc
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from tests import brute
from tracesift.functions.draws import Draws
from tracesift.operators import rule_data as data
from tracesift.operators import shape_data
from tracesift.operators.gates import RUN_LENGTH, sql_text
from tracesift.operators.rules import (
    Rule,
    builtin_rules,
    check_rules,
    first_characters,
    fixed_start,
    rule_listing,
    rules_df,
    rules_from_df,
    token_regex,
)
from tracesift.operators.scan import scan_column, scan_with_rule_table, select_rules, with_findings
from tracesift.plans.corpus import token_value


def test_kinds_and_order():
    rules = builtin_rules()
    assert [r.ord for r in rules] == list(range(74))
    assert [r.kind for r in rules][70:] == ["email", "iban", "credit_card", "phone"]
    assert set(shape_data.SHAPES) == {k for k, _, _ in data.TOKEN_RULES}


def _tree(nodes):
    """A pattern's structure with character sets spelled out and literals joined."""
    out = []
    for op, arg in nodes:
        if op is sc.LITERAL:
            out.append(("set", frozenset({arg}), 1, 1))
        elif op is sc.IN:
            chars = set()
            for kind, value in arg:
                chars |= {value} if kind is sc.LITERAL else set(range(value[0], value[1] + 1))
            out.append(("set", frozenset(chars), 1, 1))
        elif op is sc.MAX_REPEAT:
            low, high, inner = arg
            inner = _tree(inner)
            if len(inner) == 1 and inner[0][0] == "set" and inner[0][2:] == (1, 1):
                out.append(("set", inner[0][1], low, high))
            else:
                out.append(("group", frozenset({inner}), low, high))
        elif op is sc.SUBPATTERN:
            out += _tree(arg[3])
        elif op is sc.BRANCH:
            out.append(("group", frozenset(_tree(b) for b in arg[1]), 1, 1))
        else:
            raise AssertionError(op)
    return tuple(out)


def _render(layout):
    text = ""
    for p in layout:
        body = "[" + re.escape(p["alphabet"]) + "]" if p["alphabet"] else "(?:" + "|".join(map(re.escape, p["words"])) + ")"
        text += f"{body}{{{p['low']},{p['high']}}}"
    return text


@pytest.mark.parametrize("kind", list(shape_data.SHAPES))
def test_shape_describes_the_pattern(kind):
    """Same language: equal after expanding words, checked by generating both ways."""
    pattern = dict((k, p) for k, p, _ in data.TOKEN_RULES)[kind]
    layouts = shape_data.layouts(kind)
    rendered = "|".join(f"(?:{_render(x)})" for x in layouts)
    assert parser.parse(rendered).getwidth() == parser.parse(pattern).getwidth()
    # the extreme strings of each side are accepted by the other
    for own, other in ((rendered, pattern), (pattern, rendered)):
        for text in _extremes(parser.parse(own)):
            assert re.fullmatch(other, text), (kind, text)


def _extremes(tree):
    """Strings that use each character of each set, at the least and the most repeats."""

    def go(nodes, most, pick):
        text = ""
        for op, arg in nodes:
            if op is sc.LITERAL:
                text += chr(arg)
            elif op is sc.IN:
                chars = [c for k, v in arg for c in ([v] if k is sc.LITERAL else range(v[0], v[1] + 1))]
                text += chr(chars[pick % len(chars)])
            elif op is sc.MAX_REPEAT:
                low, high, inner = arg
                text += "".join(go(inner, most, pick + i) for i in range(high if most else low))
            elif op is sc.SUBPATTERN:
                text += go(arg[3], most, pick)
            elif op is sc.BRANCH:
                text += go(arg[1][pick % len(arg[1])], most, pick)
        return text

    return {go(tree, most, pick) for most in (False, True) for pick in range(70)}


def test_fixed_start_is_the_start_of_every_layout():
    for kind, pattern, _ in data.TOKEN_RULES:
        prefix = fixed_start(pattern)
        literal = prefix.replace("\\", "")
        for layout in shape_data.layouts(kind):
            for word in layout[0]["words"] or layout[0]["alphabet"]:
                whole = word + "".join((p["words"] or [""])[0] for p in layout[1:])
                assert whole.startswith(literal), kind
        assert re.compile(pattern[len(prefix):])
        assert set(first_characters(kind)) >= set(literal[:1])


def test_run_gate_is_sound():
    """Rules gated on long runs: at least RUN_LENGTH characters, all run characters."""
    for rule in builtin_rules():
        if rule.gate != "runs":
            continue
        for layout in shape_data.layouts(rule.kind):
            assert sum(p["low"] * (1 if p["alphabet"] else min(map(len, p["words"]))) for p in layout) >= RUN_LENGTH
            used = "".join(p["alphabet"] + "".join(p["words"]) for p in layout)
            assert re.fullmatch(r"[A-Za-z0-9_~.+/=:-]+", used), rule.kind
        for layout in shape_data.layouts(rule.kind):
            texts = ["".join((p["words"] or [""])[0] for p in layout)] + [p for x in layout for p in x["words"]]
            assert any(a in t for a in rule.anchors for t in texts), rule.kind


def test_every_rule_finds_its_value_and_not_a_near_miss(spark):
    n = len(data.TOKEN_RULES)
    made = spark.range(n * 6).select("id", token_value(Draws(3, F.col("id")), F.pmod("id", F.lit(n))).alias("v"))
    rows = made.select("id", "v", F.concat(F.lit('x = "'), "v", F.lit('";')).alias("hit"), F.concat(F.lit("A"), "v", F.lit("A")).alias("miss"))
    kinds = [k for k, _, _ in data.TOKEN_RULES]
    hits = {r.id: (r.kind, r.value) for r in scan_column(rows, ["id"], "hit").collect()}
    values = {r.id: (r.v, r.miss) for r in rows.collect()}
    for i in range(n * 6):
        assert hits[i] == (kinds[i % n], values[i][0])
    misses = {}
    for r in scan_column(rows, ["id"], "miss").collect():
        misses.setdefault(r.id, []).append((r.kind, r.value, r.start, r.end))
    for i, (_, miss) in values.items():
        assert misses.get(i, []) == brute.scan(miss)
    assert sum(kinds[i % n] in [f[0] for f in misses.get(i, [])] for i in values) <= 2 * 6  # dash and dot starts only


def test_bad_rules_name_the_rule(spark):
    with pytest.raises(ValueError, match="rule broken"):
        check_rules(spark, [Rule(0, "broken", "(", token_regex("("))])
    with pytest.raises(ValueError, match="unknown validator"):
        check_rules(spark, [Rule(0, "odd", "a", token_regex("a"), validator="nope")])
    with pytest.raises(ValueError, match="unknown kinds"):
        select_rules(["nope"])


def test_user_rules(spark):
    table = spark.createDataFrame(
        [(1, "it's", "it's-[0-9]{4}", ["it's-"], None), (0, "card", "[0-9]{16}", None, "luhn"), (2, "late", "it's-[0-9]+", [], "none")],
        "ord INT, id STRING, pattern STRING, anchors ARRAY<STRING>, validator STRING",
    )
    df = spark.createDataFrame([(1, "é it's-1234 4111111111111111"), (2, "it's-12345 4111111111111112")], "k INT, t STRING")
    want = {(1, "it's", "it's-1234", 3, 12), (1, "card", "4111111111111111", 13, 29), (2, "late", "it's-12345", 0, 10)}
    assert {tuple(r) for r in scan_column(df, ["k"], "t", rules_from_df(table)).collect()} == want
    assert {tuple(r) for r in scan_with_rule_table(df, ["k"], "t", table).collect()} == want
    assert {tuple(r) for r in scan_column(df, ["k"], "t", table).collect()} == want


TABLE = "ord INT, id STRING, pattern STRING, anchors ARRAY<STRING>, validator STRING"


def test_no_rules_find_nothing(spark):
    df = spark.createDataFrame([(1, "4111111111111111"), (2, None), (3, "")], "k INT, t STRING")
    none = spark.createDataFrame([], TABLE)
    for rules in ([], rules_from_df(none), none):
        assert scan_column(df, ["k"], "t", rules).count() == 0
        assert sorted(r.k for r in scan_column(df, ["k"], "t", rules, keep_clean=True).collect()) == [1, 2, 3]
    assert [len(r.findings) for r in with_findings(df, "t", []).collect()] == [0, 0, 0]


@pytest.mark.parametrize("row", [(0, "odd", "a", None, "nope"), (0, "odd", "(", None, None), (None, "odd", "a", None, None)])
def test_bad_rows_of_a_table_name_the_rule(spark, row):
    df = spark.createDataFrame([(1, "a")], "k INT, t STRING")
    table = spark.createDataFrame([(5, "fine", "b", ["b"], None), row], TABLE)
    with pytest.raises(ValueError, match="rule odd"):
        scan_column(df, ["k"], "t", table)
    if row[0] is not None:
        with pytest.raises(ValueError, match="rule odd"):
            rules_from_df(table)


def test_a_long_table_equals_its_unrolled_part(spark, monkeypatch):
    """Thousands of rules, in one block of anchors or in several; equal keys and rows stay apart."""
    from tracesift.operators import rule_table

    rows = [(i, f"k{i}", f"p{i}_[0-9]{{3}}", [f"p{i}_", "zz_"][: 1 + i % 2], None) for i in range(3000)]
    table = spark.createDataFrame(rows, TABLE)
    texts = [(i % 5, f"x p{i}_123 p{i + 1}_45 zz_ p{3 * i}_777é p7_000") for i in range(200)] * 2
    df = spark.createDataFrame(texts, "k INT, t STRING")
    want = sorted((k, f"k{m[1]}", m[0], len(t[: m.start()].encode())) for k, t in texts for m in re.finditer(r"(?<!\w)p(\d+)_\d{3}(?![A-Za-z0-9_])", t) if int(m[1]) < 3000)
    for size in (rule_table.BLOCK_BYTES, 20_000):
        monkeypatch.setattr(rule_table, "BLOCK_BYTES", size)
        got = scan_with_rule_table(df, ["k"], "t", table).collect()
        assert sorted((r.k, r.kind, r.value, r.start) for r in got) == want


def test_sql_text_needs_no_escapes(spark):
    for value in ("a'b\\d\"", r"\bx\\", "plain", "é'"):
        assert spark.range(1).select(F.expr(sql_text(value))).first()[0] == value


def test_rule_listing(spark):
    lines = {r.ord: r.line for r in rule_listing(rules_df(spark)).collect()}
    assert len(lines) == 70
    assert lines[12] == "github-pat" + " " * 26 + " ghp_[0-9a-zA-Z]{36}"


def test_a_table_is_scanned_without_shuffle_join_or_driver(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for keep_clean in (False, True):
        found = scan_with_rule_table(docs, ["doc_id"], "text", rules_df(spark), keep_clean)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan parquet") == 1
    counted = scan_with_rule_table(docs, ["doc_id"], "text", rules_df(spark), keep_clean=True)
    assert counted.select("doc_id").distinct().count() == docs.count()


def test_blocks_of_a_table_stay_bounded_and_in_order(spark, tmp_path):
    """Rules of one row that come from different blocks are tried in the order of the table; ties go to the earlier."""
    from tracesift.operators import rule_table

    rows = [(i, f"k{i}", "tok[0-9]+", ["tok"] if i % 2 else None, None) for i in reversed(range(50))]
    spark.createDataFrame(rows, TABLE).repartition(7).select("*").createOrReplaceTempView("many_rules")
    table = spark.table("many_rules")
    rule_table.checked(table).write.parquet(str(tmp_path / "rules"))
    tool = rule_table.Finder(str(tmp_path / "rules"), 1)
    assert len(list(tool.blocks())) > 1 and tool.only is None
    held = tool.of_texts(["x tok1", None, "", "nothing"]).to_pylist()
    assert sorted(r["ord"] for r in held[0]) == list(range(50)) and held[1:3] == [[], []]
    assert sorted(r["ord"] for r in held[3]) == list(range(0, 50, 2))
    df = spark.createDataFrame([(1, "x tok1 tok22")], "k INT, t STRING")
    assert [tuple(r) for r in scan_with_rule_table(df, ["k"], "t", table).collect()] == [(1, "k0", "tok1", 2, 6), (1, "k0", "tok22", 7, 12)]


def test_a_stream_with_a_rule_table(spark, tmp_path):
    spark.createDataFrame([(1, "see tok77."), (2, None)], "k INT, t STRING").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([(0, "tok", "tok[0-9]+", ["tok"], None)], TABLE)
    stream = spark.readStream.schema("k INT, t STRING").parquet(str(tmp_path / "in"))
    query = scan_column(stream, ["k"], "t", table).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "tok", "tok77", 4, 9)]
