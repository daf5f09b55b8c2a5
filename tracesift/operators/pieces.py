"""Scan texts that are larger than a task, in pieces.

A text may be cut behind any character that no email address holds.  An address then lies in one piece, however long
it is.  Every other rule matches a bounded number of bytes, so a piece that also sees ``MARGIN`` bytes of the next one, and the
character before it, holds all that decides whether a match may start at a place of its own.

What was matched before still counts: a search goes on where its rule's last match ended, and a finding may not overlap the
last one kept.  Both can reach over the end of a piece.  So a piece gives every match that *may* start in it, by
a look-ahead at each place, without taking a choice.  Matches that overlap or touch form an island; nothing of a search
or of the sweep crosses from one island to the next, as all before it has ended.  The choice is made within islands:
first each rule's search, then the validators, then the overlap rule, as in a whole scan.

Pieces are linked where a match reaches the next one, so islands are found among the few matches of linked pieces;
no task gets all matches of a text.  Texts go through no shuffle, matches go through three.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracesift.functions.folds import running
from tracesift.functions.validators import validate
from tracesift.operators import gates
from tracesift.operators.resolve import resolve
from tracesift.operators.rule_data import TOKEN_GLUE
from tracesift.operators.rules import NOT_AT_PREVIOUS_END, Rule, builtin_rules, fast_token_regex, fixed_start
from tracesift.sources.scratch import shared_path

#: Bytes that a piece sees of the next one: more than any match but an address may have.
MARGIN = 512
#: A cut: behind an ASCII character outside of addresses, or behind the last byte of any other character.
_CUT = re.compile(rb"[^A-Za-z0-9._%+@\x80-\xff-]|[\x80-\xff](?=[^\x80-\xbf])")
#: No match holds one of these, and to all rules they are what the start or the end of a text is.
SEPARATORS = "\t\n\r!\"#$&'*,;<>?[\\]^`{|}"

_MATCH = "array<struct<start:bigint,end:bigint,ord:int,kind:string,validator:string,strict:boolean,value:string>>"


def cut_after(data: bytes, start: int) -> int:
    """The first place from ``start`` on behind a character where a text may be cut; 0 if there is none.

    The character before ``start`` counts, too.
    """
    found = _CUT.search(data, max(0, start - 1))
    return found.end() if found else 0


def last_character(data: bytes) -> str:
    return data.decode(errors="ignore")[-1:]


def cut_texts(df: DataFrame, keys: list[str], text: str, piece_bytes: int) -> DataFrame:
    """Texts of a column in pieces of about so many bytes, as ``scan_pieces`` takes them; null and empty texts have none."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(_column(df, k).alias(n) for k, n in zip(keys, names, strict=True)), _column(df, text).alias(gates.TEXT))
    fields = [T.StructField("offset", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("before", "text", "after")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(gates.TEXT)):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                at = 0
                while at < len(data):
                    end = cut_after(data, at + piece_bytes) if at + piece_bytes < len(data) else 0
                    end = end or len(data)
                    own = [at, last_character(data[max(0, at - 4) : at]), data[at:end].decode(), data[end : end + MARGIN].decode(errors="ignore")]
                    kept = [batch.column(n).slice(i, 1) for n in names]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x]) for x in own)], [*names, *(f.name for f in fields)])
                    at = end

    cut = rows.mapInArrow(run, T.StructType([*(rows.schema[n] for n in names), *fields]))
    return cut.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *(f.name for f in fields))


def _column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def possible_matches(rules: list[Rule]) -> Column:
    """All places of a prepared piece where a match of a rule may start, each with the match there.

    The text begins with a separator, so none starts at its first character.
    """
    parts = []
    for rule in rules:
        searches = [_search(rule, f) for f in ("", "(?U)")]
        found = [f"regexp_extract_all({gates.TEXT}, {gates.sql_text(p)}, {i})" for p, i, _, _ in searches]
        cuts = [f"split({gates.TEXT}, {gates.sql_text(p)}, -1)" for p, _, _, _ in searches]
        if rule.any_digit:
            values, gaps = (f"IF({gates.OTHER}, {u}, {p})" for p, u in (found, cuts))
        else:
            values, gaps = found[0], cuts[0]
        _, _, prefix, moves = searches[0]
        strict = NOT_AT_PREVIOUS_END in rule.regex
        made = (
            f"named_struct('values', v, 'gaps', CASE WHEN size(v) > 0 THEN {gaps} END, 'ord', {rule.ord}, 'kind', {gates.sql_text(rule.kind)}, "
            f"'validator', {gates.sql_text(rule.validator)}, 'strict', {str(strict).lower()}, 'prefix', {gates.sql_text(prefix)}, 'moves', {moves})"
        )
        parts.append(f"CASE WHEN {gates.gate(rule)} THEN transform(array({values}), v -> {made})[0] END")
    tried = F.filter(F.expr(f"array({', '.join(parts)})"), lambda h: F.size(h["values"]) > 0)
    return F.flatten(F.transform(tried, _located)).cast(_MATCH)


def _search(rule: Rule, flags: str) -> tuple[str, int, str, str]:
    """An expression that stops at every place where a match may start, the group of it that a match is in, what comes before
    that, and the SQL for how many bytes of ``value`` the expression takes of the text."""
    if rule.validator == "email":
        # the search for addresses is left as it is: what it uses up ends within the piece
        return flags + rule.regex, 0, "", "-1"
    prefix = fixed_start(rule.pattern)
    literal = re.sub(r"\\(.)", r"\1", prefix)
    if literal and rule.regex == fast_token_regex(rule.kind, rule.pattern) and not any(literal.endswith(literal[:n]) for n in range(1, len(literal))):
        # only the fixed start is taken, which can't overlap itself; the engine skips ahead to it
        return f"{flags}{prefix}(?<![{TOKEN_GLUE}]{prefix})(?=({rule.pattern[len(prefix):]})(?![{TOKEN_GLUE}]))", 1, literal, str(len(literal))
    return f"{flags}(?=({rule.regex.replace(NOT_AT_PREVIOUS_END, '')}))", 1, "", "0"


def _located(hit: Column) -> Column:
    """The matches of a rule with their places, by the gaps between what its search takes of the text."""
    found = hit["values"]
    gaps = F.slice(F.transform(hit["gaps"], F.octet_length), 1, F.size(found))
    taken = F.transform(found, lambda v: F.when(hit["moves"] < 0, F.octet_length(v)).otherwise(hit["moves"]))
    ends = running(F.zip_with(gaps, taken, lambda gap, own: gap + own), lambda pos, step: pos + step)
    starts = F.zip_with(ends, taken, lambda end, own: end - own)

    def match(rest, start):
        value = F.concat(hit["prefix"], rest)
        return F.struct(
            start.alias("start"), (start + F.octet_length(value)).alias("end"), hit["ord"].alias("ord"), hit["kind"].alias("kind"),
            hit["validator"].alias("validator"), hit["strict"].alias("strict"), value.alias("value"),
        )

    return F.zip_with(found, starts, match)


def scan_pieces(pieces: DataFrame, keys: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """The findings of the texts that the pieces make up: ``keys``, ``kind``, ``value``, ``start``, ``end``.

    ``keys`` name a text.  A piece has ``offset`` (its bytes' place in the text), ``before`` (a character), ``text``, and
    ``after`` (``MARGIN`` bytes).  Offsets are bytes of the whole text.
    """
    rules = builtin_rules() if rules is None else rules
    names = [f"_k{i}" for i in range(len(keys))]
    own = [_column(pieces, k).alias(n) for k, n in zip(keys, names, strict=True)]
    body = F.concat(F.lit("\n"), "before", "text", "after").alias(gates.TEXT)
    lead = F.lit(1) + F.octet_length("before")
    held = pieces.select(*own, F.col("offset").alias("_from"), (F.col("offset") + F.octet_length("text")).alias("_to"), lead.alias("_lead"), body)
    featured = gates.with_features(held)
    possible = F.when(F.expr(gates.row_gate(rules)), possible_matches(rules))
    found = featured.select(*names, "_from", "_to", "_lead", F.explode(possible).alias("m"))
    shift = F.col("_from") - F.col("_lead")
    placed = found.select(*names, "_from", "_to", F.col("m").withField("start", F.col("m.start") + shift).withField("end", F.col("m.end") + shift).alias("m"))
    matches = placed.where((F.col("m.start") >= F.col("_from")) & (F.col("m.start") < F.col("_to"))).select(*names, "_from", "m")
    # written, as the matches are needed twice and the texts are to be searched once
    path = shared_path(pieces.sparkSession, "matches")
    matches.write.parquet(path)
    return _chosen(pieces.sparkSession.read.schema(matches.schema).parquet(path), names).select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "kind", "value", "start", "end")


def _chosen(matches: DataFrame, names: list[str]) -> DataFrame:
    """Links pieces, finds islands in linked pieces, and chooses within islands."""
    reach = matches.groupBy(*names, "_from").agg(F.max("m.end").alias("_reach"))
    along = Window.partitionBy(*names).orderBy("_from")
    linked = F.max("_reach").over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("_from")
    first = reach.withColumn("_new", F.when(linked, F.lit(None)).otherwise(F.col("_from")))
    # a piece is named by the first one of those that it is linked with
    chains = first.select(*names, "_from", F.last("_new", ignorenulls=True).over(along).alias("_chain"))
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in (*names, "_from")]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = matches.alias("a").join(chains.alias("b"), condition).select(*(F.col(f"a.{n}") for n in names), "b._chain", "a.m")
    by_start = Window.partitionBy(*names, "_chain").orderBy("m.start", "m.end")
    before = F.max("m.end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = joined.withColumn("_open", F.when(F.col("m.start") <= before, F.lit(None)).otherwise(F.col("m.start")))
    islands = opened.withColumn("_island", F.last("_open", ignorenulls=True).over(by_start))
    grouped = islands.groupBy(*names, "_chain", "_island").agg(F.collect_list("m").alias("found"))
    return grouped.select(*names, F.inline(resolve(_searched(F.col("found")))))


_RULE_STEP = 1 << 44


def _searched(found: Column) -> Column:
    """What the rules' own searches come upon in an island, checked: from every match on at its end."""
    ordered = F.transform(
        F.sort_array(F.transform(found, lambda m: F.struct(m["ord"].alias("ord"), m["start"].alias("start"), m.alias("m")))),
        lambda o: F.struct((o["ord"] * F.lit(_RULE_STEP) + o["start"] + 1).alias("code"), (o["m"]["end"] - o["start"]).alias("size"), o["m"].alias("m")),
    )

    def advance(at, o):
        free = F.when(o["m"]["strict"], o["code"] > at).otherwise(o["code"] >= at)
        return F.when(free, o["code"] + o["size"]).otherwise(at)

    def choose(items):
        return F.transform(F.array(items), lambda a: F.struct(a.alias("items"), running(a, advance).alias("ends")))[0]

    def kept(pair):
        taken = F.filter(pair["items"], lambda o, i: F.get(pair["ends"], i) != F.coalesce(F.get(pair["ends"], i - 1), F.lit(0)))
        valid = F.filter(taken, lambda o: validate(o["m"]["validator"], o["m"]["value"]))
        return F.transform(
            valid,
            lambda o: F.struct(
                o["m"]["start"].alias("start"), (-o["m"]["end"]).alias("neg_end"), o["m"]["ord"].alias("ord"), o["m"]["kind"].alias("kind"), o["m"]["value"].alias("value")
            ),
        )

    return F.transform(F.array(choose(ordered)), kept)[0]
