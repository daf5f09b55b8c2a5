"""The registered queries as SQL for another engine, for cross-checking.

The SQL follows the definition directly: context characters are consumed, and
the search resumes at the end of the last token, one match per recursion step.
"""

from string import ascii_lowercase, ascii_uppercase, digits

from tracesift.operators import rule_data, shape_data
from tracesift.plans import corpus_data
from tracesift.plans.planted import N_RULES
from tracesift.plans.planted import SEED as PLANT_SEED

# word characters, as this SQL dialect's expressions must spell them: letters and what counts as alphabetic
# (letter numbers, circled and squared letters), marks, decimal digits, connectors and joiners
_CIRCLED = r"\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
_W = rf"\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}{_CIRCLED}\x{{200C}}\x{{200D}}"
_IN, _OUT = f"[{_W}]", f"[^{_W}]"


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- checks -----------------------------------------------------------------


def digits_sql(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn_sql(v: str) -> str:
    d = digits_sql(v)
    step = "(CASE WHEN i % 2 = 0 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)"
    terms = (
        f"list_transform(list_transform(range(0, length({d})), "
        f"lambda i: {{'i': i, 'x': substr({d}, (length({d}) - i)::INT, 1)::INT}}), "
        f"lambda s: {step.replace('i %', 's.i %').replace('x', 's.x')})"
    )
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum({terms}) % 10 = 0)"


def mod97_sql(v: str) -> str:
    codes = (
        f"list_transform(string_split({v}, ''), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    )
    return f"list_reduce(list_prepend(0, {codes}), lambda a, x: (CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END) % 97)"


def iban_sql(v: str) -> str:
    c = f"regexp_replace({v}, '\\s', '', 'g')"
    shaped = f"regexp_full_match({c}, '[A-Z0-9]{{15,34}}')"
    return f"(CASE WHEN {shaped} THEN {mod97_sql(f'(substr({c}, 5) || substr({c}, 1, 4))')} = 1 ELSE false END)"


def phone_sql(v: str) -> str:
    d = r"\p{Nd}"
    plain = f"regexp_full_match({v}, '{d}{{3}}[ .-]?{d}{{3}}[ .-]?{d}{{4}}')"
    return f"(length({digits_sql(v)}) BETWEEN 8 AND 15 AND (left({v}, 1) IN ('+', '(', '0') OR {plain}))"


# --- scan -------------------------------------------------------------------


def _rules() -> list[tuple]:
    """(ord, kind, validator, anchors, pattern, overlap of the resumed search)"""
    rows = [
        (i, kind, "none", anchors, f"[^{rule_data.TOKEN_GLUE}]({pattern})[^{rule_data.TOKEN_GLUE}]", 0)
        for i, (kind, pattern, anchors) in enumerate(rule_data.TOKEN_RULES)
    ]
    local, label, tld = rule_data.EMAIL_LOCAL, rule_data.EMAIL_LABEL, rule_data.EMAIL_TLD
    rest = rf"{local}*@{label}+(?:\.{label}+)*\.{tld}"
    email = rf"(?:{_OUT}([A-Za-z0-9_]{rest})|{_IN}([.%+-]{rest})){_OUT}"
    iban, card, phone = (
        b.replace(r"\d", r"\p{Nd}") for b in (rule_data.IBAN_BODY, rule_data.CARD_BODY, rule_data.PHONE_BODY)
    )
    rows += [
        (70, "email", "none", ["@"], email, 1),
        (71, "iban", "iban", [], f"{_OUT}({iban}){_OUT}", 1),
        (72, "credit_card", "luhn", [], f"{_OUT}({card}){_OUT}", 1),
        (73, "phone", "phone", [], f"[^{rule_data.PHONE_GLUE_LEFT}]({phone})[^{rule_data.PHONE_GLUE_RIGHT}]", 0),
    ]
    return rows


def _search_sql(name: str, start: str, key: str, regex: str, found: str, overlap: int) -> str:
    """All matches, one per step; ``overlap`` characters of a match are seen again."""
    return f"""
search_{name}(key, ord, kind, re, rest, base, whole, token) AS (
  SELECT {key}, ord, kind, re, rest, 0::BIGINT, regexp_extract(rest, {regex}, 0), {found} FROM ({start})
  UNION ALL
  SELECT key, ord, kind, re, rest, base, regexp_extract(rest, {regex}, 0), {found}
  FROM (SELECT key, ord, kind, re,
               substr(rest, instr(rest, whole) + 1 + length(token) - {overlap}) AS rest,
               base + strlen(substr(rest, 1, instr(rest, whole) + length(token) - {overlap})) AS base
        FROM search_{name} WHERE whole <> '')
)"""


def scan_sql(source: str, key: str = "doc_id", kinds: list[str] | None = None) -> str:
    """Common table expressions ending in ``findings(key, kind, value, start, end)``.

    ``source`` is a query giving ``key`` and ``text``.
    """
    rows = [r for r in _rules() if kinds is None or r[1] in kinds]
    tokens, checked = [r for r in rows if r[0] < N_RULES], [r for r in rows if r[0] >= N_RULES]
    tables, names = [], []
    if tokens:
        values = ",\n".join(
            f"({o}, {quote(k)}, [{', '.join(map(quote, a))}]::VARCHAR[], {quote(p)})" for o, k, _, a, p, _ in tokens
        )
        start = """SELECT s.{key}, r.ord, r.kind, r.re, chr(10) || s.text || chr(10) AS rest FROM src s JOIN rules r
        ON len(list_filter(r.anchors, lambda a: contains(s.text, a))) > 0""".format(key=key)
        tables.append(f"rules(ord, kind, anchors, re) AS (VALUES\n{values})")
        tables.append(_search_sql("tokens", start, key, "re", "regexp_extract(rest, re, 1)", 0))
        names.append(("tokens", "true"))
    for o, kind, validator, _, pattern, overlap in checked:
        # one search per kind, so that its expression is a constant
        start = f"SELECT {key}, {o} AS ord, {quote(kind)} AS kind, '' AS re, chr(10) || text || chr(10) AS rest FROM src"
        found = f"regexp_extract(rest, {quote(pattern)}, 1)"
        if kind == "email":
            found = f"CASE WHEN {found} <> '' THEN {found} ELSE regexp_extract(rest, {quote(pattern)}, 2) END"
        tables.append(_search_sql(kind, start, key, quote(pattern), found, overlap))
        names.append((kind, {"none": "true", "iban": iban_sql("value"), "luhn": luhn_sql("value"), "phone": phone_sql("value")}[validator]))
    located = "\n  UNION ALL ".join(
        f"""SELECT * FROM (SELECT key, ord, kind, token AS value, base + strlen(substr(rest, 1, instr(rest, whole))) - 1 AS "start"
  FROM search_{name} WHERE whole <> '') WHERE {check}"""
        for name, check in names
    )
    return f"""
src AS ({source}),
{",".join(tables)},
located AS ({located}),
checked AS (
  SELECT key, kind, value, "start", "start" + strlen(value) AS "end",
         row_number() OVER (PARTITION BY key ORDER BY "start", strlen(value) DESC, ord) AS rn
  FROM located
),
sweep(key, rn, kept, reach) AS (
  SELECT key, rn, true, "end" FROM checked WHERE rn = 1
  UNION ALL
  SELECT c.key, c.rn, c."start" >= s.reach, CASE WHEN c."start" >= s.reach THEN c."end" ELSE s.reach END
  FROM sweep s JOIN checked c ON c.key = s.key AND c.rn = s.rn + 1
),
findings AS (
  SELECT c.key, c.kind, c.value, c."start", c."end"
  FROM checked c JOIN sweep s ON c.key = s.key AND c.rn = s.rn WHERE s.kept
)"""


def findings_sql(source: str, key: str = "doc_id", kinds: list[str] | None = None) -> str:
    return f'WITH RECURSIVE {scan_sql(source, key, kinds)}\nSELECT key AS {key}, kind, value, "start", "end" FROM findings'


# --- generated values -------------------------------------------------------


class SqlDraws:
    """The picks of ``functions.draws``, spelled in SQL."""

    def __init__(self, seed: int, row_id: str):
        self.prefix = f"'{seed}:' || {row_id} || ':'"

    def below(self, tag: str, n: int) -> str:
        return f"(('0x' || substr(md5({self.prefix} || {quote(tag)}), 1, 8))::BIGINT % {n})"

    def pick(self, tag: str, options: list[str]) -> str:
        return f"([{', '.join(map(quote, options))}])[{self.below(tag, len(options))} + 1]"

    def chars(self, tag: str, alphabet: str, k) -> str:
        code = f"substr(md5({self.prefix} || {quote(tag + '.')} || (i // 8)), ((i % 8) * 4 + 1)::INT, 4)"
        letter = f"substr({quote(alphabet)}, (('0x' || {code})::BIGINT % {len(alphabet)})::INT + 1, 1)"
        return f"array_to_string(list_transform(range(0, {k}), lambda i: {letter}), '')"


def token_sql(draws: SqlDraws, rule: str, tag: str = "token") -> str:
    branches = []
    for order, (kind, _, _) in enumerate(rule_data.TOKEN_RULES):
        layouts = shape_data.layouts(kind)
        texts = []
        for layout in layouts:
            parts = []
            for i, part in enumerate(layout):
                name = f"{tag}.{i}"
                k = f"({part['low']} + {draws.below(name + '.n', part['high'] - part['low'] + 1)})"
                if part["alphabet"]:
                    parts.append(draws.chars(name, part["alphabet"], k))
                else:
                    parts.append(f"repeat({draws.pick(name + '.w', part['words'])}, {k})")
            texts.append("concat(" + ", ".join(parts) + ")")
        if len(texts) > 1:
            pick = draws.below(f"{tag}.layout", len(texts))
            text = f"CASE {pick} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(texts)) + " END"
        else:
            text = texts[0]
        branches.append(f"WHEN {order} THEN {text}")
    return f"(CASE {rule} {' '.join(branches)} END)"


def kind_sql(rule: str) -> str:
    return f"([{', '.join(quote(k) for k, _, _ in rule_data.TOKEN_RULES)}])[{rule} + 1]"


def spaced_sql(v: str) -> str:
    return f"rtrim(regexp_replace({v}, '(.{{4}})', '\\1 ', 'g'))"


def check_digits_sql(code: str, account: str) -> str:
    return f"lpad((98 - {mod97_sql(f'({account} || {code} || chr(48) || chr(48))')})::VARCHAR, 2, '0')"


def complete_sql(body: str) -> str:
    """``body`` with its check digit: the total of the other digits decides it."""
    places = f"range(0, length({body}))"
    digit = f"substr({body}, (length({body}) - i)::INT, 1)::INT"
    term = f"(CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)"
    return f"({body} || ((10 - list_sum(list_transform({places}, lambda i: {term})) % 10) % 10)::INT::VARCHAR)"


def iban_value_sql(draws: SqlDraws) -> str:
    country = draws.below("iban.cc", len(corpus_data.IBAN_COUNTRIES))
    numbers, capitals = draws.chars("iban.d", digits, 23), draws.chars("iban.u", ascii_uppercase, 4)
    whole = "CASE " + country
    for i, (code, n_capitals, n_digits) in enumerate(corpus_data.IBAN_COUNTRIES):
        account = f"(substr({capitals}, 1, {n_capitals}) || substr({numbers}, 1, {n_digits}))"
        whole += f" WHEN {i} THEN '{code}' || {check_digits_sql(quote(code), account)} || {account}"
    whole += " END"
    return f"(CASE WHEN {draws.below('iban.spaced', 2)} = 0 THEN {spaced_sql(f'({whole})')} ELSE {whole} END)"


def phone_value_sql(draws: SqlDraws) -> str:
    d = draws.chars("phone.d", digits, 8)
    area = f"(200 + {draws.below('phone.area', 700)})"
    pairs = " || ".join(f"' ' || substr({d}, {i}, 2)" for i in (1, 3, 5, 7))
    return f"""(CASE {draws.below('phone.form', 4)}
      WHEN 0 THEN '+33 6' || {pairs}
      WHEN 1 THEN '0' || (6 + {draws.below('phone.mobile', 2)}) || {pairs}
      WHEN 2 THEN '(' || {area} || ') ' || substr({d}, 1, 3) || '-' || substr({d}, 4, 4)
      ELSE '+1-' || {area} || '-' || substr({d}, 1, 3) || '-' || substr({d}, 4, 4) END)"""


def email_value_sql(draws: SqlDraws) -> str:
    c = corpus_data
    return (
        f"({draws.pick('email.first', c.FIRST_NAMES)} || '.' || {draws.pick('email.last', c.LAST_NAMES)} || '@' || "
        f"{draws.pick('email.domain', c.DOMAINS)} || '.' || {draws.pick('email.ending', c.ENDINGS)})"
    )


def card_value_sql(draws: SqlDraws) -> str:
    body = f"substr({draws.pick('card.prefix', corpus_data.CARD_PREFIXES)} || {draws.chars('card.d', digits, 15)}, 1, 15)"
    card = complete_sql(body)
    return f"(CASE WHEN {draws.below('card.spaced', 2)} = 0 THEN {spaced_sql(card)} ELSE {card} END)"


def negative_sql(draws: SqlDraws) -> str:
    n, h = draws.chars("neg.d", digits, 12), draws.chars("neg.h", "0123456789abcdef", 64)

    def s(v, start, length):
        return f"substr({v}, {start}, {length})"

    base64 = ascii_uppercase + ascii_lowercase + digits + "+/"
    day = f"lpad((1 + {draws.below('neg.day', 28)})::VARCHAR, 2, '0')"
    minute = f"lpad({draws.below('neg.minute', 60)}::VARCHAR, 2, '0')"
    word = draws.chars("neg.w", ascii_lowercase, 4)
    def line(name, *parts):
        return f"printf({quote(corpus_data.NEGATIVE_LINES[name])}, {', '.join(parts)})"

    families = [
        line("order", s(n, 1, 6), day, s(n, 1, 3), s(n, 4, 2)),
        line("commit", word, s(n, 1, 3), s(n, 4, 3), minute),
        line("digest", h),
        line("hex", s(h, 1, 40)),
        line("uuid", s(h, 1, 8), s(h, 9, 4), s(h, 13, 3), s(h, 16, 3), s(h, 19, 12)),
        draws.pick("neg.lookalike", corpus_data.LOOKALIKES),
        draws.pick("neg.plain", corpus_data.PLAIN_LINES),
        line("base64", draws.chars("neg.b64", base64, 44)),
        line("lock", h),
        line("written", s(n, 1, 7), s(n, 8, 2), s(n, 10, 3)),
        line("merged", s(n, 1, 4), s(n, 5, 2), s(n, 7, 3), s(n, 10, 2)),
        line("weather", s(n, 1, 2), s(n, 3, 1), s(n, 4, 2)),
    ]
    branches = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(families))
    return f"(CASE {draws.below('neg.family', len(families))} {branches} END)"


def labelled_sql(table: str, key: str, seed: int) -> str:
    """``id, text, kind, value`` per row; kind and value are null for negatives."""
    draws = SqlDraws(seed, key)
    rule = draws.below("rule", N_RULES)
    inner = SqlDraws(seed, "id")
    return f"""
SELECT id, CASE WHEN kind IS NULL THEN {negative_sql(inner)}
           ELSE replace({inner.pick('context', corpus_data.CONTEXTS)}, '{{}}', value) END AS text, kind, value
FROM (SELECT {key} AS id,
  CASE WHEN {key} % 10 = 0 THEN 'iban' WHEN {key} % 10 = 1 THEN 'phone' WHEN {key} % 10 = 2 THEN 'email'
       WHEN {key} % 10 = 3 THEN 'credit_card' WHEN {key} % 10 <= 6 THEN {kind_sql(rule)} END AS kind,
  CASE WHEN {key} % 10 = 0 THEN {iban_value_sql(draws)} WHEN {key} % 10 = 1 THEN {phone_value_sql(draws)}
       WHEN {key} % 10 = 2 THEN {email_value_sql(draws)} WHEN {key} % 10 = 3 THEN {card_value_sql(draws)}
       WHEN {key} % 10 <= 6 THEN {token_sql(draws, rule)} END AS value
  FROM {table})"""


# --- planted texts ----------------------------------------------------------


def planted_tokens_sql(table: str = "documents", key: str = "doc_id", text: str = "text", also: str | None = None) -> str:
    """``also`` is what identifies a row if that is not the number ``key``."""
    token = token_sql(SqlDraws(PLANT_SEED, key), f"({key} % {N_RULES})")
    return f"""SELECT {also or key}, concat({text}, ' export API_TOKEN=', tok, chr(10), 'rejected=x', tok, 'x') AS text
FROM (SELECT {also or key}, {text}, {token} AS tok FROM {table}) WHERE {text} IS NOT NULL"""


def planted_ibans_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""SELECT {key}, concat({text}, chr(10), 'IBAN ', iban, ', not ', substr(iban, 1, 2), '00', substr(iban, 5)) AS text
FROM (SELECT {key}, {text}, {iban_value_sql(SqlDraws(PLANT_SEED, key))} AS iban FROM {table}) WHERE {text} IS NOT NULL"""


def planted_edges_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    draws = SqlDraws(PLANT_SEED, key)
    block = "-----BEGIN EC PRIVATE KEY-----"
    cases = [
        "concat(a, ',', b)",
        "concat('x', a, ' ', b, '_')",
        "concat('k=glpat-', substr(a, 1, 40), '.', d)",
        "concat('ref 0', substr(d, 1, 2), '-', substr(d, 3, 2), '-', substr(d, 5, 4), ' end')",
        "'pay 4111111111111111 123'",
        f"'{block}{block} {block}'",
        "concat('déjà vu ✓ ', a, ' ü ', phone)",
        "concat('é', a, 'é éFR7630006000011234567890189')",
        "'FR７630006000011234567890189 and ４１１１111111111111'",
        "concat('mail a@b.com-x@c.de and .x@y.org, é.q@r.io ', phone)",
        "concat('id=', phone, '_', ' -', phone)",
        "concat('hvs.', a, b, '0123456789, ', a)",
        "concat('²a@b.com ½', phone, ' Ⅷc@d.org')",
        "concat('ⓐa@b.com ', 'ⓐ4111111111111111 4111111111111111²')",
    ]
    branches = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return f"""SELECT {key}, concat({text}, chr(10), CASE {key} % {len(cases)} {branches} END) AS text
FROM (SELECT {key}, {text}, 'ghp_' || {draws.chars('edge.a', '0123456789abcdef', 36)} AS a,
             'ghp_' || {draws.chars('edge.b', '0123456789abcdef', 36)} AS b,
             {draws.chars('edge.d', digits, 9)} AS d, {phone_value_sql(draws)} AS phone
      FROM {table}) WHERE {text} IS NOT NULL"""
