"""The registered queries of the training-data operators, each over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.llm import bond_negatives, byte_bpe, chat_format, decision_list, license_scan, line_blocks, line_crf, phrase_index, simhash, suffix_dedup, token_align, url_rules, warc
from tracesift.llm.common import read_table, written

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_multi_50k.tiktoken"


#: The rules of the contract: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_rules.judge(pages, ["page_id"], "url", url_rules.rule_table(spark, RULES))


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), chosen AS (
  SELECT cut.*, (SELECT {'rule': rule_host || rule_path, 'verdict': verdict} FROM rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ORDER BY length(rule_host || rule_path) DESC LIMIT 1) AS best FROM cut
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM chosen
"""

#: The conversation that the query adds: a user's and an assistant's row, both of control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [F.struct(F.lit(-1).cast("long"), F.lit(i).cast("long"), F.lit(role), F.lit(HARD_TEXT)) for i, role in enumerate(("user", "assistant"))]
    added = spark.range(1).select(F.inline(F.array(*hard))).toDF(*rows.columns)
    made = chat_format.format_chats(rows.union(added), "conv_id", "turn", "role", "text")
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat_format.masked_text(F.col("formatted"), F.col("mask"))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, role = 'assistant' AS own, contains(role, chr(10)) AS broken,
    contains(role || chr(10) || text, CASE WHEN role = 'assistant' THEN '</s>' ELSE ' [/INST]' END) AS clash,
    len(regexp_extract_all(role || chr(10) || text, '[\[<]\\*/?(?:INST\]|s>)')) AS controls,
    length(role) - length(replace(replace(role, chr(10), ''), chr(92), '')) AS breaks
  FROM turns
), steps AS (
  SELECT conv_id, CASE WHEN bool_or(broken) THEN 2 WHEN bool_or(clash) THEN 1 ELSE 0 END AS step FROM marked GROUP BY conv_id
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN own THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN own THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + 1 + length(text) + CASE WHEN own THEN 7 ELSE 15 END + CASE WHEN step > 0 THEN controls ELSE 0 END
    + CASE WHEN step > 1 THEN breaks ELSE 0 END) + any_value(CASE WHEN step > 0 THEN step + 2 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked JOIN steps USING (conv_id) GROUP BY conv_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text", radius=4, shingle=4, seed=42)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write_archives(pages, "page_id", "url", "html"))
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    records = warc.read_records(warc.look_up(index, keys))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), hashed AS (SELECT *, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM payloads
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hashed
"""

#: A score from this on counts as label 1.
QUALITY_THRESHOLD = 0.3


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    weights, ties = line_crf.train(docs, labels, "doc_id", "text", "quality")
    scored = line_crf.score(docs, ["doc_id"], "text", weights, ties)
    return scored.select(
        "doc_id",
        line_crf.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    stats = written(decision_list.statistics(docs, "doc_id", "text"), "statistics")
    rules = decision_list.train(stats, labels, "doc_id", "quality")
    return stats.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        decision_list.base_failed().alias("base_failed"),
        (~decision_list.base_failed() & decision_list.verdict(rules)).alias("kept"),
    )


def op6_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = phrase_index.contamination(docs, "doc_id", "text", tests, "item_id", "text", width=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        phrase_index.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


PHRASE_SQL = r"""
WITH tests AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + 12) AS w
  FROM tests, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS r(i) WHERE len(words) > 0
), docs AS (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), sizes AS (SELECT DISTINCT len(w) AS n FROM windows
), places AS (
  SELECT row_id, i, n, list_slice(words, i, i + n - 1) AS w
  FROM docs, sizes, unnest(range(1, len(words) - n + 2)) AS r(i) WHERE len(words) >= n
), hits AS (
  SELECT row_id, i, n, item_id FROM places JOIN windows USING (w)
), covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS r(k) GROUP BY row_id
), items AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN items USING (row_id)
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = public_tokenizers.path(RANKS)
    # decoded where it was encoded: a second Python worker for each task would cost memory
    tokens = byte_bpe.encode(docs, ["doc_id"], "text", path, public_tokenizers.PATTERN, with_data=True)
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffix_dedup.remove_repeats(docs, "doc_id", "text", width=100).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


REPEATS_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS data, hex(encode(coalesce(text, ''))) AS digits FROM documents
), sized AS (SELECT *, octet_length(data) AS n FROM docs
), windows AS (
  SELECT doc_id, s, substr(digits, CAST(2 * s + 1 AS INTEGER), 200) AS w FROM sized, unnest(range(0, n - 99)) AS r(s) WHERE n >= 100
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1
), marked AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM again
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS e
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked) GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_here FROM spans
), kept AS (
  SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last,
    string_agg(substr(digits, CAST(2 * from_here + 1 AS INTEGER), CAST(2 * (a - from_here) AS INTEGER)), '' ORDER BY a) AS digits
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.digits, '') || substr(d.digits, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM sized d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    exact = F.size(F.filter("found", lambda f: f["missing"] + f["extra"] == 0))
    return found.select(
        "doc_id",
        F.col("n_candidates").cast("long").alias("n_candidates"),
        F.size("found").cast("long").alias("n_found"),
        exact.cast("long").alias("n_exact"),
        F.array_join(names, ",").alias("licenses"),
    )


def op11_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id"), changed, F.col("embedding"))


NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS row_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.row_id, a.vec_id AS anchor_id, a.label = r.label AS same, a.row_id = r.row_id AS own, r.vec_id,
    CAST(list_sum(list_transform(range(1, least(len(a.q), len(r.q)) + 1), lambda i: a.q[i] * r.q[i])) AS BIGINT) AS score
  FROM vectors a, vectors r WHERE a.vec_id % 50 = 0
), near AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id NULLS LAST) AS nth FROM pairs WHERE same AND NOT own
), hard AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.row_id, p.nth ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank
  FROM near p JOIN pairs n ON n.row_id = p.row_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
  WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 3
"""


def op12_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(read_table(spark, sf_dir, "pages"), ["page_id", "url"], "html")


#: Pages with one article, of these elements and references only; so are all of the table.
BLOCKS_SQL = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages
), spaced AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS body FROM articles
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[ \n]+', ' ', 'g')) AS text FROM spaced
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""

#: The vocabulary files of the two tokenizers that are aligned.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    aligned = token_align.align(docs, ["doc_id"], "text", public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Query] = {
    "op1_url_rules": op1_url_rules,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_line_crf": op5_line_crf,
    "op6_phrase_index": op6_phrase_index,
    "op7_decision_list": op7_decision_list,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_bond_negatives": op11_bond_negatives,
    "op12_line_blocks": op12_line_blocks,
    "op13_token_align": op13_token_align,
}

ORACLES: dict[str, str] = {
    "op1_url_rules": URL_SQL,
    "op2_chat_format": CHAT_SQL,
    "op4_warc": WARC_SQL,
    "op6_phrase_index": PHRASE_SQL,
    "op9_suffix_dedup": REPEATS_SQL,
    "op11_bond_negatives": NEGATIVES_SQL,
    "op12_line_blocks": BLOCKS_SQL,
}
