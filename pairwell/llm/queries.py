"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_tree, decontaminate, hidden_markov, license_scan, near_duplicates, private_data, quality, runtime, token_counts, token_files, tool_calls, url_filter

#: Listed urls (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


#: Argument schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def with_calls(messages: DataFrame) -> DataFrame:
    """Conversations with tool calls: every assistant's turn t calls c<t>, which depends on c<t - 2>, and d<t>, which depends on c<t>; a user's turn from the third on is the result of c<t - 1>."""
    turn, text = F.col("turn"), F.col("text")
    name = lambda letter, at: F.concat(F.lit(letter), at.cast("string"))
    search = F.struct(name("c", turn).alias("id"), F.lit("search").alias("name"), F.to_json(F.struct(F.substring(text, 1, 40).alias("query"), (turn - 1).alias("limit"))).alias("arguments"), F.array(name("c", turn - 2)).alias("depends_on"))
    length = F.concat(F.length(text).cast("string"), F.lit("*2"))
    calculate = F.struct(name("d", turn).alias("id"), F.lit("calculate").alias("name"), F.to_json(F.struct(length.alias("expression"))).alias("arguments"), F.array(name("c", turn)).alias("depends_on"))
    call = F.to_json(F.struct(text.alias("content"), F.array(search, calculate).alias("tool_calls")))
    result = F.to_json(F.struct(text.alias("content"), name("c", turn - 1).alias("tool_call_id")))
    said = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (turn > 1), result).otherwise(text)
    return messages.select("conv_id", "turn", "role", said.alias("text"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tool_calls.linked_messages(with_calls(runtime.table(spark, sf_dir, "conversations")), TOOLS)
    return found.withColumn("message_sha256", F.sha2(F.col("message"), 256)).drop("message")


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.private_spans(runtime.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_added")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(runtime.table(spark, sf_dir, "documents")).drop("spans")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(runtime.table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(runtime.table(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed", "kept", "distance")


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode(runtime.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(runtime.table(spark, sf_dir, "pages"), rules)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(runtime.table(spark, sf_dir, "documents"), vocabularies.path("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.shared_dir(spark)
    token_files.write(runtime.table(spark, sf_dir, "documents"), folder, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, 2)
    return token_files.read(spark, folder)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(runtime.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"))


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.scores(runtime.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_private_data, op3_license_scan, op4_ngram_jaccard, op5_quality, op6_bpe_tree, op7_url_filter, op8_token_counts, op9_token_files, op10_decontaminate, op11_token_alignment, op12_hidden_markov)}

ORACLE = {
    "op1_tool_calls": r"""
WITH turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS place FROM conversations WHERE role = 'assistant'),
called AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn - 2 * place ORDER BY turn) - 1 AS level FROM turns),
answered AS (SELECT conv_id, turn - 1 AS turn, turn AS result_turn FROM conversations WHERE role = 'user' AND turn > 1),
said AS (SELECT m.conv_id, m.turn, role, text, level, result_turn, CAST(to_json(text) AS VARCHAR) AS content, CASE WHEN m.turn < 2 THEN '$.limit: out of bounds' WHEN text = '' THEN '$.query: wrong length' END AS error
  FROM conversations m LEFT JOIN called c ON m.conv_id = c.conv_id AND m.turn = c.turn LEFT JOIN answered a ON m.conv_id = a.conv_id AND m.turn = a.turn),
linked AS (SELECT s.*, CASE WHEN role = 'user' AND s.turn > 1 THEN CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END END AS link FROM said s LEFT JOIN called c ON s.conv_id = c.conv_id AND s.turn - 1 = c.turn)
SELECT conv_id, turn, role, CAST(CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS BIGINT) AS n_calls, CAST(CASE WHEN role <> 'assistant' THEN 0 WHEN error IS NULL THEN 2 ELSE 1 END AS BIGINT) AS n_valid,
  CAST(CASE WHEN role = 'assistant' AND result_turn IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_linked, CASE WHEN role = 'assistant' THEN level + 1 END AS max_level, link,
  sha256('{"content":' || content || CASE WHEN role = 'assistant' THEN ',"role":"assistant","tool_calls":[{"arguments":{"limit":' || (turn - 1) || ',"query":' || CAST(to_json(substr(text, 1, 40)) AS VARCHAR) || '},' || coalesce('"error":"' || error || '",', '') || '"id":"c' || turn || '","level":' || level || ',"name":"search","result_turn":' || coalesce(CAST(result_turn AS VARCHAR), 'null')
      || '},{"arguments":{"expression":"' || length(text) || '*2"},"id":"d' || turn || '","level":' || (level + 1) || ',"name":"calculate","result_turn":null}]}'
    WHEN link IS NOT NULL THEN ',"link":"' || link || '","role":"user","tool_call_id":"c' || (turn - 1) || '"}' ELSE ',"role":"' || role || '"}' END) AS message_sha256
FROM linked
""",
    "op3_license_scan": license_scan.oracle(),
    "op7_url_filter": r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fit AS (SELECT k, arg_min(r_host || r_path, (-length(r_host || r_path), r_host || r_path)) AS rule, arg_min(r_verdict, (-length(r_host || r_path), r_host || r_path)) AS verdict
  FROM cut JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (k)
""",
    "op10_decontaminate": r"""
WITH dw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT k, i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND p.g = v.g),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, i, n FROM hits), unnest(range(i, i + n)) AS t(j) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (k) LEFT JOIN named USING (k)
""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY k),
classes AS (SELECT same, min(k) AS rep, min(doc_id) AS class_id, any_value(n) AS n FROM n JOIN w USING (k) GROUP BY same),
cs AS (SELECT k, g FROM s JOIN classes ON k = rep),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM cs a JOIN cs b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN classes x ON a = x.rep JOIN classes y ON b = y.rep WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(k, least_id) AS (SELECT rep, class_id FROM classes UNION SELECT b, least_id FROM reach JOIN links ON k = a),
found AS (SELECT k AS rep, min(least_id) AS component_id FROM reach GROUP BY k)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id
FROM w LEFT JOIN n USING (k) LEFT JOIN classes USING (same) LEFT JOIN found USING (rep)
""",
}
