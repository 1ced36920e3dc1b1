"""The registered queries of the operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, chunkdedup, licenses, neardup, packing, tokencount, topk, toxicity
from .common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS, capacity=4096, end_id=1)


def op4_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), PIECES, limit=4096)


#: The registered tools, against which calls are validated: name, required arguments, types.
TOOLS = [("lookup", ["order", "status"], {"order": "integer", "status": "string"}), ("refund", ["order", "amount"], {"order": "integer", "amount": "number"})]


def known_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOOLS, "name string, required array<string>, types map<string,string>")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), known_tools(spark))


def chat_planted_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``format_chats`` over conversations made of whole tables, as those given hold no calls: each order is an assistant message with
    two calls (one of them of a tool that may be unknown or lack an argument), each first line of an order a
    result, some before their call and some of no call."""
    order = F.col("o_orderkey").cast("string")
    call = lambda i, name, args: F.concat(F.lit('<tool_call>{"id":"'), i, F.lit('","name":"'), name, F.lit('","arguments":{'), args, F.lit("}}</tool_call>"))
    kind = F.element_at(F.array(F.lit("lookup"), F.lit("refund"), F.lit("ghost")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    arguments = F.concat(F.lit('"status": "'), F.col("o_orderstatus"), F.lit('", "order": '), order)
    amount = F.concat(F.lit('"order":'), order, F.lit(',"amount":'), order)
    text = F.concat(F.lit("Let me see. "), call(F.concat(F.lit("a"), order), kind, arguments), call(F.concat(F.lit("b"), order), F.lit("refund"), amount))
    orders = table(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_custkey").alias("conv_id"), (10 * F.col("o_orderkey")).alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    which = F.when(F.col("l_orderkey") % 7 == 0, F.lit("z")).when(F.col("l_linenumber") == 1, F.lit("a")).otherwise(F.lit("b"))
    answer = F.concat(F.lit('{"tool_call_id":"'), which, order, F.lit('","content":"part '), F.col("l_partkey").cast("string"), F.lit('"}'))
    late = 10 * F.col("o_orderkey") + F.when(F.col("l_orderkey") % 5 == 0, -F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    told = lines.select(F.col("o_custkey").alias("conv_id"), late.alias("turn"), F.lit("tool").alias("role"), answer.alias("text"))
    return chat.format_chats(asked.unionByName(told), known_tools(spark))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bpe_round_trip, op2_exact_topk, op3_best_fit_packing, op4_approximate_neighbours, op5_near_duplicates, op6_toxicity,
        op7_substring_dedup, op8_token_counts, op9_chat_formatting, chat_planted_tool_calls, op10_license_scan,
    )
    return {f.__name__: f for f in found}


def _canonical_sql(text: str) -> str:
    """The canonical form by rules of its own: regular expressions on word ends. Copyright statements are whole lines here."""
    rules = [
        (r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " "), (r"[^\p{L}\p{N}]+", " "), (r"\b(sub)?licenc(e|es|ed|ing)\b", r"\1licens\2"), (r"\borganisation(s?)\b", r"organization\1"),
        (r"\b(col|fav)our\b", r"\1or"), (r"\bnon commercial\b", "noncommercial"), (r"\bsub license\b", "sublicense"), (r"\bcopyright holder(s?)\b", r"copyright owner\1"),
        (r"\bhttps\b", "http"), (r"\b(?:version |v)([1-4]) ([01])\b", r"\1 \2"), (r"\b(?:version |v)([234])\b", r"\1 0"),
    ]
    out = f"lower({text})"
    for pattern, by in rules:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"trim({out})"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in licenses.NOTICES)
    return {
        "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
FROM s QUALIFY "rank" <= 5""",
        "op5_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles s ON s.doc_id = w.doc_id GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sizes LEFT JOIN least ON x = doc_id""",
        "op9_chat_formatting": """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce("role", '') AS "role", coalesce(turn, -1) AS place, CAST(0 AS INTEGER) AS n_calls,
  CAST(NULL AS VARCHAR) AS call_id, CASE WHEN "role" = 'tool' THEN false END AS linked, CAST(NULL AS BOOLEAN) AS valid,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce("role", '')) AS VARCHAR) || '}' AS message
FROM conversations""",
        "chat_planted_tool_calls": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders),
r AS (
  SELECT k, c, l_linenumber AS n, l_partkey AS part, CASE WHEN k % 7 = 0 THEN 'z' WHEN l_linenumber = 1 THEN 'a' ELSE 'b' END AS what
  FROM lineitem JOIN o ON l_orderkey = k WHERE l_linenumber <= 2),
heard AS (SELECT k, bool_or(what = 'a') AND bool_or(what = 'b') AS both_heard FROM r GROUP BY 1)
SELECT c AS conv_id, 10 * k AS turn, 'assistant' AS "role", 10 * k AS place, CAST(2 AS INTEGER) AS n_calls, CAST(NULL AS VARCHAR) AS call_id,
  coalesce(both_heard, false) AS linked, k % 3 = 0 AS valid,
  '{"content":"Let me see.","role":"assistant","tool_calls":[{"arguments":{"order":' || k || ',"status":"' || s || '"},"id":"a' || k || '","name":"' ||
  CASE k % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'refund' ELSE 'ghost' END || '"},{"arguments":{"amount":' || k || ',"order":' || k || '},"id":"b' || k || '","name":"refund"}]}' AS message
FROM o LEFT JOIN heard USING (k)
UNION ALL
SELECT c, 10 * k + CASE WHEN k % 5 = 0 THEN -n ELSE n END, 'tool', CASE WHEN k % 5 = 0 AND what <> 'z' THEN 10 * k WHEN k % 5 = 0 THEN 10 * k - n ELSE 10 * k + n END, CAST(0 AS INTEGER),
  what || k, what <> 'z', CAST(NULL AS BOOLEAN), '{"content":"part ' || part || '","role":"tool","tool_call_id":"' || what || k || '"}'
FROM r""",
        "op10_license_scan": f"""
WITH known AS (
  SELECT sha256({_canonical_sql('t')}) AS digest, min(l) AS license FROM (VALUES {known}) x(l, t) GROUP BY 1),
lines AS (
  SELECT rowid_, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT row_number() OVER () AS rowid_, text FROM documents)),
hits AS (
  SELECT rowid_, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n_lines
  FROM (SELECT rowid_, sha256({_canonical_sql('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1),
docs AS (
  SELECT row_number() OVER () AS rowid_, doc_id, sha256({_canonical_sql('text')}) AS text_digest FROM documents)
SELECT doc_id, text_digest, license AS text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_lines, 0) AS n_lines
FROM docs LEFT JOIN hits USING (rowid_) LEFT JOIN known ON digest = text_digest AND text_digest <> sha256('')""",
    }
