"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from .bpe import digest, encode_documents
from .chat import digests, format_conversations, message_events
from .common import fold_of, table
from .decontaminate import contamination
from .lm import score_documents
from .neighbours import nearest
from .packing import crc, pack_documents
from .passages import repeated_passages
from .pii import span_digests
from .runs import periodic_runs, run_digests, with_planted_repeats
from .simhash import simhash_components
from .toxicity import score_toxicity
from .tries import numbered_turns, prefix_trie, rebuilt
from .urls import judge_urls, rules_frame, weak_label


#: (verdict, host/path) of the fixed rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_chat_formatting(spark, sf_dir):
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(message_events(rows)))


def op4_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_language_model(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) == 2)


def op6_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe_round_trip(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest)


def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", weak_label(F.col("url"), F.col("html")).alias("label"))
    return judge_urls(pages, rules_frame(spark, URL_RULES))


def op9_personal_data(spark, sf_dir):
    return span_digests(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), result=crc)


def op12_periodic_runs(spark, sf_dir):
    return run_digests(periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents"))))


def op13_prefix_trie(spark, sf_dir):
    conv = F.col("conv_id")
    return prefix_trie(rebuilt(numbered_turns(table(spark, sf_dir, "conversations")), conv - conv % 100, fold_of("conv_id", 6)))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_model": op5_language_model,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_url_filter": op8_url_filter,
    "op9_personal_data": op9_personal_data,
    "op10_toxicity": op10_toxicity,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op3_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), longer AS (
  SELECT *, length(regexp_replace(role, '([\\<\[\]])', 'xx', 'g')) + length(regexp_replace(text, '([\\<\[\]])', 'xx', 'g')) + 11 AS n FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM longer GROUP BY conv_id""",
    "op6_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
cov AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit)),
runs AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS z FROM cov GROUP BY doc_id, g),
sp AS (SELECT doc_id, list({{'start': a, 'end': z}} ORDER BY a) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(spans, []) AS spans
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN sp USING (doc_id)""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, count(*) AS own_n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: [CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 6 AS h
  FROM own GROUP BY conv_id
), turns AS (
  SELECT i.conv_id, o.k AS depth, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND o.k <= h
  UNION ALL
  SELECT i.conv_id, least(i.h, coalesce(b.own_n, 0)) + o.k - i.h, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.k > i.h LEFT JOIN ids b ON b.conv_id = i.conv_id - i.conv_id % 100
), paths AS (
  SELECT conv_id, depth, length(text) AS n_chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), whole AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM paths),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_chars) AS n_chars,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM whole GROUP BY node, depth
), up AS (SELECT x.node, p.conv_id AS parent_conv_id, p.node AS parent FROM nodes x JOIN paths a ON a.conv_id = x.conv_id AND a.depth = x.depth - 1 JOIN nodes p ON p.node = a.node AND p.depth = a.depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
sums AS (
  SELECT a.node, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * x.n_chars) AS saved_tokens
  FROM nodes x LEFT JOIN kids USING (node) JOIN paths a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.node
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes LEFT JOIN up USING (node) LEFT JOIN kids USING (node) JOIN sums USING (node)""",
}
