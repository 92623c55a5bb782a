"""Registered queries of the subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import (
    dialogue_repair, edit_match, html_text, packing, partenum, periodic_runs, quality, suffix_dedup, suffix_tree, token_files, toxicity, url_filter, word_windows)
from wiretally.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.rule_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
                                          ("net", "/es/", "block"), ("net", "/fr/", "block")])
    # The list: canonical URLs of pages on advertising hosts.
    listed = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).where(
        F.col("host").rlike(r"(^|\.)ads?[-.0-9]")).distinct()
    return url_filter.judge_urls(pages, rules, listed)


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), 4, (85, 100))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_match.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repair_digests(table(spark, sf_dir, "conversations"), damage=True)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


@query
def op13_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op13_count_min"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM texts, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, unnest(range(20)) AS t(j)),
words AS (SELECT doc_id, i, w[i] AS word FROM texts, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""

ORACLES["op11_dialogue_repair"] = r"""
WITH RECURSIVE
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                         lambda a, b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295) % 20 AS code
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, E' \t\n\x0B\x0C\r') AS bare FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
put(source, state, cost, edits, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
         (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
goes(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
  SELECT j.conv_id, j.i, s.state, s.state AS after, 4 AS cost, 'D' AS edit, []::VARCHAR[] AS lines FROM judged j, (VALUES (0), (1), (2), (3)) s(state)
  UNION ALL
  SELECT j.conv_id, j.i, g.state, g.after, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text]
  FROM judged j JOIN goes g ON left(role, 1) = g.initial WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT j.conv_id, j.i, g.state, g.after, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE g.initial WHEN 'a' THEN 'assistant:' ELSE 'user:' END || text]
  FROM judged j JOIN goes g ON g.initial IN ('u', 'a') WHERE fault NOT IN ('blank', 'duplicate')),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS path FROM conversations
  UNION ALL
  SELECT p.conv_id, e.i, e.after, min({'cost': path.cost + u.cost + e.cost, 'audit': path.audit || u.edits || e.edit, 'lines': path.lines || u.lines || e.lines})
  FROM paths p JOIN put u ON u.source = p.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i + 1 AND e.state = u.state
  GROUP BY p.conv_id, e.i, e.after),
repaired AS (
  SELECT p.conv_id, min({'cost': path.cost + u.cost, 'audit': path.audit || u.edits, 'lines': path.lines || u.lines}) AS best
  FROM paths p LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id JOIN put u ON u.source = p.state AND (u.state = 3 OR u.state = 0)
  WHERE p.i = coalesce(c.n, 0) GROUP BY p.conv_id)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM repaired r LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""
