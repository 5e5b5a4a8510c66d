"""Queries of the operators for training data, and their SQL twins where SQL can express them on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwarden.llm import bpe, garble, leakage, overlap, pairs, token_count
from lexwarden.llm import components as C
from lexwarden.llm import quotas as Q
from lexwarden.session import table

#: Folder of the public vocabulary files, the same on every worker.
TOKENIZERS = os.environ.get("LEXWARDEN_TOKENIZERS", "/opt/tokenizers")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.pool(table(spark, sf_dir, "predictions"), "predictions").unionByName(Q.pool(table(spark, sf_dir, "sea_examples"), "sea_examples"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose pool is too small."""
    return Q.short_targets(_pools(spark, sf_dir), table(spark, sf_dir, "sample_targets"))


def p1_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target wants, what the pool has for it, and what is missing."""
    return Q.shortfalls(_pools(spark, sf_dir), table(spark, sf_dir, "sample_targets")).withColumn("wanted", F.round("wanted", 6))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target wanted, had and drew."""
    return Q.draw_sample(_pools(spark, sf_dir), table(spark, sf_dir, "sample_targets"))[1]


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every plan."""
    return Q.draw_sample(_pools(spark, sf_dir), table(spark, sf_dir, "sample_targets"))[0]


def p1_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct examples of the pool that belong to each target."""
    return Q.available(_pools(spark, sf_dir), table(spark, sf_dir, "sample_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a response label and a defective response, with the defect."""
    return pairs.broken_pairs(table(spark, sf_dir, "nemotron_raw"), "raw_id", "prompt", "response", "response_label")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by language."""
    rows = table(spark, sf_dir, "nemotron_raw").select("raw_id", "language")
    return p2_found(spark, sf_dir).join(rows, "raw_id").groupBy("language", "defect").agg(F.count("*").alias("n_records"))


def _prompt_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "canonical_examples")
    held = F.when(F.col("source_split") == "train", False).when(F.col("source_split").isin("valid", "test"), True)
    return overlap.normal_texts(rows, "prompt", held, [F.col("row_id"), F.col("source_split"), F.col("dataset_source")])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and a valid or test row with the same or near-same prompt."""
    rows, forms = _prompt_forms(spark, sf_dir)
    return overlap.row_pairs(rows, overlap.linked_forms(forms), "row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows and pairs by held split and the sources of both sides."""
    rows, forms = _prompt_forms(spark, sf_dir)
    return overlap.overlap_report(rows, overlap.linked_forms(forms), ["source_split", "dataset_source"])


def _entities() -> list[Column]:
    return [C.source_key(F.col("source_id")), F.col("source_id")]


def _source_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.entity_components(table(spark, sf_dir, "canonical_examples"), "row_id", _entities())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose source has rows in more than one delivered split."""
    return C.scattered_rows(table(spark, sf_dir, "canonical_examples"), "row_id", _entities(), "source_split").select(F.col("row_key").alias("row_id"))


def p5_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over sources and prompts that come again, which link sources to chains: how many have how many rows."""
    rows = table(spark, sf_dir, "canonical_examples")
    members = C.entity_components(rows, "row_id", [C.source_key(F.col("source_id")), F.sha2("prompt", 256)])
    return members.groupBy("component").agg(F.count("*").alias("n_rows")).groupBy("n_rows").agg(F.count("*").alias("n_components"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row, all rows of a source in one."""
    assigned = C.assign_splits(_source_members(spark, sf_dir), table(spark, sf_dir, "split_targets"))
    return assigned.select(F.col("row_key").alias("row_id"), "assigned_split")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised shares of the splits."""
    targets = table(spark, sf_dir, "split_targets")
    return C.split_report(C.assign_splits(_source_members(spark, sf_dir), targets), targets)


def _counted(spark: SparkSession, sf_dir: str, exact: bool = True) -> DataFrame:
    rows = table(spark, sf_dir, "canonical_examples")
    keep = ["row_id", "dataset_source", "language", F.col("category_scope").alias("domain")]
    return token_count.token_counts(rows, "text", f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", keep, exact)


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text by byte_bpe_multi_50k, with its slice."""
    return _counted(spark, sf_dir)


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source, language and domain."""
    return token_count.token_budget(_counted(spark, sf_dir), ["dataset_source", "language", "domain"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they hold."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of the item and the passage's place in the original text."""
    return _leaks(spark, sf_dir).withColumn("share", F.round("share", 4))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items and documents by benchmark."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "benchmark")
    found = _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return items.join(found, "item_id", "left").groupBy("benchmark").agg(
        F.count("*").alias("n_items"), F.count("n_docs").alias("n_leaked"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_doc_items")
    )


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents, how they were misread, and the restored text where it can be had."""
    return garble.garbled_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents."""
    return p9_restored(spark, sf_dir).select("doc_id")


_SOURCE_SQL = """
SELECT row_id, source_split, CASE
  WHEN source_id IS NULL THEN 'row:' || row_id
  WHEN regexp_matches(p, '^([0-9a-f]{20}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$') OR NOT regexp_matches(p, pat) THEN '=' || p
  ELSE regexp_extract(p, pat, 1) || '#' || CASE WHEN regexp_extract(p, pat, 2) <> '' THEN regexp_extract(p, pat, 2)
       ELSE CAST(CAST(regexp_extract(p, pat, 3) AS BIGINT) AS VARCHAR) END END AS k
FROM (SELECT *, lower(regexp_replace(source_id, '^\\s+|\\s+$', '', 'g')) AS p,
      '^([a-z][a-z0-9]*?)(?:[-_: ]0*([0-9]+)|([0-9]{9}))(?:[-_.:/ ][a-z]{2,3}(?:[-_][a-z]{2,4})?)?$' AS pat FROM canonical_examples)
"""

_ORACLE = {
    "p1_found": """
WITH pool AS (
  SELECT 'predictions' AS pool_table, example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END AS language, view, lower(trim(subset)) AS subset FROM predictions
  UNION ALL
  SELECT 'sea_examples', example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END, view, lower(trim(subset)) FROM sea_examples)
SELECT t.target_id FROM sample_targets t LEFT JOIN pool p ON p.pool_table = t.pool_table
  AND (t.language IS NULL OR t.language = p.language) AND (t.view IS NULL OR t.view = p.view) AND (t.subset IS NULL OR t.subset = p.subset)
GROUP BY t.target_id, t.min_rows, t.share, t.sample_size
HAVING count(DISTINCT p.example_id) < greatest(CAST(t.min_rows AS DOUBLE), t.share * t.sample_size)""",
    "p1_shortfalls": """
WITH pool AS (
  SELECT 'predictions' AS pool_table, example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END AS language, view, lower(trim(subset)) AS subset FROM predictions
  UNION ALL
  SELECT 'sea_examples', example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END, view, lower(trim(subset)) FROM sea_examples),
t AS (SELECT target_id, plan, greatest(CAST(min_rows AS DOUBLE), share * sample_size) AS wanted, (SELECT count(DISTINCT p.example_id) FROM pool p WHERE p.pool_table = t.pool_table
  AND (t.language IS NULL OR t.language = p.language) AND (t.view IS NULL OR t.view = p.view) AND (t.subset IS NULL OR t.subset = p.subset)) AS available FROM sample_targets t)
SELECT target_id, plan, available, round(wanted, 6) AS wanted, greatest(0, CAST(ceil(wanted) AS BIGINT) - available) AS missing, available >= wanted AS met FROM t""",
    "p1_available": """
WITH pool AS (
  SELECT 'predictions' AS pool_table, example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END AS language, view, lower(trim(subset)) AS subset FROM predictions
  UNION ALL
  SELECT 'sea_examples', example_id, CASE WHEN language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE language END, view, lower(trim(subset)) FROM sea_examples)
SELECT t.target_id, count(DISTINCT p.example_id) AS available FROM sample_targets t LEFT JOIN pool p ON p.pool_table = t.pool_table
  AND (t.language IS NULL OR t.language = p.language) AND (t.view IS NULL OR t.view = p.view) AND (t.subset IS NULL OR t.subset = p.subset)
GROUP BY t.target_id""",
    "p5_found": f"""
WITH s AS ({_SOURCE_SQL})
SELECT row_id FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(DISTINCT coalesce(source_split, '')) > 1)""",
}

_QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_shortfalls, p1_sample, p1_available, p2_found, p2_report, p4_found, p4_report, p5_found, p5_splits, p5_report, p5_linked, p6_tokens, p6_budget, p7_ids, p8_found, p8_passages, p8_report, p9_found, p9_restored)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(_ORACLE)
