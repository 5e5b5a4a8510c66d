"""Queries of preparation and integrity over the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwarden.functions import text as X
from lexwarden.operators import canonical, quality, sampling
from lexwarden.session import table

SPLITS = ("train", "valid", "test")
#: The template of guard prompts that the query renders.
TEMPLATE = "Categories:\n{taxonomy}\nuser: {query}\n{response_block}Rate it."


def canonical_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of the raw records."""
    rows = canonical.canonical_views(table(spark, sf_dir, "nemotron_raw"), keep=("raw_id",))
    return rows.drop("source_path", "source_line").withColumn("categories", F.array_join("categories", "|"))


def canonical_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and response recovered from the joint text."""
    prompt, response = X.split_text(F.col("text"))
    return table(spark, sf_dir, "canonical_examples").select("row_id", prompt.alias("prompt_back"), response.alias("response_back"))


def language_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by language after aliasing, prepared languages only."""
    raw = table(spark, sf_dir, "nemotron_raw").select(X.alias_language(F.col("language"), F.col("source_path")).alias("language"))
    return raw.where(F.col("language").isin(*X.LANGUAGES)).groupBy("language").agg(F.count("*").alias("n"))


def source_id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids with their fallback, and CSV-style ids."""
    c = F.col
    return table(spark, sf_dir, "nemotron_raw").select(
        "raw_id", X.source_id(c("id"), c("source_path"), c("source_line")).alias("source_id"), X.digest(F.coalesce("prompt", F.lit(""))).alias("prompt_digest"),
        X.csv_source_id(F.coalesce("language", F.lit("")), F.lit("a.csv"), c("source_line"), F.coalesce("prompt", F.lit(""))).alias("csv_id"),
    )


def category_split_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category fields split at commas."""
    return table(spark, sf_dir, "nemotron_raw").select("raw_id", F.array_join(X.naive_categories(F.col("violated_categories")), "|").alias("categories"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows after first-wins deduplication within each split."""
    rows = table(spark, sf_dir, "canonical_examples").select("row_id", "source_split", "source_id", "view", "language")
    return quality.first_wins(rows, ["source_split", "source_id", "view", "language"], ["row_id"], ["row_id"])


def prepared_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation: views of raw records, first delivery wins in order of path, line and view."""
    views = canonical.canonical_views(table(spark, sf_dir, "nemotron_raw"), keep=("raw_id",))
    keys = ["source_split", "source_id", "view", "language"]
    kept = quality.first_wins(views, keys, [quality.path_order(F.col("source_path")), F.col("source_line"), F.col("view")], ["raw_id", "view"])
    return kept.select("raw_id", *keys, "safety_label", "prompt_safety_label", "category_scope")


def split_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each split after deduplication."""
    rows = table(spark, sf_dir, "canonical_examples").select("row_id", "source_split", "source_id", "view", "language", "safety_label")
    return quality.split_counters(quality.first_wins(rows, ["source_split", "source_id", "view", "language"], ["row_id"], ["row_id"]))


def benchmark_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the test rows by dataset."""
    return quality.benchmark_counters(table(spark, sf_dir, "canonical_examples").where("source_split = 'test'"), ["dataset_source"])


def sea_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the SEA rows."""
    return quality.sea_counters(table(spark, sf_dir, "sea_examples"))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities shared by two splits."""
    return quality.split_overlap_counts(table(spark, sf_dir, "canonical_examples"), ["source_id", "language"])


def unique_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated example ids of the SEA rows."""
    return quality.duplicate_ids(table(spark, sf_dir, "sea_examples"))


def blank_text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts of the documents and raw prompts."""
    docs = quality.blank_counts(table(spark, sf_dir, "documents"), ["text", "lang", "source"])
    return docs.unionByName(quality.blank_counts(table(spark, sf_dir, "nemotron_raw"), ["prompt", "response", "id"]))


def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy with its codes."""
    return spark.createDataFrame([(f"S{i}", n) for i, n in enumerate(X.TAXONOMY, 1)], "code string, name string")


def registered_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA rows by task, with a flag for registered tasks."""
    tasks = ("safeguard_general_prompt", "safeguard_general_response")
    rows = table(spark, sf_dir, "sea_examples").withColumn("registered", F.col("seahelm_task_name").isin(*tasks))
    return rows.groupBy("seahelm_task_name", "registered").agg(F.count("*").alias("n"))


def expected_grid_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and split files that the delivery lacks, of twelve languages."""
    path = F.col("source_path")
    seen = table(spark, sf_dir, "nemotron_raw").select(F.element_at(F.split(path, "/"), -2).alias("language"), canonical.split_of_path(path).alias("split"))
    return quality.missing_grid(seen, [*X.LANGUAGES, "it", "ko", "nl"], SPLITS)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_examples").where("source_split = 'test'").select("row_id", "example_id", "language", "view")


def stratified_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of 100 test rows by language and view."""
    return sampling.allocation(_pool(spark, sf_dir), ["language", "view"], 100, "row_id")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 test rows by language and view."""
    return sampling.stratified_sample(_pool(spark, sf_dir), ["language", "view"], 100, "row_id", "row_id")


def remaining_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows that the sample left, counted by language and view."""
    rest = sampling.remaining(_pool(spark, sf_dir), stratified_sample(spark, sf_dir), "row_id")
    return rest.groupBy("language", "view").agg(F.count("*").alias("n"))


def limit_then_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 canonical rows, then first-wins deduplication (the limit is the feature)."""
    rows = table(spark, sf_dir, "canonical_examples").select("row_id", "source_split", "source_id", "view", "language")
    first = sampling.ordered_limit(rows, ["row_id"], 500)
    return quality.first_wins(first, ["source_split", "source_id", "view", "language"], ["row_id"], ["row_id"])


def target_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training targets of the canonical rows."""
    rows = table(spark, sf_dir, "canonical_examples")
    return rows.select("row_id", X.target_json(F.col("view"), F.col("safety_label"), F.col("prompt_safety_label"), F.col("categories")).alias("target"), X.target_binary(F.col("safety_label")).alias("target_binary"))


def guard_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the rendered guard prompt of each canonical row."""
    rows = table(spark, sf_dir, "canonical_examples")
    return rows.select("row_id", X.digest(X.guard_prompt(F.col("prompt"), F.col("response"), TEMPLATE)).alias("prompt_digest"))


def head_tail_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document cut to 33 from both ends, and completion labels against a target of three."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    cut = X.head_tail(words, 33)
    labels = X.completion_labels(cut, F.array(F.lit(1), F.lit(2), F.lit(3)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(cut, " ").alias("kept"), F.size(labels).cast("long").alias("n_labels"), F.size(F.filter(labels, lambda x: x == -100)).cast("long").alias("n_masked"))


def benchmark_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three benchmarks in one frame, counted."""
    rows = table(spark, sf_dir, "canonical_examples").where("source_split = 'test'")
    sea = table(spark, sf_dir, "sea_examples").where("language = 'vi'")
    named = canonical.union_all(
        rows.where("dataset_source = 'nemotron_v3'").select(F.lit("cultureguard").alias("benchmark"), "language", "view", "prompt"),
        sea.select(F.lit("sea_vi").alias("benchmark"), "language", "view", "prompt", "subset"),
        rows.where("dataset_source = 'xsafety'").select(F.lit("xsafety").alias("benchmark"), "language", "view", "prompt"),
    )
    return named.groupBy("benchmark", "language", "view").agg(F.count("*").alias("n"), F.sum(F.octet_length("prompt")).alias("prompt_bytes"))


#: Unicode white space for the regular expressions of DuckDB.
_WS = "[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}\\x{000B}]+"
_ALIAS = """CASE WHEN raw_language IN ('zh-CN','zh_CN','zh-cn') THEN 'zh' ELSE raw_language END"""
_RAW = f"""
raw AS (SELECT *, {_ALIAS} AS lang,
  CASE WHEN id IS NOT NULL AND id <> '' THEN id ELSE sha256(source_path || ':' || source_line) END AS sid,
  CASE WHEN regexp_extract(source_path, '([^/]+)\\.jsonl$', 1) = 'validation' THEN 'valid' ELSE regexp_extract(source_path, '([^/]+)\\.jsonl$', 1) END AS split,
  lower(coalesce(prompt_label, '')) AS pl, lower(coalesce(response_label, '')) AS rl,
  list_filter(list_transform(string_split(coalesce(violated_categories, ''), ','), lambda x: regexp_replace(x, '^{_WS}|{_WS}$', '', 'g')), lambda x: x <> '') AS cats
  FROM (SELECT *, CASE WHEN language IS NOT NULL AND language <> '' THEN language ELSE list_extract(string_split(source_path, '/'), -2) END AS raw_language FROM nemotron_raw))
"""
_VIEWS = f"""
{_RAW}, views AS (
SELECT raw_id, source_path, source_line, sid, split, lang, 'P' AS view, prompt, CAST(NULL AS VARCHAR) AS answer, pl AS label, pl AS plabel, CAST([] AS VARCHAR[]) AS c FROM raw
 WHERE lang IN ('en','ar','de','es','fr','hi','ja','th','zh') AND prompt <> '' AND pl IN ('safe','unsafe')
UNION ALL
SELECT raw_id, source_path, source_line, sid, split, lang, 'PR', prompt, response, rl, CASE WHEN pl IN ('safe','unsafe') THEN pl ELSE 'safe' END, cats FROM raw
 WHERE lang IN ('en','ar','de','es','fr','hi','ja','th','zh') AND prompt <> '' AND response <> '' AND rl IN ('safe','unsafe'))
"""
_FIRST = "SELECT * FROM canonical_examples QUALIFY row_number() OVER (PARTITION BY source_split, source_id, view, language ORDER BY row_id) = 1"
_TAXONOMY = ", ".join("'" + n + "'" for n in X.TAXONOMY)
_ALLOCATION = """
pool AS (SELECT row_id, example_id, language, view FROM canonical_examples WHERE source_split = 'test'),
q AS (SELECT language, view, count(*) AS members, min(row_id) AS first_seen, greatest(1, CAST(round_even(100.0 * count(*) / (SELECT count(*) FROM pool), 0) AS BIGINT)) AS quota FROM pool GROUP BY ALL)
"""
_SAMPLE = f"""
WITH {_ALLOCATION},
r AS (SELECT pool.*, quota, members, first_seen, row_number() OVER (PARTITION BY pool.language, pool.view ORDER BY sha256('3407:' || row_id)) AS k FROM pool JOIN q USING (language, view)),
b AS (SELECT language, view, least(quota, members) AS taken, coalesce(sum(least(quota, members)) OVER (ORDER BY first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
s AS (SELECT r.* FROM r JOIN b USING (language, view) WHERE k <= greatest(0, least(taken, 100 - before))),
f AS (SELECT *, row_number() OVER (ORDER BY sha256('3407:' || row_id)) AS j FROM r WHERE k > quota),
drawn AS (SELECT row_id, example_id, language, view FROM s UNION ALL SELECT row_id, example_id, language, view FROM f WHERE j <= 100 - (SELECT least(100, sum(taken)) FROM b))
"""
_COUNTER = "SELECT {by} 'examples' AS key FROM {t} UNION ALL SELECT {by} 'language:' || coalesce(language, 'None') FROM {t} UNION ALL SELECT {by} 'view:' || coalesce(view, 'None') FROM {t} UNION ALL SELECT {by} '{p}:' || coalesce(safety_label, 'None') FROM {t}"

ORACLE = {
    "canonical_views": f"""
WITH {_VIEWS}
SELECT raw_id, 'nemotron_v3:' || sid || ':' || view || ':' || lang AS example_id, sid AS source_id, split AS source_split, 'nemotron_v3' AS dataset_source, lang AS language, view,
 'Prompt: ' || prompt || coalesce(chr(10) || 'Response: ' || answer, '') AS text, prompt, answer AS response, label AS safety_label, plabel AS prompt_safety_label,
 coalesce(array_to_string(c, '|'), '') AS categories, CASE WHEN view = 'PR' AND len(c) > 0 THEN 'interaction' ELSE 'unavailable' END AS category_scope FROM views""",
    "canonical_text_roundtrip": f"""
SELECT row_id, regexp_replace(regexp_replace(CASE WHEN pos > 0 THEN substr(text, 1, pos - 1) ELSE text END, '^Prompt:', ''), '^{_WS}', '') AS prompt_back,
 CASE WHEN pos > 0 THEN regexp_replace(substr(text, pos + 10), '^{_WS}', '') END AS response_back
FROM (SELECT row_id, text, instr(text, chr(10) || 'Response:') AS pos FROM canonical_examples)""",
    "language_alias_filter": f"WITH {_RAW} SELECT lang AS language, count(*) AS n FROM raw WHERE lang IN ('en','ar','de','es','fr','hi','ja','th','zh') GROUP BY lang",
    "source_id_digest": f"""WITH {_RAW} SELECT raw_id, sid AS source_id, sha256(coalesce(prompt, '')) AS prompt_digest,
 substr(sha256(coalesce(language, '') || ':a.csv:' || source_line || ':' || coalesce(prompt, '')), 1, 20) AS csv_id FROM raw""",
    "category_split_clean": f"WITH {_RAW} SELECT raw_id, coalesce(array_to_string(cats, '|'), '') AS categories FROM raw",
    "dedup_first_wins": f"SELECT row_id, source_split, source_id, view, language FROM ({_FIRST})",
    "prepared_from_raw": f"""WITH {_VIEWS} SELECT raw_id, split AS source_split, sid AS source_id, view, lang AS language, label AS safety_label, plabel AS prompt_safety_label,
 CASE WHEN view = 'PR' AND len(c) > 0 THEN 'interaction' ELSE 'unavailable' END AS category_scope FROM views
 QUALIFY row_number() OVER (PARTITION BY split, sid, view, lang ORDER BY string_split(source_path, '/'), source_line, view, raw_id) = 1""",
    "split_manifest_counts": f"WITH d AS ({_FIRST}) SELECT source_split, key, count(*) AS n FROM ({_COUNTER.format(by='source_split,', t='d', p='safety_label')}) GROUP BY ALL",
    "benchmark_label_counts": f"WITH d AS (SELECT * FROM canonical_examples WHERE source_split = 'test') SELECT dataset_source, key, count(*) AS n FROM ({_COUNTER.format(by='dataset_source,', t='d', p='label')}) GROUP BY ALL",
    "sea_manifest_counts": """SELECT key, count(*) AS n FROM (SELECT 'examples' AS key FROM sea_examples UNION ALL SELECT 'subset:' || coalesce(subset, 'None') FROM sea_examples UNION ALL
 SELECT 'view:' || coalesce(view, 'None') FROM sea_examples UNION ALL SELECT 'label:' || coalesce(safety_label, 'None') FROM sea_examples UNION ALL
 SELECT 'registered:' || coalesce(lower(CAST(registered_in_pinned_seahelm_vi_suite AS VARCHAR)), 'None') FROM sea_examples) GROUP BY key""",
    "split_leakage": """WITH d AS (SELECT DISTINCT source_id, language, source_split FROM canonical_examples)
SELECT a.source_split AS split_a, b.source_split AS split_b, count(*) AS n FROM d a JOIN d b ON a.source_id IS NOT DISTINCT FROM b.source_id AND a.language IS NOT DISTINCT FROM b.language AND a.source_split < b.source_split GROUP BY ALL""",
    "unique_id_check": "SELECT example_id, count(*) AS n FROM sea_examples GROUP BY example_id HAVING count(*) > 1",
    "blank_text_check": " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS n_null, count(*) FILTER (regexp_replace({f}, '[\\s\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{0085}}\\x{{000B}}]+', '', 'g') = '') AS n_blank FROM {t}"
        for t, fields in (("documents", ("text", "lang", "source")), ("nemotron_raw", ("prompt", "response", "id")))
        for f in fields
    ),
    "taxonomy_lookup": f"SELECT 'S' || generate_subscripts(n, 1) AS code, unnest(n) AS name FROM (SELECT [{_TAXONOMY}] AS n)",
    "registered_flag": "SELECT seahelm_task_name, seahelm_task_name IN ('safeguard_general_prompt', 'safeguard_general_response') AS registered, count(*) AS n FROM sea_examples GROUP BY ALL",
    "expected_grid_missing": """SELECT l.language, s.split FROM (SELECT unnest(['en','ar','de','es','fr','hi','ja','th','zh','it','ko','nl']) AS language) l CROSS JOIN (SELECT unnest(['train','valid','test']) AS split) s
EXCEPT SELECT list_extract(string_split(source_path, '/'), -2), CASE WHEN source_path LIKE '%/validation.jsonl' THEN 'valid' ELSE regexp_extract(source_path, '([^/]+)\\.jsonl$', 1) END FROM nemotron_raw""",
    "stratified_allocation": f"WITH {_ALLOCATION} SELECT * FROM q",
    "stratified_sample": f"{_SAMPLE} SELECT * FROM drawn",
    "remaining_pool": f"{_SAMPLE} SELECT language, view, count(*) AS n FROM pool WHERE row_id NOT IN (SELECT row_id FROM drawn) GROUP BY ALL",
    "limit_then_dedup": """SELECT row_id, source_split, source_id, view, language FROM (SELECT * FROM canonical_examples ORDER BY row_id LIMIT 500)
 QUALIFY row_number() OVER (PARTITION BY source_split, source_id, view, language ORDER BY row_id) = 1""",
    "target_rendering": f"""SELECT row_id, '{{"User Safety": "' || prompt_safety_label || '"' || CASE WHEN view = 'PR' THEN ', "Response Safety": "' || safety_label || '"' ELSE '' END ||
 CASE WHEN len(k) > 0 THEN ', "Safety Categories": "' || array_to_string(k, ', ') || '"' ELSE '' END || '}}' AS target, 'Safety: ' || CASE WHEN safety_label = 'unsafe' THEN 'Unsafe' ELSE 'Safe' END AS target_binary
 FROM (SELECT *, list_filter([{_TAXONOMY}], lambda x: list_contains(categories, x)) AS k FROM canonical_examples)""",
    "guard_prompts": f"""SELECT row_id, sha256('Categories:' || chr(10) || (SELECT string_agg('S' || i || ': ' || n || '.', chr(10) ORDER BY i) FROM (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS n FROM (SELECT [{_TAXONOMY}] AS v)))
 || chr(10) || 'user: ' || prompt || chr(10) || coalesce('response: agent: ' || response || chr(10), '') || 'Rate it.') AS prompt_digest FROM canonical_examples""",
    "head_tail_truncation": """SELECT doc_id, array_to_string(k, ' ') AS kept, len(k) + 3 AS n_labels, len(k) AS n_masked FROM (SELECT doc_id, CASE WHEN len(w) > 33 THEN list_concat(w[1:16], w[-17:]) ELSE w END AS k
 FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents))""",
    "benchmark_union": """SELECT benchmark, language, view, count(*) AS n, CAST(sum(strlen(prompt)) AS BIGINT) AS prompt_bytes FROM (
 SELECT CASE dataset_source WHEN 'nemotron_v3' THEN 'cultureguard' ELSE 'xsafety' END AS benchmark, language, view, prompt FROM canonical_examples WHERE source_split = 'test' AND dataset_source IN ('nemotron_v3','xsafety')
 UNION ALL SELECT 'sea_vi', language, view, prompt FROM sea_examples WHERE language = 'vi') GROUP BY ALL""",
}
QUERIES = {
    f.__name__: f
    for f in (
        canonical_views, canonical_text_roundtrip, language_alias_filter, source_id_digest, category_split_clean, dedup_first_wins, prepared_from_raw, split_manifest_counts, benchmark_label_counts,
        sea_manifest_counts, split_leakage, unique_id_check, blank_text_check, taxonomy_lookup, registered_flag, expected_grid_missing, stratified_allocation, stratified_sample, remaining_pool,
        limit_then_dedup, target_rendering, guard_prompts, head_tail_truncation, benchmark_union,
    )
}
