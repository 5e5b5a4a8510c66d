"""Queries that write delivered tables in the formats of the sources and sinks, and read them back.

Each goes through the sink, the shared folder and the source, and must give the table again.
"""

from __future__ import annotations

import csv
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwarden.functions import text as X
from lexwarden.operators import canonical, sampling
from lexwarden.schemas import BENCHMARK_REQUIRED, CANONICAL, RAW_NEMOTRON
from lexwarden.session import shared_folder, table
from lexwarden.sources import files, jsonl, sinks


def _place(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lexwarden-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    """The same as a folder that the driver makes."""
    folder = _place(spark).removeprefix("file://")
    os.makedirs(folder)
    return folder


def _keyed(schema: T.StructType, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, T.LongType()), *schema.fields])


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as JSON lines, read by the tolerant reader; an empty id is none."""
    schema, place = _keyed(RAW_NEMOTRON, "raw_id"), _place(spark)
    sinks.write_jsonl(table(spark, sf_dir, "nemotron_raw").select(*schema.fieldNames()), place)
    return jsonl.read_jsonl(spark, place, schema, "*.json").select(*schema.fieldNames())


def contract_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows as JSON lines with their required fields checked, read by the built-in reader."""
    schema, place = _keyed(CANONICAL, "row_id"), _place(spark)
    sinks.write_jsonl(table(spark, sf_dir, "canonical_examples").select(*schema.fieldNames()), place, required=BENCHMARK_REQUIRED)
    rows = jsonl.read_contract(spark, place, schema)
    return rows.withColumn("categories", F.array_join("categories", "|"))


def written_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts below language folders as ``validation.jsonl`` and ``train.jsonl``; the valid split read back, by language folder."""
    rows, folder = table(spark, sf_dir, "nemotron_raw"), _place(spark)
    for name, part in (("validation", "valid"), ("train", "train")):
        own = rows.where(canonical.split_of_path(F.col("source_path")) == part).select(*RAW_NEMOTRON.fieldNames())
        sinks.write_jsonl(own, f"{folder}/{name}.parts")
    # One file a split, as delivered; the tables of a delivery are joined by name only.
    local = folder.removeprefix("file://")
    for name in ("validation", "train"):
        os.makedirs(f"{local}/raw/all", exist_ok=True)
        with open(f"{local}/raw/all/{name}.jsonl", "wb") as out:
            for part in sorted(os.listdir(f"{local}/{name}.parts")):
                if part.endswith(".json"):
                    with open(f"{local}/{name}.parts/{part}", "rb") as source:
                        while block := source.read(1 << 20):
                            out.write(block)
    read = jsonl.read_split(spark, f"{local}/raw", "valid")
    return read.groupBy(canonical.split_of_path(F.col("source_path")).alias("split"), "prompt_label").agg(F.count("*").alias("n"), F.sum(F.octet_length("prompt")).alias("prompt_bytes"))


def benchmark_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SEA benchmark as one file in order of row; the line on which each row stands."""
    place = _place(spark)
    rows = table(spark, sf_dir, "sea_examples").select("row_id", *BENCHMARK_REQUIRED).orderBy("row_id")
    sinks.write_benchmark(rows, place)
    lines = jsonl.numbered_lines(spark, place, "*.json")
    return lines.select(F.get_json_object("value", "$.row_id").cast("long").alias("row_id"), "source_line")


def sea_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEA records of the subset ``general`` as delivered, prepared to canonical rows."""
    place = _place(spark)
    rows = table(spark, sf_dir, "sea_examples").where("view = 'PR' and trim(prompt) <> '' and trim(response) <> '' and safety_label in ('safe', 'unsafe') and prompt_safety_label in ('safe', 'unsafe')")
    raw = rows.orderBy("row_id").select(
        F.array(F.struct(F.col("prompt").alias("prompt_text"), F.col("response").alias("response_text"))).alias("prompts"),
        F.when(F.col("prompt_safety_label") == "safe", "Safe").otherwise("Có  hại").alias("prompt_label"), F.when(F.col("safety_label") == "safe", " AN TOÀN").otherwise("Harmful ").alias("response_label"),
    )
    sinks.write_jsonl(raw, place, one_file=True)
    pair = T.StructType([T.StructField("prompt_text", T.StringType()), T.StructField("response_text", T.StringType())])
    schema = T.StructType([T.StructField("prompts", T.ArrayType(pair)), T.StructField("prompt_label", T.StringType()), T.StructField("response_label", T.StringType())])
    records = jsonl.read_jsonl(spark, place, schema, "*.json", strict=True)
    out = canonical.sea_rows(records, "general", "pinned", ["safeguard_general_prompt"])
    return out.select("example_id", "source_line", "view", "seahelm_task_name", "registered_in_pinned_seahelm_vi_suite", "prompt", "response", "text", "safety_label", "prompt_safety_label", "category_scope")


def csv_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation passages as headerless CSV files below language folders, prepared to canonical rows."""
    folder, languages = _folder(spark), ("en", "de", "es", "fr", "zh")
    rows = sinks.small_rows(table(spark, sf_dir, "eval_items").where(F.col("language").isin(*languages)).select("item_id", "language", "text").orderBy("item_id"))
    for language in languages:
        os.makedirs(f"{folder}/{X.LANGUAGE_DIRECTORIES[language]}")
        with open(f"{folder}/{X.LANGUAGE_DIRECTORIES[language]}/Insult.csv", "w", encoding="utf-8-sig", newline="") as file:
            csv.writer(file).writerows([[r["text"]] for r in rows if r["language"] == language])
        with open(f"{folder}/{X.LANGUAGE_DIRECTORIES[language]}/CommonSense.csv", "w", encoding="utf-8") as file:
            file.write("left out\n")
    out = canonical.csv_rows(files.read_csv_records(spark, folder, languages))
    return out.select("example_id", "source_id", "language", "view", "text", "prompt", "safety_label", F.array_join("categories", "|").alias("categories"), "category_scope")


def small_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample targets as one CSV file with a byte order mark, read back."""
    path = f"{_folder(spark)}/targets.csv"
    wanted = table(spark, sf_dir, "sample_targets").orderBy("target_id")
    sinks.write_csv(wanted, path)
    return spark.read.option("header", True).schema(wanted.schema).csv(f"file://{path}")


def small_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample targets as one JSON array, read back."""
    path = f"{_folder(spark)}/targets.json"
    wanted = table(spark, sf_dir, "sample_targets").orderBy("target_id")
    sinks.write_json(wanted, path)
    return jsonl.read_rows(spark, path, wanted.schema)


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the prepared splits: rows of each split and its counters, read from the written file."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "canonical_examples")
    sinks.write_json(sinks.splits_manifest(rows, folder, "delivered", sorted(X.LANGUAGES)), f"{folder}/manifest.json")
    written = spark.read.option("multiLine", True).text(f"file://{folder}/manifest.json", wholetext=True)
    splits = F.from_json(F.get_json_object("value", "$.splits"), "map<string, struct<path string, rows bigint, counts map<string, bigint>>>")
    one = written.select(F.explode(splits).alias("source_split", "s"))
    return one.select("source_split", F.col("s.rows").alias("n_rows"), F.explode("s.counts").alias("key", "n"))


def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation passages as members of a ZIP file, and what their archive sums up to."""
    path = f"{_folder(spark)}/items.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for r in sinks.small_rows(table(spark, sf_dir, "eval_items").select("item_id", "benchmark", "text")):
            archive.writestr(f"{r['benchmark']}/{r['item_id']}.txt", r["text"])
    members = files.archive_members(spark, [f"file://{path}"])
    files.check_archives(members)
    return members.select("name", "size").crossJoin(F.broadcast(files.archive_totals(members).select("entries", "uncompressed_bytes")))  # one row


def extracted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation passages packed in two archives, merged, extracted; bytes and digest of each file."""
    folder = _folder(spark)
    rows = sinks.small_rows(table(spark, sf_dir, "eval_items").select("item_id", "text"))
    parts = []
    for k in range(2):
        parts.append(f"{folder}/part{k}.zip")
        with zipfile.ZipFile(parts[-1], "w") as archive:
            for r in rows:
                if r["item_id"] % 2 == k:
                    archive.writestr(f"items/{r['item_id']}.txt", r["text"])
    files.merge_archives(parts, f"{folder}/whole.zip", [f"items/{r['item_id']}.txt" for r in rows])
    files.extract_archive(f"{folder}/whole.zip", f"{folder}/out")
    found = files.file_digests(spark, f"file://{folder}/out/items")
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("item_id"), "bytes", "sha256")


def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the expected benchmark files are there, and the steps that are still open."""
    folder = _folder(spark)
    paths = files.benchmark_files(folder)
    sinks.write_json([], paths["sea_vi"])
    status = files.readiness(spark, sorted(paths.items()))
    advice = spark.createDataFrame([(k, 1 if k == "sea_vi" else 2, f"prepare {k}") for k in paths], "key string, step int, advice string")
    return files.next_actions(status, advice).select("step", "advice", F.array_join("missing", ",").alias("missing"))


def likelihood_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vietnamese rows, the first 400 of them, of these the ones with a response."""
    rows = table(spark, sf_dir, "predictions")
    return sampling.select_texts(rows, "vi", 400, "raw_output", ["pred_id"]).select("pred_id", "language")


_SEA = """SELECT *, row_number() OVER (ORDER BY row_id) AS line FROM sea_examples WHERE view = 'PR' AND trim(prompt) <> '' AND trim(response) <> ''
  AND safety_label IN ('safe','unsafe') AND prompt_safety_label IN ('safe','unsafe')"""
ORACLE = {
    "jsonl_roundtrip": "SELECT raw_id, nullif(id, '') AS id, prompt, response, prompt_label, response_label, language, violated_categories FROM nemotron_raw",
    "contract_roundtrip": "SELECT row_id, example_id, source_id, source_split, dataset_source, language, view, text, prompt, response, safety_label, prompt_safety_label, coalesce(array_to_string(categories, '|'), '') AS categories, category_scope FROM canonical_examples",
    "written_split": "SELECT 'valid' AS split, prompt_label, count(*) AS n, CAST(sum(strlen(prompt)) AS BIGINT) AS prompt_bytes FROM nemotron_raw WHERE regexp_extract(source_path, '([^/]+)\\.jsonl$', 1) IN ('valid', 'validation') GROUP BY prompt_label",
    "benchmark_file_lines": "SELECT row_id, row_number() OVER (ORDER BY row_id) AS source_line FROM sea_examples",
    "sea_prepared": f"""WITH s AS ({_SEA}) SELECT 'sea:general:' || printf('%04d', line) || ':' || v || ':vi' AS example_id, line AS source_line, v AS view,
  CASE v WHEN 'P' THEN 'safeguard_general_prompt' ELSE 'safeguard_general_response' END AS seahelm_task_name, v = 'P' AS registered_in_pinned_seahelm_vi_suite, prompt,
  CASE v WHEN 'PR' THEN response END AS response, 'Prompt: ' || prompt || CASE v WHEN 'PR' THEN chr(10) || 'Response: ' || response ELSE '' END AS text,
  CASE v WHEN 'PR' THEN safety_label ELSE prompt_safety_label END AS safety_label, prompt_safety_label, 'unavailable' AS category_scope FROM s CROSS JOIN (SELECT unnest(['P', 'PR']) AS v)""",
    "csv_prepared": """WITH r AS (SELECT language, trim(text) AS prompt, row_number() OVER (PARTITION BY language ORDER BY item_id) AS line FROM eval_items WHERE language IN ('en','de','es','fr','zh')),
 d AS (SELECT *, substr(sha256(language || ':Insult.csv:' || line || ':' || prompt), 1, 20) AS source_id FROM r)
 SELECT 'xsafety:' || source_id || ':P:' || language AS example_id, source_id, language, 'P' AS view, 'Prompt: ' || prompt AS text, prompt, 'unsafe' AS safety_label, 'Insult' AS categories, 'prompt' AS category_scope FROM d""",
    "small_csv": "SELECT * FROM sample_targets",
    "small_json": "SELECT * FROM sample_targets",
    "split_manifest": """WITH k AS (SELECT source_split, 'examples' AS key FROM canonical_examples UNION ALL SELECT source_split, 'language:' || coalesce(language, 'None') FROM canonical_examples
  UNION ALL SELECT source_split, 'view:' || coalesce(view, 'None') FROM canonical_examples UNION ALL SELECT source_split, 'safety_label:' || coalesce(safety_label, 'None') FROM canonical_examples)
 SELECT source_split, sum(CASE WHEN key = 'examples' THEN n ELSE 0 END) OVER (PARTITION BY source_split)::BIGINT AS n_rows, key, n FROM (SELECT source_split, key, count(*) AS n FROM k GROUP BY ALL)""",
    "archive_listing": "SELECT benchmark || '/' || item_id || '.txt' AS name, strlen(text) AS size, (SELECT count(*) FROM eval_items) AS entries, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM eval_items) AS uncompressed_bytes FROM eval_items",
    "extracted_digests": "SELECT item_id, strlen(text) AS bytes, sha256(text) AS sha256 FROM eval_items",
    "readiness_report": "SELECT 2 AS step, 'prepare ' || k AS advice, k AS missing FROM (SELECT unnest(['cultureguard', 'xsafety']) AS k)",
    "likelihood_selection": "SELECT pred_id, language FROM (SELECT * FROM predictions WHERE language = 'vi' ORDER BY pred_id LIMIT 400) WHERE trim(raw_output) <> ''",
}
QUERIES = {f.__name__: f for f in (jsonl_roundtrip, contract_roundtrip, written_split, benchmark_file_lines, sea_prepared, csv_prepared, small_csv, small_json, split_manifest, archive_listing, extracted_digests, readiness_report, likelihood_selection)}
