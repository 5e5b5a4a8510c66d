"""From raw records to canonical rows: projection and view explosion, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwarden.functions import text as X
from lexwarden.schemas import CANONICAL, SEA_CANONICAL


def split_of_path(path: Column) -> Column:
    """``train``, ``valid`` or ``test`` by file name; ``validation`` is ``valid``."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    return F.when(stem == "validation", "valid").otherwise(stem)


def canonical_views(raw: DataFrame, languages: Sequence[str] = X.LANGUAGES, keep: Sequence[str] = ()) -> DataFrame:
    """0, 1 or 2 canonical rows per raw record: the prompt view, then the prompt-and-response view.

    ``raw`` needs the raw fields, ``source_path`` and ``source_line``.  A prompt view needs a prompt and a valid prompt
    label; the pair view needs both texts and a valid response label, and takes an invalid prompt label as safe.
    """
    path, line = F.col("source_path"), F.col("source_line")
    label, answer_label = X.lower_label(F.col("prompt_label")), X.lower_label(F.col("response_label"))
    base = raw.select(
        *keep, path, line, "prompt", "response",
        X.source_id(F.col("id").cast("string"), path, line).alias("source_id"),
        split_of_path(path).alias("source_split"),
        X.alias_language(F.col("language"), path).alias("language"),
        label.alias("prompt_label"), answer_label.alias("response_label"),
        X.naive_categories(F.col("violated_categories")).alias("found"),
    ).where(F.col("language").isin(*languages) & X.truthy(F.col("prompt")))
    good, good_answer = F.col("prompt_label").isin(*X.LABELS), F.col("response_label").isin(*X.LABELS)
    none = F.lit(None).cast("string")
    p = F.when(good, F.struct(F.lit("P").alias("view"), none.alias("answer"), F.col("prompt_label").alias("safety_label"), F.col("prompt_label").alias("prompt_safety_label"), F.array().cast("array<string>").alias("categories")))
    pr = F.when(
        X.truthy(F.col("response")) & good_answer,
        F.struct(F.lit("PR").alias("view"), F.col("response").alias("answer"), F.col("response_label").alias("safety_label"), F.when(good, F.col("prompt_label")).otherwise("safe").alias("prompt_safety_label"), F.col("found").alias("categories")),
    )
    rows = base.select(*keep, "source_path", "source_line", "source_id", "source_split", "language", "prompt", F.explode(F.filter(F.array(p, pr), lambda x: x.isNotNull())).alias("v"))
    out = rows.select(
        *keep, "source_path", "source_line",
        F.concat_ws(":", F.lit("nemotron_v3"), "source_id", "v.view", "language").alias("example_id"),
        "source_id", "source_split", F.lit("nemotron_v3").alias("dataset_source"), "language", F.col("v.view").alias("view"),
        X.text_of(F.col("prompt"), F.col("v.answer")).alias("text"), "prompt", F.col("v.answer").alias("response"),
        F.col("v.safety_label").alias("safety_label"), F.col("v.prompt_safety_label").alias("prompt_safety_label"), F.col("v.categories").alias("categories"),
        F.when((F.col("v.view") == "PR") & (F.size("v.categories") > 0), "interaction").otherwise("unavailable").alias("category_scope"),
    )
    return out


def contract(df: DataFrame) -> DataFrame:
    """Exactly the contract's columns, in order."""
    return df.select(*CANONICAL.fieldNames())


def sea_rows(records: DataFrame, subset: str, revision: str, registered: Sequence[str] = ()) -> DataFrame:
    """Canonical rows of one SEA subset.  Total: an empty text or unknown label raises.

    ``records``: ``source_path``, ``source_line`` and the JSON fields ``prompts`` (array of structs) and labels.
    """
    wild = subset == "cultural_in_the_wild"
    first = F.get("prompts", 0)
    prompt = F.coalesce(first["local_prompt" if wild else "prompt_text"], F.lit(""))
    own = F.col("label" if wild else "prompt_label")
    base = f"safeguard_{subset}"
    views = [("P", F.lit(None).cast("string"), own, base if wild else f"{base}_prompt")]
    if not wild:
        views.append(("PR", F.coalesce(first["response_text"], F.lit("")), F.col("response_label"), f"{base}_response"))
    array = F.array(*[F.struct(F.lit(v).alias("view"), r.alias("response"), lab.alias("label"), F.lit(t).alias("task")) for v, r, lab, t in views])
    rows = records.select("source_path", "source_line", prompt.alias("prompt"), own.alias("own"), F.explode(array).alias("v"))
    blank = (X.strip(F.col("prompt")) == "") | ((F.col("v.view") == "PR") & (X.strip(F.col("v.response")) == ""))
    where = F.concat_ws(":", F.lit(subset), F.col("source_line").cast("string"), F.col("v.view"))
    return rows.select(
        F.when(blank, F.raise_error(F.concat(F.lit("empty text: "), where))).otherwise(F.concat_ws(":", F.lit("sea"), F.lit(subset), X.padded_line(F.col("source_line")), F.col("v.view"), F.lit("vi"))).alias("example_id"),
        F.lit("sea_helm_safeguard").alias("dataset_source"), F.lit(revision).alias("source_revision"), "source_path", "source_line", F.lit("evaluation").alias("source_split"),
        F.col("v.task").alias("seahelm_task_name"), F.col("v.task").isin(*registered).alias("registered_in_pinned_seahelm_vi_suite") if registered else F.lit(False).alias("registered_in_pinned_seahelm_vi_suite"),
        F.lit(subset).alias("subset"), F.lit("vi").alias("language"), F.col("v.view").alias("view"), "prompt", F.col("v.response").alias("response"),
        X.text_of(F.col("prompt"), F.col("v.response")).alias("text"), X.sea_label(F.col("v.label")).alias("safety_label"), X.sea_label(F.col("own")).alias("prompt_safety_label"),
        F.array().cast("array<string>").alias("categories"), F.lit("unavailable").alias("category_scope"),
    ).select(*SEA_CANONICAL.fieldNames())


def csv_rows(records: DataFrame) -> DataFrame:
    """Canonical rows of headerless CSV records: (``language``, ``file_name``, ``record_no``, ``prompt``)."""
    found = X.csv_source_id(F.col("language"), F.col("file_name"), F.col("record_no"), F.col("prompt"))
    return records.withColumn("source_id", found).select(
        F.concat_ws(":", F.lit("xsafety"), "source_id", F.lit("P"), "language").alias("example_id"), "source_id", F.lit("test").alias("source_split"), F.lit("xsafety").alias("dataset_source"),
        "language", F.lit("P").alias("view"), F.concat(F.lit("Prompt: "), "prompt").alias("text"), "prompt", F.lit(None).cast("string").alias("response"),
        F.lit("unsafe").alias("safety_label"), F.lit("unsafe").alias("prompt_safety_label"), F.array(X.category_of_file(F.col("file_name"))).alias("categories"), F.lit("prompt").alias("category_scope"),
    )


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all frames; missing columns are null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
