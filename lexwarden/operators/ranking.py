"""Comparison of models from their metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overall(metrics: DataFrame, benchmark: str = "sea_vi") -> DataFrame:
    """The row of a benchmark over all languages, views and subsets, per model."""
    return metrics.where((F.col("benchmark") == benchmark) & (F.col("language") == "ALL") & (F.col("view") == "ALL") & (F.col("subset") == "ALL"))


def compare_models(models: DataFrame, likelihood: DataFrame, guard: DataFrame) -> DataFrame:
    """One row per model with both overall measures and two ranks.

    ``models``: (``model``, ``ordinal``, ``run_directory``), a handful of rows, so that both ranks order few rows.
    Ranks leave out nulls; bits per byte ascend, ties by ordinal; macro F1 and then unsafe recall (null as 0) descend.
    """
    ll = likelihood.select("model", "bits_per_byte", "perplexity", "tokens_scored", F.lit(True).alias("ll"))
    gd = guard.select("model", F.col("macro_f1").alias("guard_macro_f1"), F.col("unsafe_recall").alias("guard_unsafe_recall"), F.col("unsafe_f1").alias("guard_unsafe_f1"), F.col("parse_rate").alias("guard_parse_rate"), F.lit(True).alias("gd"))
    rows = models.join(ll, "model", "left").join(gd, "model", "left")
    by_bits = Window.orderBy(F.col("bits_per_byte").isNull(), "bits_per_byte", "ordinal")
    by_guard = Window.orderBy(F.col("guard_macro_f1").isNull(), F.desc("guard_macro_f1"), F.desc(F.coalesce("guard_unsafe_recall", F.lit(0.0))), "ordinal")
    return rows.select(
        "model", "run_directory", F.coalesce("ll", F.lit(False)).alias("likelihood_ready"), F.coalesce("gd", F.lit(False)).alias("guard_ready"),
        "bits_per_byte", "perplexity", "tokens_scored", "guard_macro_f1", "guard_unsafe_recall", "guard_unsafe_f1", "guard_parse_rate",
        F.when(F.col("bits_per_byte").isNotNull(), F.row_number().over(by_bits)).cast("long").alias("bpb_rank"),
        F.when(F.col("guard_macro_f1").isNotNull(), F.row_number().over(by_guard)).cast("long").alias("guard_rank"),
    )


def run_directory(root: str, model: str, checkpoint: str, method: str = "lora", mode: str = "full") -> str:
    """Where a run of a model lies."""
    return "/".join((root.rstrip("/"), model, "base" if checkpoint == "before" else f"{method}_{mode}"))
