"""Queries over fields that pack several values (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwarden.operators.packed import packed_multi, packed_values
from lexwarden.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of each category field that holds two or more values."""
    raw = packed_multi(table(spark, sf_dir, "nemotron_raw"), "raw_id", "violated_categories")
    scored = packed_multi(table(spark, sf_dir, "predictions"), "pred_id", "safety_categories")
    return (
        raw.withColumn("field", F.lit("violated_categories"))
        .unionByName(scored.withColumn("field", F.lit("safety_categories")))
        .select("field", "row_key", "pos", "value")
    )


def p3_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value occurs in either field, case set aside."""
    raw = packed_values(table(spark, sf_dir, "nemotron_raw"), "raw_id", "violated_categories")
    scored = packed_values(table(spark, sf_dir, "predictions"), "pred_id", "safety_categories")
    both = raw.withColumn("field", F.lit("violated_categories")).unionByName(scored.withColumn("field", F.lit("safety_categories")))
    return both.groupBy("field", F.lower("value").alias("value")).agg(F.count("*").alias("n_values"), F.max("pos").alias("last_pos"))


QUERIES = {"p3_found": p3_found, "p3_value_counts": p3_value_counts}
ORACLE: dict[str, str] = {}
