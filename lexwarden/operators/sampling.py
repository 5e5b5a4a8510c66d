"""Stratified sampling with exact allocation, and limits.

Members of a stratum are ordered by a seeded digest instead of a shuffle, which every engine can repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 3407


def draw_order(key: Column, seed: int = SEED) -> Column:
    """Digest that orders the members."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def allocation(df: DataFrame, strata: Sequence[str], n: int, arrival: str) -> DataFrame:
    """(``strata``, ``members``, ``first_seen``, ``quota``): half-even share of ``n``, at least 1 for each stratum."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("members"), F.min(arrival).alias("first_seen"))
    total = df.agg(F.count("*").alias("total"))  # one number
    return sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("members") / F.col("total")).cast("long"))).drop("total")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: str, arrival: str, seed: int = SEED) -> DataFrame:
    """At most ``n`` rows: the quota of each stratum by order of arrival of the strata, then a fill from the rest.

    If quotas exceed ``n``, the strata that arrived last lose rows.  Ranks in a stratum come from counts by digest bucket
    and an order within buckets, so that a stratum with most rows is not sorted in one task.  ``key`` must be unique.
    """
    quotas = allocation(df, strata, n, arrival)
    w = Window.orderBy("first_seen").rowsBetween(Window.unboundedPreceding, -1)
    # One row per stratum: a single small partition.
    quotas = quotas.withColumn("taken", F.least("quota", "members")).withColumn("before", F.coalesce(F.sum("taken").over(w), F.lit(0)))
    quotas = quotas.withColumn("room", F.greatest(F.lit(0), F.least("taken", F.lit(n) - F.col("before"))))
    ranked = rank_within(df, strata, draw_order(F.col(key), seed))
    same = [F.col(f"r.{s}").eqNullSafe(F.col(f"q.{s}")) for s in strata]
    joined = ranked.alias("r").join(F.broadcast(quotas.alias("q")), same).select("r.*", "q.quota", "q.room")
    drawn = joined.where(F.col("rank_in") <= F.col("room"))
    open_ = quotas.agg((F.lit(n) - F.least(F.lit(n), F.sum("taken"))).alias("open")).first()["open"] or 0  # one number
    if open_ == 0:
        return drawn.select(*df.columns)
    rest = rank_within(joined.where(F.col("rank_in") > F.col("quota")).drop("rank_in", "room", "quota"), [], draw_order(F.col(key), seed))
    return drawn.select(*df.columns).unionByName(rest.where(F.col("rank_in") <= open_).select(*df.columns))


def rank_within(df: DataFrame, groups: Sequence[str], order: Column) -> DataFrame:
    """Adds ``rank_in``, the place of each row in its group by a hex digest, in two steps.

    Rows are ranked within (group, first two digits of the digest), and these ranks are raised by the counts of the
    earlier buckets.
    """
    d = df.withColumn("__d", order).withColumn("__b", F.substring("__d", 1, 2))
    inner = d.withColumn("__r", F.row_number().over(Window.partitionBy(*groups, "__b").orderBy("__d")))
    counts = d.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))  # 256 rows a group
    keys = [*groups, "__b"]
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return inner.alias("i").join(counts.alias("c"), same).select(*[F.col(f"i.{c}") for c in df.columns], (F.col("i.__r") + F.col("c.__before")).alias("rank_in"))


def ordered_limit(df: DataFrame, order: Sequence[str | Column], n: int | None) -> DataFrame:
    """The first ``n`` rows; None sets no limit, 0 gives none."""
    return df if n is None else df.orderBy(*order).limit(n)


def remaining(df: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """Rows that were not drawn, by id."""
    return df.join(drawn.select(key), key, "left_anti")


def select_texts(df: DataFrame, language: str, n: int | None, field: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows of a language (``all`` for any), the first ``n`` of them, and of these the ones whose text is not blank."""
    chosen = df if language == "all" else df.where(F.col("language") == language)
    return ordered_limit(chosen, order, n).where(F.coalesce(F.regexp_replace(field, r"(?U)\s+", ""), F.lit("")) != "")
