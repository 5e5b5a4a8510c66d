"""Integrity: first-wins deduplication, counters, leakage between splits, and checks that raise.

The functions named ``check_*`` run one small aggregate each and raise; everything else is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwarden.schemas import BENCHMARK_REQUIRED


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], row_key: Sequence[str]) -> DataFrame:
    """One row per key: the first in the order.

    The least order value per key is a partial aggregate, so that a key with a third of all rows is one row per task
    before the shuffle; the rows are then kept by a semi-join on the unique ``row_key``.
    """
    names = [f"__o{i}" for i in range(len(order))]
    ranked = df.select(*keys, *row_key, *[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names, strict=True)])
    first = ranked.groupBy(*keys).agg(F.min(F.struct(*names, *row_key)).alias("__m")).select(*[F.col(f"__m.{k}").alias(k) for k in row_key])
    return df.join(first, list(row_key), "left_semi")


def path_order(path: Column) -> Column:
    """Paths compare by component."""
    return F.split(path, "/")


def counters(df: DataFrame, fields: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(``by``, ``key``, ``n``): all rows as ``examples``, and ``prefix:value`` for each field, in one pass."""
    keys = F.array(F.lit("examples"), *[F.concat(F.lit(f"{prefix}:"), F.coalesce(F.col(field).cast("string"), F.lit("None"))) for prefix, field in fields])
    return df.select(*by, F.explode(keys).alias("key")).groupBy(*by, "key").agg(F.count("*").alias("n"))


def split_counters(df: DataFrame) -> DataFrame:
    """Counters of a prepared split, after deduplication."""
    return counters(df, [("language", "language"), ("view", "view"), ("safety_label", "safety_label")], ["source_split"])


def benchmark_counters(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of a benchmark file."""
    return counters(df, [("language", "language"), ("view", "view"), ("label", "safety_label")], by)


def sea_counters(df: DataFrame) -> DataFrame:
    """Counters of the SEA benchmark, in order of key."""
    named = df.withColumn("__flag", F.lower(F.col("registered_in_pinned_seahelm_vi_suite").cast("string")))
    return counters(named, [("subset", "subset"), ("view", "view"), ("label", "safety_label"), ("registered", "__flag")]).orderBy("key")


def split_overlap(df: DataFrame, identity: Sequence[str], split: str = "source_split") -> DataFrame:
    """(``identity``, ``splits``): identities that occur in more than one split.

    Distinct (identity, split) first: a hot identity is at most one row per split and task.
    """
    return df.select(*identity, split).distinct().groupBy(*identity).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def split_overlap_counts(df: DataFrame, identity: Sequence[str], split: str = "source_split") -> DataFrame:
    """(``split_a``, ``split_b``, ``n``): shared identities of each pair of splits, in order of name."""
    pairs = F.expr("filter(flatten(transform(splits, a -> transform(splits, b -> struct(a as split_a, b as split_b)))), p -> p.split_a < p.split_b)")
    return split_overlap(df, identity, split).select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n"))


def check_no_leakage(df: DataFrame, identity: Sequence[str] = ("source_id", "language"), split: str = "source_split") -> None:
    """Raises if an identity occurs in two splits."""
    found = {(r["split_a"], r["split_b"]): r["n"] for r in split_overlap_counts(df, identity, split).collect()}  # a row per pair of splits
    if found:
        raise ValueError("split leakage: " + ", ".join(f"{a}/{b}: {n}" for (a, b), n in sorted(found.items())))


def check_row_count(df: DataFrame, expected: int = 1840) -> int:
    """Raises unless the frame has the expected rows; 0 sets no expectation."""
    n = df.count()
    if expected and n != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    return n


def check_required_fields(df: DataFrame, required: Sequence[str] = BENCHMARK_REQUIRED) -> None:
    """Raises, naming the fields that the schema lacks."""
    missing = [f for f in required if f not in df.columns]
    if missing:
        raise ValueError("missing fields: " + ", ".join(missing))


def duplicate_ids(df: DataFrame, key: str = "example_id") -> DataFrame:
    """Ids that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(df: DataFrame, key: str = "example_id") -> None:
    """Raises if an id occurs twice."""
    row = duplicate_ids(df, key).limit(1).collect()
    if row:
        raise ValueError(f"{key} is not unique: {row[0][0]!r}")


def check_views(df: DataFrame) -> None:
    """Raises on a view other than ``P`` and ``PR``."""
    bad = df.where(~F.coalesce(F.col("view").isin("P", "PR"), F.lit(False))).select("view").limit(1).collect()
    if bad:
        raise ValueError(f"unsupported view: {bad[0][0]!r}")


def check_not_blank(df: DataFrame, field: str) -> None:
    """Raises on null or blank text."""
    bad = df.where(F.coalesce(F.regexp_replace(field, r"(?U)\s+", ""), F.lit("")) == "").limit(1).count()
    if bad:
        raise ValueError(f"blank {field}")


def blank_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(``field``, ``n_null``, ``n_blank``) of text fields, in one pass."""
    plain = [F.regexp_replace(f, r"(?U)\s+", "") for f in fields]
    one = df.agg(*[F.sum(F.col(f).isNull().cast("long")).alias(f"n{i}") for i, f in enumerate(fields)], *[F.sum((p == "").cast("long")).alias(f"b{i}") for i, p in enumerate(plain)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"n{i}", F.lit(0)).alias("n_null"), F.coalesce(f"b{i}", F.lit(0)).alias("n_blank")) for i, f in enumerate(fields)])
    return one.select(F.inline(rows))


def missing_grid(seen: DataFrame, languages: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Expected (``language``, ``split``) files that were not seen.  The grid is a literal of known size."""
    spark = seen.sparkSession
    grid = spark.createDataFrame([(a, b) for a in languages for b in splits], "language string, split string")
    return grid.join(seen.select("language", "split").distinct(), ["language", "split"], "left_anti")
