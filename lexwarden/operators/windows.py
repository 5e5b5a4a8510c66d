"""Overlapping token windows in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_window(max_length: int, stride: int) -> None:
    """Raises unless ``max_length >= 2`` and ``0 < stride < max_length``."""
    if max_length < 2 or not 0 < stride < max_length:
        raise ValueError(f"window {max_length} with stride {stride}")


def window_count(n: Column, max_length: int, stride: int) -> Column:
    """Number of windows over ``n`` tokens: none below 2."""
    check_window(max_length, stride)
    more = F.ceil((n - max_length) / F.lit(float(stride)))
    return F.when(n < 2, F.lit(0)).when(n <= max_length, F.lit(1)).otherwise(1 + more).cast("long")


def token_windows(df: DataFrame, key: str, n: Column, max_length: int = 2048, stride: int = 1024) -> DataFrame:
    """(``key``, ``window_no``, ``begin``, ``end``, ``target``, ``valid``): the windows that a scorer reads.

    ``target`` tokens are new in the window; the first window scores one less, as its first token has no predictor.
    The valid counts of a text sum to ``n - 1``.
    """
    base = df.select(key, n.cast("long").alias("n")).withColumn("windows", window_count(F.col("n"), max_length, stride)).where("windows > 0")
    one = base.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("window_no"))
    end, last_end = F.least(F.col("begin") + max_length, F.col("n")), F.least(F.col("begin") - stride + max_length, F.col("n"))
    one = one.withColumn("begin", F.col("window_no") * stride).withColumn("end", end)
    one = one.withColumn("target", F.when(F.col("window_no") == 0, F.col("end")).otherwise(F.col("end") - last_end))
    return one.select(key, "window_no", "begin", "end", "target", (F.col("target") - F.when(F.col("window_no") == 0, 1).otherwise(0)).cast("long").alias("valid"))
