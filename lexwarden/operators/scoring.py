"""The boundary to model scorers, and a deterministic stand-in for likelihood.

A scorer is a function from an iterator of pandas frames to an iterator of pandas frames, run by ``mapInPandas``; model
inference itself lies outside this engine.  The stand-in scores tokens 2..n of a text by unigram frequencies of the whole
corpus.  It keeps every rule of the downstream sums and is no language model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwarden.session import stored

#: Words of a vocabulary that is sent to each executor, some 50 MB.
MAX_WORDS = 1_000_000

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score(df: DataFrame, scorer: Scorer, adds: T.StructType, batch_rows: int | None = None) -> DataFrame:
    """Runs the scorer over Arrow batches of ``df``; it returns the columns of ``df`` and ``adds``.

    ``batch_rows`` cuts the frames that the scorer sees.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if batch_rows is None:
            yield from scorer(frames)
            return
        yield from scorer(frame.iloc[i : i + batch_rows] for frame in frames for i in range(0, len(frame), batch_rows))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *adds.fields]))


def unigram_rows(df: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """(``key``, ``carry``, ``input_tokens``, ``tokens_scored``, ``utf8_bytes``, ``nll_nats``) of each text that is not blank.

    Words are what stands between single spaces.  Each text is reduced to its word counts, which are written once and read
    for the corpus counts and for the texts.  A vocabulary of up to ``MAX_WORDS`` is broadcast; a larger one is joined by
    word, whose frequent ones adaptive execution splits.
    """
    texts = df.select(key, *carry, text).where(F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) != "")
    words = texts.select(key, F.posexplode(F.split(text, " ")).alias("at", "word"))
    inside = words.groupBy(key, "word").agg(F.sum(F.when(F.col("at") > 0, 1).otherwise(0)).alias("scored"), F.count("*").alias("n"))
    inside, _ = stored(inside)
    corpus = inside.groupBy("word").agg(F.sum("n").alias("seen"))
    total = inside.agg(F.sum("n").alias("total"))  # one number
    costs = corpus.crossJoin(F.broadcast(total)).select("word", (F.ln("total") - F.ln("seen")).alias("cost"))
    if corpus.limit(MAX_WORDS + 1).count() <= MAX_WORDS:
        costs = F.broadcast(costs)
    nll = inside.join(costs, "word").groupBy(key).agg(F.sum("n").alias("input_tokens"), F.sum("scored").alias("tokens_scored"), F.sum(F.col("scored") * F.col("cost")).alias("nll_nats"))
    return texts.select(key, *carry, F.octet_length(text).cast("long").alias("utf8_bytes")).join(nll, key)
