"""JSON lines with provenance, JSON arrays and benchmark files.

Line numbers come from two narrow passes instead of whole files in a row: Spark reads the lines of a file block in order,
so that the number of a line is its place in the block plus the lines of the earlier blocks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwarden.schemas import RAW_NEMOTRON

#: Blocks of files whose line counts are broadcast; more are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str | list[str], name_glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """(``source_path``, ``source_line``, ``value``): every physical line, blank ones included, numbered from 1.

    Counts the lines of the file blocks when called (one narrow job).
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    blocks = lines.groupBy("source_path", "block").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    before = Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_path", "block", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if blocks.limit(MAX_BROADCAST_BLOCKS + 1).count() <= MAX_BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    joined = lines.join(blocks, ["source_path", "block"])
    return joined.select(F.regexp_replace("source_path", "^file:/+", "/").alias("source_path"), (F.col("at") - F.col("first_at") + F.col("before") + 1).alias("source_line"), "value")


def _typed(value, kind: T.DataType):
    """A JSON value in a column's type: NaN and wrong types are null, numbers and flags in a text column keep Python's spelling."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StructType):
        return {f.name: _typed(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.LongType):
        return int(value) if isinstance(value, (int, float)) else None
    return float(value) if isinstance(value, (int, float)) else None


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_NEMOTRON, name_glob: str | None = "*.jsonl", strict: bool = False, falsy_ids: bool = True) -> DataFrame:
    """``source_path``, ``source_line`` and the fields of ``schema`` of each JSON object line.

    Blank lines are skipped, malformed lines raise with their place.  A line that holds another JSON value is skipped, or
    raises when ``strict``.  The bare token ``NaN`` is null.  ``falsy_ids``: a number 0 or false in ``id`` is no id.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for place, line, text in zip(frame["source_path"], frame["source_line"], frame["value"], strict=True):
                if not text.strip():
                    continue
                try:
                    value = json.loads(text)
                except ValueError as problem:
                    raise ValueError(f"malformed JSON at {place}:{line}: {problem}") from None
                if not isinstance(value, dict):
                    if strict:
                        raise ValueError(f"no object at {place}:{line}")
                    continue
                if falsy_ids and "id" in value and not value["id"]:
                    value["id"] = None
                rows.append((place, line, *[_typed(value.get(f.name), f.dataType) for f in schema.fields]))
            yield pd.DataFrame(rows, columns=["source_path", "source_line", *schema.fieldNames()])

    out = T.StructType([T.StructField("source_path", T.StringType()), T.StructField("source_line", T.LongType()), *schema.fields])
    return numbered_lines(spark, path, name_glob).mapInPandas(parse, out)


def read_split(spark: SparkSession, root: str, split: str, schema: T.StructType = RAW_NEMOTRON) -> DataFrame:
    """All ``<split>.jsonl`` below ``root`` (``validation.jsonl`` is ``valid`` too); none raises."""
    names = ("valid", "validation") if split == "valid" else (split,)
    if not any(f in {f"{n}.jsonl" for n in names} for _, _, files in os.walk(root) for f in files):
        raise FileNotFoundError(f"no {split} files below {root}")
    glob = "{" + ",".join(f"{n}.jsonl" for n in names) + "}"
    return read_jsonl(spark, root, schema, glob)


def read_contract(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Well-formed JSON lines of a known schema, by the built-in reader; malformed lines raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of objects; a missing file or another JSON value gives no rows.  For metric files, read on the driver."""
    rows = []
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            value = json.load(file)
        rows = [tuple(_typed(v.get(f.name), f.dataType) for f in schema.fields) for v in value if isinstance(v, dict)] if isinstance(value, list) else []
    return spark.createDataFrame(rows, schema)
