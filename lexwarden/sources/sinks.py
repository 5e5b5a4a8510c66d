"""Sinks: JSON lines, small CSV and JSON results, manifests, and safe overwriting."""

from __future__ import annotations

import csv
import json
import os
import shutil
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwarden.operators.quality import check_required_fields
from lexwarden.schemas import BENCHMARK_REQUIRED

#: Rows that a driver-side result file may have.
MAX_SMALL = 100_000


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists", required: tuple[str, ...] = ()) -> None:
    """JSON lines in UTF-8 with nulls kept.  ``one_file`` is for small benchmark files only."""
    check_required_fields(df, required)
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_benchmark(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A benchmark file; the fields of its contract must be there."""
    write_jsonl(df, path, one_file=True, mode=mode, required=BENCHMARK_REQUIRED)


def small_rows(df: DataFrame) -> list[dict]:
    """The rows of a small result on the driver; more than ``MAX_SMALL`` raise."""
    rows = df.limit(MAX_SMALL + 1).collect()
    if len(rows) > MAX_SMALL:
        raise ValueError(f"more than {MAX_SMALL} rows: write it with Spark")
    return [r.asDict(recursive=True) for r in rows]


def write_csv(df: DataFrame, path: str, bom: bool = True) -> int:
    """One CSV file with a header, and a byte order mark unless told otherwise; returns the rows written."""
    rows = small_rows(df)
    with _replacing(path) as name, open(name, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as file:
        out = csv.DictWriter(file, fieldnames=df.columns)
        out.writeheader()
        out.writerows(rows)
    return len(rows)


def write_json(value: DataFrame | dict | list, path: str) -> None:
    """One JSON file: an array of rows, or a manifest."""
    data = small_rows(value) if isinstance(value, DataFrame) else value
    with _replacing(path) as name, open(name, "w", encoding="utf-8") as file:
        json.dump(data, file, ensure_ascii=False, indent=2, default=str)
        file.write("\n")


def manifest(counters: DataFrame, **facts) -> dict:
    """Counters (``key``, ``n``) and facts of a run, with the UTC time."""
    return {"created_at": datetime.now(UTC).isoformat(timespec="seconds"), **facts, **{r["key"]: r["n"] for r in small_rows(counters.orderBy("key"))}}


def splits_manifest(df: DataFrame, folder: str, source: str, languages: list[str], split: str = "source_split") -> dict:
    """The manifest of prepared splits: path, rows, counters and content digest of each."""
    from lexwarden.operators.quality import split_counters

    counts: dict[str, dict[str, int]] = {}
    for r in small_rows(split_counters(df).orderBy(split, "key")):
        counts.setdefault(r[split], {})[r["key"]] = r["n"]
    digests = {name: small_rows(written_digest(df.where(F.col(split).eqNullSafe(name))))[0]["digest"] for name in counts}  # one row a split
    return {"source": source, "languages": languages, "splits": {str(n): {"path": os.path.join(folder, f"{n}.jsonl"), "rows": c["examples"], "digest": digests[n], "counts": c} for n, c in counts.items()}}


def written_digest(df: DataFrame) -> DataFrame:
    """One row (``rows``, ``digest``): an order-free digest of a frame's content, for manifests of many files."""
    return df.select(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.hex(F.pmod(F.coalesce(F.sum("h"), F.lit(0)), F.lit(1 << 62)).cast("long")).alias("digest"))


def move_to_backup(path: str, now: datetime | None = None) -> str | None:
    """Moves what stands at ``path`` beside it under a UTC stamp; returns its new place."""
    if not os.path.exists(path):
        return None
    to = f"{path}.backup-{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%SZ')}"
    shutil.move(path, to)
    return to


class _replacing:
    """A temporary name in the target's folder that takes the target's place on success."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self) -> str:
        folder = os.path.dirname(os.path.abspath(self.path))
        os.makedirs(folder, exist_ok=True)
        handle, self.name = tempfile.mkstemp(dir=folder)
        os.close(handle)
        return self.name

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            os.replace(self.name, self.path)
        else:
            os.unlink(self.name)
