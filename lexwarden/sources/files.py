"""CSV records, archives, weight headers and file checks."""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import os
import shutil
import stat
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwarden.functions.text import LANGUAGE_DIRECTORIES
from lexwarden.sources.sinks import move_to_backup

#: Guards of archives.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 200_000, 100 << 30, 10_000


def read_csv_records(spark: SparkSession, root: str, languages: Sequence[str]) -> DataFrame:
    """(``language``, ``file_name``, ``record_no``, ``prompt``) of headerless CSV files below language directories.

    A record's cells are joined with commas again and stripped; empty ones are skipped but numbered.  Files whose stem
    contains "sense" are left out.  A byte order mark is no text.  Unknown languages and missing files raise.
    """
    frames = []
    for language in languages:
        if language not in LANGUAGE_DIRECTORIES:
            raise ValueError(f"unsupported language: {language}")
        folder = Path(root, LANGUAGE_DIRECTORIES[language])
        if not folder.is_dir():
            raise FileNotFoundError(f"no directory for {language}: {folder}")
        if not any("sense" not in p.stem.lower() for p in folder.glob("*.csv")):
            raise FileNotFoundError(f"no CSV files in {folder}")
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(str(folder))
        frames.append(files.select(F.lit(language).alias("language"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content"))
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    chosen = every.where(~F.lower(F.regexp_replace("file_name", r"\.csv$", "")).contains("sense"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, name, content in zip(batch["language"], batch["file_name"], batch["content"], strict=True):
                records = enumerate(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline="")), 1)
                rows = [(language, name, n, p) for n, cells in records if (p := ",".join(cells).strip())]
                yield pd.DataFrame(rows, columns=["language", "file_name", "record_no", "prompt"])

    return chosen.mapInPandas(parse, "language string, file_name string, record_no long, prompt string")


def archive_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``archive``, ``name``, ``size``, ``compressed``, ``mode``) of the members of ZIP files."""

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    rows = [(path, m.filename, m.file_size, m.compress_size, m.external_attr >> 16) for m in archive.infolist()]
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "compressed", "mode"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(listing, "archive string, name string, size long, compressed long, mode long")


def archive_totals(members: DataFrame) -> DataFrame:
    """Entries and bytes per archive, and what speaks against it (null if nothing does)."""
    norm = F.regexp_replace("name", r"\\", "/")
    unsafe = norm.startswith("/") | F.array_contains(F.split(norm, "/"), "..")
    link = F.col("mode").bitwiseAND(0o170000) == stat.S_IFLNK
    out = members.withColumn("__u", unsafe).withColumn("__l", link).groupBy("archive").agg(
        F.count("*").alias("entries"), F.sum("compressed").alias("compressed_bytes"), F.sum("size").alias("uncompressed_bytes"),
        F.max("__u").alias("__u"), F.max("__l").alias("__l"), F.min(F.least("size", "compressed")).alias("__s"),
    )
    problem = (
        F.when(F.col("entries") > MAX_ENTRIES, "too many entries").when(F.col("__u"), "unsafe path").when(F.col("__l"), "symbolic link").when(F.col("__s") < 0, "invalid size")
        .when(F.col("uncompressed_bytes") > MAX_BYTES, "too large").when((F.col("compressed_bytes") > 0) & (F.col("uncompressed_bytes") > MAX_RATIO * F.col("compressed_bytes")), "suspicious ratio")
    )
    return out.select("archive", "entries", "compressed_bytes", "uncompressed_bytes", problem.alias("problem"))


def check_archives(members: DataFrame) -> None:
    """Raises if something speaks against an archive."""
    bad = archive_totals(members).where("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['archive']}: {bad[0]['problem']}")


def merged_members(members: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(``name``, ``n``): names that a merge of the archives would repeat (n > 1) or miss (n = 0)."""
    seen = members.groupBy("name").agg(F.count("*").alias("n"))
    wanted = members.sparkSession.createDataFrame([(e,) for e in expected], "name string")
    return seen.join(wanted, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def merge_archives(parts: Sequence[str], out: str, expected: Sequence[str] = ()) -> int:
    """One ZIP of the members of several, on the driver; a repeated or missing member raises and leaves nothing behind."""
    seen: set[str] = set()
    draft = out + ".part"
    try:
        with zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED) as target:
            for part in parts:
                with zipfile.ZipFile(part) as source:
                    for name in source.namelist():
                        if name in seen:
                            raise ValueError(f"repeated member: {name}")
                        seen.add(name)
                        with source.open(name) as a, target.open(name, "w", force_zip64=True) as b:
                            shutil.copyfileobj(a, b, 1 << 20)
        if lost := sorted(set(expected) - seen):
            raise ValueError(f"missing members: {lost}")
        os.replace(draft, out)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
    return len(seen)


def extract_archive(path: str, out: str) -> int:
    """Extracts a checked ZIP file beside ``out`` and moves it there; what stood there is kept as a backup.

    An unsafe name, a link or a suspicious size raises before anything is written; a failure leaves ``out`` as it was.
    """
    with zipfile.ZipFile(path) as archive:
        members = archive.infolist()
        size, packed = sum(m.file_size for m in members), sum(m.compress_size for m in members)
        if len(members) > MAX_ENTRIES or size > MAX_BYTES or packed and size > MAX_RATIO * packed:
            raise ValueError(f"{path}: too many entries or bytes")
        for m in members:
            parts = PurePosixPath(m.filename.replace("\\", "/"))
            if parts.is_absolute() or ".." in parts.parts or stat.S_ISLNK(m.external_attr >> 16):
                raise ValueError(f"{path}: unsafe member {m.filename!r}")
        draft = f"{out}.draft-{uuid.uuid4().hex}"
        try:
            archive.extractall(draft)
            move_to_backup(out)
            os.replace(draft, out)
        finally:
            shutil.rmtree(draft, ignore_errors=True)
    return len(members)


def chosen_archives(specs: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    """The archive specifications with the given keys, all without any; an unknown key raises."""
    if not only:
        return specs
    unknown = sorted(set(only) - {r["key"] for r in specs.select("key").distinct().collect()})  # a handful of archives
    if unknown:
        raise ValueError(f"unknown archives: {unknown}")
    return specs.where(F.col("key").isin(*only))


#: The files of the benchmarks.
BENCHMARK_FILES = {"cultureguard": "cultureguard_test_9lang.jsonl", "xsafety": "xsafety_multilingual.jsonl", "sea_vi": "sea_safeguard_vi.jsonl"}


def benchmark_files(folder: str) -> dict[str, str]:
    """The path of each benchmark's file."""
    return {name: os.path.join(folder, file) for name, file in BENCHMARK_FILES.items()}


def match_archive(folder: str, patterns: Sequence[str]) -> str | None:
    """The one file whose name fits a pattern, case set aside; None if none does, more than one raises."""
    names = sorted(n for n in os.listdir(folder) if any(fnmatch.fnmatchcase(n.lower(), p.lower()) for p in patterns))
    if len(names) > 1:
        raise ValueError(f"several files fit {list(patterns)}: {names}")
    return os.path.join(folder, names[0]) if names else None


def find_root(folder: str, marker: str, skip: Sequence[str] = ("__MACOSX", ".cache")) -> str:
    """The directory that holds ``marker``: the folder itself, else exactly one below it."""
    parts = PurePosixPath(marker).parts
    if Path(folder, *parts).exists():
        return folder
    found = {str(p.parents[len(parts) - 1]) for p in Path(folder).rglob(parts[-1]) if p.parts[-len(parts) :] == parts and not set(skip) & set(p.parts)}
    if len(found) != 1:
        raise ValueError(f"expected one root with {marker}, found {sorted(found)}")
    return found.pop()


def weight_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(``path``, ``ok``): whether each weight file starts with a length and a JSON object of that length.

    Executors read the head of each file on the shared file system only.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "ok": [_header_ok(p) for p in batch["path"]]})

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(check, "path string, ok boolean")


def _header_ok(path: str) -> bool:
    try:
        with open(path, "rb") as file:
            n = int.from_bytes(file.read(8), "little")
            return 2 <= n <= min(100 << 20, os.path.getsize(path) - 8) and isinstance(json.loads(file.read(n)), dict)
    except (OSError, ValueError):
        return False


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(``path``, ``bytes``, ``sha256``) of files that fit in a row."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def readiness(spark: SparkSession, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """(``key``, ``path``, ``ready``, ``bytes``) of expected files or non-empty directories, checked on the driver."""
    rows = []
    for key, path in expected:
        folder = os.path.isdir(path)
        ready = bool(os.listdir(path)) if folder else os.path.isfile(path)
        rows.append((key, path, ready, os.path.getsize(path) if ready and not folder else None))
    return spark.createDataFrame(rows, "key string, path string, ready boolean, bytes long")


def check_ready(status: DataFrame) -> None:
    """Raises, naming the keys that are not ready."""
    missing = sorted(r["key"] for r in status.where(~F.col("ready")).select("key").collect())
    if missing:
        raise ValueError("not ready: " + ", ".join(missing))


def next_actions(status: DataFrame, advice: DataFrame) -> DataFrame:
    """(``step``, ``advice``, ``missing``): steps of which some file is missing.  ``advice``: (``key``, ``step``, ``advice``)."""
    open_keys = status.where(~F.col("ready")).select("key")
    return advice.join(open_keys, "key").groupBy("step", "advice").agg(F.sort_array(F.collect_set("key")).alias("missing")).orderBy("step")
