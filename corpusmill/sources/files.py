"""Source roots, their files, and the logs on disk."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.manifest import file_name, is_supported, matches_glob

CONFIG = "name string, path string, recurse boolean, exclude array<string>"
EVENT = "path string, event string, hash string, timestamp string, chunks int, doc_type string, previous_hash string, location string, display_name string, relative_path string, reason string"
#: The root that stands in where none is configured.
FALLBACK = {"name": "Local", "path": "sources", "recurse": True, "exclude": []}


def read_config(spark: SparkSession, file: str, base: str = ".") -> DataFrame:
    """The configured roots: name, path (resolved against ``base``), recurse, exclude.

    Entries without a name or path are skipped; a file that is missing, no list or without a sound entry gives
    the one fallback root. The file is a few lines that people edit, and is read where the session runs.
    """
    try:
        found = json.loads(Path(file).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = []
    sound = [e for e in (found if isinstance(found, list) else []) if isinstance(e, dict) and isinstance(e.get("name"), str) and isinstance(e.get("path"), str)]
    rows = [
        (e["name"], str(Path(base, e["path"])), bool(e.get("recurse", True)), [x for x in e.get("exclude") or [] if isinstance(x, str)]) for e in (sound or [FALLBACK])
    ]
    return spark.createDataFrame(rows, CONFIG)


def scan(spark: SparkSession, config: DataFrame, extra: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """path (root name and relative path), location, relative_path, hash of the supported files under all roots.

    Files are named first, filtered, and only then read. Roots that are missing are skipped; so are hidden
    files, lock files, and names that match one of the root's patterns. ``extra``: more (name, path) roots.
    Spark lists no files whose name begins with an underscore.
    """
    out = None
    roots = [(r["name"], r["path"], r["recurse"], r["exclude"] or []) for r in config.collect()] + [(n, p, True, []) for n, p in extra]
    for name, folder, recurse, exclude in roots:
        if "://" not in folder and not Path(folder).is_dir():
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if recurse else "false").load(folder)
        file = file_name(F.col("path"))
        own = files.where(is_supported(file))
        for pattern in exclude:
            own = own.where(~matches_glob(file, F.lit(pattern)))
        bare = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
        relative = F.substring(bare, len(folder.rstrip("/")) + 2, 1_000_000)
        part = own.select(
            F.concat(F.lit(name + "/"), relative).alias("path"), F.lit(name).alias("location"), relative.alias("relative_path"), F.sha2("content", 256).alias("hash")
        )
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "path string, location string, relative_path string, hash string")


def read_events(spark: SparkSession, file: str) -> DataFrame:
    """A log that is one JSON array, with seq, the place in it; no rows where it can't be read.

    Such a file is read by one task; logs that grow are kept as a table (append_events).
    """
    if "://" not in file and not Path(file).exists():
        return spark.createDataFrame([], "seq long, " + EVENT)
    whole = spark.read.text(file, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in EVENT.split(', '))}>>")).alias("seq", "e"))
    return rows.select(F.col("seq").cast("long").alias("seq"), "e.*").where("path is not null")


def append_events(log: str, events: DataFrame) -> None:
    """Add events to the table at ``log``; their seq continues after the largest there is."""
    spark = events.sparkSession
    try:
        last = spark.read.parquet(log).agg(F.max("seq")).first()[0] or 0
    except Exception as error:  # there is no log yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        last = 0
    events.withColumn("seq", F.monotonically_increasing_id() + last + 1).write.mode("append").parquet(log)


def read_done(spark: SparkSession, file: str) -> DataFrame:
    """key: what a backfill has done, from ``{"done": [...]}``; empty where there is nothing to read."""
    try:
        keys = json.loads(Path(file).read_text(encoding="utf-8"))["done"]
    except (OSError, ValueError, KeyError, TypeError):
        keys = []
    return spark.createDataFrame([(k,) for k in keys if isinstance(k, str)], "key string")
