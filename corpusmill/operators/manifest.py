"""The event log of ingested files: state, differences, source roots, duplicate file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import squeeze, strip

#: The types of document that are read.
SUPPORTED = ("pptx", "pdf", "docx")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each path by order of arrival (seq)."""
    last = Window.partitionBy("path").orderBy(F.col("seq").desc())
    return events.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def kind(event: Column = None) -> Column:
    return squeeze(F.col("event") if event is None else event)


def alive(state: DataFrame) -> DataFrame:
    """Without paths whose last event is a deletion."""
    return state.where(F.coalesce(kind() != "deleted", F.lit(True)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^./]+$", "")


def is_supported(name: Column) -> Column:
    """A document type that is read, and neither hidden nor a lock file."""
    return extension(name).isin(*SUPPORTED) & ~name.startswith("~$") & ~name.startswith(".")


def matches_glob(name: Column, pattern: Column) -> Column:
    """Shell pattern with ``*``, ``?``, ``[a-z]`` and ``[!a-z]``; case matters, and a bracket that is never closed stands for itself."""
    steps = (
        (r"([\\.^$|(){}+])", r"\\$1"), (r"\[(?!!?\]?[^\]]*\])", r"\\["), (r"\[!", "[^"),
        (r"\*(?![^\[\]]*\])", ".*"), (r"\?(?![^\[\]]*\])", "."),
    )
    for old, new in steps:
        pattern = F.regexp_replace(pattern, old, new)
    return F.rlike(name, F.concat(F.lit("(?s)^"), pattern, F.lit("$")))


def to_do(scanned: DataFrame, done: DataFrame, state: DataFrame) -> DataFrame:
    """path, hash of scanned files that a backfill still has to take: not done, or with another content than the last event says.

    ``scanned``: path, hash. ``done``: path. ``state``: path, hash of the last event, whatever its kind. A file without a hash is never done.
    """
    same = state.join(done.select("path").distinct(), "path", "left_semi").select("path", "hash")
    return scanned.join(same, ["path", "hash"], "left_anti")


def diff(scanned: DataFrame, state: DataFrame) -> DataFrame:
    """path, status (new, changed, unchanged, deleted) of files on disk against the last known state.

    ``scanned``: path, hash. A file that comes back after a deletion is new. Deleted files that are still
    away give no row.
    """
    known = state.select("path", F.col("hash").alias("old_hash"), F.coalesce(kind() != "deleted", F.lit(True)).alias("known"))
    here = scanned.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("here"))
    status = (
        F.when(F.col("here") & ~F.coalesce("known", F.lit(False)), "new")
        .when(F.col("here") & F.col("new_hash").eqNullSafe(F.col("old_hash")), "unchanged")
        .when(F.col("here"), "changed")
        .when(F.col("known"), "deleted")
    )
    return here.join(known, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def excluded_files(files: DataFrame, config: DataFrame) -> DataFrame:
    """path, root, supported, excluded of files under their source roots; ``files``: path, location."""
    roots = config.select(F.col("name").alias("location"), F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude"))
    name = file_name(F.col("path"))
    return files.select("path", "location").join(roots, "location", "left").select(
        "path",
        F.col("location").alias("root"),
        is_supported(name).alias("supported"),
        F.coalesce(F.exists("exclude", lambda p: matches_glob(name, p)), F.lit(False)).alias("excluded"),
    )


# --- duplicate file names ----------------------------------------------------------------------------

#: Marks of copies at the end of a stem, as they are found and taken off; of versions; and of what is apart.
_TAIL = r"(?i)(\bcopy\b|\(\d+\)|[_-]1)\s*$"
_STRIP = r"(?i)(\s*-?\s*copy\b|\s*\(\d+\)|\s*[_-]1)\s*$"
_VERSION = r"(?i)^(.*?)[\s_-]v(\d+(?:\.\d+)?)$"
_DISTINCT = r"(?i)\bweek\s*\d+\b|\bissue\s*\d+\b|\d{4}-\d{2}-\d{2}|\b\d{8}\b"


def normal_base(name: Column) -> Column:
    """A stem without copy marks (taken off one after the other) and then without one version mark."""
    lowered = F.lower(strip(name))
    # Every round takes off one mark, so there are no more rounds than marks anywhere in the name.
    marks = F.size(F.regexp_extract_all(lowered, F.lit(r"copy|\(\d+\)|[_-]1"), 0))
    bare = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), marks)), lowered, lambda acc, _: strip(F.regexp_replace(acc, _STRIP, "")))
    return F.when(bare.rlike(_VERSION), strip(F.regexp_extract(bare, _VERSION, 1))).otherwise(bare)


def file_variants(state: DataFrame) -> DataFrame:
    """Living files with what their names say: parent, base, stem, artifact, version, distinct."""
    rel = F.when(F.coalesce(F.col("relative_path"), F.lit("")) != "", F.col("relative_path")).otherwise(F.col("path"))
    s = stem(file_name(rel))
    return alive(state).select(
        "path",
        "seq",
        folder(rel).alias("parent"),
        normal_base(s).alias("base"),
        s.alias("stem"),
        s.rlike(_TAIL).alias("artifact"),
        s.rlike(_DISTINCT).alias("named_apart"),
        F.regexp_extract(strip(s), _VERSION, 2).try_cast("double").alias("version"),
    )


def artifact_removals(variants: DataFrame) -> DataFrame:
    """keep, remove: copies beside an original; the shortest original stays, then the oldest."""
    keep = variants.where(~F.col("artifact")).groupBy("parent", "base").agg(F.min_by("path", F.struct(F.length("stem"), F.col("seq"))).alias("keep"))
    return variants.where("artifact").join(keep, ["parent", "base"]).select("keep", F.col("path").alias("remove"))


def version_removals(variants: DataFrame) -> DataFrame:
    """keep, remove: lower versions beside the highest, among files that aren't copies or named apart."""
    originals = variants.where(~F.col("artifact")).select("parent", "base").distinct().withColumn("has_plain", F.lit(True))
    left = (
        variants.join(originals, ["parent", "base"], "left")
        .where(~(F.col("artifact") & F.coalesce("has_plain", F.lit(False))) & ~F.col("named_apart") & F.col("version").isNotNull())
    )
    best = left.groupBy("parent", "base").agg(F.max_by("path", F.struct(F.col("version"), -F.col("seq"))).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return left.join(best, ["parent", "base"]).where("path <> keep").select("keep", F.col("path").alias("remove"))
