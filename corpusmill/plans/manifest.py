"""Queries over the event log and the source roots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import manifest as M
from corpusmill.plans.registry import CORE
from corpusmill.session import keep, table

LATEST = "(SELECT * FROM manifest_event QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"
KIND = "lower(trim(event))"


def events(spark, d):
    return table(spark, d, "manifest_event")


@CORE.query("manifest_latest_state", f"SELECT path, {KIND} AS event, hash, seq FROM {LATEST}")
def manifest_latest_state(spark, d):
    return M.latest_state(events(spark, d)).select("path", M.kind().alias("event"), "hash", "seq")


@CORE.query("manifest_alive", f"SELECT location, count(*) AS n_files, sum(chunks) AS n_chunks FROM {LATEST} WHERE {KIND} <> 'deleted' GROUP BY location")
def manifest_alive(spark, d):
    return M.alive(M.latest_state(events(spark, d))).groupBy("location").agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks"))


DIFF_SQL = f"""
    WITH scan AS (SELECT path, hash FROM manifest_event WHERE timestamp IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY path ORDER BY timestamp DESC, seq DESC) = 1),
         gone AS (SELECT path, hash, {KIND} AS kind FROM {LATEST})
    SELECT coalesce(s.path, g.path) AS path,
           CASE WHEN s.path IS NOT NULL AND (g.path IS NULL OR g.kind = 'deleted') THEN 'new'
                WHEN s.path IS NOT NULL AND s.hash IS NOT DISTINCT FROM g.hash THEN 'unchanged'
                WHEN s.path IS NOT NULL THEN 'changed' ELSE 'deleted' END AS status
    FROM scan s FULL JOIN gone g ON s.path = g.path
    WHERE s.path IS NOT NULL OR g.kind <> 'deleted'"""


def _diff(spark, d):
    """What a scan by timestamps sees against what the log by arrival says."""
    return M.diff(_scan(spark, d), M.latest_state(events(spark, d)))


@CORE.query("manifest_diff", DIFF_SQL)
def manifest_diff(spark, d):
    return _diff(spark, d)


@CORE.query("update_summary", f"SELECT status, count(*) AS n_files FROM ({DIFF_SQL}) GROUP BY status")
def update_summary(spark, d):
    return _diff(spark, d).groupBy("status").agg(F.count("*").alias("n_files"))


@CORE.query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


NAME = "regexp_extract(path, '[^/]*$')"


@CORE.query(
    "source_filter",
    f"""SELECT DISTINCT e.path, e.location AS root,
               lower(regexp_extract({NAME}, '[^.]\\.([^./]+)$', 1)) IN ('pptx','pdf','docx')
                 AND NOT starts_with({NAME}, '~$') AND NOT starts_with({NAME}, '.') AS supported,
               coalesce(len(list_filter(c.exclude, lambda x: {NAME} GLOB x)) > 0, false) AS excluded
        FROM (SELECT path, location FROM manifest_event) e LEFT JOIN (SELECT name, exclude FROM source_config) c ON c.name = e.location""",
)
def source_filter(spark, d):
    return M.excluded_files(events(spark, d).select("path", "location").distinct(), table(spark, d, "source_config"))


@CORE.query(
    "source_census",
    "SELECT c.name, coalesce(c.recurse, true) AS recurse, count(DISTINCT e.path) AS n_files FROM source_config c LEFT JOIN manifest_event e ON e.location = c.name GROUP BY c.name, c.recurse",
)
def source_census(spark, d):
    files = events(spark, d).select("location", "path").distinct().groupBy("location").agg(F.count("*").alias("n"))
    return table(spark, d, "source_config").join(files, F.col("location") == F.col("name"), "left").select(
        "name", F.coalesce("recurse", F.lit(True)).alias("recurse"), F.coalesce("n", F.lit(0)).alias("n_files")
    )


@CORE.query(
    "source_roots",
    """SELECT c.name, CASE WHEN starts_with(c.path, '/') THEN c.path ELSE '/srv/' || regexp_replace(c.path, '^\\./', '') END AS path,
              len(coalesce(c.exclude, [])) AS n_exclude, count(DISTINCT e.doc_type) AS n_types
       FROM source_config c LEFT JOIN manifest_event e ON e.location = c.name GROUP BY ALL""",
)
def source_roots(spark, d):
    """Configured roots with their paths resolved, and how many types of document each has."""
    types = events(spark, d).groupBy("location").agg(F.countDistinct("doc_type").alias("n"))
    path = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/srv/"), F.regexp_replace("path", r"^\./", "")))
    return table(spark, d, "source_config").join(types, F.col("location") == F.col("name"), "left").select(
        "name", path.alias("path"), F.size(F.coalesce("exclude", F.array().cast("array<string>"))).alias("n_exclude"), F.coalesce("n", F.lit(0)).alias("n_types")
    )


SCAN_SQL = "SELECT path, hash FROM manifest_event WHERE timestamp IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY timestamp DESC, seq DESC) = 1"


def _scan(spark, d):
    return events(spark, d).where("timestamp is not null").groupBy("path").agg(F.max_by("hash", F.struct("timestamp", "seq")).alias("hash"))


@CORE.query(
    "resume_filter",
    f"""SELECT s.path, s.hash FROM ({SCAN_SQL}) s WHERE NOT (s.path IN (SELECT path FROM manifest_event WHERE {KIND} = 'ingested' AND path IS NOT NULL)
        AND EXISTS (SELECT 1 FROM {LATEST} l WHERE l.path = s.path AND l.hash = s.hash))""",
)
def resume_filter(spark, d):
    """Scanned files that were never taken in, or whose content isn't that of their last event."""
    e = events(spark, d)
    return M.to_do(_scan(spark, d), e.where(M.kind() == "ingested").select("path"), M.latest_state(e).select("path", "hash"))


def pick(keys, substrings: tuple[str, ...], limit: int):
    """The first keys that have one of the substrings in them, or of all where none is asked for; a limit of 0 is none."""
    hit = F.lit(not substrings)
    for s in substrings:
        hit = hit | F.col("path").contains(s)
    found = keys.where(hit).select("path").orderBy("path")
    return found.limit(limit) if limit else found


PICKED = f"SELECT path FROM {LATEST} WHERE {KIND} <> 'deleted' AND (contains(path, 'Risk Register') OR contains(path, 'Archive/'))"


@CORE.query("pick_backfill", f"{PICKED} ORDER BY path LIMIT 50")
def pick_backfill(spark, d):
    """The first 50 living files whose key has one of two names in it (the limit is the feature)."""
    return pick(M.alive(M.latest_state(events(spark, d))), ("Risk Register", "Archive/"), 50)


@CORE.query("pick_all", PICKED)
def pick_all(spark, d):
    """All of them: a limit of 0 is none."""
    return pick(M.alive(M.latest_state(events(spark, d))), ("Risk Register", "Archive/"), 0)


@CORE.query(
    "doc_type_from_name",
    f"SELECT lower(regexp_extract({NAME}, '[^.]\\.([^./]+)$', 1)) AS extension, doc_type, count(*) AS n FROM manifest_event GROUP BY ALL",
)
def doc_type_from_name(spark, d):
    return events(spark, d).groupBy(M.extension(M.file_name(F.col("path"))).alias("extension"), "doc_type").agg(F.count("*").alias("n"))


STEM = f"regexp_replace({NAME}, '([^.])\\.[^./]+$', '\\1')"


@CORE.query(
    "display_names",
    f"""SELECT DISTINCT path, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace({STEM}, '[_-]', ' ', 'g'), ' \xa0'), '[^\\p{{L}}]+|[\\p{{L}}]+'),
               lambda x: upper(x[1]) || lower(x[2:])), '') AS display_name FROM manifest_event""",
)
def display_names(spark, d):
    return events(spark, d).select("path").distinct().select("path", T.display_name(M.stem(M.file_name(F.col("path")))).alias("display_name"))


#: The marks of file names as in operators/manifest.py.
def _fixpoint(rounds: int = 12) -> str:
    mark = "'(\\s*-?\\s*copy\\b|\\s*\\(\\d+\\)|\\s*[_-]1)\\s*$'"
    sql = "lower(trim(stem))"
    for _ in range(rounds):
        sql = f"trim(regexp_replace({sql}, {mark}, ''))"
    return sql


VARIANTS_SQL = f"""
    files AS (SELECT path, seq, CASE WHEN coalesce(relative_path, '') <> '' THEN relative_path ELSE path END AS rel FROM {LATEST} WHERE {KIND} <> 'deleted'),
    stems AS (SELECT path, seq, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS parent,
                     regexp_replace(regexp_extract(rel, '[^/]*$'), '([^.])\\.[^./]+$', '\\1') AS stem FROM files),
    bases AS (SELECT *, {_fixpoint()} AS bare FROM stems),
    variants AS (SELECT path, seq, parent, stem,
                   CASE WHEN regexp_matches(bare, '(?i)^(.*?)[\\s_-]v(\\d+(?:\\.\\d+)?)$') THEN trim(regexp_extract(bare, '(?i)^(.*?)[\\s_-]v(\\d+(?:\\.\\d+)?)$', 1)) ELSE bare END AS base,
                   regexp_matches(stem, '(?i)(\\bcopy\\b|\\(\\d+\\)|[_-]1)\\s*$') AS artifact,
                   regexp_matches(stem, '(?i)\\bweek\\s*\\d+\\b|\\bissue\\s*\\d+\\b|\\d{{4}}-\\d{{2}}-\\d{{2}}|\\b\\d{{8}}\\b') AS apart,
                   try_cast(nullif(regexp_extract(trim(stem), '(?i)^(.*?)[\\s_-]v(\\d+(?:\\.\\d+)?)$', 2), '') AS DOUBLE) AS version
                 FROM bases)"""
ARTIFACTS_SQL = """
    plain AS (SELECT parent, base, arg_min(path, (length(stem), seq)) AS keep FROM variants WHERE NOT artifact GROUP BY ALL),
    artifacts AS (SELECT p.keep, v.path AS remove FROM variants v JOIN plain p USING (parent, base) WHERE v.artifact)"""
VERSIONS_SQL = """
    versioned AS (SELECT v.* FROM variants v LEFT JOIN plain p USING (parent, base) WHERE NOT (v.artifact AND p.keep IS NOT NULL) AND NOT v.apart AND v.version IS NOT NULL),
    best AS (SELECT parent, base, arg_max(path, (version, -seq)) AS keep FROM versioned GROUP BY ALL HAVING count(*) > 1),
    versions AS (SELECT b.keep, v.path AS remove FROM versioned v JOIN best b USING (parent, base) WHERE v.path <> b.keep)"""


def _variants(spark, d):
    return M.file_variants(M.latest_state(events(spark, d)))


@CORE.query("dedup_artifacts", f"WITH {VARIANTS_SQL}, {ARTIFACTS_SQL} SELECT keep, remove FROM artifacts")
def dedup_artifacts(spark, d):
    return M.artifact_removals(_variants(spark, d))


@CORE.query("dedup_versions", f"WITH {VARIANTS_SQL}, {ARTIFACTS_SQL}, {VERSIONS_SQL} SELECT keep, remove FROM versions")
def dedup_versions(spark, d):
    return M.version_removals(_variants(spark, d))


@CORE.query(
    "dedup_proposal",
    f"""WITH {VARIANTS_SQL}, {ARTIFACTS_SQL}, {VERSIONS_SQL}, removals AS (SELECT keep, remove, 'artifact' AS reason FROM artifacts UNION ALL SELECT keep, remove, 'version' FROM versions)
        SELECT keep, reason, count(*) AS n_remove, min(remove) AS first_remove FROM removals GROUP BY keep, reason""",
)
def dedup_proposal(spark, d):
    """Removals by the file that stays and the reason."""
    return _removals(spark, d).groupBy("keep", "reason").agg(F.count("*").alias("n_remove"), F.min("remove").alias("first_remove"))


def _removals(spark, d):
    v = keep(_variants(spark, d), "variants")
    return M.artifact_removals(v).withColumn("reason", F.lit("artifact")).unionByName(M.version_removals(v).withColumn("reason", F.lit("version")))


@CORE.query(
    "dedup_removals",
    f"""WITH {VARIANTS_SQL}, {ARTIFACTS_SQL}, {VERSIONS_SQL}, removals AS (SELECT keep, remove, 'artifact' AS reason FROM artifacts UNION ALL SELECT keep, remove, 'version' FROM versions)
        SELECT keep, reason, CAST(row_number() OVER (PARTITION BY keep, reason ORDER BY remove) AS INTEGER) AS nth, remove FROM removals""",
)
def dedup_removals(spark, d):
    """The proposal as a list: what to remove for each file that stays, in order of names."""
    nth = F.row_number().over(Window.partitionBy("keep", "reason").orderBy("remove"))
    return _removals(spark, d).select("keep", "reason", nth.alias("nth"), "remove")


@CORE.query(
    "removal_reasons",
    f"SELECT coalesce(nullif(trim(reason), ''), 'none') AS reason, count(*) AS n, count(DISTINCT path) AS n_paths FROM manifest_event WHERE {KIND} = 'deleted' GROUP BY 1",
)
def removal_reasons(spark, d):
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("none"))
    return events(spark, d).where(M.kind() == "deleted").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))
