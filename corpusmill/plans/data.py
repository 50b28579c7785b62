"""Queries of the training-data problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.changes import apply_changes, balances, current_files, identifiers, latest_of, merge_changes, read_changes
from corpusmill.operators.orphans import orphan_report, page_orphans
from corpusmill.plans.registry import CORE
from corpusmill.plans.wiki import key_sql, slug_sql, strip_sql
from corpusmill.session import keep, table


def instant_sql(c: str) -> str:
    s = strip_sql(c)
    return f"""epoch_us(try_cast(CASE WHEN regexp_matches({s}, '\\d{{2}}:\\d{{2}}.*([Zz]|[+-]\\d{{2}}:?\\d{{2}})$') THEN {s}
        WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {s} || 'T00:00:00Z' ELSE {s} || 'Z' END AS TIMESTAMPTZ))"""


BIG = str(1 << 62)
STATE_SQL = f"""
    read AS (SELECT path AS key, {key_sql('event')} AS kind, nullif(trim(hash), '') AS content, nullif(trim(previous_hash), '') AS replaced, {instant_sql('timestamp')} AS t
             FROM manifest_event WHERE path IS NOT NULL),
    change AS (SELECT key, kind, content, replaced, max(t) AS t FROM read WHERE kind IN ('ingested', 'updated', 'deleted')
               GROUP BY key, kind, content, replaced, t IS NULL, floor(t / 1000000)),
    ends AS (SELECT key, content AS c, 1 AS brought, false AS gone, t FROM change WHERE kind <> 'deleted' UNION ALL SELECT key, content, 0, true, t FROM change WHERE kind = 'deleted'
             UNION ALL SELECT key, replaced, 0, false, NULL FROM change WHERE kind <> 'deleted' AND replaced IS NOT NULL),
    balance AS (SELECT key, c, sum(brought) AS n_brought, sum(1 - brought) AS n_consumed, max(t) FILTER (brought = 1) AS brought_at, max(t) FILTER (gone) AS gone_at,
                count(*) FILTER (gone) AS n_gone FROM ends GROUP BY key, c),
    candidate AS (SELECT key, c, coalesce(brought_at, {BIG}) AS moment, 1 AS stays FROM balance WHERE n_brought > 0 AND (c IS NULL OR n_brought > n_consumed) UNION ALL
                  SELECT key, c, greatest(coalesce(gone_at, -{BIG}), coalesce(CASE WHEN n_brought = 1 AND c IS NOT NULL THEN brought_at END, -{BIG})), 0 FROM balance WHERE n_gone > 0),
    state AS (SELECT key AS path, coalesce(c, '') AS hash FROM (SELECT * FROM candidate QUALIFY row_number() OVER (PARTITION BY key ORDER BY moment DESC, stays DESC, c DESC NULLS LAST) = 1) WHERE stays = 1)"""
ORPHANS_SQL = f"""
    page AS (SELECT DISTINCT page_id, slug, created_at, updated_at, relations, sources FROM wiki_page),
    refs AS (SELECT DISTINCT * FROM (SELECT page_id, 'relations' AS field, {slug_sql('t')} AS target, moment FROM
               (SELECT page_id, moment, unnest(map_values(r)) AS t FROM (SELECT page_id, {instant_sql('updated_at')} AS moment, unnest(relations) AS r FROM page))
             UNION ALL SELECT page_id, 'sources', {key_sql('t')}, moment FROM (SELECT page_id, {instant_sql('updated_at')} AS moment, unnest(sources) AS t FROM page)) WHERE target <> ''),
    parent AS (SELECT field, target, bool_or(alive) AS alive, min(born) AS born FROM (
             SELECT 'relations' AS field, {slug_sql('slug')} AS target, true AS alive, {instant_sql('created_at')} AS born FROM page UNION ALL
             SELECT 'sources', {key_sql('path')}, false, {instant_sql('timestamp')} FROM manifest_event UNION ALL SELECT 'sources', {key_sql('path')}, true, NULL FROM state) GROUP BY ALL),
    judged AS (SELECT r.*, CASE WHEN p.target IS NULL THEN 'missing' WHEN NOT p.alive THEN 'deleted' WHEN r.moment < p.born THEN 'late' END AS state
               FROM refs r LEFT JOIN parent p ON p.field = r.field AND p.target = r.target)"""


@CORE.query("p2_found", f"WITH {STATE_SQL}, {ORPHANS_SQL} SELECT DISTINCT page_id, field, target, state FROM judged WHERE state IS NOT NULL")
def p2_found(spark, d):
    found = page_orphans(table(spark, d, "wiki_page"), table(spark, d, "manifest_event"))
    return found.select(F.col("owner").alias("page_id"), F.col("domain").alias("field"), "target", "state").distinct()


@CORE.query(
    "p2_report",
    f"""WITH {STATE_SQL}, {ORPHANS_SQL} SELECT field AS table_name, coalesce(strftime(make_timestamp(moment), '%Y-%m'), '') AS period, state, count(*) AS n_references, count(DISTINCT target) AS n_targets
        FROM judged WHERE state IS NOT NULL GROUP BY ALL""",
)
def p2_report(spark, d):
    return orphan_report(page_orphans(table(spark, d, "wiki_page"), table(spark, d, "manifest_event")))


@CORE.query("p3_found", f"WITH {STATE_SQL} SELECT path, hash FROM state")
def p3_found(spark, d):
    return current_files(table(spark, d, "manifest_event")).select("path", "hash")


FIELDS = ("location", "relative_path", "display_name", "doc_type", "chunks")


@CORE.query("p3_state")
def p3_state(spark, d):
    """The whole rows of the rebuilt table."""
    state = apply_changes(None, read_changes(table(spark, d, "manifest_event"), FIELDS))
    return state.select(F.col("key").alias("path"), F.coalesce("content", F.lit("")).alias("hash"), "row.*").drop("seq")


@CORE.query("p3_merged", f"WITH {STATE_SQL} SELECT path, hash FROM state")
def p3_merged(spark, d):
    """The same files when the second half of the feed, by order of arrival, is merged into a base made of the first."""
    events = table(spark, d, "manifest_event")
    half = (events.agg(F.max("seq")).first()[0] or 0) // 2
    first = read_changes(events.where(F.col("seq") <= half), FIELDS)
    seen, base = keep(identifiers(first).select("id"), "seen"), keep(balances(first), "balances")
    _, merged = merge_changes(seen, base, read_changes(events.where(F.col("seq") > half), FIELDS))
    return latest_of(merged).where("kind <> 'deleted'").select(F.col("key").alias("path"), F.coalesce("content", F.lit("")).alias("hash"))
