"""Queries that put a knowledge base in order: normalised pages, stubs, removals as events, texts of hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import search_text as S
from corpusmill.functions import text as T
from corpusmill.operators import manifest as M
from corpusmill.operators import wiki as W
from corpusmill.plans import manifest as PM
from corpusmill.plans import wiki as PW
from corpusmill.plans.registry import CORE
from corpusmill.session import table

#: What a page gets whose value names no entry.
DEFAULTS = {"entity_type": ("supplier", "entities"), "domain": ("operations", "concepts"), "category": ("technical-note", None)}


def _note_sql(c: str) -> str:
    default, folder = DEFAULTS[c]
    only = f"folder = '{folder}' AND " if folder else ""
    return f"CASE WHEN {only}coalesce({c}, '') <> '' AND {c}_c IS NULL THEN '{c} ' || {c} || ' -> {default}' END"


@CORE.query(
    "normalized_pages",
    f"""WITH {PW.PAGES}, {PW.SYN}, word AS (SELECT field, word, min(value) AS value FROM syn GROUP BY ALL),
        coerced AS (SELECT p.page_id, p.folder, p.entity_type, p.domain, p.category, a.value AS entity_type_c, b.value AS domain_c, c.value AS category_c FROM pages p
          LEFT JOIN word a ON a.field = 'entity_type' AND a.word = {PW.key_sql('p.entity_type')} LEFT JOIN word b ON b.field = 'domain' AND b.word = {PW.key_sql('p.domain')}
          LEFT JOIN word c ON c.field = 'category' AND c.word = {PW.key_sql('p.category')})
        SELECT page_id, CASE WHEN folder = 'entities' THEN coalesce(entity_type_c, 'supplier') ELSE entity_type END AS entity_type,
               CASE WHEN folder = 'concepts' THEN coalesce(domain_c, 'operations') ELSE domain END AS domain, coalesce(category_c, 'technical-note') AS category,
               array_to_string(list_filter([{', '.join(_note_sql(c) for c in DEFAULTS)}], lambda x: x IS NOT NULL), '; ') AS notes FROM coerced""",
)
def normalized_pages(spark, d):
    """Fields set to entries of the vocabulary; a note where a value that was given had to be replaced."""
    p, v = PW.pages(spark, d), PW.vocab(spark, d)
    out = p.select("page_id", "folder", *DEFAULTS)
    for c in DEFAULTS:
        out = out.join(W.coerced(p, v, c, c).select("page_id", F.col("canonical").alias(c + "_c")), "page_id")
    fields, notes = [], []
    for c, (default, folder) in DEFAULTS.items():
        here = F.lit(True) if folder is None else F.col("folder") == folder
        fields.append(F.when(here, F.coalesce(c + "_c", F.lit(default))).otherwise(F.col(c)).alias(c))
        notes.append(F.when(here & (F.coalesce(c, F.lit("")) != "") & F.col(c + "_c").isNull(), F.concat(F.lit(c + " "), c, F.lit(" -> " + default))))
    return out.select("page_id", *fields, F.array_join(F.array_compact(F.array(*notes)), "; ").alias("notes"))


@CORE.query(
    "filled_fields",
    f"""WITH {PW.PAGES} SELECT page_id, coalesce(nullif(type, ''), CASE folder WHEN 'entities' THEN 'entity' WHEN 'concepts' THEN 'concept' ELSE folder END) AS type,
        coalesce(nullif(title, ''), slug) AS title, coalesce(nullif(updated_at, ''), '1970-01-01T00:00:00Z') AS updated_at, coalesce(type, '') = '' OR coalesce(title, '') = '' OR coalesce(updated_at, '') = '' AS was_missing FROM pages""",
)
def filled_fields(spark, d):
    """Required fields with something in them; the clock is fixed."""
    gone = lambda c: F.coalesce(c, F.lit("")) == ""
    kind = F.when(F.col("folder") == "entities", "entity").when(F.col("folder") == "concepts", "concept").otherwise(F.col("folder"))
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return PW.pages(spark, d).select(
        "page_id", given("type", kind).alias("type"), given("title", F.col("slug")).alias("title"), given("updated_at", F.lit("1970-01-01T00:00:00Z")).alias("updated_at"),
        (gone("type") | gone("title") | gone("updated_at")).alias("was_missing"),
    )


@CORE.query(
    "link_stubs",
    f"WITH {PW.BODIES}, {PW.LINKS}, {PW.KNOWN}, {PW.BROKEN} SELECT replace(target, ' ', '-') AS slug, {PW._case_sql('target')} AS title, count(*) AS n_links FROM broken GROUP BY ALL",
)
def link_stubs(spark, d):
    """A stub for each page that links ask for."""
    t = F.col("target")
    return W.broken_links(PW.bodies(spark, d)).groupBy(
        F.regexp_replace(t, " ", "-").alias("slug"), T.title_case(T.strip(F.regexp_replace(t, "[-_]", " "))).alias("title")
    ).agg(F.count("*").alias("n_links"))


@CORE.query(
    "dedup_events",
    f"""WITH {PM.VARIANTS_SQL}, {PM.ARTIFACTS_SQL}, {PM.VERSIONS_SQL}, removals AS (SELECT keep, remove, 'artifact' AS reason FROM artifacts UNION ALL SELECT keep, remove, 'version' FROM versions)
        SELECT l.path, 'deleted' AS event, l.hash, r.reason, r.keep, l.location FROM removals r JOIN {PM.LATEST} l ON l.path = r.remove""",
)
def dedup_events(spark, d):
    """The removals of a proposal as deletions for the log, with the content they remove."""
    removals = PM._removals(spark, d)
    state = M.alive(M.latest_state(PM.events(spark, d))).select("path", "hash", "location")
    return removals.join(state, F.col("remove") == F.col("path")).select("path", F.lit("deleted").alias("event"), "hash", "reason", "keep", "location")


@CORE.query(
    "exclude_hints",
    f"""WITH {PM.VARIANTS_SQL}, hints AS (SELECT path, CASE WHEN regexp_matches(stem, '(?i)copy') THEN '*copy*' WHEN regexp_matches(stem, '\\(\\d+\\)') THEN '*' || regexp_extract(stem, '\\(\\d+\\)') || '*'
          WHEN regexp_matches(stem, '[_-]1\\s*$') THEN '*_1.*' END AS pattern FROM variants WHERE artifact) SELECT split_part(path, '/', 1) AS root, pattern, count(*) AS n_files FROM hints GROUP BY ALL""",
)
def exclude_hints(spark, d):
    """Patterns that would keep copies out, for each root, with the files that each would drop."""
    s = F.col("stem")
    pattern = F.when(s.rlike("(?i)copy"), "*copy*").when(s.rlike(r"\(\d+\)"), F.concat(F.lit("*"), F.regexp_extract(s, r"\(\d+\)", 0), F.lit("*"))).when(s.rlike(r"[_-]1\s*$"), "*_1.*")
    return PM._variants(spark, d).where("artifact").groupBy(F.substring_index("path", "/", 1).alias("root"), pattern.alias("pattern")).agg(F.count("*").alias("n_files"))


CELLS = "list_filter(list_transform(flatten(list_transform(list_filter(l, lambda x: starts_with(x, '|')), lambda x: string_split(x, '|'))), lambda c: trim(c)), lambda c: c <> '')"


@CORE.query(
    "suppressed_cells",
    f"""WITH t AS (SELECT chunk_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM chunk WHERE text IS NOT NULL),
        s AS (SELECT chunk_id, len(list_filter(l, lambda x: NOT starts_with(x, '|') AND trim(x) <> '')) AS n_lines, list_filter(l, lambda x: NOT starts_with(x, '|') AND trim(x) <> '') AS plain, {CELLS} AS cells FROM t)
        SELECT chunk_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(len(cells) AS INTEGER) AS n_cells, CAST(len(list_filter(plain, lambda x: list_contains(cells, trim(x)))) AS INTEGER) AS n_suppressed FROM s WHERE len(cells) > 0""",
)
def suppressed_cells(spark, d):
    """Lines of a chunk that only repeat a cell of one of its tables."""
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n", -1)
    cells = F.filter(F.transform(F.flatten(F.transform(F.filter("l", lambda x: x.startswith("|")), lambda x: F.split(x, r"\|", -1))), F.trim), lambda c: c != "")
    s = table(spark, d, "chunk").where("text is not null").select("chunk_id", lines.alias("l")).select(
        "chunk_id", F.filter("l", lambda x: ~x.startswith("|") & (F.trim(x) != "")).alias("plain"), cells.alias("cells")
    )
    return s.where("size(cells) > 0").select(
        "chunk_id", F.size("plain").alias("n_lines"), F.size("cells").alias("n_cells"), F.size(F.filter("plain", lambda x: F.array_contains(F.col("cells"), F.trim(x)))).alias("n_suppressed")
    )


@CORE.query(
    "deterministic_pass",
    f"""WITH {PW.PAGES}, {PW.SYN}, {PW.VIOLATIONS}, {PW.LINKS}, {PW.KNOWN}, {PW.BROKEN},
        stubs AS (SELECT page_id FROM pages WHERE tags = ['stub'] OR contains(coalesce(body, ''), 'auto-generated stub')),
        doubles AS (SELECT p.page_id FROM pages p JOIN (SELECT DISTINCT {PW.key_sql('title')} AS t FROM pages WHERE folder = 'sources' AND {PW.key_sql('title')} <> '') s ON s.t = {PW.key_sql('p.title')} WHERE p.folder = 'concepts')
        SELECT 'vocabulary' AS step, count(DISTINCT page_id) AS n_pages FROM violations UNION ALL SELECT 'stub', count(*) FROM stubs UNION ALL SELECT 'double of a source', count(*) FROM doubles
        UNION ALL SELECT 'link', count(DISTINCT page_id) FROM broken""",
)
def deterministic_pass(spark, d):
    """How many pages each step of a clean-up would change, none of them applied."""
    p, v = PW.pages(spark, d), PW.vocab(spark, d)
    stubs = p.where((F.col("tags") == F.array(F.lit("stub"))) | F.coalesce("body", F.lit("")).contains("auto-generated stub"))
    titles = p.where("folder = 'sources'").select(W.page_key(F.col("title")).alias("t")).where("t <> ''").distinct()
    doubles = p.where("folder = 'concepts'").withColumn("t", W.page_key(F.col("title"))).join(titles, "t", "left_semi")
    n = lambda step, df: df.agg(F.countDistinct("page_id").alias("n_pages")).select(F.lit(step).alias("step"), "n_pages")
    return (
        n("vocabulary", W.vocabulary_violations(p, v)).unionByName(n("stub", stubs)).unionByName(n("double of a source", doubles)).unionByName(n("link", W.broken_links(p)))
    )


@CORE.query(
    "hit_lines",
    f"""WITH {PW.PAGES} SELECT page_id, '#' || page_id AS docid, (page_id % 100) / 100.0::DOUBLE AS score, rel_path AS file, {PW.strip_sql('title')} AS title,
        rel_path AS location FROM pages WHERE {PW.strip_sql('title')} <> '' AND NOT contains(rel_path, ' - ') AND NOT regexp_matches(title, '[\\n\\r]')""",
)
def hit_lines(spark, d):
    """Pages as rows of text that a search prints, and what is read from them again."""
    p = PW.pages(spark, d).where((T.strip(F.col("title")) != "") & ~F.col("rel_path").contains(" - ") & ~F.col("title").rlike(r"[\n\r]"))
    i = F.col("page_id").cast("string")
    line = F.concat(F.lit("#"), i, F.lit(" "), (F.col("page_id") % 100).cast("string"), F.lit("% "), "rel_path", F.lit(" - "), T.strip(F.col("title")))
    ref = F.concat(F.lit("kb://wiki/"), "rel_path", F.lit("?index=main"))
    return p.select("page_id", line.alias("line"), S.location(ref, "kb", "wiki").alias("location")).select("page_id", *S.parse_hit(F.col("line")), "location")


@CORE.query("page_texts", f"WITH {PW.PAGES} SELECT page_id, length({PW.strip_sql('body')}) AS n_fenced, length({PW.strip_sql('body')}) AS n_unfenced, length({PW.strip_sql('body')}) AS n_snippet FROM pages WHERE {PW.strip_sql('body')} <> '' AND NOT regexp_matches(body, '(^|\\n)\\s*(@@|---|(type|title|created_at|updated_at|sources|tags|domain|entity_type|display_name|location|relative_path):)')")
def page_texts(spark, d):
    """Bodies freed from frontmatter with both fences, with one, and from the marks of a snippet: as long as they were."""
    own = ~F.col("body").rlike(r"(^|\n)\s*(@@|---|(" + "|".join(S.FIELDS) + "):)")
    p = PW.pages(spark, d).where((T.strip(F.col("body")) != "") & own)
    head = F.concat(F.lit("type: x\ntitle: "), F.coalesce("slug", F.lit("")), F.lit("\n---\n"))
    n = lambda c: F.length(T.strip(c))
    return p.select(
        "page_id",
        n(S.without_frontmatter(F.concat(F.lit("\n---\n"), head, "body"))).alias("n_fenced"),
        n(S.without_frontmatter(F.concat(head, "body"))).alias("n_unfenced"),
        n(S.clean_snippet(F.concat(F.lit("@@ -1,4 +1,4 @@\n"), head, "body"))).alias("n_snippet"),
    )


# --- writes --------------------------------------------------------------------------------------------

#: Each document is written to the place of the one before it in its folder, as a new version of it.
WRITES = """order_of AS (SELECT doc_id, text, lag(doc_id) OVER w AS before, 'wiki/' || coalesce(relative_path, '') AS path FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
      WINDOW w AS (PARTITION BY source, regexp_replace(relative_path, '[^/]*$', '') ORDER BY ingested_at, doc_id)),
    writes AS (SELECT o.doc_id, o.path, o.text AS content, b.text AS existing FROM order_of o LEFT JOIN documents b ON b.doc_id = o.before)"""
NOTES = "(?i)supersed|contradict|revis|no longer|replaced by"
LINES = "(length({0}) - length(replace({0}, chr(10), '')) + 1)"
REASON = f"""CASE WHEN regexp_matches(path, '(^|/)\\.\\.(/|$)') OR NOT starts_with(path, 'wiki/') THEN 'outside' WHEN regexp_matches(content, '(/Users/|/home/|[A-Za-z]:\\\\|OneDrive/\\S)') THEN 'raw path'
    WHEN existing IS NOT NULL AND {LINES.format('existing')} >= 4 AND {LINES.format('content')} * 2 < {LINES.format('existing')} AND NOT regexp_matches(content, '{NOTES}') THEN 'truncated' END"""


def _writes(spark, d):
    docs = table(spark, d, "documents").where("text is not null and doc_id is not null")
    before = Window.partitionBy("source", F.regexp_replace("relative_path", "[^/]*$", "")).orderBy("ingested_at", "doc_id")
    order = docs.select("doc_id", "source", "relative_path", "ingested_at").select("doc_id", F.lag("doc_id").over(before).alias("before"))
    old = docs.select(F.col("doc_id").alias("before"), F.col("text").alias("existing"))
    new = docs.select("doc_id", F.concat(F.lit("wiki/"), F.coalesce("relative_path", F.lit(""))).alias("path"), F.col("text").alias("content"))
    return new.join(order, "doc_id").join(old, "before", "left").drop("before")


@CORE.query("validate_writes", f"WITH {WRITES} SELECT doc_id, coalesce({REASON}, 'ok') AS verdict FROM writes")
def validate_writes(spark, d):
    """Whether each text may be written over the one before it in its folder."""
    return _writes(spark, d).select("doc_id", F.coalesce(W.rejection(F.col("path"), F.col("content"), F.col("existing")), F.lit("ok")).alias("verdict"))


ACTIONS = f"""{WRITES}, slugs AS (SELECT DISTINCT {PW.key_sql("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')")} AS target FROM writes UNION SELECT DISTINCT {PW.key_sql('slug')} FROM wiki_page WHERE slug IS NOT NULL),
    asked AS (SELECT doc_id, path, content, existing, {REASON} AS reason, regexp_extract(path, '[^/]*$') AS name FROM writes),
    linked AS (SELECT doc_id, count(*) FILTER (WHERE t NOT IN (SELECT target FROM slugs)) AS n_unlinked FROM (SELECT doc_id, {PW.key_sql('raw')} AS t FROM (SELECT doc_id, unnest(regexp_extract_all(content, {PW.LINK}, 1)) AS raw FROM writes)) GROUP BY doc_id),
    actions AS (SELECT a.doc_id, CASE WHEN name = 'index.md' THEN 'dropped' WHEN name = 'log.md' THEN 'appended' WHEN reason IS NOT NULL THEN 'rejected' WHEN existing IS NULL THEN 'written' ELSE 'updated' END AS action,
                  CASE WHEN name IN ('index.md', 'log.md') THEN NULL ELSE reason END AS reason, coalesce(l.n_unlinked, 0) AS n_unlinked FROM asked a LEFT JOIN linked l ON l.doc_id = a.doc_id)"""


def _actions(spark, d):
    return W.write_actions(_writes(spark, d), PW.pages(spark, d).select("slug"), "doc_id")


@CORE.query("write_actions", f"WITH {ACTIONS} SELECT * FROM actions")
def write_actions(spark, d):
    """What becomes of each write, and how many links in it lead neither to a page nor to one of the batch."""
    return _actions(spark, d).select("doc_id", "action", "reason", "n_unlinked")


@CORE.query("write_summary", f"WITH {ACTIONS} SELECT action, coalesce(reason, '') AS reason, count(*) AS n_writes FROM actions GROUP BY ALL")
def write_summary(spark, d):
    return _actions(spark, d).groupBy("action", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n_writes"))


@CORE.query(
    "merged_aliases",
    f"""WITH {PW.PAGES}, grouped AS (SELECT {PW.key_sql('title')} AS t, min(slug) AS canonical FROM pages WHERE {PW.key_sql('title')} <> '' GROUP BY 1 HAVING count(*) > 1)
        SELECT DISTINCT canonical, alias FROM (SELECT g.canonical, {PW.strip_sql('a')} AS alias FROM grouped g JOIN (SELECT title, unnest(aliases) AS a FROM pages) p ON {PW.key_sql('p.title')} = g.t WHERE {PW.key_sql('a')} <> g.t
          UNION ALL SELECT g.canonical, {PW.strip_sql('p.title')} FROM grouped g JOIN pages p ON {PW.key_sql('p.title')} = g.t) WHERE alias <> ''""",
)
def merged_aliases(spark, d):
    """The names that the first of several pages of one title has after they are merged: the aliases of all, and their titles."""
    p = PW.pages(spark, d).withColumn("t", W.page_key(F.col("title"))).where("t <> ''")
    grouped = p.groupBy("t").agg(F.min("slug").alias("canonical"), F.count("*").alias("n")).where("n > 1").select("t", "canonical")
    aliases = p.select("t", F.explode("aliases").alias("a")).where(W.page_key(F.col("a")) != F.col("t")).select("t", T.strip(F.col("a")).alias("alias"))
    return grouped.join(aliases.unionByName(p.select("t", T.strip(F.col("title")).alias("alias"))), "t").where("alias <> ''").select("canonical", "alias").distinct()


CLEANED = f"""every AS (SELECT * FROM wiki_page QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rel_path) = 1),
    doubles AS (SELECT p.page_id, {PW.key_sql('p.slug')} AS target, '[[' || s.slug || ']]' AS text FROM every p JOIN (SELECT {PW.key_sql('title')} AS t, max(slug) AS slug FROM every WHERE folder = 'sources' AND {PW.key_sql('title')} <> '' GROUP BY 1) s
                ON s.t = {PW.key_sql('p.title')} WHERE p.folder = 'concepts'),
    pages AS (SELECT * FROM every WHERE NOT (coalesce(tags = ['stub'], false) OR contains(coalesce(body, ''), 'auto-generated stub')) AND page_id NOT IN (SELECT page_id FROM doubles))"""


@CORE.query(
    "cleaned_pages",
    PW._rewritten("SELECT target, min(text) AS text FROM doubles GROUP BY target UNION ALL SELECT DISTINCT target, NULL FROM links WHERE target NOT IN (SELECT target FROM known) AND target NOT IN (SELECT target FROM doubles)", CLEANED),
)
def cleaned_pages(spark, d):
    """The pages that are left when the clean-up is applied: without stubs and doubles of sources, links led to the source or made plain text."""
    return PW._hashed(W.cleaned(PW.pages(spark, d)))


@CORE.query(
    "chunk_contexts",
    """SELECT chunk_id, CASE WHEN len(meta.slides) > 0 THEN 'slides ' || array_to_string(meta.slides, ',') WHEN meta.slide IS NOT NULL THEN 'slide ' || meta.slide
              WHEN coalesce(meta.heading_path, '') = '' AND meta.page IS NULL THEN 'document'
              ELSE concat_ws(' · ', nullif(meta.heading_path, ''), 'page ' || meta.page) END AS context FROM chunk""",
)
def chunk_contexts(spark, d):
    """Where in its document a chunk stands, in words."""
    m = F.col("meta")
    place = F.concat_ws(" · ", F.nullif(m["heading_path"], F.lit("")), F.concat(F.lit("page "), m["page"].cast("string")))
    context = F.when(F.size(m["slides"]) > 0, F.concat(F.lit("slides "), F.array_join(m["slides"], ","))).when(m["slide"].isNotNull(), F.concat(F.lit("slide "), m["slide"].cast("string"))).otherwise(
        F.when(place == "", "document").otherwise(place)
    )
    return table(spark, d, "chunk").select("chunk_id", context.alias("context"))


DIGEST_CHARS = 20_000


@CORE.query(
    "pages_digest",
    f"""WITH {PW.PAGES}, lines AS (SELECT folder, slug, page_id, '  [[' || slug || ']] ' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE slug END
          || CASE WHEN folder = 'entities' AND coalesce(entity_type, '') <> '' THEN ' (' || entity_type || ')' WHEN folder = 'concepts' AND coalesce(domain, '') <> '' THEN ' (' || domain || ')' ELSE '' END AS line FROM pages WHERE slug IS NOT NULL)
        SELECT slug, line FROM (SELECT *, sum(length(line) + 1) OVER (ORDER BY folder, slug, page_id ROWS UNBOUNDED PRECEDING) AS upto FROM lines) WHERE upto <= {DIGEST_CHARS}""",
)
def pages_digest(spark, d):
    """The list of pages that a prompt has room for (its length is the feature): what fits of the first lines, by folder and slug."""
    return W.digest(PW.pages(spark, d), DIGEST_CHARS)
