"""Queries over the pages of a wiki."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import wiki as W
from corpusmill.plans.registry import CORE
from corpusmill.session import keep, table
from corpusmill.sources import markdown as MD

#: Pages once, and strip() and the key of a name as macros in text.
PAGES = "pages AS (SELECT * FROM wiki_page QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rel_path) = 1)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x0B\\p{{Z}}\\x{{85}}]+|[\\s\\x0B\\p{{Z}}\\x{{85}}]+$', '', 'g')"


def key_sql(c: str) -> str:
    return f"lower({strip_sql(c)})"


LINK = "'\\[\\[([^\\]\\|#]+)(?:[\\|#][^\\]]*)?\\]\\]'"
LINKS = f"""links AS (SELECT page_id, slug, i - 1 AS ord, {key_sql('raw[i]')} AS target, {strip_sql('raw[i]')} AS shown FROM
    (SELECT page_id, slug, raw, unnest(range(1, len(raw) + 1)) AS i FROM (SELECT page_id, slug, regexp_extract_all(body, {LINK}, 1) AS raw FROM pages)))"""
KNOWN = f"known AS (SELECT DISTINCT {key_sql('slug')} AS target FROM pages WHERE {key_sql('slug')} <> '')"


def pages(spark, d):
    return W.unique_pages(table(spark, d, "wiki_page"))


#: Bodies that may hold links: those of pages, and the texts of documents under negative ids.
BODIES = """pages AS (SELECT page_id, slug, body, title FROM wiki_page QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rel_path) = 1
    UNION ALL SELECT -doc_id - 1, NULL, text, NULL FROM documents)"""


def bodies(spark, d):
    texts = table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("page_id"), F.lit(None).cast("string").alias("slug"), F.col("text").alias("body"))
    return pages(spark, d).select("page_id", "slug", "body").unionByName(texts)


def vocab(spark, d):
    return table(spark, d, "vocab")


@CORE.query("wikilinks", f"WITH {PAGES}, {LINKS} SELECT page_id, ord, target FROM links")
def wikilinks(spark, d):
    return W.links(pages(spark, d)).select("page_id", "ord", "target")


INBOUND = f"""inbound AS (SELECT p.page_id, coalesce(n, 0) AS n_inbound FROM pages p LEFT JOIN
    (SELECT target, count(*) AS n FROM links WHERE target <> {key_sql('slug')} GROUP BY target) l ON l.target = {key_sql('p.slug')})"""


@CORE.query("inbound_links", f"WITH {PAGES}, {LINKS}, {INBOUND} SELECT * FROM inbound")
def inbound_links(spark, d):
    return W.inbound(pages(spark, d))


@CORE.query("orphan_pages", f"WITH {PAGES}, {LINKS}, {INBOUND} SELECT page_id FROM inbound WHERE n_inbound = 0")
def orphan_pages(spark, d):
    return W.inbound(pages(spark, d)).where("n_inbound = 0").select("page_id")


BROKEN = "broken AS (SELECT page_id, ord, target FROM links WHERE target NOT IN (SELECT target FROM known))"


@CORE.query("broken_links", f"WITH {BODIES}, {LINKS}, {KNOWN}, {BROKEN} SELECT * FROM broken")
def broken_links(spark, d):
    return W.broken_links(bodies(spark, d))


@CORE.query("broken_targets", f"WITH {BODIES}, {LINKS}, {KNOWN}, {BROKEN} SELECT target, count(*) AS n_links FROM broken GROUP BY target")
def broken_targets(spark, d):
    return W.broken_links(bodies(spark, d)).groupBy("target").agg(F.count("*").alias("n_links"))


def _rewritten(lookup: str, pages: str = PAGES) -> str:
    """A body put together again from what stands between links and what the links become."""
    return f"""WITH {pages}, {LINKS}, {KNOWN}, lookup AS ({lookup}),
      parts AS (SELECT page_id, body, regexp_split_to_array(body, {LINK}) AS between, regexp_extract_all(body, {LINK}, 0) AS whole FROM pages),
      spread AS (SELECT page_id, between, whole, unnest(range(1, len(between) + 1)) AS i FROM parts WHERE body IS NOT NULL),
      changed AS (SELECT s.page_id, s.i, s.between[s.i] || coalesce(CASE WHEN k.target IS NOT NULL THEN coalesce(k.text, l.shown) END, s.whole[s.i], '') AS piece, k.target IS NOT NULL AS hit
                  FROM spread s LEFT JOIN links l ON l.page_id = s.page_id AND l.ord = s.i - 1 LEFT JOIN lookup k ON k.target = l.target)
      SELECT page_id, md5(string_agg(piece, '' ORDER BY i)) AS body_hash, CAST(count(*) FILTER (WHERE hit) AS INTEGER) AS n_changed FROM changed GROUP BY page_id
      UNION ALL SELECT page_id, NULL, 0 FROM pages WHERE body IS NULL"""


def _hashed(df):
    return df.select("page_id", F.md5(F.col("body").cast("binary")).alias("body_hash"), "n_changed")


@CORE.query("unlink_unresolved", _rewritten("SELECT DISTINCT target, NULL::VARCHAR AS text FROM links WHERE target NOT IN (SELECT target FROM known)", BODIES))
def unlink_unresolved(spark, d):
    return _hashed(W.unlink_unresolved(bodies(spark, d)))


RENAMES = f"SELECT {key_sql('slug')} AS target, '[[' || first || ']]' AS text FROM (SELECT slug, min(slug) OVER (PARTITION BY {key_sql('title')}) AS first FROM pages WHERE {key_sql('title')} <> '') WHERE slug <> first"


def _renames(p):
    """Pages of one title become the first of them."""
    first = p.where(W.page_key(F.col("title")) != "").groupBy(W.page_key(F.col("title")).alias("t")).agg(F.min("slug").alias("new"))
    return p.join(first, W.page_key(F.col("title")) == F.col("t")).where("slug <> new").select(F.col("slug").alias("old"), "new")


@CORE.query("repoint_links", _rewritten(RENAMES))
def repoint_links(spark, d):
    p = pages(spark, d)
    return _hashed(W.repoint(p, _renames(p)))


@CORE.query(
    "merge_aliases",
    f"""WITH {PAGES}, grouped AS (SELECT {key_sql('title')} AS t, min(slug) AS canonical, count(*) AS n_merged FROM pages WHERE {key_sql('title')} <> '' GROUP BY 1 HAVING count(*) > 1),
        named AS (SELECT {key_sql('title')} AS t, {key_sql('a')} AS alias FROM (SELECT title, unnest(aliases) AS a FROM pages) WHERE {key_sql('a')} <> '')
        SELECT g.canonical, g.n_merged, count(DISTINCT n.alias) AS n_aliases FROM grouped g LEFT JOIN named n ON n.t = g.t AND n.alias <> g.t GROUP BY ALL""",
)
def merge_aliases(spark, d):
    """Pages of one title merged: how many, and the aliases that the first one takes over."""
    p = pages(spark, d).withColumn("t", W.page_key(F.col("title"))).where("t <> ''")
    grouped = p.groupBy("t").agg(F.min("slug").alias("canonical"), F.count("*").alias("n_merged")).where("n_merged > 1")
    named = p.select("t", F.explode("aliases").alias("a")).select("t", W.page_key(F.col("a")).alias("alias")).where("alias <> '' and alias <> t").groupBy("t").agg(
        F.countDistinct("alias").alias("n_aliases")
    )
    return grouped.join(named, "t", "left").select("canonical", "n_merged", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


SYN = """syn AS (SELECT field, lower(value) AS word, value, true AS own FROM vocab UNION ALL
    SELECT n.field, n.word, n.value, false FROM (SELECT field, unnest(string_split(regexp_replace(lower(description), '^covers ', ''), ' and ')) AS word, value FROM vocab WHERE description IS NOT NULL) n
    WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.field = n.field AND lower(v.value) = n.word))"""


def _coerce_sql(column: str, field: str) -> str:
    return f"""WITH {PAGES}, {SYN} SELECT p.page_id, p.{column} AS value, s.value AS canonical FROM pages p
        LEFT JOIN (SELECT word, min(value) AS value FROM syn WHERE field = '{field}' GROUP BY word) s ON s.word = {key_sql('p.' + column)}"""


for _column, _field in (("entity_type", "entity_type"), ("domain", "domain"), ("category", "category")):

    @CORE.query(f"coerce_{_column}", _coerce_sql(_column, _field))
    def _coerce(spark, d, column=_column, field=_field):
        return W.coerced(pages(spark, d), vocab(spark, d), column, field)


@CORE.query(
    "normalize_tags",
    f"""WITH {PAGES}, {SYN}, words AS (SELECT replace(word, ' ', '-') AS word, min(value) AS value FROM syn WHERE field = 'tag' GROUP BY 1),
        spread AS (SELECT page_id, i, replace({key_sql('tags[i]')}, ' ', '-') AS word FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM pages)),
        firsts AS (SELECT page_id, value, min(i) AS i FROM spread JOIN words USING (word) GROUP BY ALL),
        cut AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM firsts)
        SELECT p.page_id, coalesce(string_agg(value, ',' ORDER BY i), '') AS tags FROM pages p LEFT JOIN (SELECT * FROM cut WHERE k <= 8) c ON c.page_id = p.page_id GROUP BY p.page_id""",
)
def normalize_tags(spark, d):
    return W.normal_tags(pages(spark, d), vocab(spark, d)).select("page_id", F.array_join("tags", ",").alias("tags"))


QUALIFIER = "'\\s*\\(([^()]*)\\)\\s*$'"


def _title_sql() -> str:
    bare = strip_sql("coalesce(title, '')")
    for _ in range(3):
        bare = f"CASE WHEN regexp_matches({{0}}, {QUALIFIER}) AND list_contains(q, {key_sql('regexp_extract({0}, ' + QUALIFIER + ', 1)')}) THEN {strip_sql('regexp_replace({0}, ' + QUALIFIER + ', chr(0))')} ELSE {{0}} END".replace(", chr(0))", ", '')").replace("{0}", f"b{_}")
        yield bare


def _case_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({strip_sql('regexp_replace(' + c + ', ' + chr(39) + '[-_]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[^\\p{{L}}]+|[\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')".replace("{{", "{").replace("}}", "}")


_B1, _B2, _B3 = _title_sql()
TITLES = f"""words AS (SELECT list(word) AS q FROM (SELECT lower(value) AS word FROM vocab WHERE field IN ('entity_type', 'domain') UNION SELECT 'person' UNION SELECT 'company' UNION SELECT 'client' UNION SELECT 'tool')),
    t0 AS (SELECT page_id, title, slug, q, {strip_sql("coalesce(title, '')")} AS b0 FROM pages, words),
    t1 AS (SELECT *, {_B1} AS b1 FROM t0), t2 AS (SELECT *, {_B2} AS b2 FROM t1), t3 AS (SELECT *, {_B3} AS b FROM t2),
    titles AS (SELECT page_id, title, CASE WHEN b = '' THEN {_case_sql('slug')}
      WHEN b = lower(b) AND regexp_matches(b, '[-_]') AND NOT contains(b, ' ') THEN {_case_sql('b')} ELSE b END AS normalized FROM t3)"""


def _titles(spark, d):
    """Words that qualify a title are entity types and domains, and what people call these."""
    rows = vocab(spark, d).where("field in ('entity_type', 'domain')").select(F.lower("value").alias("v")).distinct().orderBy("v").collect()
    words = F.array(*[F.lit(r["v"]) for r in rows], F.lit("person"), F.lit("company"), F.lit("client"), F.lit("tool"))
    return pages(spark, d).select("page_id", "title", W.normal_title(F.col("title"), F.col("slug"), words).alias("normalized"))


@CORE.query("normalize_title", f"WITH {PAGES}, {TITLES} SELECT page_id, normalized FROM titles")
def normalize_title(spark, d):
    return _titles(spark, d).select("page_id", "normalized")


@CORE.query("baked_qualifiers", f"WITH {PAGES}, {TITLES} SELECT page_id, title, normalized FROM titles WHERE coalesce(title, '') <> '' AND normalized <> {strip_sql('title')}")
def baked_qualifiers(spark, d):
    return _titles(spark, d).where("title <> ''").where(F.col("normalized") != T.strip(F.col("title")))


MISSING = """missing AS (SELECT page_id, array_to_string(list_filter([CASE WHEN coalesce(type, '') = '' THEN 'type' END, CASE WHEN coalesce(title, '') = '' THEN 'title' END,
    CASE WHEN coalesce(updated_at, '') = '' THEN 'updated_at' END, CASE WHEN sources IS NULL THEN 'sources' END], lambda x: x IS NOT NULL), ',') AS missing FROM pages)"""


@CORE.query("missing_fields", f"WITH {PAGES}, {MISSING} SELECT * FROM missing WHERE missing <> ''")
def missing_fields(spark, d):
    return W.missing_fields(pages(spark, d))


@CORE.query(
    "path_leaks",
    """SELECT doc_id, regexp_matches(text, '(/Users/|/home/|[A-Za-z]:\\\\|OneDrive/\\S)') AS leaks FROM documents WHERE text IS NOT NULL""",
)
def path_leaks(spark, d):
    """Whether a text gives away where on a disk something lies."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").rlike(W.RAW_PATH).alias("leaks"))


VIOLATIONS = f"""allowed AS (SELECT DISTINCT field, CASE WHEN field = 'tag' THEN replace(word, ' ', '-') ELSE word END AS word FROM syn WHERE own OR field = 'tag'),
    given AS (SELECT page_id, 'entity_type' AS field, entity_type AS value FROM pages WHERE folder = 'entities' UNION ALL
              SELECT page_id, 'domain', domain FROM pages WHERE folder = 'concepts' UNION ALL SELECT page_id, 'category', category FROM pages UNION ALL
              SELECT page_id, 'tag', unnest(tags) FROM pages),
    violations AS (SELECT page_id, field, value FROM given g WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.field = g.field
              AND a.word = CASE WHEN g.field = 'tag' THEN replace({key_sql('g.value')}, ' ', '-') ELSE {key_sql('g.value')} END))"""


@CORE.query("vocabulary_violations", f"WITH {PAGES}, {SYN}, {VIOLATIONS} SELECT * FROM violations")
def vocabulary_violations(spark, d):
    return W.vocabulary_violations(pages(spark, d), vocab(spark, d))


def slug_sql(c: str) -> str:
    bare = f"regexp_replace({strip_sql(c)}, '^\\[\\[|\\]\\]$', '', 'g')"
    head = f"regexp_extract({bare}, '^([^|#]*)', 1)"
    return key_sql(f"regexp_replace({strip_sql(head)}, '(?i)\\.md$', '')")


RELATIONS = f"""spread AS (SELECT page_id, i - 1 AS ord, map_keys(relations[i])[1] AS relation, map_values(relations[i])[1] AS t
      FROM (SELECT page_id, relations, unnest(range(1, len(relations) + 1)) AS i FROM pages) WHERE cardinality(relations[i]) = 1),
    relations AS (SELECT page_id, ord, relation, {slug_sql('t')} AS target FROM spread)"""


@CORE.query("page_relations", f"WITH {PAGES}, {RELATIONS} SELECT page_id, ord, relation, target FROM relations")
def page_relations(spark, d):
    return W.relations(pages(spark, d))


UNRESOLVED = f"""unresolved AS (SELECT page_id, ord, relation, target, CASE WHEN relation NOT IN (SELECT value FROM vocab WHERE field = 'relation') THEN 'unknown relation'
    WHEN target NOT IN (SELECT target FROM known) THEN 'unresolved' END AS problem FROM relations)"""


@CORE.query("unresolved_relations", f"WITH {PAGES}, {RELATIONS}, {KNOWN}, {UNRESOLVED} SELECT * FROM unresolved WHERE problem IS NOT NULL")
def unresolved_relations(spark, d):
    return W.unresolved_relations(pages(spark, d), vocab(spark, d))


@CORE.query(
    "resolved_relations",
    f"""WITH {PAGES}, {RELATIONS}, {KNOWN} SELECT page_id, ord, relation, target FROM relations
        WHERE relation IN (SELECT value FROM vocab WHERE field = 'relation') AND target IN (SELECT target FROM known)""",
)
def resolved_relations(spark, d):
    """The relations that stay when those to nothing are filtered out."""
    p = pages(spark, d)
    kinds = (vocab(spark, d).where("field = 'relation'").select(F.col("value").alias("relation")))
    return W.relations(p).join(kinds, "relation", "left_semi").join(W.known_slugs(p), "target", "left_semi").select("page_id", "ord", "relation", "target")


DUPLICATES = f"duplicates AS (SELECT {key_sql('title')} AS title, count(*) AS n_pages FROM pages WHERE {key_sql('title')} <> '' GROUP BY 1 HAVING count(*) > 1)"


@CORE.query("duplicate_titles", f"WITH {PAGES}, {DUPLICATES} SELECT * FROM duplicates")
def duplicate_titles(spark, d):
    return W.duplicate_titles(pages(spark, d))


COLLISIONS = f"""collisions AS (SELECT a.name, a.n_alias_pages, t.n_title_pages FROM
      (SELECT {key_sql('a')} AS name, count(DISTINCT page_id) AS n_alias_pages FROM (SELECT page_id, unnest(aliases) AS a FROM pages) WHERE {key_sql('a')} <> '' GROUP BY 1) a JOIN
      (SELECT {key_sql('title')} AS name, count(DISTINCT page_id) AS n_title_pages FROM pages WHERE {key_sql('title')} <> '' GROUP BY 1) t ON a.name = t.name)"""


@CORE.query("alias_collisions", f"WITH {PAGES}, {COLLISIONS} SELECT * FROM collisions")
def alias_collisions(spark, d):
    return W.alias_collisions(pages(spark, d))


LOG = "log AS (SELECT page_id AS line_no, updated_at || ' wrote ' || rel_path || ' - ' || title AS line FROM pages WHERE updated_at IS NOT NULL AND title IS NOT NULL)"
STALE = f"""dated AS (SELECT line_no, lower(line) AS line, regexp_extract(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS log_date FROM log WHERE regexp_matches(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}')),
    lines AS (SELECT line_no, line, log_date FROM dated),
    named AS (SELECT page_id, lower(title) AS title, updated_at[1:10] AS updated FROM pages WHERE title <> '' AND updated_at <> ''),
    stale AS (SELECT page_id, arg_min(log_date, line_no) AS log_date FROM named JOIN lines ON contains(line, title) AND log_date > updated GROUP BY page_id)"""


def _log(spark, d):
    """The log of operations: a line for each page as it was written."""
    p = pages(spark, d).where("updated_at is not null and title is not null")
    return p.select(F.col("page_id").alias("line_no"), F.concat("updated_at", F.lit(" wrote "), "rel_path", F.lit(" - "), "title").alias("line"))


@CORE.query("stale_pages", f"WITH {PAGES}, {LOG}, {STALE} SELECT * FROM stale")
def stale_pages(spark, d):
    """Pages that the log mentions after their last update."""
    return W.stale(pages(spark, d), _log(spark, d))


@CORE.query(
    "log_dates",
    "WITH " + PAGES + ", " + LOG + " SELECT regexp_extract(line, '\\d{4}-\\d{2}-\\d{2}') AS log_date, count(*) AS n_lines FROM log GROUP BY 1",
)
def log_dates(spark, d):
    return _log(spark, d).groupBy(F.regexp_extract("line", r"\d{4}-\d{2}-\d{2}", 0).alias("log_date")).agg(F.count("*").alias("n_lines"))


@CORE.query(
    "source_dupe_concepts",
    f"""WITH {PAGES}, s AS (SELECT {key_sql('title')} AS t, max(slug) AS source_slug FROM pages WHERE folder = 'sources' AND {key_sql('title')} <> '' GROUP BY 1)
        SELECT p.page_id, p.slug, s.source_slug FROM pages p JOIN s ON s.t = {key_sql('p.title')} WHERE p.folder IN ('concepts', 'synthesis', 'engagements')""",
)
def source_dupe_concepts(spark, d):
    """Pages that only repeat the title of a source page; of sources with one title the last counts."""
    p = pages(spark, d).withColumn("t", W.page_key(F.col("title")))
    s = p.where("folder = 'sources' and t <> ''").groupBy("t").agg(F.max("slug").alias("source_slug"))
    return p.where("folder in ('concepts', 'synthesis', 'engagements')").join(s, "t").select("page_id", "slug", "source_slug")


@CORE.query(
    "lint_summary",
    f"""WITH {PAGES}, {LINKS}, {KNOWN}, {INBOUND}, {BROKEN}, {MISSING}, {SYN}, {VIOLATIONS}, {RELATIONS}, {UNRESOLVED}, {DUPLICATES}, {COLLISIONS}, {TITLES}
        SELECT 'orphan' AS finding, count(*) AS n FROM inbound WHERE n_inbound = 0 UNION ALL SELECT 'broken link', count(*) FROM broken
        UNION ALL SELECT 'missing field', count(*) FROM missing WHERE missing <> '' UNION ALL SELECT 'vocabulary', count(*) FROM violations
        UNION ALL SELECT 'relation', count(*) FROM unresolved WHERE problem IS NOT NULL UNION ALL SELECT 'duplicate title', count(*) FROM duplicates
        UNION ALL SELECT 'alias collision', count(*) FROM collisions
        UNION ALL SELECT 'baked qualifier', count(*) FROM titles WHERE coalesce(title, '') <> '' AND normalized <> {strip_sql('title')}""",
)
def lint_summary(spark, d):
    """How many findings each check has."""
    p, v = keep(pages(spark, d), "pages"), vocab(spark, d)
    found = {
        "orphan": W.inbound(p).where("n_inbound = 0"), "broken link": W.broken_links(p), "missing field": W.missing_fields(p), "vocabulary": W.vocabulary_violations(p, v),
        "relation": W.unresolved_relations(p, v), "duplicate title": W.duplicate_titles(p), "alias collision": W.alias_collisions(p), "baked qualifier": baked_qualifiers(spark, d),
    }
    out = None
    for name, df in found.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@CORE.query(
    "index_catalogue",
    """WITH """ + PAGES + """ SELECT folder, slug, '- [[' || slug || ']] — ' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE slug END
        || CASE WHEN folder = 'entities' AND coalesce(entity_type, '') <> '' THEN ' (' || entity_type || ')' WHEN folder = 'concepts' AND coalesce(domain, '') <> '' THEN ' (' || domain || ')' ELSE '' END
        || CASE WHEN coalesce(category, '') <> '' THEN ' (' || category || ')' ELSE '' END AS line FROM pages""",
)
def index_catalogue(spark, d):
    return W.catalogue(pages(spark, d))


@CORE.query(
    "page_excerpts",
    f"""WITH {PAGES}, s AS (SELECT page_id, {strip_sql('body')} AS b FROM pages WHERE body IS NOT NULL)
        SELECT page_id, CASE WHEN length(b) > 300 THEN regexp_replace(regexp_replace(b[1:300], ' [^ ]*$', ''), '[\\s\\x0B\\p{{Z}}\\x{{85}}]+$', '') || ' …' ELSE b END AS excerpt FROM s""",
)
def page_excerpts(spark, d):
    return pages(spark, d).where("body is not null").select("page_id", W.excerpt(F.col("body"), 300).alias("excerpt"))


# --- the dashboard ------------------------------------------------------------------------------------


@CORE.query("dash_by_type", f"WITH {PAGES} SELECT type, count(*) AS n_pages FROM pages GROUP BY type")
def dash_by_type(spark, d):
    return pages(spark, d).groupBy("type").agg(F.count("*").alias("n_pages")).orderBy(F.desc("n_pages"), "type")


@CORE.query(
    "dash_recent",
    f"WITH {PAGES} SELECT page_id, type, updated_at FROM pages WHERE folder IN ('entities','concepts','engagements','synthesis') AND updated_at IS NOT NULL ORDER BY updated_at DESC, page_id LIMIT 15",
)
def dash_recent(spark, d):
    """The 15 pages updated last (a top-k report)."""
    return pages(spark, d).where("folder in ('entities','concepts','engagements','synthesis') and updated_at is not null").orderBy(F.desc("updated_at"), "page_id").limit(15).select("page_id", "type", "updated_at")


DASH = {
    "dash_customers": ("folder = 'entities' AND (entity_type = 'customer-account' OR entity_type = 'supplier')", ["page_id", "slug", "entity_type"], ["slug"]),
    "dash_engagements": ("folder = 'engagements'", ["page_id", "slug", "updated_at"], ["updated_at"]),
    "dash_tools": ("folder = 'entities' AND entity_type IN ('software-product', 'hosting-service', 'reference-model')", ["page_id", "slug", "entity_type"], ["entity_type", "slug"]),
    "dash_concepts": ("folder = 'concepts'", ["page_id", "slug", "domain"], ["domain", "slug"]),
    "dash_sources": ("folder = 'sources'", ["page_id", "slug", "updated_at"], ["updated_at"]),
    "dash_untended": ("coalesce(type, '') = '' OR coalesce(updated_at, '') = ''", ["page_id", "slug"], ["slug"]),
}
for _name, (_where, _columns, _order) in DASH.items():

    @CORE.query(_name, f"WITH {PAGES} SELECT {', '.join(_columns)} FROM pages WHERE {_where}")
    def _dash(spark, d, where=_where, columns=_columns, order=_order):
        return pages(spark, d).where(where).select(*columns).orderBy(*order)


@CORE.query("dash_by_tag", f"WITH {PAGES} SELECT page_id, slug FROM pages WHERE folder IN ('entities','concepts','engagements') AND list_contains(tags, 'price-elasticity')")
def dash_by_tag(spark, d):
    return pages(spark, d).where("folder in ('entities','concepts','engagements')").where(F.array_contains("tags", "price-elasticity")).select("page_id", "slug").orderBy("slug")


@CORE.query(
    "frontmatter_roundtrip",
    f"""WITH {PAGES} SELECT page_id, title, entity_type, updated_at, coalesce(len(tags), 0) AS n_tags, coalesce(len(sources), 0) AS n_sources, length({strip_sql("coalesce(body, '')")}) AS n_body FROM pages""",
)
def frontmatter_roundtrip(spark, d):
    """Pages written as markdown files with frontmatter, and read back."""
    p = pages(spark, d)
    back = MD.parsed(MD.rendered(p, ("title", "entity_type", "updated_at", "tags", "sources")))
    f = F.from_json("fields", "title string, entity_type string, updated_at string, tags array<string>, sources array<string>")
    size = lambda c: F.coalesce(F.size(f[c]), F.lit(0))
    return back.select(
        "page_id", f["title"].alias("title"), f["entity_type"].alias("entity_type"), f["updated_at"].alias("updated_at"),
        F.when(f["tags"].isNull(), 0).otherwise(size("tags")).alias("n_tags"), F.when(f["sources"].isNull(), 0).otherwise(size("sources")).alias("n_sources"),
        F.length(T.strip(F.col("body"))).alias("n_body"),
    )
