"""Pages of a wiki: vocabulary, titles, the graph of links, and the checks that run over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import strip, title_case
from corpusmill.operators.orphans import slug_of

#: Links ([[slug]], [[slug|alias]], [[slug#anchor]]), paths that give a disk away, required fields, most tags.
LINK = r"\[\[([^\]\|#]+)(?:[\|#][^\]]*)?\]\]"
RAW_PATH = r"(/Users/|/home/|[A-Za-z]:\\|OneDrive/\S)"
REQUIRED = ("type", "title", "updated_at", "sources")
MAX_TAGS = 8


def unique_pages(pages: DataFrame) -> DataFrame:
    """Each page once; repeated rows are whole repeats."""
    return pages.dropDuplicates(["page_id"])


def page_key(c: Column) -> Column:
    return F.lower(strip(c))


def links(pages: DataFrame) -> DataFrame:
    """page_id, slug (of the page), ord, target of every link in a body."""
    return pages.select("page_id", "slug", F.posexplode(F.regexp_extract_all("body", F.lit(LINK), 1)).alias("ord", "raw")).select(
        "page_id", "slug", "ord", page_key(F.col("raw")).alias("target")
    )


def known_slugs(pages: DataFrame) -> DataFrame:
    return pages.select(page_key(F.col("slug")).alias("target")).where("target <> ''").distinct()


def inbound(pages: DataFrame) -> DataFrame:
    """page_id, n_inbound: links from other pages, each occurrence counted."""
    hits = links(pages).where(F.col("target") != page_key(F.col("slug"))).groupBy("target").agg(F.count("*").alias("n"))
    return pages.select("page_id", page_key(F.col("slug")).alias("target")).join(hits, "target", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("n_inbound")
    )


def broken_links(pages: DataFrame) -> DataFrame:
    return links(pages).join(known_slugs(pages), "target", "left_anti").select("page_id", "ord", "target")


def replace_links(pages: DataFrame, lookup: DataFrame) -> DataFrame:
    """page_id, body, n_changed, with links set by ``lookup`` (target, text): the whole link becomes text.

    Links whose target isn't in ``lookup`` stay. Lookups are joined per link, so neither side is collected.
    """
    pieces = F.split("body", LINK, -1)
    found = F.regexp_extract_all("body", F.lit(LINK), 0)
    exploded = pages.select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit(LINK), 1)).alias("ord", "raw")).select(
        "page_id", "ord", strip(F.col("raw")).alias("raw"), page_key(F.col("raw")).alias("target")
    )
    changed = exploded.join(lookup, "target").groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ord", F.coalesce("text", "raw")))).alias("change")
    )
    new = F.transform(found, lambda x, i: F.coalesce(F.element_at("change", i), x))
    body = F.array_join(F.flatten(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, x: F.array(p, x))), "")
    joined = pages.select("page_id", "body").join(changed, "page_id", "left")
    return joined.select(
        "page_id",
        F.when(F.col("change").isNull(), F.col("body")).otherwise(body).alias("body"),
        F.when(F.col("change").isNull(), 0).otherwise(F.size("change")).alias("n_changed"),
    )


def unlink_unresolved(pages: DataFrame) -> DataFrame:
    """Links to pages that don't exist become the plain slug."""
    gone = links(pages).select("target").distinct().join(known_slugs(pages), "target", "left_anti")
    return replace_links(pages, gone.select("target", F.lit(None).cast("string").alias("text")))


def repoint(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """Links to ``old`` become links to ``new`` (or the plain slug where ``new`` is null); renames don't chain."""
    return replace_links(
        pages, renames.select(page_key(F.col("old")).alias("target"), F.when(F.col("new").isNotNull(), F.concat(F.lit("[["), F.col("new"), F.lit("]]"))).alias("text"))
    )


# --- vocabulary --------------------------------------------------------------------------------------


def synonyms(vocab: DataFrame) -> DataFrame:
    """field, word, value: each entry under its own name, and under those its description covers."""
    own = vocab.select("field", F.lower("value").alias("word"), "value", F.lit(True).alias("own"))
    named = vocab.where("description is not null").select(
        "field",
        F.explode(F.split(F.regexp_replace(F.lower("description"), "^covers ", ""), " and ")).alias("word"),
        "value",
        F.lit(False).alias("own"),
    )
    return own.unionByName(named.join(own.select("field", "word"), ["field", "word"], "left_anti"))


def coerced(pages: DataFrame, vocab: DataFrame, column: str, field: str) -> DataFrame:
    """page_id, value, canonical: the entry that a single-valued field names literally or by a synonym, or null."""
    words = (synonyms(vocab).where(F.col("field") == field).groupBy("word").agg(F.min("value").alias("canonical")))
    return pages.select("page_id", F.col(column).alias("value"), page_key(F.col(column)).alias("word")).join(words, "word", "left").select("page_id", "value", "canonical")


def normal_tags(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """page_id, tags: known tags in the order of the page, each once, at most MAX_TAGS."""
    words = (
        synonyms(vocab).where("field = 'tag'").select(F.regexp_replace("word", " ", "-").alias("word"), "value").groupBy("word").agg(F.min("value").alias("value"))
    )
    spread = pages.select("page_id", F.posexplode("tags").alias("ord", "tag")).select(
        "page_id", "ord", F.regexp_replace(page_key(F.col("tag")), " ", "-").alias("word")
    )
    known = spread.join(words, "word").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("t"))
    return pages.select("page_id").join(known, "page_id", "left").select(
        "page_id", F.slice(F.array_distinct(F.coalesce(F.col("t.value"), F.array().cast("array<string>"))), 1, MAX_TAGS).alias("tags")
    )


def normal_title(title: Column, slug: Column, qualifiers: Column) -> Column:
    """Without trailing "(qualifier)" marks that are in ``qualifiers`` (an array); slugs become Title Case."""
    q = r"\s*\(([^()]*)\)\s*$"
    t = strip(F.coalesce(title, F.lit("")))
    bare = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(t, r"\(", -1)))),
        t,
        lambda acc, _: F.when(
            acc.rlike(q) & F.array_contains(qualifiers, F.lower(strip(F.regexp_extract(acc, q, 1)))), strip(F.regexp_replace(acc, q, ""))
        ).otherwise(acc),
    )
    from_slug = title_case(strip(F.regexp_replace(slug, "[-_]", " ")))
    slugged = (bare == F.lower(bare)) & bare.rlike("[-_]") & ~bare.contains(" ")
    return (
        F.when(t == "", from_slug)
        .when(bare == "", from_slug)
        .when(slugged, title_case(strip(F.regexp_replace(bare, "[-_]", " "))))
        .otherwise(bare)
    )


# --- checks ------------------------------------------------------------------------------------------


def missing_fields(pages: DataFrame) -> DataFrame:
    """page_id, missing: required fields that are null or '' (an empty list is there)."""
    gone = lambda c: F.col(c).isNull() if c == "sources" else (F.col(c).isNull() | (F.col(c) == ""))
    fields = F.array_compact(F.array(*[F.when(gone(c), F.lit(c)) for c in REQUIRED]))
    return pages.select("page_id", F.array_join(fields, ",").alias("missing")).where("missing <> ''")


def vocabulary_violations(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """page_id, field, value outside the vocabulary. Synonyms of tags are in it, those of types and domains aren't."""
    words = (synonyms(vocab).where("own or field = 'tag'").select("field", F.when(F.col("field") == "tag", F.regexp_replace("word", " ", "-")).otherwise(F.col("word")).alias("word")).distinct())
    one = lambda c, where: pages.where(where).select("page_id", F.lit(c).alias("field"), F.col(c).alias("value"), page_key(F.col(c)).alias("word"))
    tags = pages.select("page_id", F.lit("tag").alias("field"), F.explode("tags").alias("value")).withColumn(
        "word", F.regexp_replace(page_key(F.col("value")), " ", "-")
    )
    all_ = one("entity_type", "folder = 'entities'").unionByName(one("domain", "folder = 'concepts'")).unionByName(one("category", "true")).unionByName(tags)
    return all_.where("value is not null").join(words, ["field", "word"], "left_anti").select("page_id", "field", "value")


def relations(pages: DataFrame) -> DataFrame:
    """page_id, ord, relation, target of typed relations; an entry has to have one key."""
    return pages.select("page_id", F.posexplode("relations").alias("ord", "r")).where(F.size("r") == 1).select(
        "page_id", "ord", F.map_keys("r")[0].alias("relation"), slug_of(F.map_values("r")[0]).alias("target")
    )


def unresolved_relations(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """page_id, ord, relation, target, problem: of an unknown kind, or to a page that doesn't exist."""
    kinds = (vocab.where("field = 'relation'").select(F.col("value").alias("relation"), F.lit(True).alias("ok")))
    there = known_slugs(pages).withColumn("there", F.lit(True))
    problem = F.when(F.col("ok").isNull(), "unknown relation").when(F.col("there").isNull(), "unresolved")
    return relations(pages).join(kinds, "relation", "left").join(there, "target", "left").select(
        "page_id", "ord", "relation", "target", problem.alias("problem")
    ).where("problem is not null")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return pages.select(page_key(F.col("title")).alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("n_pages")).where("n_pages > 1")


def alias_collisions(pages: DataFrame) -> DataFrame:
    """name, n_alias_pages, n_title_pages: what is the alias of one page and the title of one."""
    aliases = pages.select("page_id", F.explode("aliases").alias("a")).select(page_key(F.col("a")).alias("name"), "page_id").where("name <> ''")
    titles = pages.select(page_key(F.col("title")).alias("name"), "page_id").where("name <> ''")
    return (
        aliases.groupBy("name").agg(F.countDistinct("page_id").alias("n_alias_pages"))
        .join(titles.groupBy("name").agg(F.countDistinct("page_id").alias("n_title_pages")), "name")
    )


def stale(pages: DataFrame, log: DataFrame, grams: int = 6) -> DataFrame:
    """page_id, log_date: pages whose title the log mentions on a day after their last update.

    ``log``: line_no, line. The first line counts that has the title and a later date. A title is found
    in a line over ``grams`` characters of it, an equi-join, and compared whole then.
    """
    dated = log.select("line_no", F.lower("line").alias("line"), F.regexp_extract("line", r"\d{4}-\d{2}-\d{2}", 0).alias("log_date")).where("log_date <> ''")
    named = pages.where("title is not null and title <> '' and updated_at is not null and updated_at <> ''").select(
        "page_id", F.lower("title").alias("title"), F.substring("updated_at", 1, 10).alias("updated")
    )
    # Of all runs of ``grams`` characters in a title, the one that the fewest titles have, so that titles which begin alike don't meet.
    own = F.when(F.length("title") <= grams, F.array("title")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("title") - grams + 1), lambda i: F.col("title").substr(i, F.lit(grams))))
    )
    spread = named.select("page_id", "title", "updated", F.explode(own).alias("gram"))
    rare = spread.groupBy("gram").agg(F.count("*").alias("n"))
    heads = spread.join(rare, "gram").groupBy("page_id", "title", "updated").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # Titles shorter than a gram are rare; lines are cut only to the lengths that there are, six at most.
    lengths = [r[0] for r in named.select(F.least(F.length("title"), F.lit(grams))).distinct().collect()] or [grams]
    sizes = F.array(*[F.lit(n) for n in sorted(lengths)])
    of_line = dated.select(
        "line_no",
        "line",
        "log_date",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("line") - n + 1)), lambda i: F.substring("line", i, n))
                    )
                )
            )
        ).alias("gram"),
    )
    # Grams that stand for no title are dropped before the lines are joined.
    first = heads.select("gram").distinct()
    return (
        of_line.join(first, "gram", "left_semi").join(heads, "gram")
        .where(F.col("line").contains(F.col("title")) & (F.col("log_date") > F.col("updated")))
        .groupBy("page_id").agg(F.min_by("log_date", "line_no").alias("log_date"))
    )


def excerpt(body: Column, limit: int = 800) -> Column:
    """The beginning of a text, cut at a space, with an ellipsis where it was cut."""
    text = strip(body)
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.regexp_replace(cut, r"(?s) [^ ]*$", ""), r"(?U)\s+$", ""), F.lit(" …"))).otherwise(text)


def catalogue(pages: DataFrame) -> DataFrame:
    """folder, slug, line of the index of a wiki; a folder is a range of rows, never one value."""
    extra = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" ("), F.col(c), F.lit(")"))).otherwise(F.lit(""))
    kind_ = F.when(F.col("folder") == "entities", extra("entity_type")).when(F.col("folder") == "concepts", extra("domain")).otherwise(F.lit(""))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.col("slug"))
    return pages.select(
        "folder", "slug", F.concat(F.lit("- [["), F.col("slug"), F.lit("]] — "), title, kind_, extra("category")).alias("line")
    ).orderBy("folder", "slug")


# --- writes and clean-ups -----------------------------------------------------------------------------

#: Words of a note that lets a text shrink, and files that are made or added to by rule.
NOTE = r"(?i)supersed|contradict|revis|no longer|replaced by"
INDEX, LOG = "index.md", "log.md"


def n_lines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def rejection(path: Column, content: Column, existing: Column) -> Column:
    """Why a text may not be written: its place is outside of the wiki, it gives a disk away, or it would cut what is there; null if it may.

    A text is cut that has 4 lines or more and would have under half as many, without a note on what changed.
    """
    shrinks = (n_lines(existing) >= 4) & (n_lines(content) * 2 < n_lines(existing)) & ~content.rlike(NOTE)
    outside = path.rlike(r"(^|/)\.\.(/|$)") | ~path.startswith("wiki/")
    return F.when(outside, "outside").when(content.rlike(RAW_PATH), "raw path").when(F.coalesce(shrinks, F.lit(False)), "truncated")


def write_actions(writes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``key``, path, action (dropped, appended, rejected, written, updated), reason, content, n_unlinked of a batch of writes.

    ``writes``: ``key``, path, content, existing (null for a new page); ``pages``: slug. The index is made by rule, so writes to it are dropped; those to the
    log are appended. Links to what is neither a page nor in the batch become plain text before a write is judged.
    """
    name = F.substring_index("path", "/", -1)
    known = pages.select(page_key(F.col("slug")).alias("target")).unionByName(writes.select(page_key(F.regexp_replace(name, "[.][^.]*$", "")).alias("target"))).distinct()
    bodies = writes.select(F.col(key).alias("page_id"), F.col("content").alias("body"), F.lit(None).cast("string").alias("slug"))
    gone = links(bodies).select("target").distinct().join(known, "target", "left_anti")
    resolved = replace_links(bodies, gone.select("target", F.lit(None).cast("string").alias("text"))).select(F.col("page_id").alias(key), F.col("body").alias("resolved"), F.col("n_changed").cast("long").alias("n_unlinked"))
    by_rule = name.isin(INDEX, LOG)
    reason = F.when(~by_rule, rejection(F.col("path"), F.col("resolved"), F.col("existing")))
    action = F.when(name == INDEX, "dropped").when(name == LOG, "appended").when(reason.isNotNull(), "rejected").when(F.col("existing").isNull(), "written").otherwise("updated")
    return writes.join(resolved, key).select(key, "path", action.alias("action"), reason.alias("reason"), F.col("resolved").alias("content"), "n_unlinked")


def is_stub() -> Column:
    return F.coalesce(F.col("tags") == F.array(F.lit("stub")), F.lit(False)) | F.coalesce("body", F.lit("")).contains("auto-generated stub")


def source_doubles(pages: DataFrame) -> DataFrame:
    """page_id, target (its slug), source (a slug): concepts that only repeat the title of a source page, the last of these."""
    p = pages.withColumn("t", page_key(F.col("title")))
    s = p.where("folder = 'sources' and t <> ''").groupBy("t").agg(F.max("slug").alias("source"))
    return p.where("folder = 'concepts'").join(s, "t").select("page_id", page_key(F.col("slug")).alias("target"), "source")


def cleaned(pages: DataFrame) -> DataFrame:
    """page_id, body, n_changed of the pages that a clean-up leaves: stubs and concepts that repeat a source are gone.

    Links to a concept that repeats a source lead to the source, links to nothing that is left become plain text.
    """
    doubles = source_doubles(pages)
    left = pages.where(~is_stub()).join(doubles.select("page_id"), "page_id", "left_anti")
    to = doubles.groupBy("target").agg(F.min(F.concat(F.lit("[["), F.col("source"), F.lit("]]"))).alias("text"))
    gone = links(left).select("target").distinct().join(known_slugs(left), "target", "left_anti").join(to, "target", "left_anti")
    return replace_links(left, to.unionByName(gone.select("target", F.lit(None).cast("string").alias("text"))))


def digest(pages: DataFrame, limit: int) -> DataFrame:
    """slug, line of the pages, by folder and slug, as far as their lines have room in ``limit`` characters."""
    extra = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(" ("), F.col(c), F.lit(")"))).otherwise(F.lit(""))
    kind = F.when(F.col("folder") == "entities", extra("entity_type")).when(F.col("folder") == "concepts", extra("domain")).otherwise(F.lit(""))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.col("slug"))
    line = F.concat(F.lit("  [["), F.col("slug"), F.lit("]] "), title, kind)
    # No line is shorter than its brackets, so that no more lines than this can have room.
    order = ["folder", "slug", "page_id"]
    first = pages.where("slug is not null").select(*order, line.alias("line")).orderBy(*order).limit(limit // 8 + 1)
    upto = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("upto", upto).where(F.col("upto") <= limit).select("slug", "line")
