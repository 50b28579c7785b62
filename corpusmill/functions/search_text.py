"""Columns for what a search gives back: places, excerpts and rows of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

#: Fields whose lines are no text of a page.
FIELDS = ("type", "title", "created_at", "updated_at", "sources", "tags", "domain", "entity_type", "display_name", "location", "relative_path")


def location(ref: Column, scheme: str, collection: str) -> Column:
    """The path of a page within its collection, from a reference like ``scheme://collection/path?query``."""
    bare = F.substring_index(F.regexp_replace(ref, f"^{scheme}://", ""), "?", 1)
    own = F.when(bare.startswith(collection + "/"), F.substring(bare, len(collection) + 2, 1_000_000)).otherwise(bare)
    return F.when(F.coalesce(own, F.lit("")) == "", collection).otherwise(own)


def without_frontmatter(text: Column) -> Column:
    """A page without the block above its text, also where the opening fence is missing (within 30 lines)."""
    t = F.regexp_replace(text, r"^\n+", "")
    fenced = F.regexp_extract(t, r"(?s)^---.*?\n---", 0)
    lines = F.split(t, "\n", -1)
    at = F.array_position(F.transform(F.slice(lines, 2, 29), strip), F.lit("---"))
    rest = lambda c: F.regexp_replace(c, r"^\n+", "")
    return (
        F.when(fenced != "", rest(F.substring(t, F.length(fenced) + 1, F.length(t))))
        .when(at > 0, rest(F.array_join(F.slice(lines, at.cast("int") + 2, F.size(lines)), "\n")))
        .otherwise(t)
    )


def clean_snippet(text: Column) -> Column:
    """Without fences, marks of a change and lines of frontmatter."""
    kept = F.filter(F.split(text, "\n", -1), lambda ln: ~strip(ln).startswith("@@") & (strip(ln) != "---") & ~strip(ln).rlike("^(" + "|".join(FIELDS) + "):"))
    return strip(F.array_join(kept, "\n"))


def parse_hit(line: Column) -> list[Column]:
    """docid, score, file, title of a line ``#id 93% path - Title``; nulls where it isn't one."""
    pattern = r"^#(\S+)\s+(\d+)%\s+(.+?)\s+-\s+(.+)$"
    part = lambda i: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, i))
    return [F.concat(F.lit("#"), part(1)).alias("docid"), (part(2).cast("int") / 100.0).alias("score"), part(3).alias("file"), part(4).alias("title")]
