"""Applying a feed of inserts, updates and deletes (problem 3).

The method: drop repeated changes by an identifier, bring the rest into log order, keep the latest
change of each key by window ranking, merge into the base table, drop deletes.

A change is identified by key, kind, content, replaced content and its instant in whole seconds, as
repeats may arrive with a coarser timestamp. Log order is the instant; the link from a change to the
content which it replaces or removes decides where instants tie, are missing or contradict it. That link
needs no sorting of a key's history: a content that as many changes consumed as brought in can't be the
last one, so only *open* contents and deletions compete. Both counts are grouped by (key, content), and
the ranking keeps one row per key before its shuffle, so that a key with a third of all rows costs no
task more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import instant, squeeze

KINDS = ("ingested", "updated", "deleted")


def read_changes(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Changes of a manifest feed, without repeats: key, kind, content, replaced, at, row (a struct).

    Rows without a path, or of a kind that is none of the three, are no changes and drop out; kinds are
    compared without case and white space. A blank hash counts as none. Columns named in ``extra`` travel
    in ``row``; other columns are ignored. An empty table gives an empty result.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    changes = events.select(
        F.col("path").alias("key"),
        squeeze(F.col("event")).alias("kind"),
        blank(F.col("hash")).alias("content"),
        blank(F.col("previous_hash")).alias("replaced"),
        instant(F.col("timestamp")).alias("at"),
        F.struct(F.col("seq").alias("seq"), *[F.col(c).alias(c) for c in extra]).alias("row"),
    ).where(F.col("key").isNotNull() & F.col("kind").isin(*KINDS))
    second = F.col("at").isNull(), F.floor(F.col("at") / 1_000_000)
    found = changes.groupBy("key", "kind", "content", "replaced", second[0].alias("timeless"), second[1].alias("second")).agg(
        # among repeats, the most precise instant and the row with most of its fields
        F.max("at").alias("at"),
        F.max_by("row", F.struct(_filled(extra), -F.col("row.seq"))).alias("row"),
    )
    return found.select("key", "kind", "content", "replaced", "at", "row")


def _filled(extra: tuple[str, ...]) -> Column:
    return sum((F.col(f"row.{c}").isNotNull().cast("int") for c in extra), F.lit(0))


def balances(changes: DataFrame) -> DataFrame:
    """For each key and content how often it was brought in and consumed, and the last change of either kind.

    ``changes`` is what read_changes gives; where it has a column ``repeated`` that is true, the change was counted before and
    only its instant and its row may tell more. Balances of parts of a feed add up (add_balances).
    """
    deleted = F.col("kind") == "deleted"
    last = F.struct("kind", "content", "at", "row")
    one = F.when(F.col("repeated"), 0).otherwise(1) if "repeated" in changes.columns else F.lit(1)
    entry = lambda c, brought, consumed, last: F.struct(c.alias("c"), brought.alias("n_brought"), consumed.alias("n_consumed"), last.alias("last"))
    none = F.lit(0)
    # Each change stands with the content it brought in, and with the one it replaced or removed.
    ends = changes.select(
        "key",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~deleted, entry(F.col("content"), one, none, last)), F.when(deleted, entry(F.col("content"), none, one, last)),
                    F.when(~deleted & F.col("replaced").isNotNull(), entry(F.col("replaced"), none, one, F.lit(None))),
                )
            )
        ).alias("e"),
    ).select("key", "e.*")
    gone = F.col("last.kind") == "deleted"
    return _summed(
        ends.select("key", "c", "n_brought", "n_consumed", F.when(~gone, F.col("last.at")).alias("brought_at"), F.when(~gone, F.col("last")).alias("open"), F.when(gone, F.col("last")).alias("gone"))
    )


def _summed(parts: DataFrame) -> DataFrame:
    rank_of = lambda c: F.struct(F.coalesce(f"{c}.at", F.lit(-(1 << 62))), F.col(f"{c}.row.seq"))
    return parts.groupBy("key", "c").agg(
        F.sum("n_brought").alias("n_brought"),
        F.sum("n_consumed").alias("n_consumed"),
        F.max("brought_at").alias("brought_at"),
        F.max_by("open", F.when(F.col("open").isNotNull(), rank_of("open"))).alias("open"),
        F.max_by("gone", F.when(F.col("gone").isNotNull(), rank_of("gone"))).alias("gone"),
    )


def add_balances(base: DataFrame, more: DataFrame) -> DataFrame:
    """The balances of two parts of a feed as one."""
    return _summed(base.unionByName(more))


def identifiers(changes: DataFrame) -> DataFrame:
    """``changes`` with ``id``: equal for repeats of one change, which may differ below the second."""
    return changes.withColumn("id", F.md5(F.to_json(F.struct("key", "kind", "content", "replaced", F.floor(F.col("at") / 1_000_000).alias("second")))))


def latest_of(balance: DataFrame) -> DataFrame:
    """The last change of each key: key, kind, content, at, row, from its balances."""
    # An unknown content is never known to have been replaced; each content else is open while more changes
    # brought it in than consumed it. A deletion is not before what it deletes; an open content whose changes all lost
    # their instant has to be the last, for nothing replaced it.
    never, ever = F.lit(-(1 << 62)), F.lit(1 << 62)
    is_open = F.col("c").isNull() | (F.col("n_brought") > F.col("n_consumed"))
    candidates = balance.select(
        "key",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("open").isNotNull() & is_open, F.struct(F.coalesce("brought_at", ever).alias("order"), F.lit(1).alias("stays"), F.col("open").alias("last"))),
                    F.when(
                        F.col("gone").isNotNull(),
                        F.struct(
                            F.greatest(F.coalesce("gone.at", never), F.when((F.col("n_brought") == 1) & F.col("c").isNotNull(), F.col("brought_at")), never).alias("order"),
                            F.lit(0).alias("stays"),
                            F.col("gone").alias("last"),
                        ),
                    ),
                )
            )
        ).alias("e"),
    ).select("key", "e.*")
    rank = Window.partitionBy("key").orderBy(F.desc("order"), F.desc("stays"), F.col("last.content").desc_nulls_last(), F.desc("last.row.seq"))
    return candidates.withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("key", "last.*")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each key: key, kind, content, at, row.

    ``changes`` is what read_changes gives. Ties that neither instant nor content decides go to the larger
    content, so that a result never depends on the order of rows.
    """
    return latest_of(balances(changes))


def merge_changes(seen: DataFrame, base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A base as ``identifiers`` (id) and balances, merged with more changes: both again, for the whole feed so far.

    Only identifiers and balances are read of what came before, never its changes. Changes that the base has seen add nothing but
    a more precise instant; changes that are older than what it knows take their place among them.
    """
    coded = identifiers(changes)
    known = coded.join(seen.select("id", F.lit(True).alias("repeated")), "id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    new = known.where("not repeated").select("id")
    return seen.select("id").unionByName(new).distinct(), add_balances(base, balances(known.drop("id")))


def apply_changes(base: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The state of a table after all changes; deleted keys drop out.

    Without a base: key, content, at, row. With one (key unique, content, and any other columns): the columns of the base. Keys
    without a change stay as they are in it; of keys with one, content, ``at`` and what the change carries in ``row`` are taken from it, and
    columns that no change carries stay, or are null for new keys.
    """
    last = latest_changes(changes)
    if base is None:
        return last.where("kind <> 'deleted'").select("key", "content", "at", "row")
    carried = [f.name for f in last.schema["row"].dataType.fields]
    b, n = base.select(F.struct(*base.columns).alias("old"), F.col("key").alias("k")), last.withColumnRenamed("key", "k2")
    changed = F.col("k2").isNotNull()

    def value(c: str) -> Column:
        if c == "key":
            return F.coalesce("k2", "k")
        now = F.col(c) if c in ("content", "at") else F.col(f"row.{c}") if c in carried else None
        return F.col(f"old.{c}") if now is None else F.when(changed, now.cast(base.schema[c].dataType)).otherwise(F.col(f"old.{c}"))

    both = b.join(n, F.col("k") == F.col("k2"), "full_outer").where("kind is null or kind <> 'deleted'")
    return both.select(*[value(c).alias(c) for c in base.columns])


def current_files(events: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The files that exist now: path, hash ('' if its last change has none), at, row."""
    state = apply_changes(None, read_changes(events, extra))
    return state.select(F.col("key").alias("path"), F.coalesce("content", F.lit("")).alias("hash"), "at", "row")
