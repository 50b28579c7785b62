"""References to records that do not exist (problem 2).

The method: every key gets an integer from a dictionary, each range of 32,768 integers is one compressed
bitmap per side and period (a list, runs or bits, whatever is smallest), orphans are the bits of *references AND NOT
parents*, and the bits that survive are decoded to keys again. What is shuffled for the comparison are containers of 4 KB at
most, not references; the references themselves are joined once, with the keys that survived.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import instant, strip
from corpusmill.operators.changes import current_files
from corpusmill.session import keep

BITS = 32_768


def packed(positions: np.ndarray) -> bytes:
    """Sorted positions below BITS as the smallest of three containers: a list, runs (first, more of it), or a bit for each."""
    at = positions.astype(np.uint16)
    first = np.flatnonzero(np.diff(positions, prepend=-2) != 1)
    more = np.diff(np.append(first, len(at))) - 1
    if 4 * len(first) < min(2 * len(at), BITS // 8):
        return b"r" + np.column_stack([at[first], more.astype(np.uint16)]).tobytes()
    if 2 * len(at) < BITS // 8:
        return b"a" + at.tobytes()
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[positions] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpacked(container: bytes) -> np.ndarray:
    """A container as one flag for each position."""
    out = np.zeros(BITS, dtype=bool)
    kind, body = container[:1], container[1:]
    if kind == b"b":
        return np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(bool)
    values = np.frombuffer(body, dtype=np.uint16).astype(np.int64)
    if kind == b"a":
        out[values] = True
    else:
        for start, more in values.reshape(-1, 2):
            out[start : start + more + 1] = True
    return out


def _pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["bits"] = [packed(np.sort(np.asarray(p, dtype=np.int64))) for p in b["positions"]]
        yield b.drop(columns="positions")


def _and_not(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One range of keys: at most one container for each side and period, so the group is bounded."""
    domain, bucket = key
    none = np.zeros(BITS, dtype=bool)
    by_side: dict[str, list[tuple[str, bytes]]] = {"reference": [], "known": [], "alive": [], "born": []}
    for side, period, bits in zip(rows["side"], rows["period"], rows["bits"]):
        by_side[side].append((period, bits))
    known, alive = (unpacked(by_side[s][0][1]) if by_side[s] else none for s in ("known", "alive"))
    born, before = sorted(by_side["born"], reverse=True), none.copy()
    found = []
    for period, bits in sorted(by_side["reference"]):
        while born and born[-1][0] < period:
            before |= unpacked(born.pop()[1])
        there = unpacked(bits)
        for state, left in (("missing", there & ~known), ("deleted", there & known & ~alive), ("late", there & alive & ~before if period else none)):
            at = np.flatnonzero(left)
            if len(at):
                found.append(pd.DataFrame({"domain": domain, "period": period, "id": int(bucket) * BITS + at, "state": state}))
    columns = ["domain", "period", "id", "state"]
    return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Each reference whose parent is missing, deleted or later than the reference.

    ``references``: owner, domain, target, at (microseconds of the reference, or null). ``parents``:
    domain, target, alive (boolean), born (microseconds, or null); rows of one target count together:
    it is alive if any is, and born with the first. The result has owner, domain, target, at, period
    (the month of ``at``, '' if that is null) and state. A reference without a time, or to a parent without
    one, is never late. Null and blank targets are no references and no parents. Repeated rows give one.
    """
    valid = F.col("target").isNotNull() & (F.col("target") != "")
    month = lambda c: F.coalesce(F.date_format(F.timestamp_micros(c), "yyyy-MM"), F.lit(""))
    refs = references.where(valid).select("owner", "domain", "target", "at", month("at").alias("period")).distinct()
    sides = keep(
        refs.select("domain", "target", "period", F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("long").alias("born"))
        .distinct()
        .unionByName(
            parents.where(valid)
            .groupBy("domain", "target")
            .agg(F.max("alive").alias("alive"), F.min("born").alias("born"))
            .select("domain", "target", month("born").alias("period"), F.coalesce("alive", F.lit(False)).alias("alive"), "born")
        ),
        "sides",
    )
    # The dictionary is written once: an integer that was given out must not change when a task is repeated.
    dictionary = keep(sides.select("domain", "target").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = sides.join(dictionary, ["domain", "target"])
    is_parent = F.col("alive").isNotNull()
    entries = coded.select(
        "domain",
        "id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~is_parent, F.struct(F.lit("reference").alias("side"), F.col("period").alias("p"))),
                    F.when(is_parent, F.struct(F.lit("known").alias("side"), F.lit("").alias("p"))),
                    F.when(F.col("alive"), F.struct(F.lit("alive").alias("side"), F.lit("").alias("p"))),
                    F.when(is_parent, F.struct(F.lit("born").alias("side"), F.col("period").alias("p"))),
                )
            )
        ).alias("e"),
    )
    # The positions of a range are at most BITS, and each stands once in a side and period.
    ranges = entries.groupBy("domain", F.floor(F.col("id") / BITS).alias("bucket"), F.col("e.side").alias("side"), F.col("e.p").alias("period")).agg(
        F.collect_list((F.col("id") % BITS).cast("int")).alias("positions")
    )
    bitmaps = ranges.mapInPandas(_pack, "domain string, bucket long, side string, period string, bits binary")
    left = bitmaps.groupBy("domain", "bucket").applyInPandas(_and_not, "domain string, period string, id long, state string")
    decoded = left.join(dictionary, ["domain", "id"]).drop("id")
    # Months are too coarse for what is late: those bits are candidates, and instants decide.
    births = sides.where("alive is not null").select("domain", "target", "born")
    checked = decoded.join(births, ["domain", "target"], "left")
    return (
        refs.join(checked, ["domain", "target", "period"])
        .where((F.col("state") != "late") | (F.col("at") < F.col("born")))
        .select("owner", "domain", "target", "at", "period", "state")
    )


def slug_of(link):
    """The slug of a ``[[slug|alias]]`` or ``[[slug#anchor]]`` or bare slug, in lower case."""
    bare = F.regexp_replace(strip(link), r"^\[\[|\]\]$", "")
    return F.lower(strip(F.regexp_replace(strip(F.regexp_extract(bare, r"(?s)^([^|#]*)", 1)), r"(?i)\.md$", "")))


def page_references(pages: DataFrame) -> DataFrame:
    """owner, domain, target, at of the relations and sources of wiki pages."""
    at = instant(F.col("updated_at")).alias("at")
    relations = pages.select("page_id", at, F.explode("relations").alias("r")).select(
        F.col("page_id").alias("owner"), F.lit("relations").alias("domain"), F.explode(F.map_values("r")).alias("t"), "at"
    )
    sources = pages.select(F.col("page_id").alias("owner"), F.lit("sources").alias("domain"), F.explode("sources").alias("t"), at)
    return relations.withColumn("target", slug_of(F.col("t"))).drop("t").unionByName(
        sources.withColumn("target", F.lower(strip(F.col("t")))).drop("t")
    )


def page_parents(pages: DataFrame, events: DataFrame) -> DataFrame:
    """domain, target, alive, born of the slugs of pages and the paths of a manifest feed."""
    slugs = pages.select(
        F.lit("relations").alias("domain"),
        slug_of(F.col("slug")).alias("target"),
        F.lit(True).alias("alive"),
        instant(F.col("created_at")).alias("born"),
    )
    seen = events.select(
        F.lit("sources").alias("domain"), F.lower(strip(F.col("path"))).alias("target"), F.lit(False).alias("alive"), instant(F.col("timestamp")).alias("born")
    ).groupBy("domain", "target", "alive").agg(F.min("born").alias("born"))
    now = current_files(events).select(
        F.lit("sources").alias("domain"), F.lower(strip(F.col("path"))).alias("target"), F.lit(True).alias("alive"), F.lit(None).cast("long").alias("born")
    )
    return slugs.unionByName(seen).unionByName(now)


def page_orphans(pages: DataFrame, events: DataFrame) -> DataFrame:
    return orphan_references(page_references(pages), page_parents(pages, events))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table (of the reference), period and state."""
    return orphans.groupBy(F.col("domain").alias("table_name"), "period", "state").agg(
        F.count("*").alias("n_references"), F.countDistinct("target").alias("n_targets")
    )


__all__ = ["orphan_references", "orphan_report", "page_orphans", "page_parents", "page_references", "slug_of"]
