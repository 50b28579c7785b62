"""The best representative of each group of duplicate records (problem 7).

The method: token-level consensus. The values of a field in a group are aligned one after the other to a
profile of columns of weighted tokens; the heaviest token of each column that has at least half of the
weight is the consensus, and the value that exists and lies nearest to it represents the group. Only tokens of
values with half of all weight can become part of it, so all others are left out before values are aligned, and values
that are equal then are one. Large groups are counted by Spark and aligned in blocks whose profiles are aligned to
each other in the same way, so that no task sees a group whole.

Records are files of a manifest. Under one root, two are copies of one document if they have the same
content, or lie in one folder under names that differ only as copies, versions, drafts, formats and
spellings do.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.llm.canonical import fold
from corpusmill.llm.graph import components
from corpusmill.functions.frames import groups, runs
from corpusmill.operators.changes import current_files
from corpusmill.session import keep, release, tasks

#: Distinct values, or profiles, that are aligned in one go.
BLOCK_VALUES = 256
#: What stands where no name was given.
PLACEHOLDERS = ("untitled", "unnamed", "no name", "no title", "none", "null", "nan", "n/a", "na", "unknown", "tbd", "todo", "tba", "xxx", "test", "document", "new document", "unbenannt", "ohne titel", "sans titre", "sin titulo")

_COPY = r"(?:copy|kopie|copie|copia)"
_BEFORE = regex.compile(rf"^{_COPY}\s*(?:\(\d+\)\s*)?(?:of|von|de)\s+")
_MARKS = [
    regex.compile(rf"[\s_\-–]*[(\[]\s*(?:\d{{1,3}}|{_COPY}(?:\s*\d+)?|draft|entwurf|final|v\s?\d+(?:[._]\d+)*)\s*[)\]]$"),
    regex.compile(rf"[\s_\-–]+{_COPY}(?:[\s_\-]*\d{{1,3}})?$"),
    regex.compile(r"[\s_\-–]+(?:final|latest|draft|entwurf)(?:[\s_\-]*v?\d+(?:\.\d+)*)?$"),
    regex.compile(r"[\s_\-–]+(?:v|ver|version|rev)[\s_\-.]*\d+(?:[._]\d+)*$"),
]
#: A number glued to a name by _ or - is a copy's, unless the word before it is one that is numbered.
_GLUED = regex.compile(r"(?<=[^\W_])[_\-]\d$")
_NUMBERED = regex.compile(r"(?:part|annex|week|issue|plant|phase|volume|vol|chapter|section|site|team|lot|no|nr|kw|q|teil|anlage|woche|parte|semana|semaine|partie|annexe)$|(?:19|20)\d\d(?:-\d\d)?$")


def base_name(file: str) -> str:
    """What a file is called, without its format and without the marks of copies, versions and drafts."""
    stem = fold(regex.sub(r"\.[A-Za-z0-9]{1,5}$", "", file)).strip()
    while True:
        was = stem
        stem = _BEFORE.sub("", stem.strip(" _-–"))
        for mark in _MARKS:
            shorter = mark.sub("", stem)
            # "Offer Draft" is a name, "Status Report draft" is a draft of one.
            if shorter != stem and len(regex.findall(r"[^\W_]+", shorter)) >= (2 if regex.search(r"[\s_\-–]+(?:final|latest|draft|entwurf)$", stem) else 1):
                stem = shorter
        glued = _GLUED.sub("", stem)
        if glued != stem and not _NUMBERED.search(glued):
            stem = glued
        if stem == was:
            return regex.sub(r"[\W_]+", " ", stem).strip() or fold(file)


def with_keys(files: DataFrame) -> DataFrame:
    """``files`` (path, hash, and any others) with n and c: codes of what files of one name, and of one content, share.

    A blank or null hash is no content that files could share.
    """

    def names(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [p.rpartition("/") for p in batch["path"]]
            yield batch.assign(n=[f"{folder}/{base_name(name)}" for folder, _, name in parts])

    code = lambda *c: F.substring(F.sha2(F.concat_ws("\n", *c), 256), 1, 24)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(names, schema + ", n string").withColumn("n", code(F.lit("n"), "n")).withColumn(
        "c", F.when(F.col("hash") != "", code(F.lit("c"), F.substring_index("path", "/", 1), "hash"))
    )


def linked_groups(keyed: DataFrame) -> DataFrame:
    """path, group of every file that has a duplicate; ``keyed`` is what with_keys gives, written.

    Groups are linked over files that share content with one and a name with another.
    """
    keys = keyed.select("path", F.explode(F.array_compact(F.array("n", "c"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    member = keep(keys.join(shared, "key").groupBy("path").agg(F.min("key").alias("a"), F.max("key").alias("b")), "members")
    roots = components(member.where("a <> b").select("a", "b"))
    return member.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("path", F.coalesce("root", "a").alias("group"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """path, group of every file that has a duplicate; ``files``: path, hash. Files without a duplicate give no row."""
    return linked_groups(keep(with_keys(files.select("path", "hash")), "keys"))


Profile = list[dict[str, float]]


def align(one: Profile, two: Profile) -> Profile:
    """Two profiles merged column by column, as many equal tokens as possible opposite each other."""
    score = [[0.0] * (len(two) + 1) for _ in range(len(one) + 1)]
    match = [[sum(min(w, b[t]) for t, w in a.items() if t in b) for b in two] for a in one]
    for i in range(len(one) - 1, -1, -1):
        for j in range(len(two) - 1, -1, -1):
            score[i][j] = max(score[i + 1][j], score[i][j + 1], score[i + 1][j + 1] + match[i][j])
    out: Profile = []
    i = j = 0
    while i < len(one) and j < len(two):
        if match[i][j] and score[i][j] == score[i + 1][j + 1] + match[i][j]:
            merged = dict(one[i])
            for t, w in two[j].items():
                merged[t] = merged.get(t, 0.0) + w
            out.append(merged)
            i, j = i + 1, j + 1
        elif score[i][j] == score[i + 1][j]:
            out.append(one[i])
            i += 1
        else:
            out.append(two[j])
            j += 1
    return out + one[i:] + two[j:]


def tokens_of(value: str) -> list[str]:
    return regex.findall(r"[^\W_]+|[^\w\s]|_", value)


def consensus(profile: Profile, weight: float) -> list[str]:
    """The heaviest token of each column that has at least half of all weight."""
    best = [max(c.items(), key=lambda x: (x[1], x[0])) for c in profile if c]
    return [t for t, w in best if 2 * w >= weight]


def distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], above if x == y else 1 + min(above, row[j], row[j - 1])
    return row[-1]


def numbered(tokens: list[str]) -> list[tuple[str, int]]:
    """Tokens with how many equal ones are before each."""
    seen: Counter[str] = Counter()
    out = []
    for t in tokens:
        out.append((t, seen[t]))
        seen[t] += 1
    return out


def reduced(tokens: list[str], often: set[tuple[str, int]]) -> list[str]:
    return [t for t, k in numbered(tokens) if (t, k) in often]


def aligned(values: Iterable[tuple[list[str], float]]) -> Profile:
    """A profile of weighted lists of tokens, the heaviest first."""
    profile: Profile = []
    for tokens, weight in sorted(values, key=lambda x: (-x[1], x[0])):
        profile = align(profile, [{t: weight} for t in tokens])
    return profile


def agreed(values: list[str], weights: list[float]) -> list[str]:
    """The consensus of the values of one group."""
    half = sum(weights) / 2 - 1e-9
    lists = [tokens_of(v) for v in values]
    counts: Counter[tuple[str, int]] = Counter()
    for tokens, w in zip(lists, weights):
        for t in numbered(tokens):
            counts[t] += w
    often = {t for t, w in counts.items() if w >= half}
    merged: Counter[tuple[str, ...]] = Counter()
    for tokens, w in zip(lists, weights):
        merged[tuple(reduced(tokens, often))] += w
    return consensus(aligned((list(t), w) for t, w in merged.items()), sum(weights))


def consensus_values(values: DataFrame) -> DataFrame:
    """group, field, value: for each group and field the existing value nearest to the consensus.

    ``values``: group, field, value, weight. Null and blank values have no vote. Ties go to the heavier
    value, then to the first in the alphabet.
    """
    n_tasks = tasks(values.sparkSession)
    voted = values.where(F.col("value").isNotNull() & (strip(F.col("value")) != "")).groupBy("group", "field", "value").agg(F.sum("weight").alias("weight"))
    size = keep(voted.groupBy("group", "field").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max_by("value", F.struct("weight")).alias("any")), "sizes")
    # One value alone is its own consensus.
    alone = size.where("n = 1").select("group", "field", F.col("any").alias("value"))
    several = lambda where: voted.join(size.where(where).select("group", "field", "n", "total"), ["group", "field"])

    def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, (group, field, texts, weights) in runs(batches, "key", ["group", "field", "value", "weight"]):
            middle = agreed(texts, weights)
            best = min(zip(texts, weights), key=lambda x: (distance(tokens_of(x[0]), middle), -x[1], x[0]))[0]
            out.append((group[0], field[0], best))
        yield pd.DataFrame(out, columns=["group", "field", "value"])

    schema = "group string, field string, value string"
    small = (
        several(f"n > 1 and n <= {BLOCK_VALUES}").select("group", "field", "value", "weight", F.concat_ws("\t", "group", "field").alias("key"))
        .repartition(n_tasks, "key").sortWithinPartitions("key").mapInPandas(nearest, schema)
    )
    found = small.unionByName(alone)
    most = size.agg(F.max("n")).first()[0] or 0
    return found.unionByName(_of_large_groups(several(f"n > {BLOCK_VALUES}"), most)) if most > BLOCK_VALUES else found


def _of_large_groups(values: DataFrame, most: int) -> DataFrame:
    """What consensus_values gives for groups of more than one block; ``values``: group, field, value, weight, n, total."""
    n_tasks = tasks(values.sparkSession)
    large = keep(values, "values")

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, f, t, k, w) for g, f, v, w in zip(b["group"], b["field"], b["value"], b["weight"]) for t, k in numbered(tokens_of(v))]
            yield pd.DataFrame(rows, columns=["group", "field", "token", "k", "weight"])

    counts = large.select("group", "field", "value", "weight").mapInPandas(spread, "group string, field string, token string, k int, weight double")
    totals = large.select("group", "field", "total").distinct()
    # Tokens of half the weight are at most twice as many as a value has on average.
    often = (
        counts.groupBy("group", "field", "token", "k").agg(F.sum("weight").alias("w")).join(totals, ["group", "field"]).where("2 * w >= total - 1e-9")
        .groupBy("group", "field").agg(F.collect_list(F.struct("token", "k")).alias("often"))
    )

    def reduce(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [json.dumps(reduced(tokens_of(v), {(x["token"], x["k"]) for x in o} if o is not None else set())) for v, o in zip(b["value"], b["often"])]
            yield b.assign(tokens=kept)[["group", "field", "tokens", "weight", "total"]]

    lists = keep(
        large.join(often, ["group", "field"], "left").select("group", "field", "value", "weight", "total", "often")
        .mapInPandas(reduce, "group string, field string, tokens string, weight double, total double")
        .groupBy("group", "field", "tokens", "total").agg(F.sum("weight").alias("weight")), "reduced",
    )
    key = F.concat_ws("\t", "group", "field", F.col("block").cast("string"))
    schema = "group string, field string, block long, profile string, total double"

    def merged(batches: Iterable[pd.DataFrame], of: Callable[[pd.DataFrame], Profile]) -> Iterator[pd.DataFrame]:
        for _, rows in groups(batches, "key"):
            yield pd.DataFrame([(*rows.iloc[0][["group", "field", "block"]], json.dumps(of(rows)), rows["total"].iat[0])], columns=["group", "field", "block", "profile", "total"])

    def joined(rows: pd.DataFrame) -> Profile:
        profile: Profile = []
        for p in sorted(rows["profile"]):
            profile = align(profile, json.loads(p))
        return profile

    n_blocks = max(1, math.ceil(most / BLOCK_VALUES))
    blocks = (
        lists.withColumn("block", F.pmod(F.xxhash64("tokens"), F.lit(n_blocks)))
        .withColumn("key", key).repartition(n_tasks, "key").sortWithinPartitions("key")
        .mapInPandas(lambda batches: merged(batches, lambda rows: aligned((json.loads(t), w) for t, w in zip(rows["tokens"], rows["weight"]))), schema)
    )
    # Profiles meet in blocks of as many, until each group has one.
    while n_blocks > 1:
        n_blocks = math.ceil(n_blocks / BLOCK_VALUES)
        blocks = (
            keep(blocks, "profiles").withColumn("block", F.floor(F.col("block") / BLOCK_VALUES))
            .withColumn("key", key).repartition(n_tasks, "key").sortWithinPartitions("key").mapInPandas(lambda batches: merged(batches, joined), schema)
        )

    def agree(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["consensus"] = [consensus(json.loads(p), t) for p, t in zip(b["profile"], b["total"])]
            yield b[["group", "field", "consensus"]]

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["distance"] = [distance(tokens_of(v), list(c)) for v, c in zip(b["value"], b["consensus"])]
            yield b[["group", "field", "value", "weight", "distance"]]

    middle = blocks.mapInPandas(agree, "group string, field string, consensus array<string>")
    near = large.join(middle, ["group", "field"]).select("group", "field", "value", "weight", "consensus").mapInPandas(
        compare, "group string, field string, value string, weight double, distance int"
    )
    return near.groupBy("group", "field").agg(F.min_by("value", F.struct("distance", -F.col("weight"), F.col("value"))).alias("value"))


def says_something(name):
    """Whether a display name is neither blank nor a placeholder."""
    s = F.lower(strip(name))
    return F.coalesce(s.rlike(r"[\p{L}\p{N}]") & ~s.isin(*PLACEHOLDERS), F.lit(False))


FIELDS = ("hash", "relative_path", "display_name")
#: Marks of a copy in a file's name.
COPY_MARK = r"(?i)(^|[^\p{L}])(copy|kopie|copie|copia)([^\p{L}]|$)|\(\d{1,3}\)"


def best_representatives(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and records of all groups of duplicates in a manifest feed.

    Members: path, group, keep_path. Records: group, keep_path, hash, relative_path, display_name, n_members.

    A record is voted for field by field: each member has a vote of weight (1 + its fields that say something) times
    (1 + how late it changed, from 0 for the first of the group to 1 for the last), half of that if its name is that of a copy; the
    value nearest to the consensus stands in the record, '' for a hash that no member has, null for other fields.
    The member that changed last survives, among those whose last change has a hash, a relative path and a display
    name that says something; if there are none, among all, the most complete first. Where that leaves a tie, the member whose
    fields are those of the record survives, then the first path.
    """
    state = current_files(events, ("relative_path", "display_name")).select("path", "hash", "at", "row.relative_path", "row.display_name")
    files = keep(with_keys(state), "files")
    has = lambda c: F.coalesce(strip(F.col(c)) != "", F.lit(False))
    facts = keep(
        linked_groups(files).join(files, "path").select(
            "path", "group", "at", F.when(has("hash"), F.col("hash")).alias("hash"), F.when(has("relative_path"), F.col("relative_path")).alias("relative_path"),
            F.when(says_something(F.col("display_name")), F.col("display_name")).alias("display_name"),
        ), "facts",
    )
    release(files)
    span = facts.groupBy("group").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in FIELDS), F.lit(0))
    late = F.coalesce((F.col("at") - F.col("first")) / F.nullif(F.col("last") - F.col("first"), F.lit(0)), F.lit(0.0))
    weight = (1 + filled) * (1 + late) * F.when(F.substring_index("path", "/", -1).rlike(COPY_MARK), 0.5).otherwise(1.0)
    votes = facts.join(span, "group").select("group", weight.alias("weight"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("v"))
    best = consensus_values(votes.select("group", "v.field", "v.value", F.round("weight", 6).alias("weight")))
    wide = best.groupBy("group").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"best_{f}") for f in FIELDS])
    agrees = sum((F.coalesce(F.col(f) == F.col(f"best_{f}"), F.lit(False)).cast("int") for f in FIELDS), F.lit(0))
    order = F.struct(-filled, -F.coalesce("at", F.lit(-(1 << 62))), -agrees, F.col("path"))
    records = (
        facts.join(wide, "group", "left").groupBy("group")
        .agg(F.min_by("path", order).alias("keep_path"), F.count("*").alias("n_members"), *[F.max(f"best_{f}").alias(f) for f in FIELDS])
        .withColumn("hash", F.coalesce("hash", F.lit("")))
    )
    return facts.join(records.select("group", "keep_path"), "group").select("path", "group", "keep_path"), records
