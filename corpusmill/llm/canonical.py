"""Mapping freely entered values to a canonical list (problem 6).

The method: a trie of the reference entries and of the aliases in their descriptions, searched with a
Levenshtein automaton. Every way in which a value may name an entry is a walk down that trie: as it stands, by its words
in any order (each word continues where another ended), by abbreviated words that go on to the end of the entry's word, and by the
beginning of an entry of one word. All entries within a distance that depends on their length come back, and the
first kind of walk that leads to one entry alone decides.

Values are mapped once for each distinct spelling, so that a spelling which a third of all rows share costs one search.
A controlled vocabulary is sent to the tasks; a longer list is cut into parts that all values meet.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip
from corpusmill.functions.frames import groups
from corpusmill.llm.tries import Automaton, Trie
from corpusmill.session import tasks

#: Entries of a reference list that are sent to every task; longer lists are cut into parts of as many.
SENT_ENTRIES = 200_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһԛԝвкмнтгпАЕОРСУХІЈЅВКМНТαοερικντυχ", "aeopcyxijsdhqwbkmhtrnAEOPCYXIJSBKMHTaoepikvtux")
#: Words between the parts of a turned phrase.
LINKS = {"of", "the", "a", "an", "and", "for", "de", "du", "der", "des", "von"}
_WORD = regex.compile(r"[\p{L}\p{N}&]+\.?")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")


def fold(text: str) -> str:
    """Lower case without accents, lookalikes of other scripts as Latin letters."""
    text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    return "".join(ch for ch in text if not unicodedata.combining(ch)).lower()


def _words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def _plain(words: Iterable[str]) -> str:
    return "".join(w.rstrip(".").replace("&", "") for w in words)


class Entry(NamedTuple):
    value: str
    length: int
    alias: bool
    words: tuple[str, ...]


#: Kinds of walks, the first that leads to one entry alone decides.
LITERAL, TURNED, SHORTENED, BEGUN, NEAR = range(5)


class Reference:
    """The entries of one field, and all ways a value may name one of them."""

    def __init__(self, entries: list[tuple[str, list[str]]]) -> None:
        self.trie = Trie()
        self.cuts: set[int] = set()  # nodes at which a word of an entry ends
        self.room: dict[int, tuple[int, int]] = {}  # the fewest and the most letters that go on from a node to an end
        for value, aliases in entries:
            for text, alias in [(value, False), *((a, True) for a in aliases)]:
                words = [w.rstrip(".") for w in _words(text)]
                for form in dict.fromkeys([tuple(words), tuple(w for w in words if w not in LINKS)]):
                    if plain := _plain(form):
                        self.trie.add(plain, Entry(value, len(plain), alias, form))
                        for i in range(1, len(form) + 1):
                            self.cuts.add(id(self.trie.find(_plain(form[:i]))))
        self._measure()

    def _measure(self) -> None:
        order, stack = [], [self.trie]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children.values()
        for node in reversed(order):
            below = [self.room[id(c)] for c in node.children.values()] + [(-1, -1)] * bool(node.end)
            self.room[id(node)] = (1 + min(a for a, _ in below), 1 + max(b for _, b in below)) if below else (0, 0)

    def _orders(self, words: list[str], budget: int) -> dict[Entry, int]:
        """Entries that the words give in any order, each with the edits within words; the trie tells which word may be next."""
        best: dict[Entry, int] = {}
        seen: set[tuple] = set()
        automata: dict[tuple[str, int], Automaton] = {}
        stack = [(self.trie, tuple(sorted(words)), 0)]
        while stack:
            node, left, used = stack.pop()
            state = (id(node), left, used)
            if state in seen:
                continue
            seen.add(state)
            if not left:
                for e in node.end:
                    if used <= self.bound(e.length) and used < best.get(e, 99):
                        best[e] = used
                continue
            letters = sum(map(len, left))
            for w in dict.fromkeys(left):
                k = min(budget - used, 0 if len(w) < 3 else 1 if len(w) < 5 else 2)
                automaton = automata.get((w, k)) or automata.setdefault((w, k), Automaton(w, k))
                i = left.index(w)
                for to, d in node.reached(automaton):
                    low, high = self.room[id(to)]
                    if low - (budget - used - d) <= letters - len(w) <= high + (budget - used - d):
                        stack.append((to, left[:i] + left[i + 1 :], used + d))
        return best

    def _abbreviated(self, words: list[str]) -> set[str]:
        """Entries whose words begin with the given ones, where these end in a full stop."""
        short = [w.rstrip(".") for w in words]
        dots = [w.endswith(".") and len(w) > 3 for w in words]
        if not any(dots):
            return set()
        nodes = [self.trie]
        for w, dot in zip(short, dots):
            reached = [n for n in (node.find(w) for node in nodes) if n is not None]
            nodes = [m for n in reached for m in (self._ends_of_word(n) if dot else [n])]
        fits = lambda e: len(e.words) == len(short) and all((f.startswith(s) and f != s) if dot else f == s for f, s, dot in zip(e.words, short, dots))
        return {e.value for n in nodes for e in n.end if fits(e)}

    def _ends_of_word(self, node: Trie) -> list[Trie]:
        out, stack = [], list(node.children.values())
        while stack:
            at = stack.pop()
            if id(at) in self.cuts:
                out.append(at)
            stack += at.children.values()
        return out

    def _begun(self, plain: str) -> set[str]:
        """Entries of one word that begin with the given letters, six at least."""
        node = self.trie.find(plain) if len(plain) >= 6 else None
        return {e.value for e in node.below() if len(e.words) == 1 and not e.alias} if node is not None else set()

    @staticmethod
    def bound(length: int) -> int:
        """Edits by the length of the entry: none below 5 letters, 1 below 9, else 2."""
        return 0 if length < 5 else 1 if length < 9 else 2

    def _near(self, words: list[str], bare: list[str]) -> dict[str, tuple[int, bool]]:
        best: dict[str, tuple[int, bool]] = {}
        query = _plain(words)
        found = [*self.trie.near(query, self.bound(len(query) + 2)), *(self._orders(bare, 2).items() if len(bare) > 1 else ())]
        for e, d in found:
            if d <= self.bound(e.length) and (d, e.alias) < best.get(e.value, (99, True)):
                best[e.value] = (d, e.alias)
        return best

    def all_near(self, text: str) -> list[tuple[str, tuple[int, bool]]]:
        """Every entry within the distance for its length, in any order of words, nearest first.

        Each comes with its distance and whether it was an alias that was near.
        """
        words, bare = self._bare(text)
        return sorted(self._near(words, bare).items(), key=lambda x: (x[1], x[0])) if words else []

    @staticmethod
    def _bare(text: str) -> tuple[list[str], list[str]]:
        """The words of a value, and those that don't only link others, without full stops."""
        words = _words(text)
        plain = [w.rstrip(".") for w in words]
        return words, [w for w in plain if w not in LINKS] or plain

    def walks(self, raw: str, field: str) -> Iterator[tuple[int, int, bool, set[str]]]:
        """What each kind of walk leads to, in the order in which they decide: number, distance, alias, entries."""
        for i, text in enumerate(_readings(raw, field)):
            words, bare = self._bare(text)
            if not words:
                continue
            node = self.trie.find(_plain(words))
            ends = node.end if node is not None else []
            turned = self._orders(bare, 0)
            for kind, found in ((LITERAL, ends), (TURNED, turned)):
                for alias in (False, True):
                    yield 10 * i + 2 * kind + alias, 0, alias, {e.value for e in found if e.alias == alias}
            yield 10 * i + 2 * SHORTENED, 0, False, self._abbreviated(words)
            yield 10 * i + 2 * BEGUN, 0, False, self._begun(_plain(words))
            near = self._near(words, bare)
            if near:
                first = min(near.values())
                yield 10 * i + 2 * NEAR, *first, {v for v, k in near.items() if k == first}

    def best(self, raw: str, field: str) -> str:
        """The one entry that ``raw`` stands for, or ''."""
        return next((next(iter(found)) for *_, found in self.walks(raw, field) if len(found) == 1), "")


def _readings(raw: str, field: str) -> list[str]:
    """The value as it stands, and without what people put around a value: field name, quotes, remarks."""
    text = raw.strip()
    out = [text]
    bare = regex.sub(r"\s*[\(\[][^)\]]*[\)\]]\s*$", "", text)
    bare = regex.sub(rf"^\s*(?:{regex.escape(field)}|tag|type|kind|domain|category|entity[ _]type)\s*[:=]\s*", "", bare, flags=regex.I)
    if bare and bare != text:
        out.append(bare)
    if _CAMEL.search(text):
        out.append(_CAMEL.sub(" ", text))
    return out


def split_aliases(description: str | None) -> list[str]:
    """The other names in a description of the form ``covers A and B``."""
    if not description:
        return []
    text = regex.sub(r"^\s*(?:covers|includes|also|means)\s+", "", description, flags=regex.I)
    return [a.strip() for a in regex.split(r"\s+and\s+|\s*[,;]\s*", text) if a.strip()]


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct spellings to entries: field, raw_value, canonical ('' if it stands for none).

    ``values``: field, raw_value. ``reference``: field, value, description. Null and blank values give no
    row, nor do values that are literally an entry of their field. A tie between two entries at the same
    distance is no match. A field without entries maps everything to ''.
    """
    entries = reference.select("field", "value", "description").where("field is not null and value is not null").distinct()
    distinct = (
        values.where(F.col("raw_value").isNotNull() & (strip(F.col("raw_value")) != ""))
        .select("field", "raw_value")
        .distinct()
        .join(entries.select("field", F.col("value").alias("raw_value")).distinct(), ["field", "raw_value"], "left_anti")
    )
    n = entries.limit(SENT_ENTRIES + 1).count()
    return _by_list(distinct, entries) if n <= SENT_ENTRIES else _by_parts(distinct, entries, math.ceil(entries.count() / SENT_ENTRIES))


def _references(rows: Iterable[tuple[str, str, str | None]]) -> dict[str, Reference]:
    by_field: dict[str, list[tuple[str, list[str]]]] = {}
    for field, value, description in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        by_field.setdefault(field, []).append((value, split_aliases(description)))
    return {f: Reference(e) for f, e in by_field.items()}


def _by_list(distinct: DataFrame, entries: DataFrame) -> DataFrame:
    """Every task has the whole list, of at most SENT_ENTRIES."""
    spark = distinct.sparkSession
    sent = spark.sparkContext.broadcast([tuple(r) for r in entries.collect()])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        references, none = _references(sent.value), Reference([])
        for batch in batches:
            batch["canonical"] = [references.get(f, none).best(v, f) for f, v in zip(batch["field"], batch["raw_value"])]
            yield batch

    return distinct.repartition(tasks(spark), "raw_value").mapInPandas(run, "field string, raw_value string, canonical string")


def _by_parts(distinct: DataFrame, entries: DataFrame, n_parts: int) -> DataFrame:
    """Each block of values meets each part of the list, and what the walks lead to in all parts decides."""
    n_blocks = tasks(distinct.sparkSession)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    listed = entries.select("field", "value", "description", own("value", n_parts).alias("part"), every(n_blocks).alias("block")).withColumn("side", F.lit(0))
    asked = distinct.select("field", F.col("raw_value").alias("value"), F.lit(None).cast("string").alias("description"), every(n_parts).alias("part"), own("raw_value", n_blocks).alias("block"))
    rows = listed.unionByName(asked.withColumn("side", F.lit(1))).withColumn("key", F.concat_ws("/", "part", "block"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, block in groups(batches, "key"):
            here = block[block["side"] == 0]
            references = _references(zip(here["field"], here["value"], here["description"]))
            out = []
            for f, v in block.loc[block["side"] == 1, ["field", "value"]].itertuples(index=False):
                if f in references:
                    out += [(f, v, walk, d, alias, e) for walk, d, alias, found in references[f].walks(v, f) for e in found]
            yield pd.DataFrame(out, columns=["field", "raw_value", "walk", "distance", "alias", "entry"])

    led = (
        rows.select("key", "side", "field", "value", "description").repartition(n_blocks * n_parts, "key").sortWithinPartitions("key", "side")
        .mapInPandas(run, "field string, raw_value string, walk int, distance int, alias boolean, entry string")
        .groupBy("field", "raw_value", "walk", "distance", "alias").agg(F.countDistinct("entry").alias("n"), F.min("entry").alias("entry"))
        .groupBy("field", "raw_value", "walk").agg(F.min_by(F.struct("n", "entry"), F.struct("distance", "alias")).alias("near"))
        .where("near.n = 1").groupBy("field", "raw_value").agg(F.min_by("near.entry", "walk").alias("canonical"))
    )
    return distinct.join(led, ["field", "raw_value"], "left").select("field", "raw_value", F.coalesce("canonical", F.lit("")).alias("canonical"))


def page_values(pages: DataFrame) -> DataFrame:
    """page_id, field, raw_value of the vocabulary fields of wiki pages."""
    one = lambda c: pages.select("page_id", F.lit(c).alias("field"), F.col(c).alias("raw_value"))
    tags = pages.select("page_id", F.lit("tag").alias("field"), F.explode("tags").alias("raw_value"))
    return one("entity_type").unionByName(one("domain")).unionByName(tags)


def map_pages(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    values = page_values(pages).distinct()
    return values.join(map_values(values, vocab), ["field", "raw_value"]).select("page_id", "field", "raw_value", "canonical")
