"""Variant spellings of names typed by people (problem 1).

The method: a trie join. The words of all names are sharded into tries by what is left of them, or of a half, without
one letter, which two words within the bound share; in each shard a Levenshtein automaton walks the trie for every
word that falls into it. Neighbours give each word the spelling it stands for. Names are then compared as sets of words, in
whatever order: the rarest word (a surname, the invented part of a firm's name) is the anchor, and the
others have to agree with one and only one full name of that anchor, as equal words, initials,
abbreviations, or by being left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.frames import runs
from corpusmill.llm.canonical import fold
from corpusmill.llm.graph import components
from corpusmill.llm.tries import Automaton, Trie, within
from corpusmill.session import keep, release, tasks

#: Letters from which two edits are allowed; entries and queries of a block of a shard.
LONG, BLOCK_WORDS = 11, 1_024
#: Pages up to which a word may be a slip of anything; how much rarer than a word its misspelling is.
FEW, COMMON = 3, 4

#: Short forms of given names that are no beginning of the full form, by full form.
NICKNAMES = {
    "alexandra": "sandra sandy lexi sasha", "alexander": "sascha xander", "andrew": "drew", "anthony": "tony", "barbara": "barb babs",
    "catherine": "cathy kate katie", "charles": "charlie chuck chas", "christopher": "kit", "daniel": "danny", "dorothy": "dot dottie dolly thea",
    "edward": "ted eddie ned", "eleanor": "ellie nell nora lenny", "elizabeth": "liz lizzie beth betty bess libby lisa betsy", "francisco": "paco pancho",
    "frederick": "freddie freddy fritz rick", "gabriele": "gabi gaby", "heinrich": "heinz heini", "helen": "nell", "henry": "harry hank hal",
    "ignacio": "nacho", "isabella": "izzy bella issy", "james": "jim jimmy jamie", "john": "jack johnny", "jose": "pepe", "josefina": "pepa fina josie",
    "joseph": "joe joey jo", "katherine": "kathy kate katie kat kitty kath", "lawrence": "larry lawrie laurie lars", "margaret": "maggie peggy meg greta margie",
    "mary": "polly molly", "nicholas": "nick nicky klaus", "oliver": "ollie olly noll", "patricia": "pat patty trish tricia patsy",
    "quentin": "quinn", "richard": "dick rick ricky rich ritchie", "robert": "bob bobby rob robbie bert", "samuel": "sam sammy",
    "theodore": "ted teddy theo", "ursula": "uschi ulla ursel", "victoria": "vicky vicki tori", "walter": "walt wally", "william": "bill billy will willy liam",
    "yolanda": "yoli yola", "zachary": "zack zach zac zak",
}
#: Abbreviations of legal forms and trades that are no beginning of the full word.
SHORT_FORMS = {
    "assoc": "associates", "assocs": "associates", "co": "company", "comp": "company", "corp": "corporation", "grp": "group", "hldgs": "holdings", "inc": "incorporated",
    "intl": "international", "ltd": "limited", "mfg": "manufacturing", "manuf": "manufacturing", "ptnrs": "partners", "svcs": "services", "serv": "services",
    "sys": "systems", "syst": "systems",
}
#: Words around a name that are no part of it.
AROUND = {"the", "mr", "mrs", "ms", "mx", "dr", "prof", "phd", "msc", "mba", "jr", "sr", "gmbh", "ag", "sa", "llc", "plc", "and"}
SHORT = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split() if sum(short in s.split() for s in NICKNAMES.values()) == 1}
MANY = {short: [full for full, s in NICKNAMES.items() if short in s.split()] for shorts in NICKNAMES.values() for short in shorts.split()}
GIVEN = set(NICKNAMES)
#: Short forms that are a beginning of the full form.
BEGUN = sorted({full[:k] for full in NICKNAMES for k in range(3, len(full))})

_REMARK = regex.compile(r"\s*[\(\[][^)\]]*[\)\]]\s*$")
_ROLE = regex.compile(r"(?<=\S\s\S.*|\S{4})\s+[-–—]\s+\S.*$")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def parse(name: str) -> list[str]:
    """The words of a name, folded; without titles, remarks and roles."""
    text = regex.sub(r"&\s*co\b\.?", " ", name.strip(), flags=regex.I)
    text = _ROLE.sub("", _REMARK.sub("", text))
    text = regex.sub(r"(?<=\p{L})['’](?=\p{L}\b)", "", _CAMEL.sub(" ", text))
    words = [w for w in _WORD.findall(fold(text)) if w not in AROUND]
    # Of several initials only the first is that of the given name.
    first = next((w for w in words if len(w) == 1), None)
    words = [w for i, w in enumerate(words) if len(w) > 1 or i == words.index(first)]
    return [SHORT.get(w, SHORT_FORMS.get(w, w)) for w in words]


def names_nobody(words: list[str]) -> bool:
    """One word alone, too short to be more than an abbreviation."""
    return all(len(w) < 5 for w in words) and len(words) < 2


def bound(length: int) -> int:
    """Edits by length: none below 5 letters, 1 below 11, else 2 (a transposition of neighbours is one edit)."""
    return 0 if length < 5 else 1 if length < LONG else 2


def _shortened(c: Column) -> Column:
    """A text, and what is left of it without one of its letters."""
    return F.array_append(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c)))), c)


def _tagged(tag: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(tag, k))


def whole_shards(word: Column) -> Column:
    """The shards of a word for 1 edit: texts that are 1 edit apart give the same text when each loses the right letter, or as they are."""
    return F.array_distinct(_tagged(F.lit("="), _shortened(word)))


def entry_shards(word: Column) -> Column:
    """The shards of an entry for 2 edits: its length with those of its halves, as one of them has 1 edit at most."""
    n, half = F.length(word), F.floor(F.length(word) / 2).cast("int")
    sized = lambda side: F.concat(F.lit(side), n.cast("string"), F.lit(" "))
    return F.array_distinct(F.concat(_tagged(sized("<"), _shortened(word.substr(F.lit(1), half))), _tagged(sized(">"), _shortened(word.substr(half + 1, n)))))


def query_shards(word: Column) -> Column:
    """The shards in which an entry within 2 edits has to lie, for each length from two letters less to two more.

    A half of the entry is a part of the query that is as long, or a letter shorter or longer. It isn't shorter if the entry
    is the shorter word, nor longer if the entry is the longer one; where lengths differ by two, both edits are letters that one of them lacks.
    """
    n = F.length(word)
    none = F.array().cast("array<string>")

    def halves(length: Column) -> Column:
        left = F.floor(length / 2).cast("int")
        right = length - left
        head = lambda k: word.substr(F.lit(1), k)
        tail = lambda k: word.substr(n - k + 1, k)

        def keys(side: str, part, k: Column) -> Column:
            shorter = F.when(length >= n, F.array(part(k - 1))).otherwise(none)
            alike = F.when(F.abs(length - n) < 2, _shortened(part(k))).otherwise(F.array(part(k)))
            longer = F.when(length <= n, _shortened(part(k + 1))).otherwise(none)
            return _tagged(F.concat(F.lit(side), length.cast("string"), F.lit(" ")), F.concat(shorter, alike, longer))

        return F.concat(keys("<", head, left), keys(">", tail, right))

    lengths = F.filter(F.sequence(n - 2, n + 2), lambda k: k >= LONG)
    return F.array_distinct(F.flatten(F.transform(lengths, halves)))


def trie_join(entries: DataFrame, queries: DataFrame, edits: int) -> DataFrame:
    """Pairs of different words, at most ``edits`` (1 or 2) and the bound for the length of ``entry`` apart: query, entry, distance.

    Both have the column ``word``, distinct; queries have 4 letters at least. A shard is what is left of few words when they
    lose a letter, so it is the number of shards that grows with the vocabulary, not their size. One that has much
    work all the same is cut into blocks of entries and of queries.
    """
    n_tasks = tasks(entries.sparkSession)
    word = F.col("word")
    least = 5 if edits == 1 else LONG
    keys = (whole_shards, whole_shards) if edits == 1 else (entry_shards, query_shards)
    rows = entries.where(F.length("word") >= least).select(F.explode(keys[0](word)).alias("shard"), F.lit(0).alias("side"), "word").unionByName(
        queries.where(F.length("word") >= least - edits).select(F.explode(keys[1](word)).alias("shard"), F.lit(1).alias("side"), "word")
    )
    all_of = Window.partitionBy("shard").orderBy("side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = (
        rows.repartition(n_tasks, "shard")
        .select("*", F.min("word").over(all_of).alias("first"), F.max("word").over(all_of).alias("last"), F.sum("side").over(all_of).alias("n_queries"), F.count("*").over(all_of).alias("n"))
        .where("first <> last and n_queries between 1 and n - 1")
        .select("shard", "side", "word", "n_queries", (F.col("n") - F.col("n_queries")).alias("n_entries"))
    )

    def pairs(words: list[str], sides: list[int]) -> list[tuple[str, str, int]]:
        tries: dict[int, Trie] = {}  # by the bound for the length of an entry
        for w, side in zip(words, sides):
            if side == 0:
                tries.setdefault(min(edits, bound(len(w))), Trie()).add(w, w)
        asked = [w for w, side in zip(words, sides) if side == 1]
        return [(q, e, d) for q in asked for k, trie in tries.items() for e, d in trie.accepted(automaton(q, k)) if e != q]

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy: list[pd.DataFrame] = []

        def light() -> Iterator[pd.DataFrame]:
            for b in batches:
                much = (b["n_entries"] * b["n_queries"] > BLOCK_WORDS**2).to_numpy()
                if much.any():
                    heavy.append(b[much])
                    b = b[~much]
                yield b

        out: list[tuple[str, str, int]] = []
        for _, (words, sides) in runs(light(), "shard", ["word", "side"]):
            out += pairs(words, sides)
            if len(out) > 10_000 or heavy:
                yield pd.DataFrame(out, columns=["query", "entry", "distance"])
                for h in heavy:  # rows of shards with much work go through as they are
                    yield pd.DataFrame({"query": h["word"], "entry": h["shard"], "distance": -1 - h["side"], "n_queries": h["n_queries"], "n_entries": h["n_entries"]})
                heavy.clear()
                out = []
        yield pd.DataFrame(out, columns=["query", "entry", "distance"])
        for h in heavy:
            yield pd.DataFrame({"query": h["word"], "entry": h["shard"], "distance": -1 - h["side"], "n_queries": h["n_queries"], "n_entries": h["n_entries"]})

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.reindex(columns=["query", "entry", "distance", "n_queries", "n_entries"])

    found = keep(counted.mapInPandas(lambda b: typed(walk(b)), "query string, entry string, distance int, n_queries long, n_entries long"), "neighbours")
    near = found.where("distance >= 0").select("query", "entry", "distance")
    heavy = found.where("distance < 0")
    if heavy.isEmpty():
        return near.distinct()
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_WORDS).cast("int")
    own = lambda c: F.pmod(F.xxhash64("query"), blocks(c))
    other = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    grid = heavy.where("distance = -1").select("entry", F.lit(0).alias("side"), F.col("query").alias("word"), own("n_entries").alias("i"), other("n_queries").alias("j")).unionByName(
        heavy.where("distance = -2").select("entry", F.lit(1).alias("side"), F.col("query").alias("word"), other("n_entries").alias("i"), own("n_queries").alias("j"))
    )

    def meet(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (words, sides) in runs(batches, "shard", ["word", "side"]):
            yield pd.DataFrame(pairs(words, sides), columns=["query", "entry", "distance"])

    met = grid.select(F.concat_ws("/", "entry", "i", "j").alias("shard"), "side", "word").repartition(n_tasks, "shard").sortWithinPartitions("shard", "side")
    return near.unionByName(met.mapInPandas(meet, "query string, entry string, distance int")).distinct()


@lru_cache(maxsize=50_000)
def automaton(query: str, edits: int) -> Automaton:
    return Automaton(query, edits)


def spellings(counts: DataFrame) -> DataFrame:
    """word -> canon: the spelling that a word stands for, itself if there is none.

    ``counts``: word, n (pages that use it). A word stands for the most frequent neighbour that is more
    frequent than it, or equally frequent and first in the alphabet; two words that are both frequent
    (over FEW pages, and not COMMON times rarer) are different words. The nearest neighbours decide, so that only
    words without one at 1 edit are joined for 2.
    """
    n = counts.select(F.col("word").alias("query"), F.col("n").alias("nq"))
    m = counts.select(F.col("word").alias("entry"), F.col("n").alias("ne"))
    better = (F.col("ne") > F.col("nq")) | ((F.col("ne") == F.col("nq")) & (F.col("entry") < F.col("query")))
    unlike = (F.col("nq") > FEW) & (F.col("nq") * COMMON > F.col("ne"))

    def ranked(near: DataFrame) -> DataFrame:
        """The two best of the nearest neighbours of each word."""
        return (
            near.join(n, "query").join(m, "entry").where(better & ~unlike & ~F.col("query").isin(*GIVEN))
            .groupBy(F.col("query").alias("word"))
            .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ne").alias("n"), F.col("entry").alias("canon"))), asc=False), 1, 2).alias("c"))
        )

    words = counts.select("word")
    one = keep(ranked(trie_join(words, words, 1)), "near")
    two = ranked(trie_join(words, words.where(F.length("word") >= LONG - 2).join(one, "word", "left_anti"), 2))
    found = one.unionByName(two)
    # Equally near to two frequent words it stands for neither; the name around it decides.
    second = F.get("c", F.lit(1))
    torn = F.coalesce((second["d"] == F.col("c")[0]["d"]) & (second["n"] > FEW) & (second["n"] * COMMON >= F.col("c")[0]["n"]), F.lit(False))
    best = found.where(~torn).select("word", F.col("c")[0]["canon"].alias("canon"))
    to = keep(words.join(best, "word", "left").select("word", F.coalesce("canon", "word").alias("canon")), "spellings")
    # A misspelling of a misspelling: each round takes words twice as far, until none moves. Chains end, as each step goes to
    # a more frequent word, or to one before it in the alphabet.
    while True:
        again = to.select(F.col("word").alias("canon"), F.col("canon").alias("next"))
        further = keep(to.join(again, "canon").select("word", F.col("next").alias("canon"), (F.col("next") != F.col("canon")).alias("moved")), "spellings")
        release(to)
        to = further.drop("moved")
        to._kept_at = further._kept_at
        if further.where("moved").isEmpty():
            return to


def joined_words(counts: DataFrame) -> DataFrame:
    """word -> parts, for long words that are two or three known words without a space.

    Of a word that several pages use, each part has to be COMMON times as frequent.
    """
    known = counts.where("length(word) >= 3").select("word", "n")
    cut = lambda df, c, head, tail: df.select(
        "*", F.explode(F.sequence(F.lit(3), F.length(c) - 3)).alias("i")
    ).select("*", F.expr(f"substring({c}, 1, i)").alias(head), F.expr(f"substring({c}, i + 1)").alias(tail)).drop("i")
    long = counts.where("length(word) >= 10").select("word", F.col("n").alias("nw"))
    fits = lambda some, all_: (some >= FEW) & ((F.col("nw") <= FEW) | (all_ >= COMMON * F.col("nw")))
    first = cut(long, "word", "a", "rest").join(known.select(F.col("word").alias("a"), F.col("n").alias("na")), "a")
    # At least one part of two, or two of three, are words that several pages use.
    two = first.join(known.select(F.col("word").alias("rest"), F.col("n").alias("nb")), "rest").where(fits(F.greatest("na", "nb"), F.least("na", "nb"))).select(
        "word", F.array("a", "rest").alias("parts"), (F.col("na") + F.col("nb")).alias("score")
    )
    three = (
        cut(first.where("length(rest) >= 6"), "rest", "b", "c")
        .join(known.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
        .join(known.select(F.col("word").alias("c"), F.col("n").alias("nc")), "c")
        .where(fits(F.array_sort(F.array("na", "nb", "nc"))[1], F.least("na", "nb", "nc")))
        .select("word", F.array("a", "b", "c").alias("parts"), (F.col("na") + F.col("nb") + F.col("nc")).alias("score"))
    )
    return two.unionByName(three).groupBy("word").agg(F.max_by("parts", F.struct(-F.size("parts"), "score", F.array_join("parts", " "))).alias("parts"))


def _abbreviates(short: str, full: str) -> bool:
    """Initial, beginning, or letters of ``full`` in order from its first."""
    if short == full or full.startswith(short):
        return True
    if short in MANY and full in MANY[short]:
        return True
    if len(short) < 2 or short[0] != full[0] or len(short) > len(full) // 2 + 1:
        return False
    letters = iter(full)
    return all(ch in letters for ch in short)


@lru_cache(maxsize=200_000)
def _misspelt(a: str, b: str) -> bool:
    """One edit apart, from four letters on; two from eleven."""
    short = min(len(a), len(b))
    return short >= 4 and abs(len(a) - len(b)) <= 2 and within(a, b, max(1, bound(short)))


def _within(part: tuple[str, ...], whole: tuple[str, ...]) -> bool:
    """Every word of ``part`` stands for another word of ``whole``."""
    left = list(whole)
    for w in sorted(part, key=len, reverse=True):
        hit = next((f for same in (str.__eq__, _abbreviates, _misspelt) for f in left if same(w, f)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def resolve(attributes: list[tuple[str, ...]]) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Sets of words beside one anchor -> the full one each stands for; itself if that isn't one alone."""
    sets = sorted(set(attributes), key=lambda a: (-len(a), [-len(w) for w in a], a))
    full: list[tuple[str, ...]] = []
    to: dict[tuple[str, ...], tuple[str, ...]] = {}
    for a in sets:
        over = [f for f in full if _within(a, f)]
        if len(over) == 1:
            to[a] = over[0]
        else:
            to[a] = a
            if not over:
                full.append(a)
    return to


def link_names(pages: DataFrame) -> DataFrame:
    """page, entity: an id for each page, the same for all pages of one person or organisation.

    ``pages``: page, title, aliases; rows without a page drop out. Pages without a name that has an anchor (one short word alone, initials,
    a nickname with an initial, null, blank) are entities of their own. Repeated rows and null or blank aliases change nothing.
    """
    pages = pages.where("page is not null")
    named = pages.select("page", F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where(
        "name is not null and trim(name) <> ''"
    ).repartition(tasks(pages.sparkSession), "page", "name").distinct()

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [parse(n) for n in batch["name"]]
            batch["words"] = [[] if names_nobody(w) else w for w in words]
            yield batch[batch["words"].map(len) > 0]

    page_type = pages.schema["page"].dataType.simpleString()
    parsed = keep(named.mapInPandas(split, f"page {page_type}, name string, words array<string>"), "names")
    counts = keep(parsed.select("page", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n")), "words")
    parts = joined_words(counts)
    apart = parsed.select("page", "name", F.explode("words").alias("word")).join(parts, "word", "left").select(
        "page", "name", F.explode(F.coalesce("parts", F.array("word"))).alias("word")
    )
    spelt = keep(
        apart.join(spellings(counts), "word", "left").select("page", "name", F.coalesce("canon", "word").alias("word")).distinct(), "spelt"
    )
    # The anchor of a name is the word seen beside the fewest others.
    sets = spelt.groupBy("page", "name").agg(F.array_sort(F.collect_set("word")).alias("words"))
    distinct = sets.select("words").distinct()
    beside = distinct.select(F.explode("words").alias("word"), "words").select("word", F.explode("words").alias("other")).where(
        "other <> word and length(other) > 1"
    )
    spread = beside.groupBy("word").agg(F.countDistinct("other").alias("spread"))
    given, form = F.col("word").isin(*GIVEN), F.col("word").isin(*SHORT_FORMS.values())
    of = lambda n: F.size(F.filter("words", lambda w: F.length(w) >= n))
    # Names without a long word of their own: a short surname, else two given names beside each other.
    kind = (
        F.when((F.length("word") >= 5) & ~given & ~form, 0)
        .when((F.length("word") >= 3) & ~given & ~form & ~F.col("word").isin(*MANY, *BEGUN) & (of(2) > 1), 1)
        .when((F.length("word") >= 3) & given & (of(3) > 1), 2)
    )
    anchor = (
        distinct.select("words", F.explode("words").alias("word")).withColumn("kind", kind).where("kind is not null")
        .join(spread, "word", "left")
        .groupBy("words")
        .agg(F.min_by("word", F.struct("kind", F.coalesce("spread", F.lit(0)), -F.length("word"), F.col("word"))).alias("anchor"))
        .select("words", "anchor", F.array_except("words", F.array("anchor")).alias("attributes"))
    )
    # Initials beside a full word are middle names.
    longer = F.filter("attributes", lambda w: F.length(w) > 1)
    anchor = anchor.select("words", "anchor", F.when(F.size(longer) > 0, longer).otherwise(F.col("attributes")).alias("attributes"))
    anchor = keep(anchor, "anchors")

    def entities(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for a, (sets_,) in runs(batches, "anchor", ["attributes"]):
            given_sets = [tuple(x) for x in sets_]
            to = resolve(given_sets)
            out += [(a, list(s), " ".join((a, *to[s]))) for s in given_sets]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["anchor", "attributes", "entity"])
                out = []
        yield pd.DataFrame(out, columns=["anchor", "attributes", "entity"])

    resolved = (
        anchor.select("anchor", "attributes").distinct()
        .repartition(tasks(pages.sparkSession), "anchor").sortWithinPartitions("anchor")
        .mapInPandas(entities, "anchor string, attributes array<string>, entity string")
    )
    of_page = (
        sets.join(anchor, "words").join(resolved, ["anchor", "attributes"]).select("page", "entity").distinct()
    )
    of_page = keep(of_page, "entities")
    release(parsed, counts, spelt, anchor)
    # Pages with several names tie these together.
    first = of_page.groupBy("page").agg(F.min("entity").alias("first"))
    edges = of_page.join(first, "page").where("entity <> first").select(F.col("first").alias("a"), F.col("entity").alias("b")).distinct()
    roots = components(edges)
    named_pages = first.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("page", F.coalesce("root", "first").alias("entity"))
    return pages.select("page").distinct().join(named_pages, "page", "left").select("page", F.coalesce("entity", F.concat(F.lit("page "), F.col("page").cast("string"))).alias("entity"))


def entity_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of pages of one entity, page_a < page_b."""
    a = linked.select("entity", F.col("page").alias("page_a"))
    b = linked.select("entity", F.col("page").alias("page_b"))
    return a.join(b, "entity").where("page_a < page_b").select("page_a", "page_b")
