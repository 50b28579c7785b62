"""Texts cut off by field limits or in transfer (problem 10).

The method: a trie of the corpus vocabulary, in shards by prefix and blocks by hash. A text whose last word is unknown and a
proper prefix of known words was cut inside a word. Length is the second kind of evidence: a length, in
characters or bytes, at which the ends of several different texts show a cut, is the limit of a field. What the end of a
text is (prose, item, table row, signature, closing note) and whether lines that begin like the last one
usually end with a full stop come from counts over the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.frames import runs
from corpusmill.functions.text import strip
from corpusmill.llm.scans import code
from corpusmill.llm.tries import Trie
from corpusmill.session import keep, release, tasks

#: Support: times that a word, an opening, a whole last line or a length has to occur before its share decides.
KNOWN, OPENINGS, CLOSINGS, LIMIT_TEXTS = 3, 4, 2, 5
#: How much rarer than a word its beginning is that was only ever cut or misspelt; words of one trie.
RARE, BLOCK_WORDS = 10_000, 4_096
#: Distinct entries that a task counts before it passes them on; last lines that are sent to every task at once.
FLUSH, SENT_LINES = 200_000, 100_000

MARK = re.compile(r"(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|[\[(<]\s*(?:truncated|cut|cut off|gekürzt|tronqué|truncado|continued|more|snip)\s*[\])>]|…|\.{3,})\s*$", re.I)
DONE = re.compile(r"[.!?:;。！？][\"'”’»)\]*_]*$")
ITEM = re.compile(r"^\s*(?:[-•*+–]|\d{1,3}[.)])\s")
HEADING = re.compile(r"^\s*(?:#{1,6}\s|Slide \d+:|\d{1,2}\.\s\S{1,40}(?:\s\S{1,20}){0,4}$)")
LETTERS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
URL = re.compile(r"https?://\S+$|www\.\S+$")
#: Where a line or a sentence begins.
BEGIN = re.compile(r"[\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]+|(?<=[.!?…])\s+")


def clean(token: str) -> str:
    """A token without punctuation around it, in lower case; '' if it isn't a word."""
    t = token.strip(".,;:!?\"'“”‘’«»()[]{}*_`|#…<>=").lower()
    return t if LETTERS.fullmatch(t) else ""


def mark_of(body: str) -> re.Match | None:
    """The mark of a cut at the end of a text, which is looked for only where one may begin."""
    last = body[-1]
    if last in "])>":
        begin = max(map(body.rfind, "[(<"))
        return MARK.match(body, begin) if begin >= 0 else None
    if last not in "….":
        return None
    return MARK.match(body, len(body) - 1 if last == "…" else len(body.rstrip(".")))


def ending(text: str) -> dict | None:
    """What the end of a text looks like; None for blank texts."""
    body = text.rstrip()
    if not body:
        return None
    mark = mark_of(body)
    rest = body[: mark.start()].rstrip() if mark else body
    lines = rest.splitlines() or [""]
    last = lines[-1]
    words = last.split()
    before = next((ln.rstrip() for ln in reversed(lines[:-1]) if ln.strip()), "")
    if body.endswith("\ufffd"):
        kind = "broken character"
    elif body.endswith("```"):
        kind = "code"
    elif "```" in rest and sum(ln.lstrip().startswith("```") for ln in lines) % 2:
        kind = "open code"
    elif last.lstrip().startswith("|"):
        kind = "row" if last.rstrip().endswith("|") else "open row"
    elif URL.search(last):
        kind = "link"
    elif last.rfind("[[") > last.rfind("]]"):
        kind = "open link"
    elif ITEM.match(last) and not HEADING.match(last):
        kind = "item"
    elif HEADING.match(last):
        kind = "heading"
    elif before.endswith(",") and len(before.split()) <= 5 and len(words) <= 5:
        kind = "signature"
    else:
        kind = "prose"
    token = words[-1] if words else ""
    return {
        "mark": (mark.group().strip() if mark else ""),
        "kind": kind,
        "done": bool(DONE.search(token)),
        "token": clean(token) if token[-1:].isalpha() else "",
        "opening": " ".join(words[:2]).lower(),
        "n_words": len(words),
        # a short paragraph of its own may be a closing note
        "line": " ".join(words).lower() if len(words) <= 6 and (len(lines) < 2 or not lines[-2].strip()) else "",
        "before": before.strip(),
    }


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each ending, and counts of words and openings."""
    names = ["what", "doc_id", "source", "length", "n_bytes", "text_hash", "mark", "kind", "done", "token", "opening", "line", "before", "n_words", "n", "m"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        openings: Counter[str] = Counter()
        finished: Counter[str] = Counter()

        def flush() -> list[tuple]:
            clean_words: Counter[str] = Counter()
            clean_ends: Counter[str] = Counter()
            for w, n in words.items():
                if c := clean(w):
                    clean_words[c] += n
                    if w[-1:] in ".!?;:":
                        clean_ends[c] += n
            for w, n in ends.items():
                if (c := clean(w)) and w[-1:] not in ".!?;:":
                    clean_ends[c] += n
            rows = [("word", None, None, None, None, None, None, None, None, w, None, None, None, None, n, clean_ends[w]) for w, n in clean_words.items()]
            rows += [("opening", None, None, None, None, None, None, None, None, None, o, None, None, None, n, finished[o]) for o, n in openings.items()]
            for c in (words, ends, openings, finished):
                c.clear()
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows = []
            for doc_id, text, source, text_hash in zip(*(batch.column(i).to_pylist() for i in range(4))):
                e = ending(text) if text else None
                if e is None:
                    continue
                rows.append(("end", doc_id, source, len(text), len(text.encode("utf-8", "surrogatepass")), text_hash, e["mark"], e["kind"], e["done"], e["token"], e["opening"], e["line"], code(e["before"]) if e["line"] else None, e["n_words"], 0, 0))
                tokens = text.split()
                words.update(tokens[:-1])  # the last word may be cut
                lines = text.splitlines()
                for i, line in enumerate(lines):
                    parts = line.split()
                    if not parts:
                        continue
                    if i < len(lines) - 1:
                        ends[parts[-1]] += 1
                    if line[0] not in "-•*|#`+" and len(parts) > 2:
                        key = " ".join(parts[:2]).lower()
                        openings[key] += 1
                        if DONE.search(parts[-1]):
                            finished[key] += 1
            if rows:
                yield batch_of(rows)
            if len(words) + len(openings) > FLUSH:
                yield batch_of(flush())
        if rows := flush():
            yield batch_of(rows)

    schema = "what string, doc_id long, source string, length long, n_bytes long, text_hash long, mark string, kind string, done boolean, token string, opening string, line string, before long, n_words int, n long, m long"
    return docs.select(
        F.col("doc_id").cast("long"), "text", strip(F.col("source")).alias("source"), F.xxhash64("text").alias("text_hash")
    ).mapInArrow(run, schema)


def cut_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The tokens (column ``token``, distinct) that are a proper prefix of known words and unknown beside them.

    ``vocabulary``: token, n. A word is known that occurs KNOWN times; beside a word it begins, a token is unknown
    unless it does, too, and is not RARE times rarer. Shards are the words that share their first two
    letters, in blocks by hash of BLOCK_WORDS words; each block is one trie, and a token is walked down those of its shard.
    """
    known = vocabulary.where(F.col("n") >= KNOWN)
    head = lambda c: F.substring(c, 1, 2)
    # A token of one letter meets the most frequent word of each two letters that it begins.
    short = known.where("length(token) > 1").groupBy(head("token").alias("head")).agg(F.max("n").alias("n")).select(F.substring("head", 1, 1).alias("shard"), F.col("head").alias("token"), "n")
    entries = known.select(head("token").alias("shard"), "token", "n").unionByName(short)
    blocks = entries.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_WORDS).cast("int").alias("blocks"))
    side = lambda df, s, n, block: df.join(blocks, "shard").select("shard", block.alias("block"), F.lit(s).alias("side"), "token", n)
    asked = tokens.where("token <> ''").select(head("token").alias("shard"), "token")
    rows = side(entries, 0, F.col("n"), F.pmod(F.xxhash64("token"), "blocks").cast("int")).unionByName(
        side(asked, 1, F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, (words, sides, counts) in runs(batches, "key", ["token", "side", "n"]):
            if 1 not in sides:
                continue
            trie = Trie()
            for w, side, n in zip(words, sides, counts):
                if side == 0:
                    trie.add(w, (w, n))
            out = []
            for t in (w for w, side in zip(words, sides) if side == 1):
                node = trie.find(t)
                most = max((n for w, n in node.below() if w != t), default=0) if node is not None else 0
                if most:
                    out.append((t, most))
            yield pd.DataFrame(out, columns=["token", "most"])

    longer = (
        rows.select(F.concat_ws("/", "shard", "block").alias("key"), "side", "token", "n")
        .repartition(tasks(tokens.sparkSession), "key").sortWithinPartitions("key", "side")
        .mapInPandas(walk, "token string, most long").groupBy("token").agg(F.max("most").alias("most"))
    )
    own = vocabulary.select("token", "n")
    return longer.join(own, "token", "left").where((F.coalesce("n", F.lit(0)) < KNOWN) | (F.col("n") * RARE < F.col("most"))).select("token")


def lookout(known: set[str]) -> ahocorasick.Automaton:
    """Finds texts that have one of the ``known`` lines anywhere, once white space is single blanks."""
    found = ahocorasick.Automaton()
    for line in known:
        found.add_word(line, True)
    found.make_automaton()
    return found


def going_on(text: str, lines: dict[str, set[int]], known: set[str], anywhere: ahocorasick.Automaton) -> set[str]:
    """Those of the ``known`` lines (not none) with which a line or sentence begins that goes on; ``lines``: first character -> lengths."""
    found: set[str] = set()
    lower = text.lower()
    if next(anywhere.iter(" ".join(lower.split())), None) is None:
        return found
    for piece in BEGIN.split(lower):
        bare = piece.lstrip()
        for p in {bare, bare.lstrip("-–•*+#>|\"'“„«( \t")}:
            if lengths := lines.get(p[:1]):
                p = " ".join(p.split())
                found.update(p[:n] for n in lengths if len(p) > n and p[:n] in known and any(ch.isalnum() for ch in p[n:]))
    return found


def closing_notes(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """line: the short last paragraphs that are closing notes, of those that a mark of a cut follows somewhere.

    ``ends``: text_hash, line, before (a hash of the line before it), mark and kind. A closing note ends at least CLOSINGS
    different texts, after different lines, and over twice as many as have a line or sentence that begins like
    it and goes on: what many sentences begin with was cut.
    """
    shared = (
        ends.where("line <> ''").groupBy("line")
        .agg(F.countDistinct("text_hash").alias("n_texts"), F.countDistinct("before").alias("n_before"), F.max((F.col("mark") != "") & (F.col("kind") == "prose")).alias("marked"))
        .where(F.col("marked") & (F.least("n_texts", "n_before") >= CLOSINGS)).select("line", "n_texts")
    )
    shared = keep(shared, "closings")
    context = docs.sparkSession.sparkContext
    texts = docs.where("text <> ''").select("text", F.xxhash64("text").alias("text_hash"))

    def hits(sent) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: set[str] = sent.value
            sizes: defaultdict[str, set[int]] = defaultdict(set)
            for line in known:
                sizes[line[0]].add(len(line))
            anywhere = lookout(known)
            for batch in batches:
                rows = [(line, h) for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for line in going_on(text, sizes, known, anywhere)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["line", "text_hash"])

        return texts.mapInArrow(run, "line string, text_hash long")

    # As many passes as it takes to send all lines.
    n_passes = math.ceil(shared.count() / SENT_LINES)
    longer = None
    for i in range(n_passes):
        part = shared.where(F.pmod(F.xxhash64("line"), F.lit(n_passes)) == i)
        if not (lines := {r["line"] for r in part.select("line").collect()}):
            continue
        found = hits(context.broadcast(lines))
        longer = found if longer is None else longer.unionByName(found)
    if longer is None:
        return shared.select("line")
    counts = longer.groupBy("line").agg(F.countDistinct("text_hash").alias("n_longer"))
    return shared.join(counts, "line", "left").where(F.coalesce("n_longer", F.lit(0)) * 2 < F.col("n_texts")).select("line")


def field_limits(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lengths, and the numbers of bytes, at which texts are cut: (length, n_cut) and (n_bytes, n_cut).

    ``ends``: length, n_bytes, text_hash and reason (null unless the end of the text itself shows a cut). A limit
    has at least LIMIT_TEXTS different texts cut at exactly this size, and they are three quarters of all texts of
    this size. A cut counts for the measure in which more texts share its size: a limit in bytes cuts many
    texts at lengths close to each other, and these are no limits.
    """
    texts = ends.groupBy("text_hash", "length", "n_bytes").agg(F.max(F.col("reason").isNotNull()).alias("cut"))
    sizes = {}
    for size in ("length", "n_bytes"):
        sizes[size] = texts.groupBy(size).agg(F.count("*").alias(f"all_{size}"), F.count_if("cut").alias(f"cut_{size}"))
    cut = texts.where("cut").join(sizes["length"], "length").join(sizes["n_bytes"], "n_bytes")

    def limits(size: str, other: str) -> DataFrame:
        own = cut.where(F.col(f"cut_{size}") >= F.col(f"cut_{other}")).groupBy(size).agg(F.count("*").alias("n_cut"))
        return own.where(F.col("n_cut") >= LIMIT_TEXTS).join(sizes[size], size).where(F.col(f"cut_{size}") * 4 >= F.col(f"all_{size}") * 3).select(size, "n_cut")

    return limits("length", "n_bytes"), limits("n_bytes", "length")


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id, source, reason of every text that was cut off: 'mark', 'word', 'sentence' or 'limit'.

    Null, empty and blank texts are not cut off. ``source`` is without white space around it; null stays
    null. Equal texts count once as evidence of a limit, and each comes out.
    """
    seen = keep(_scan(docs), "endings")
    ends = seen.where("what = 'end'").drop("what", "n", "m")
    # Counts by word, by the first two words of a line and by its first word, all in one table.
    first = lambda c: F.element_at(F.split(c, " "), 1)
    entry = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    counted = seen.where("what in ('word', 'opening')").select(
        F.explode(F.when(F.col("what") == "word", F.array(entry("token", F.col("token")))).otherwise(F.array(entry("opening", F.col("opening")), entry("first", first("opening"))))).alias("e"), "n", "m"
    )
    counts = keep(counted.groupBy("e.what", "e.key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    vocabulary = counts.where("what = 'token'").select(F.col("key").alias("token"), "n")
    doubtful = keep(
        ends.where("mark <> '' or kind = 'broken character' or (not done and kind not in ('code', 'row', 'link'))").withColumn("row", F.monotonically_increasing_id()), "doubtful"
    )
    inside = cut_words(doubtful.select("token").distinct(), vocabulary).select(F.lit("token").alias("what"), F.col("token").alias("key"), F.lit(True).alias("flag"))
    closings = closing_notes(docs, ends).select(F.lit("line").alias("what"), F.col("line").alias("key"), F.lit(True).alias("flag"))
    # Only what an ending has is looked up, so that no blank key gathers rows.
    asked = doubtful.select(
        "row", F.explode(F.filter(F.array(*[entry(c, F.col(c)) for c in ("token", "opening", "line")], entry("first", first("opening"))), lambda e: e["key"] != "")).alias("e")
    ).select("row", "e.*")
    known = asked.join(counts, ["what", "key"], "left").join(inside.unionByName(closings), ["what", "key"], "left")
    of = lambda what, c, to: F.max(F.when(F.col("what") == what, F.col(c))).alias(to)
    facts = known.groupBy("row").agg(
        of("token", "n", "n_word"), of("token", "m", "at_end"), of("token", "flag", "inside"), of("opening", "n", "n_open"), of("opening", "m", "n_done"),
        of("first", "n", "n_first"), of("first", "m", "n_first_done"), of("line", "flag", "closing"),
    )
    joined = doubtful.join(facts, "row", "left")
    inside_word = F.coalesce("inside", F.lit(False))
    often = F.coalesce("n_open", F.lit(0)) >= OPENINGS
    prose_like = (
        F.when(often, F.col("n_done") * 2 >= F.col("n_open"))
        .when(F.coalesce("n_first", F.lit(0)) >= OPENINGS, F.col("n_first_done") * 2 >= F.col("n_first"))
        .otherwise(F.col("n_words") >= 6)
    )
    never_last = (F.coalesce("n_word", F.lit(0)) >= 20) & (F.col("at_end") * 200 < F.col("n_word"))
    bracket = F.col("mark").rlike(r"^[\[(<]")
    reason = (
        F.when(bracket, "mark")
        .when((F.col("mark") != "") & F.col("closing").isNotNull() & (F.col("kind") == "prose"), None)
        .when(F.col("mark") != "", "mark")
        .when(F.col("kind") == "broken character", "word")
        .when(F.col("kind").isin("open row", "open link"), "sentence")
        .when(inside_word & (F.col("kind").isin("prose", "item", "open code")), "word")
        .when((F.col("kind") == "prose") & prose_like, "sentence")
        .when((F.col("kind") == "item") & never_last, "sentence")
    )
    shown = keep(joined.select("doc_id", "source", "length", "n_bytes", "text_hash", "kind", "mark", inside_word.alias("inside"), reason.alias("reason")).distinct(), "shown")
    # What the ends show tells the limits of fields, in characters or in bytes; other texts that end there
    # without having been finished were cut by the limit, too.
    all_ = ends.select("doc_id", "length", "n_bytes", "text_hash").join(
        shown.where("reason <> 'mark'").select("doc_id", "reason").distinct(), "doc_id", "left"
    )
    limits = [found.select(size, F.lit(True).alias(f"at_{size}")) for size, found in zip(("length", "n_bytes"), field_limits(all_))]
    at_limit = F.coalesce("at_length", F.lit(False)) | F.coalesce("at_n_bytes", F.lit(False))
    found = shown.join(limits[0], "length", "left").join(limits[1], "n_bytes", "left")
    release(doubtful, counts)
    return found.select("doc_id", "source", F.coalesce("reason", F.when(at_limit & (F.col("mark") == ""), "limit")).alias("reason")).where("reason is not null").distinct()


def truncation_report(docs: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, share: of the texts that aren't blank, how many of each source were cut off."""
    all_ = docs.where(strip(F.col("text")) != "").groupBy(strip(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"))
    cut = truncated(docs).groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_cut"))
    return all_.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_docs"), 6).alias("share")
    )
