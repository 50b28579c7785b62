"""Noise in text from scanned pages (problem 4).

The method: the lines of a chunk are a sequence that a hidden Markov model labels as header (the running
title), page (a page's number alone), body, or break (the last line of a paragraph). What it sees of a line
is its layout: whether the document repeats it, where it stands, how full it is, how it begins and ends,
what numbers it has. The model is fitted here, on counts over all lines of all scanned documents whose label
is beyond doubt. Paragraphs are put together from the labels, divided words are joined and misread
characters set right by the corpus' own vocabulary.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import keep, tasks

STATES = ("header", "page", "body", "break")
#: What scanners read for what was printed.
MISREAD = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("†", "t"), ("|", "l"), ("ii", "u"), ("rn", "m"), ("vv", "w"),
    ("cl", "d"), ("l", "t"), ("l", "i"), ("i", "l"), ("c", "e"), ("b", "h"), ("h", "b"), ("e", "c"), ("t", "l"), ("u", "n"), ("n", "u"), ("f", "t"), ("3", "e"), ("4", "a"),
    ("in", "m"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("li", "h"),
)
#: Characters that are taken for each other, as one spelling of all of them.
_ROUGH = str.maketrans({"0": "o", "1": "l", "i": "l", "t": "l", "†": "l", "|": "l", "f": "l", "5": "s", "c": "e", "b": "h", "8": "h", "6": "h", "n": "ll", "u": "ll", "m": "rll", "w": "vv", "d": "el"})
HYPHENS = "-‐‑¬­"
#: Words that a task counts before it passes them on, and entries of a table that may be sent to every task.
FLUSH, MAX_SENT = 200_000, 400_000
#: Times that a word has to occur to be known, where letters alone don't tell that another one was misread.
KNOWN = 5
#: How much rarer than the word that was meant a slip of the pen is outside PDFs.
SLIPS = 10_000

_FORM = re.compile(r"^\s*(?:[-–—~•|\[(]*\s*)(?:(?:page|seite|página|pagina|pág\.|pag\.|pg\.?|p\.|s\.|blatt|sheet|folio)\s*[\dlIoOS]{1,9}(?:\s*(?:of|von|de|sur|/|\|)\s*[\dlIoOS]{1,9})?|[\dlIoOS]{1,9}\s*(?:/|of|von|sur)\s*[\dlIoOS]{1,9}|[-–—~•|\[(]+\s*[\dlIoOS]{1,9}\s*[-–—~•|\])]+)\s*$", re.I)
_BARE = re.compile(r"^\s*\d{1,9}\s*$")
_ROMAN = re.compile(r"^\s*(?=[ivxl])x{0,4}(?:ix|iv|v?i{0,3})\s*$|^\s*(?=[IVXL])X{0,4}(?:IX|IV|V?I{0,3})\s*$")
_TRAILING = re.compile(r"(?:\s{2,}|\t|\s[|·•–—-]\s*)(?:(?:page|seite|página|pg\.?|p\.|s\.)\s*)?([\dlIoOS]{1,9})\s*$|^\s*(?:(?:page|seite|página|pg\.?|p\.|s\.)\s*)?(\d{1,9})(?:\s{2,}|\t|\s[|·•–—-]\s)\S", re.I)
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?:;…][\"'”’»)\]]*$")
_LIST = re.compile(r"^\s*(?:[-•*+–]|\d{1,3}[.)])\s|^\s*\|")
#: Forms that no word is written in: a digit, dagger or bar between letters; vv hardly ever is.
_IMPOSSIBLE, _UNLIKELY = r"\p{L}[0-9†|]+\p{L}", r"\p{L}vv\p{L}"
_EDGE = ".,;:!?\"'“”‘’«»()[]{}*_`#…<>="


def is_pdf(c):
    return F.lower(F.trim(c)).endswith(".pdf")


def skeleton(line: str) -> str:
    """A line as scanning leaves it recognisable: case, spaces, numbers and misread characters set aside."""
    t = re.sub(r"[^\w†|]+", " ", line.lower())
    t = re.sub(r"\b[\dloisxv]{1,4}\b", " ", t)
    return re.sub(r"[\s\d]+", "", t.translate(_ROUGH))


def code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=FLUSH)
def clean(token: str) -> str:
    t = token.strip(_EDGE).lower()
    return t if any(ch.isalpha() for ch in t) else ""


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def squeeze(text: str) -> str:
    return " ".join(text.split()).lower()


def headings(path: str | None) -> set[str]:
    return {squeeze(path), *(squeeze(p) for p in path.split(">"))} if path else set()


def divisions(lines: list[str], most: int | None = None) -> Iterator[tuple[int, int, str, str, str]]:
    """Lines that end inside a word: line, the line that may go on, word joined, word with hyphen, the hyphen.

    It goes on behind any number of titles and page numbers; ``most``: lines to look at, once these are left out.
    """
    for i, line in enumerate(lines):
        bare = line.rstrip()
        if len(bare) < 2 or bare[-1] not in HYPHENS or not bare[-2].isalpha():
            continue
        head = bare.split()[-1]
        seen = 0
        for j in range(i + 1, len(lines)):
            if not lines[j].strip():
                continue
            seen += 1
            first = lines[j].split()[0]
            if first[0].isalpha() and first[0].islower():
                joined, hyphened = clean(head[:-1] + first), clean(head[:-1] + "-" + first)
                if joined:
                    yield i, j, joined, hyphened, bare[-1]
                break
            if seen == most:
                break


def _wrapped(lines: list[str]) -> tuple[int, int]:
    """Of the lines that another one follows without a gap: how many end inside a sentence, and all."""
    inside = all_ = 0
    for a, b in zip(lines, lines[1:]):
        if a.strip() and b.strip() and not _LIST.match(a) and not _LIST.match(b):
            all_ += 1
            inside += 30 <= len(a) <= 110 and not _STOP.search(a.rstrip())  # shorter ones are headings
    return inside, all_


def _first_pass(chunks: DataFrame) -> DataFrame:
    """Counts of words, and of each PDF chunk its lines as codes, its wrapped lines and divided words."""
    names = ["what", "text", "hyphened", "n", "m", "chunk_id", "line", "doc", "skeleton"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()  # of PDFs
        native: Counter[str] = Counter()  # of all others
        pairs: set[tuple[str, str]] = set()

        def flush() -> list[tuple]:
            total: Counter[str] = Counter()
            plain: Counter[str] = Counter()
            for source, to in ((words, (total,)), (native, (total, plain))):
                for w, n in source.items():
                    if c := clean(w):
                        for t in to:
                            t[c] += n
            rows = [("word", w, None, n, plain[w], None, None, None, None) for w, n in total.items()]
            rows += [("pair", a, b, 1, 0, None, None, None, None) for a, b in pairs]
            words.clear(), native.clear(), pairs.clear()
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for chunk_id, doc, text, pdf in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not text:
                    continue
                (words if pdf else native).update(text.split())
                if not pdf:
                    continue
                lines = lines_of(text)
                inside, all_ = _wrapped(lines)
                key = code(doc or "")
                rows.append(("chunk", None, None, inside, all_, chunk_id, None, key, None))
                for _, _, joined, hyphened, _ in divisions(lines):
                    pairs.add((joined, hyphened))
                for i, line in enumerate(lines):
                    bare = line.strip()
                    if bare and not _LIST.match(line) and not _STOP.search(bare) and not bare[0].islower() and (s := skeleton(bare)):
                        rows.append(("line", None, None, 0, 0, chunk_id, i, key, code(s)))
            if rows:
                yield batch_of(rows)
            if len(words) + len(native) > FLUSH or len(pairs) > FLUSH:
                yield batch_of(flush())
        if rows := flush():
            yield batch_of(rows)

    schema = "what string, text string, hyphened string, n long, m long, chunk_id long, line int, doc long, skeleton long"
    return chunks.select(F.col("chunk_id").cast("long"), "doc_key", "text", F.coalesce(is_pdf(F.col("doc_key")), F.lit(False)).alias("pdf")).mapInArrow(run, schema)


#: Misreadings of which what was read isn't a letter; those that letters alone hardly give by chance.
_ODD, _SURE = [p for p in MISREAD if not p[0].isalpha()], MISREAD[:12]


def _set_right(word: str, pairs: Iterable[tuple[str, str]]) -> set[str]:
    return {word[:i] + b + word[i + len(a) :] for a, b in pairs if a in word for i in range(len(word)) if word.startswith(a, i)}


def readings(word: str) -> set[str]:
    """What may have been printed where ``word`` was read: one or two characters set right.

    What isn't a letter has to be among them, so of words with more than two such characters there is no reading.
    """
    odd = sum(not ch.isalpha() and ch not in "-'’" for ch in word)
    if odd > 2:
        return set()
    if odd:
        once = _set_right(word, _ODD)
        twice = {r for w in once for r in _set_right(w, MISREAD if odd == 1 else _ODD)}
    else:
        once = _set_right(word, MISREAD)
        twice = {r for w in once for r in _set_right(w, _SURE)} if len(word) > 7 else set()
    return {w for w in once | twice if len(w) >= 3 and all(ch.isalpha() or ch in "-'’" for ch in w)}


def misread_words(vocabulary: DataFrame) -> DataFrame:
    """word, meant: words with a known reading that is 20 times as frequent at least, and SLIPS times outside PDFs.

    Outside PDFs nothing is misread, but people make slips, more of them the larger a corpus is. ``vocabulary``: word, n, n_native. Where the form itself is none that words have, its most frequent reading that the corpus has
    is meant, however rare it is: names don't become frequent as a corpus grows. With vv it has to be the more frequent one.
    """

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, m, r) for w, n, m in zip(b["word"], b["n"], b["n_native"]) if len(w) >= 3 for r in readings(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "n_native", "meant"])

    # Of words that are frequent themselves only those with a still more frequent reading are left by the join.
    most = vocabulary.agg(F.max("n_native")).first()[0] or 0
    doubtful = vocabulary.where(F.col("n_native") * SLIPS <= most).select("word", "n", "n_native")
    return (
        doubtful.repartition(tasks(vocabulary.sparkSession), "word").mapInPandas(spread, "word string, n long, n_native long, meant string")
        .join(vocabulary.select(F.col("word").alias("meant"), F.col("n").alias("n_meant"), F.col("n_native").alias("m_meant")), "meant")
        .where(F.col("n_native") * SLIPS <= F.col("m_meant"))
        .where(
            F.col("word").rlike(_IMPOSSIBLE) | (F.col("word").rlike(_UNLIKELY) & (F.col("n_meant") > F.col("n")))
            | ((F.col("n_meant") >= KNOWN) & (F.col("n_meant") >= 20 * F.col("n")))
        )
        .groupBy("word").agg(F.max_by("meant", F.struct("n_meant", "meant")).alias("meant"))
    )


def divided_words(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """joined, hyphened, divided: whether the word is written without the hyphen, more often than with it.

    Null where the corpus knows neither.
    """
    n = lambda c, to: vocabulary.select(F.col("word").alias(c), F.col("n").alias(to))
    both = pairs.join(n("joined", "n_joined"), "joined", "left").join(n("hyphened", "n_hyphened"), "hyphened", "left").fillna(0, ["n_joined", "n_hyphened"])
    return both.select("joined", "hyphened", F.when((F.col("n_joined") > 0) | (F.col("n_hyphened") > 0), F.col("n_joined") > F.col("n_hyphened")).alias("divided"))


class Layout:
    """Viterbi over the lines of a chunk."""

    def __init__(self, seen: dict[tuple[str, int, str], int], moves: dict[tuple[str, str], int]) -> None:
        self.seen: list[dict[tuple[str, str], float]] = []
        for f in range(6):
            totals = {s: sum(n for (t, k, _), n in seen.items() if t == s and k == f) for s in STATES}
            kinds = {v for (_, k, v) in seen if k == f} | {"?"}
            self.seen.append({(s, v): math.log((seen.get((s, f, v), 0) + 0.5) / (totals[s] + 0.5 * len(kinds))) for s in STATES for v in kinds})
        out = {s: sum(moves.get((s, t), 0) for t in STATES) for s in (*STATES, "start")}
        self.moves = {(s, t): math.log((moves.get((s, t), 0) + 0.5) / (out[s] + 0.5 * len(STATES))) for s in (*STATES, "start") for t in STATES}
        self.into = [[self.moves[(s, t)] for s in STATES] for t in STATES]
        self.cache: dict[tuple[str, ...], list[float]] = {}

    def emission(self, features: tuple[str, ...]) -> list[float]:
        found = self.cache.get(features)
        if found is None:
            found = self.cache[features] = [sum(self.seen[f].get((s, v), self.seen[f][(s, "?")]) for f, v in enumerate(features)) for s in STATES]
        return found

    def label(self, lines: list[tuple[str, ...]]) -> list[str]:
        if not lines:
            return []
        n = range(len(STATES))
        best = [self.moves[("start", s)] + e for s, e in zip(STATES, self.emission(lines[0]))]
        ways: list[list[int]] = []
        for features in lines[1:]:
            came, new = [], []
            for t, e in zip(n, self.emission(features)):
                scores = [b + m for b, m in zip(best, self.into[t])]
                at = scores.index(max(scores))
                came.append(at)
                new.append(scores[at] + e)
            ways.append(came)
            best = new
        at = best.index(max(best))
        out = [STATES[at]]
        for came in reversed(ways):
            at = came[at]
            out.append(STATES[at])
        return out[::-1]


def number_kind(line: str, alone: bool) -> str:
    if not _DIGIT.search(line) and len(line.strip()) > 8:
        return "none"
    if len(line) <= 60 and _FORM.match(line):
        return "form"
    if _BARE.match(line):
        return "bare" if alone else "list"
    if _ROMAN.match(line):
        return "roman" if alone else "list"
    return "trailing" if _TRAILING.search(line) else "none"


def features_of(lines: list[str], repeats: dict[int, int], path: str | None) -> list[tuple[int, tuple[str, ...]]]:
    """Of each line that isn't blank: its number and what the model sees of it."""
    at = [i for i, ln in enumerate(lines) if ln.strip()]
    lengths = sorted(len(lines[i]) for i in at)
    width = lengths[int(0.9 * (len(lengths) - 1))] if lengths else 0
    titles = headings(path)
    out = []
    numeric = [bool(_BARE.match(lines[i]) or _ROMAN.match(lines[i])) for i in at]
    for k, i in enumerate(at):
        ln = lines[i].rstrip()
        above, below = k > 0 and numeric[k - 1] and at[k - 1] == i - 1, k + 1 < len(at) and numeric[k + 1] and at[k + 1] == i + 1
        alone = not (above or below)
        n = repeats.get(i, 0)
        heading = bool(titles) and squeeze(ln) in titles
        out.append((
            i,
            (
                "heading" if heading else "none" if n < 2 else "twice" if n == 2 else "often",
                "top" if k == 0 else "bottom" if k == len(at) - 1 else "inner",
                "short" if len(ln) < 0.6 * width else "full",
                "stop" if _STOP.search(ln) else "hyphen" if ln[-1] in HYPHENS else "open",
                number_kind(ln, alone),
                ("lower" if ln.strip()[0].islower() else "digit" if ln.strip()[0].isdigit() else "upper") + ("|gap" if i + 1 >= len(lines) or not lines[i + 1].strip() else ""),
            ),
        ))
    return out


def seed(features: tuple[str, ...]) -> str | None:
    """The label of a line that is beyond doubt."""
    repeated, where, full, end, number, start = features
    if number in ("form",) or (number in ("bare", "roman") and where != "inner"):
        return "page"
    if repeated in ("often", "twice") and end == "open" and start.startswith(("upper", "digit")):
        return "header"
    if repeated == "none" and number == "none" and (start.startswith("lower") or end in ("stop", "hyphen") or full == "full"):
        return "break" if start.endswith("gap") else "body"
    if repeated == "heading":
        return "body"
    return None


def unpack(repeats: Iterable[int] | None) -> dict[int, int]:
    """Line -> how often the document has it, from integers of which the upper bits are the line."""
    return {int(x) >> 20: int(x) & 1_048_575 for x in repeats} if repeats is not None else {}


def fit(labelled: DataFrame) -> tuple[dict, dict]:
    """Counts of the model over all scanned chunks; ``labelled``: text, repeats, heading_path.

    What comes to the driver are counts by label and kind of feature: at most a few hundred.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int, str]] = Counter()
        for b in batches:
            for text, repeats, path in zip(b["text"], b["repeats"], b["heading_path"]):
                before: str | None = "start"
                for _, features in features_of(lines_of(text), unpack(repeats), path):
                    label = seed(features)
                    if label:
                        for f, v in enumerate(features):
                            counts[(label, f, v)] += 1
                        if before:
                            counts[(before, -1, label)] += 1
                    before = label
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["label", "feature", "kind", "n"])

    rows = labelled.mapInPandas(run, "label string, feature int, kind string, n long").groupBy("label", "feature", "kind").agg(F.sum("n").alias("n")).collect()
    seen = {(r["label"], r["feature"], r["kind"]): r["n"] for r in rows if r["feature"] >= 0}
    moves = {(r["label"], r["kind"]): r["n"] for r in rows if r["feature"] < 0}
    return seen, moves


def _value(text: str) -> int | None:
    t = text.strip().lower().translate(str.maketrans("loisxx", "1015xx"))
    return int(t) if t.isdigit() else None


def repair(text: str, repeats: dict[int, int], path: str | None, page: int | None, layout: Layout, meant: dict[str, str], divided: dict[tuple[str, str], bool | None]) -> tuple[set[str], str]:
    """The kinds of noise in a scanned chunk, and its paragraphs without them."""
    lines = lines_of(text)
    seen = features_of(lines, repeats, path)
    labels = dict(zip((i for i, _ in seen), layout.label([f for _, f in seen])))
    facts = dict(seen)
    noise: set[str] = set()
    for i, label in list(labels.items()):
        repeated, _, _, end, number, start = facts[i]
        if repeated == "heading" and label == "header":
            label = labels[i] = "break"
        if label == "page" and number == "trailing":
            label = labels[i] = "header"
        if label == "page" and number in ("none", "list"):
            label = labels[i] = "body"
        if label == "page" and number in ("bare", "roman"):
            # A number alone is a page's only near the page that the chunk is from.
            value = _value(lines[i]) if number == "bare" else page
            if page is None or value is None or not page - 2 <= value <= page + 20:
                label = labels[i] = "body"
        if label in ("header", "page") and number != "form" and (_LIST.match(lines[i]) or end == "stop" or start.startswith("lower") and number != "roman"):
            label = labels[i] = "body"
        if label == "page":
            noise.add("page_number")
        if label == "header":
            noise.add("header")
            if number == "trailing":
                noise.add("page_number")
    body = [ln if labels.get(i, "body") in ("body", "break") else None for i, ln in enumerate(lines)]
    kept = [(i, ln) for i, ln in enumerate(body) if ln is not None]
    # A blank line beside a header or page number belongs to the page, not to the text.
    plain = [ln for _, ln in kept]
    joins: dict[int, tuple[int, bool]] = {}
    for i, j, joined, hyphened, mark in divisions(plain, 3):
        known = divided.get((joined, hyphened))
        split = mark in "¬­" or (known if known is not None else True)
        joins[i] = (j, split)
        if split:
            noise.add("hyphen")
    paragraphs: list[str] = []
    held = ""
    for i, ln in enumerate(plain):
        bare = ln.strip()
        if not bare:
            if held and i - 1 not in joins and not any(a < i < j for a, (j, _) in joins.items()):
                paragraphs.append(held)
                held = ""
            continue
        if _LIST.match(ln) and held:
            paragraphs.append(held)
            held = ""
        glue = "" if not held or held.endswith("\0") else " "
        held = held.rstrip("\0") + glue + bare
        if i in joins:
            held = (held[:-1] if joins[i][1] else held) + "\0"
    if held:
        paragraphs.append(held.rstrip("\0"))
    fixed = []
    for p in paragraphs:
        words = []
        for w in p.split(" "):
            c = clean(w) if meant else ""
            if c in meant:
                noise.add("character")
                core = w.strip(_EDGE)
                right = meant[c]
                right = right.upper() if core.isupper() and len(core) > 1 else right.capitalize() if core[:1].isupper() else right
                w = w.replace(core, right)
            words.append(w)
        fixed.append(" ".join(words))
    for line, label in labels.items():  # in running titles, too, characters are misread
        if label == "header" and any(clean(w) in meant for w in lines[line].split()):
            noise.add("character")
    return noise, "\n\n".join(fixed)


def _sent(df: DataFrame) -> list | None:
    """A table as rows for every task if it is small enough, which it is for any vocabulary of a few languages."""
    return df.collect() if df.limit(MAX_SENT + 1).count() <= MAX_SENT else None


def own_lookups(misread: Iterable[str] | None, divided: Iterable[str] | None) -> tuple[dict, dict]:
    meant = dict(x.split("\t", 1) for x in misread) if misread is not None else {}
    parts = [x.split("\t") for x in divided] if divided is not None else []
    return meant, {(p[0], p[1]): {"true": True, "false": False}.get(p[2]) for p in parts}


def with_lookups(texts: DataFrame, misread: DataFrame, divided: DataFrame) -> DataFrame:
    """``texts`` with the misread and divided words of each chunk, joined; for tables too large to be sent."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, c) for i, t in zip(b["chunk_id"], b["text"]) for c in {clean(w) for w in t.split()} | {w for _, _, *both, _ in divisions(lines_of(t)) for w in both} if c]
            yield pd.DataFrame(rows, columns=["chunk_id", "word"])

    used = texts.select("chunk_id", "text").mapInPandas(words, "chunk_id long, word string")
    # Words that a division put together are not in the text as it stands: paragraphs look these up, too.
    of = lambda df, key, *value: used.join(df.withColumnRenamed(key, "word"), "word").groupBy("chunk_id").agg(
        F.collect_list(F.concat_ws("\t", "word", *value)).alias(key + "_words")
    )
    flag = F.coalesce(F.col("divided").cast("string"), F.lit(""))
    return texts.join(of(misread, "misread", "meant"), "chunk_id", "left").join(of(divided.withColumn("divided", flag), "joined", "hyphened", "divided"), "chunk_id", "left")


def clean_scans(chunks: DataFrame) -> DataFrame:
    """chunk_id, noise (sorted list of kinds), text (repaired) of every chunk of a scanned PDF.

    A PDF is scanned if in most of its chunks most lines that another one follows end inside a sentence. Chunks of other
    documents, and null and empty texts, give no row. Repeated rows give one each. Columns of ``chunks``
    other than chunk_id, doc_key, text and meta are ignored.
    """
    seen = keep(_first_pass(chunks), "lines")
    vocabulary = keep(seen.where("what = 'word'").groupBy(F.col("text").alias("word")).agg(F.sum("n").alias("n"), F.sum("m").alias("n_native")), "words")
    pairs = seen.where("what = 'pair'").select(F.col("text").alias("joined"), "hyphened").distinct()
    spark = chunks.sparkSession
    misread = keep(misread_words(vocabulary), "misread").withColumnRenamed("word", "misread")
    division = keep(divided_words(pairs, vocabulary), "divided")
    rows = _sent(misread), _sent(division)
    sent = None if None in rows else spark.sparkContext.broadcast(({r["misread"]: r["meant"] for r in rows[0]}, {(r["joined"], r["hyphened"]): r["divided"] for r in rows[1]}))

    scanned = seen.where("what = 'chunk'").groupBy("doc").agg((F.count_if((F.col("n") * 2 > F.col("m")) & (F.col("m") > 1)) * 2 > F.count("*")).alias("scanned")).where("scanned").select("doc")
    lines = seen.where("what = 'line'").select("chunk_id", "line", "doc", "skeleton")
    repeated = lines.groupBy("doc", "skeleton").agg(F.count("*").alias("times")).where("times > 1").join(scanned, "doc")
    flags = lines.join(repeated, ["doc", "skeleton"]).groupBy("chunk_id").agg(F.collect_list(F.col("line") * 1_048_576 + F.least("times", F.lit(1_048_575))).alias("repeats"))
    of_scans = seen.where("what = 'chunk'").join(scanned, "doc").select("chunk_id").distinct()
    texts = (
        chunks.where(is_pdf(F.col("doc_key")) & (F.col("text") != ""))
        .select(F.col("chunk_id").cast("long"), "text", "meta.heading_path", "meta.page")
        .join(of_scans.join(flags, "chunk_id", "left"), "chunk_id")
        .select("chunk_id", "text", "heading_path", "page", "repeats")
    )
    texts = keep(texts, "scans")
    counts = fit(texts)
    if sent is None:
        texts = with_lookups(texts, misread, division)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout = Layout(*counts)
        for b in batches:
            found = []
            for k, (text, repeats, path, page) in enumerate(zip(b["text"], b["repeats"], b["heading_path"], b["page"])):
                meant, divided = sent.value if sent else own_lookups(b["misread_words"].iloc[k], b["joined_words"].iloc[k])
                found.append(repair(text, unpack(repeats), path, None if page is None or page != page else int(page), layout, meant, divided))
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "noise": [sorted(n) for n, _ in found], "text": [t for _, t in found]})

    return texts.mapInPandas(run, "chunk_id long, noise array<string>, text string")
