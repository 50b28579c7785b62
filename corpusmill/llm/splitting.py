"""Splitting oversized texts at natural boundaries (problem 5).

The method: a hierarchy of separators. A text over the limit is cut at its sections; a section that is
still too large at its paragraphs, then lines (items of lists, rows of tables), sentences, words, and at
last characters. The units are packed greedily up to the limit, and each piece but the first starts with
the end of the piece before it, in whole units of the finest level that gives the overlap asked for.

Tokens are words / 0.75, rounded, at least 1, so a limit in tokens is a limit in words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From coarse to fine; each keeps its separator at the end of the unit before it.
SECTION = re.compile(r"(?<=\n)(?=#{1,6} |Slide \d+:|\d+\. \S[^\n]{0,60}\n)")
PARAGRAPH = re.compile(r"(?<=\n\n)(?=\S)|(?<=\r\n\r\n)(?=\S)")
LINE = re.compile(r"(?<=\n)(?=.)")
SENTENCE = re.compile(r"(?<=[.!?…])(?=\s+\S)")
WORD = re.compile(r"\s*\S+\s*")
LEVELS = (SECTION, PARAGRAPH, LINE, SENTENCE)


def tokens(words: int) -> int:
    return max(1, round(words / 0.75))


def max_words(limit: int) -> int:
    """The most words whose tokens stay within ``limit``."""
    n = int(limit * 0.75)
    while tokens(n + 1) <= limit:
        n += 1
    while n > 1 and tokens(n) > limit:
        n -= 1
    return n


def units(text: str, limit: int, max_chars: int, level: int = 0) -> Iterator[tuple[str, int]]:
    """The text in units of at most ``limit`` words, cut no finer than needed; (unit, words)."""
    n = len(text.split())
    if n <= limit and len(text) <= max_chars:
        yield text, n
        return
    if level < len(LEVELS):
        for part in LEVELS[level].split(text):
            if part:
                yield from units(part, limit, max_chars, level + 1)
        return
    words = WORD.findall(text)
    if not words:  # white space alone
        words = [text]
    for w in words:
        for i in range(0, len(w), max_chars):
            piece = w[i : i + max_chars]
            yield piece, len(piece.split())


def min_words(overlap: int) -> int:
    """The fewest words that are ``overlap`` tokens; 0 for no overlap."""
    return next(n for n in range(overlap + 1) if tokens(n) >= overlap) if overlap > 0 else 0


def _tail(held: list[tuple[str, int]], overlap: int) -> list[tuple[str, int]]:
    """The last ``overlap`` words of a piece, as one unit."""
    if not overlap:
        return []
    last = WORD.findall("".join(t for t, _ in held))[-overlap:]
    return [("".join(last), len(last))] if last else []


def split_text(text: str, limit: int = 1000, overlap: int = 150, max_chars: int = 100_000) -> list[tuple[str, int, int]]:
    """Pieces of ``text``, each with the words and the characters it shares with the piece before it.

    A text within the limit is one piece as it is. Pieces have at most ``limit`` tokens, overlap included;
    without their overlaps they give the text again, character by character. A word longer than
    ``max_chars`` is cut.
    """
    most, shared = max_words(limit), min(min_words(overlap), max_words(limit) // 2)
    if len(text.split()) <= most and len(text) <= max_chars:
        return [(text, 0, 0)]
    pieces: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []  # units of the piece being packed, overlap first
    words = size = lead = lead_size = 0
    # A unit has to fit beside an overlap.
    for text_, n in units(text, most - shared, max_chars):
        if held and (words + n > most or size + len(text_) > 2 * max_chars):
            pieces.append(("".join(t for t, _ in held), lead, lead_size))
            held = _tail(held, shared)
            words = lead = sum(k for _, k in held)
            size = lead_size = sum(len(t) for t, _ in held)
        held.append((text_, n))
        words += n
        size += len(text_)
    if held:
        pieces.append(("".join(t for t, _ in held), lead, lead_size))
    return pieces


def split_oversized(chunks: DataFrame, limit: int = 1000, overlap: int = 150) -> DataFrame:
    """The pieces of each chunk over ``limit`` tokens: chunk_id, piece, n_pieces, text, tokens, overlap_words, overlap_chars, meta.

    Chunks within the limit, and null and empty texts, give no row. Repeated rows give repeated pieces.
    Other columns are not read. Texts too short to have so many words never leave the JVM.
    """
    most = max_words(limit)
    large = chunks.select("chunk_id", "text", "meta").where(F.length("text") > 2 * most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(text.split()) <= most:
                    continue
                pieces = split_text(text, limit, overlap)
                rows += [(i, k, len(pieces), t, tokens(len(t.split())), *shared) for k, (t, *shared) in enumerate(pieces)]
            at, *rest = zip(*rows) if rows else [()] * 7
            rows_of = pa.array(at, pa.int32())
            kinds = pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_of), *map(pa.array, rest, kinds), batch.column(2).take(rows_of)],
                names=["chunk_id", "piece", "n_pieces", "text", "tokens", "overlap_words", "overlap_chars", "meta"],
            )

    meta = chunks.schema["meta"].dataType.simpleString()
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return large.mapInArrow(run, f"chunk_id {kind}, piece int, n_pieces int, text string, tokens int, overlap_words int, overlap_chars int, meta {meta}")
