"""Pairs of texts whose Ratcliff-Obershelp ratio reaches a bound, for blocks of texts at once.

The ratio is that of ``difflib.SequenceMatcher``, with its choice among equal matches, and every pair of a block gets
its exact answer. Letters in common (a product of matrices) and the longest common subsequence (additions on words of
64 bits) bound it from above; what they leave is matched in bit vectors, many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Fixed value: the ratio from which names are similar.
LEAST = 0.6
#: Bits of a word; letters counted on their own, and sets of the others; occurrences of one that are counted.
WORD, LETTERS, SETS, OFTEN = 64, 96, 32, 64
#: difflib passes over frequent letters of a second text from this length on.
JUNK = 200
#: Pairs of a product of matrices, pairs matched at once, and ranges searched at once.
PAIRS, MATCHED, RANGES = 1 << 21, 1 << 14, 1 << 12
#: Rows of queries of a slice.
ASKED = 128
ALL, ONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)


def similar(a: str, b: str, least: float = LEAST) -> bool:
    """Ratcliff-Obershelp ratio of at least ``least``, or an equal first word of over three letters.

    The ratio isn't symmetric; ``a`` is the earlier of the two. Cheaper bounds on it are tried first.
    """
    first = a.split(" ", 1)[0]
    if len(first) > 3 and first == b.split(" ", 1)[0]:
        return True
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def needed(sizes: np.ndarray) -> np.ndarray:
    """The fewest matched letters with which two texts of so many letters together reach the ratio."""
    m = np.maximum(np.floor(sizes * LEAST / 2).astype(np.int64) - 1, 0)
    while (short := 2.0 * m < LEAST * sizes - 1e-9).any():
        m += short
    return m


class Texts:
    """Distinct texts with letters as numbers of a block's alphabet (0 beyond a text's end), and counts of letters as bits."""

    def __init__(self, texts: list[str], alphabet: np.ndarray, often: np.ndarray, kinds: np.ndarray):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        of = np.repeat(np.arange(len(texts)), self.sizes)
        letters = np.searchsorted(alphabet, points(texts)) + 1
        # Letters of a word's bits; longer texts are compared one by one.
        short = np.minimum(self.sizes, JUNK)
        at = np.arange(len(of)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        inside = at < JUNK
        self.codes = np.zeros((len(texts), int(short.max(initial=0))), np.min_scalar_type(len(alphabet)))
        self.codes[of[inside], at[inside]] = letters[inside]
        counts = kinds_of(texts, kinds[letters - 1])
        self.over = (counts > OFTEN).any(axis=1)
        self.bits = np.concatenate([counts[:, k, None] >= np.arange(1, often[k] + 1) for k in range(len(often))], axis=1).astype(np.float32)


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def kinds_of(texts: list[str], kinds: np.ndarray) -> np.ndarray:
    """How often each kind of letter is in each text; ``kinds``: those of all their letters."""
    n = LETTERS + SETS
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.bincount(of * n + kinds, minlength=len(texts) * n).reshape(len(texts), n)


class Alphabet:
    """The letters of a block's texts: the most frequent ones by themselves, the others in sets, which can only raise a bound."""

    def __init__(self, asked: list[str], texts: list[str]):
        self.letters, n = np.unique(np.concatenate([points(asked), points(texts)]), return_counts=True)
        self.kinds = LETTERS + (self.letters % SETS).astype(np.int64)
        self.kinds[np.argsort(-n, kind="stable")[:LETTERS]] = np.arange(min(LETTERS, len(self.letters)))
        # More of a letter than any of the queries has can't be in common.
        counts = kinds_of(asked, self.kinds[np.searchsorted(self.letters, points(asked))])
        self.often = np.minimum(counts.max(axis=0), OFTEN)

    def texts(self, texts: list[str]) -> Texts:
        return Texts(texts, self.letters, self.often, self.kinds)


def lowest(x: np.ndarray) -> np.ndarray:
    """The place of the lowest bit."""
    return np.bitwise_count((x & (~x + ONE)) - ONE).astype(np.int64)


def longest(same: np.ndarray, upright: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and beginnings (step, bit) of the longest match in each column of ``same``: bits that equal the letter of a step.

    Among equal ones the first in the first text, then the first in the second; ``upright``: the steps are the first text.
    """
    n = same.shape[1]
    size, step, bit = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    now = np.flatnonzero(np.bitwise_or.reduce(same, axis=0))
    same = same[:, now]
    length = 1
    while len(now):
        longer = same[1:] & (same[:-1] << ONE)
        on = np.bitwise_or.reduce(longer, axis=0) != 0 if len(longer) else np.zeros(len(now), bool)
        ended = np.flatnonzero(~on)
        if len(ended):
            last, at, up = same[:, ended], now[ended], upright[now[ended]]
            cols = np.arange(len(ended))
            by_step = (last != 0).argmax(axis=0)
            of_step = lowest(last[by_step, cols])
            of_all = lowest(np.bitwise_or.reduce(last, axis=0))
            by_bit = ((last >> of_all.astype(np.uint64)) & ONE).argmax(axis=0)
            size[at] = length
            step[at] = np.where(up, by_step, by_bit)
            bit[at] = np.where(up, of_step, of_all) - (length - 1)
            longer, now = longer[:, on], now[on]
        same = longer
        length += 1
    return size, step, bit


def reaches(same: np.ndarray, n_steps: np.ndarray, n_bits: np.ndarray, need: np.ndarray, upright: np.ndarray) -> np.ndarray:
    """Whether the matches of each column of ``same`` add up to ``need``: the longest one, then those before and after it, and so on."""
    n = len(need)
    done, left = np.zeros(n, np.int64), np.minimum(n_steps, n_bits)
    col = np.flatnonzero((left >= need) & (left > 0))
    s0, s1, b0, b1 = np.zeros(len(col), np.int64), n_steps[col], np.zeros(len(col), np.int64), n_bits[col]
    while len(col):
        order = np.argsort(s1 - s0, kind="stable")
        found = []
        for a in range(0, len(order), RANGES):
            i = order[a : a + RANGES]
            c, wide = col[i], int((s1[i] - s0[i]).max())
            steps = s0[i] + np.arange(wide)[:, None]
            part = same[np.minimum(steps, len(same) - 1), c]
            part &= (ALL >> (WORD - b1[i]).astype(np.uint64)) & (ALL << b0[i].astype(np.uint64))
            part[steps >= s1[i]] = 0
            size, step, bit = longest(part, upright[c])
            done += np.bincount(c, size, n).astype(np.int64)
            some = np.flatnonzero(size)
            i, c, size, step, bit = i[some], c[some], size[some], step[some] + s0[i[some]], bit[some]
            found.append((np.tile(c, 2), np.concatenate([s0[i], step + size]), np.concatenate([step, s1[i]]), np.concatenate([b0[i], bit + size]), np.concatenate([bit, b1[i]])))
        col, s0, s1, b0, b1 = (np.concatenate(x) for x in zip(*found))
        room = np.minimum(s1 - s0, b1 - b0)
        left = np.bincount(col, np.maximum(room, 0), n)
        on = (room > 0) & ((done < need) & (done + left >= need))[col]
        col, s0, s1, b0, b1 = col[on], s0[on], s1[on], b0[on], b1[on]
    return done >= need


class Pending:
    """Pairs that wait to be matched, many at once."""

    def __init__(self, out: np.ndarray):
        self.out, self.held, self.n = out, [], 0

    def add(self, same: np.ndarray, *columns: np.ndarray) -> None:
        self.held.append((same, columns))
        self.n += same.shape[1]
        if self.n >= MATCHED:
            self.run()

    def run(self) -> None:
        if not self.n:
            return
        same, at = np.zeros((max(len(s) for s, _ in self.held), self.n), np.uint64), 0
        for s, _ in self.held:
            same[: len(s), at : at + s.shape[1]] = s
            at += s.shape[1]
        q, x, n_steps, n_bits, need, upright = (np.concatenate(c) for c in zip(*(columns for _, columns in self.held)))
        ok = reaches(same, n_steps, n_bits, need, upright)
        self.out[upright.astype(np.int64)[ok], q[ok], x[ok]] = True
        self.held, self.n = [], 0


def compare(asked: Texts, texts: Texts, wanted: np.ndarray) -> np.ndarray:
    """Whether the ratio of each pair is enough, by direction (1: the second text is the earlier one), query and text.

    ``wanted``: the directions and pairs that are asked for. Texts are ordered by length.
    """
    out = np.zeros(wanted.shape, bool)
    pending = Pending(out)
    near = asked.bits @ texts.bits.T >= LEAST / 2 * (asked.sizes[:, None] + texts.sizes) - 0.01
    near |= asked.over[:, None] & texts.over
    near &= wanted.any(axis=0)
    table = np.zeros(int(max(asked.codes.max(initial=0), texts.codes.max(initial=0))) + 1, np.uint64)
    enough = needed(np.arange(WORD + JUNK))
    for q in np.flatnonzero(near.any(axis=1)):
        size, found = int(asked.sizes[q]), np.flatnonzero(near[q])
        if 0 < size <= WORD:
            long = texts.sizes[found] >= JUNK
            table[:] = 0
            np.bitwise_or.at(table, asked.codes[q, :size], ONE << np.arange(size, dtype=np.uint64))
            fits = found[~long]
            for a in range(0, len(fits), RANGES):
                x = fits[a : a + RANGES]
                sizes = texts.sizes[x]
                need, wide = enough[size + sizes], int(sizes[-1])
                codes = np.ascontiguousarray(texts.codes[x, :wide].T)
                rest = np.full(len(x), ALL)
                for step, start in enumerate(np.searchsorted(sizes, np.arange(wide), "right").tolist()):
                    now = rest[start:]
                    met = table.take(codes[step, start:])
                    met &= now
                    more = now + met
                    now ^= met
                    now |= more
                common = np.bitwise_count(~rest & (ALL >> np.uint64(WORD - size)))
                close = np.flatnonzero(common >= need)
                for way in (0, 1):
                    on = close[wanted[way, q, x[close]]]
                    if len(on):
                        k = len(on)
                        pending.add(table[codes[:, on]], np.full(k, q), x[on], sizes[on], np.full(k, size), need[on], np.full(k, way == 1))
            found = found[long]
        for x in found:
            for way in (0, 1):
                if wanted[way, q, x]:
                    a, b = asked.texts[q], texts.texts[x]
                    out[way, q, x] = similar(b, a) if way else similar(a, b)
    pending.run()
    return out


class Slice:
    """Pages with all their names, which are distinct and ordered by length: ``page`` and ``name`` (a number) by row."""

    def __init__(self, page: np.ndarray, names: list[str]):
        self.page, self.names = page, sorted(set(names), key=lambda t: (len(t), t))
        place = {t: i for i, t in enumerate(self.names)}
        self.name = np.fromiter((place[t] for t in names), np.int64, len(names))
        self.first, self.last = np.full(len(place), np.iinfo(np.int64).max), np.full(len(place), np.iinfo(np.int64).min)
        np.minimum.at(self.first, self.name, page)
        np.maximum.at(self.last, self.name, page)

    def heads(self, known: dict[str, int]) -> np.ndarray:
        """A number for each first word of over three letters, -1 for others."""
        words = (t.split(" ", 1)[0] for t in self.names)
        return np.array([known.setdefault(w, len(known)) if len(w) > 3 else -1 for w in words], np.int64)

    def pages(self) -> Iterator[tuple[int, np.ndarray]]:
        cuts = [0, *(np.flatnonzero(self.page[1:] != self.page[:-1]) + 1).tolist(), len(self.page)]
        for a, b in zip(cuts, cuts[1:]):
            yield self.page[a], self.name[a:b]


def slices(page: np.ndarray, names: list[str], rows: int) -> Iterator[Slice]:
    """Slices of about so many rows; pages stay whole, and those that begin with equal names are neighbours."""
    lowest_of: dict[int, str] = {}
    for p, t in zip(page.tolist(), names):
        lowest_of[p] = min(t, lowest_of.get(p, t))
    order = sorted(range(len(names)), key=lambda i: (lowest_of[page[i]], page[i]))
    page, names = page[order], [names[i] for i in order]
    starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    cuts = [*starts[np.unique(starts // rows, return_index=True)[1]].tolist(), len(page)]
    for a, b in zip(cuts, cuts[1:]):
        yield Slice(page[a:b], names[a:b])


def similar_pages(asked_page: np.ndarray, asked_names: list[str], page: np.ndarray, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different pages, each once, of which a name is similar to one of the other's; the page with the lower id is the earlier one."""
    alphabet, known = Alphabet(asked_names, names), {}
    asked = [(s, alphabet.texts(s.names), s.heads(known)) for s in slices(asked_page, asked_names, ASKED)]
    for s in slices(page, names, PAIRS // ASKED):
        texts, heads = alphabet.texts(s.names), s.heads(known)
        for q, asked_texts, asked_heads in asked:
            equal = (asked_heads[:, None] == heads) & (asked_heads[:, None] >= 0)
            # The query's page is the earlier one of some pair of pages with these names, the later one of some.
            wanted = np.stack([q.first[:, None] < s.last, q.last[:, None] > s.first]) & ~equal
            alike = compare(asked_texts, texts, wanted) | equal
            found = []
            for own, of in q.pages():
                before, after = alike[:, of].any(axis=1)
                p = np.unique(s.page[np.where(s.page > own, before[s.name], after[s.name]) & (s.page != own)])
                found.append((np.full(len(p), own), p))
            yield tuple(np.concatenate(x) for x in zip(*found))
