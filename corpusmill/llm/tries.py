"""Tries searched with Levenshtein automata.

The automaton has a set of positions in the query for each number of edits, as the bits of one integer: position i
is in the set j if the prefix walked so far is within j edits of the first i letters. A letter moves all positions at
once. A transposition of neighbours is one edit. Where no set has a position left, the branch has no neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

State = tuple[int, ...]


class Automaton:
    """All texts within ``bound`` edits of ``query``."""

    __slots__ = ("bound", "end", "full", "masks", "start")

    def __init__(self, query: str, bound: int) -> None:
        masks: dict[str, int] = {}
        for i, ch in enumerate(query):
            masks[ch] = masks.get(ch, 0) | 1 << i
        self.masks, self.bound = masks, bound
        self.end, self.full = 1 << len(query), (1 << len(query) + 1) - 1
        self.start: State = tuple(((1 << j + 1) - 1) & self.full for j in range(bound + 1))

    def move(self, state: State, ch: str, before: State | None, last: str) -> State:
        """The state after ``ch``; ``before`` and ``last`` are the state and the letter one step ago."""
        mask = self.masks.get(ch, 0)
        low = (state[0] & mask) << 1
        out = [low]
        swap = mask & self.masks.get(last, 0) >> 1 if before is not None else 0
        for j in range(1, self.bound + 1):
            less = state[j - 1]
            low = (state[j] & mask) << 1 | less | less << 1 | low << 1
            if swap:
                low |= (before[j - 1] & swap) << 2
            low &= self.full
            out.append(low)
        return tuple(out)

    def distance(self, state: State) -> int:
        """The edits of a text that ends in ``state``; above the bound if it isn't accepted."""
        return next((j for j, s in enumerate(state) if s & self.end), self.bound + 1)


class Trie:
    __slots__ = ("children", "end")

    def __init__(self) -> None:
        self.children: dict[str, Trie] = {}
        self.end: list = []

    def add(self, text: str, value: object) -> None:
        node = self
        for ch in text:
            nxt = node.children.get(ch)
            if nxt is None:
                nxt = node.children[ch] = Trie()
            node = nxt
        node.end.append(value)

    def find(self, text: str) -> Trie | None:
        node: Trie | None = self
        for ch in text:
            node = node.children.get(ch)
            if node is None:
                return None
        return node

    def below(self) -> Iterator[object]:
        """The values of all entries that begin with the way to this node."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield from node.end
            stack += node.children.values()

    def reached(self, automaton: Automaton) -> Iterator[tuple[Trie, int]]:
        """All nodes whose way is within the bound of the query, each with the distance."""
        move, end, bound = automaton.move, automaton.end, automaton.bound
        stack: list[tuple[Trie, State, State | None, str]] = [(self, automaton.start, None, "")]
        while stack:
            node, state, before, last = stack.pop()
            if state[-1] & end:
                yield node, automaton.distance(state)
            for ch, child in node.children.items():
                new = move(state, ch, before, last)
                if new[-1] or bound and state[-2]:
                    stack.append((child, new, state, ch))

    def near(self, query: str, bound: int) -> Iterator[tuple[object, int]]:
        """The values of all entries within ``bound`` edits, each with its distance."""
        yield from self.accepted(Automaton(query, bound))

    def accepted(self, automaton: Automaton) -> Iterator[tuple[object, int]]:
        for node, d in self.reached(automaton):
            for v in node.end:
                yield v, d


def within(a: str, b: str, bound: int) -> bool:
    """Whether two texts are at most ``bound`` edits apart."""
    automaton = Automaton(a, bound)
    state, before, last = automaton.start, None, ""
    for ch in b:
        state, before, last = automaton.move(state, ch, before, last), state, ch
        if not (state[-1] or bound and before[-2]):
            return False
    return bool(state[-1] & automaton.end)
