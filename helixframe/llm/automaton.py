"""Regular expressions over bytes compiled to minimal deterministic automata.

A pattern is parsed to a tree, turned into a nondeterministic automaton with empty moves, made deterministic by the
subset construction over classes of bytes that no pattern tells apart, and minimised by partition refinement. The
result is a set of transition arrays: one list of 256 successors for each state.

Supported: literals, escapes (`\\n`, `\\xHH`, `\\.` ...), `.`, classes `[a-z]` and `[^a-z]`, groups, `|`, `?`, `*`,
`+`, `{m}`, `{m,}` and `{m,n}`.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable
from itertools import accumulate
from operator import getitem, itemgetter

ALL = frozenset(range(256))
_NAMED = {"n": 10, "r": 13, "t": 9, "f": 12, "v": 11, "0": 0}


class Parser:
    """Pattern to tree: ("set", bytes), ("cat", [..]), ("alt", [..]) or ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str, fold: bool = False):
        self.text, self.at, self.fold = pattern, 0, fold

    def parse(self):
        tree = self._alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} at {self.at} in {self.text!r}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _next(self) -> str:
        c = self._peek()
        if not c:
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return c

    def _alternatives(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._next()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated())
        return ("cat", parts)

    def _repeated(self):
        tree = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self._next()
            if c != "{":
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
                continue
            end = self.text.index("}", self.at)
            least, comma, most = self.text[self.at : end].partition(",")
            self.at = end + 1
            tree = ("rep", tree, int(least), int(most) if most else None if comma else int(least))
        return tree

    def _byte(self) -> int:
        c = self._next()
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("patterns are ASCII; give other bytes as \\xHH")
            return ord(c)
        c = self._next()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum() and c not in _NAMED:
            raise ValueError(f"\\{c} isn't supported")
        return _NAMED.get(c, ord(c))

    def _set(self, found: Iterable[int]):
        found = set(found)
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(found))

    def _atom(self):
        c = self._peek()
        if c == "(":
            self._next()
            tree = self._alternatives()
            if self._next() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            return tree
        if c == ".":
            self._next()
            return ("set", ALL - {10})
        if c != "[":
            return self._set([self._byte()])
        self._next()
        negated = self._peek() == "^"
        if negated:
            self._next()
        found: set[int] = set()
        first = True
        while self._peek() != "]" or first:
            first = False
            low = self._byte()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self._next()
                found |= set(range(low, self._byte() + 1))
            else:
                found.add(low)
        self._next()
        kind, found = self._set(found)
        return (kind, ALL - found if negated else found)


def reverse(tree):
    """The tree of all strings of `tree` read backwards."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Lay the tree from `start`; returns the state at its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for t in tree[1]:
                start = self.add(t, start)
            return start
        if kind == "alt":
            end = self.state()
            for t in tree[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(t, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop]
            self.empty[loop].append(end)
            self.empty[self.add(part, loop)].append(loop)
            return end
        ends = [start]
        for _ in range(most - least):
            start = self.add(part, start)
            ends.append(start)
        end = self.state()
        for x in ends:
            self.empty[x].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


class Dfa:
    """Minimal automaton of several trees: accepts[s] has the numbers of the trees that end in state s.

    unanchored: a match may begin anywhere, so one pass finds every place where one ends.
    State 0 is the start; `dead` is the state without a way out, if there is one.
    """

    def __init__(self, trees: list, unanchored: bool = False):
        nfa = Nfa()
        root = nfa.state()
        if unanchored:
            nfa.moves[root].append((ALL, root))
        for k, tree in enumerate(trees):
            begin = nfa.state()
            nfa.empty[root].append(begin)
            nfa.accepts[nfa.add(tree, begin)] = k
        classes = self._classes(nfa)
        table, accepts = self._subsets(nfa, root, classes)
        table, self.accepts = self._minimise(table, accepts)
        of = [0] * 256
        for k, group in enumerate(classes):
            for b in group:
                of[b] = k
        self.next = [[row[of[b]] for b in range(256)] for row in table]
        self.dead = next((s for s, row in enumerate(self.next) if not self.accepts[s] and set(row) == {s}), -1)
        self._scan_rows()

    @staticmethod
    def _classes(nfa: Nfa) -> list[list[int]]:
        sets = {s for moves in nfa.moves for s, _ in moves}
        groups = defaultdict(list)
        for b in range(256):
            groups[tuple(b in s for s in sets)].append(b)
        return list(groups.values())

    @staticmethod
    def _subsets(nfa: Nfa, root: int, classes: list[list[int]]):
        start = nfa.closure([root])
        number, todo, table, accepts = {start: 0}, deque([start]), [], []
        while todo:
            states = todo.popleft()
            accepts.append(frozenset(nfa.accepts[s] for s in states if s in nfa.accepts))
            row = []
            for group in classes:
                b = group[0]
                to = nfa.closure({t for s in states for chars, t in nfa.moves[s] if b in chars})
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        return table, accepts

    @staticmethod
    def _minimise(table: list[list[int]], accepts: list[frozenset]):
        """Split blocks of states until those of a block agree on what they accept and on their successors' blocks."""
        names: dict = {}
        block = [names.setdefault(a, len(names)) for a in accepts]
        while True:
            names = {}
            finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(table)]
            if len(names) == len(set(block)):
                break
            block = finer
        first: dict[int, int] = {}
        for s, b in enumerate(block):
            first.setdefault(b, s)
        order = {b: k for k, b in enumerate(sorted(first, key=first.get))}  # the start's block comes first
        return [[order[block[t]] for t in table[first[b]]] for b in order], [accepts[first[b]] for b in order]

    def _scan_rows(self) -> None:
        """Each state as a list of its 256 successors' lists; entry 256 is the number of its set of accepted trees."""
        self.sets = sorted(set(self.accepts), key=sorted)
        rows: list[list] = [[] for _ in self.next]
        for row, to, accepted in zip(rows, self.next, self.accepts, strict=True):
            row += [rows[t] for t in to]
            row.append(self.sets.index(accepted))
        self.start_row = rows[0]

    def marks(self, data: bytes) -> bytes:
        """For each byte the number (in `sets`) of the set of trees that accept there; the loop runs in C."""
        return bytes(map(itemgetter(256), accumulate(data, getitem, initial=self.start_row)))[1:]

    def longest(self, data: bytes, start: int, stop: int, step: int = 1) -> int:
        """Bytes of the longest match from `start` on (or backwards, before `start`); -1 without one."""
        state, best, to = 0, 0 if self.accepts[0] else -1, self.next
        places = range(start, stop) if step > 0 else range(start - 1, stop - 1, -1)
        for n, i in enumerate(places, 1):
            state = to[state][data[i]]
            if self.accepts[state]:
                best = n
            elif state == self.dead:
                break
        return best
