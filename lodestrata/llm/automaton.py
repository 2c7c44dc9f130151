"""Regular expressions compiled, all together, to one deterministic automaton over bytes.

Syntax: literals, ``\\`` escapes (``\\d \\w \\s`` in ASCII), ``.`` (any character but
a newline), classes, groups, ``|``, ``? * +`` and ``{m} {m,} {m,n}``.  Characters
that a rule names are ASCII; ``.``, ``\\D \\W \\S`` and negated classes take every other
character of UTF-8 as a whole.  A match begins at the text's start or after a
character that is no ASCII letter, digit or ``_``.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from ._text import mix

DIGIT = frozenset(range(48, 58))
WORDS = frozenset([*range(48, 58), *range(65, 91), *range(97, 123), 95])
SPACES = frozenset([9, 10, 11, 12, 13, 32])
ALL = frozenset(range(128))
EVERY = frozenset(range(256))
_NEXT = ("set", frozenset(range(0x80, 0xC0)))
#: A character beyond ASCII, in UTF-8.
BEYOND = [("cat", [("set", frozenset(range(a, b))), *[_NEXT] * k]) for a, b, k in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3))]
ESCAPES = {"d": DIGIT, "w": WORDS, "s": SPACES, "D": ALL - DIGIT, "W": ALL - WORDS, "S": ALL - SPACES, "n": frozenset([10]), "t": frozenset([9]), "r": frozenset([13])}
IS_WORD = np.zeros(256, bool)
IS_WORD[[*WORDS]] = True


class Parser:
    """Text to a tree of ("set", bytes), ("cat", items), ("alt", items), ("rep", item, m, n or None)."""

    def __init__(self, text: str):
        self.t, self.i = text, 0

    def parse(self):
        tree = self.alt()
        if self.i < len(self.t):
            raise ValueError(f"unexpected {self.t[self.i]!r} in {self.t!r}")
        return tree

    def peek(self) -> str:
        return self.t[self.i : self.i + 1]

    def take(self) -> str:
        if self.i >= len(self.t):
            raise ValueError(f"{self.t!r} ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def alt(self):
        items = [self.cat()]
        while self.peek() == "|":
            self.take()
            items.append(self.cat())
        return items[0] if len(items) == 1 else ("alt", items)

    def cat(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeat(self.atom()))
        return ("cat", items)

    def repeat(self, item):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                inside = ""
                while (x := self.take()) != "}":
                    inside += x
                m, comma, n = inside.partition(",")
                item = ("rep", item, int(m), int(n) if n else None if comma else int(m))
            else:
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def one(self) -> frozenset:
        c = self.take()
        if c != "\\":
            return frozenset([ord(c)])
        c = self.take()
        return ESCAPES.get(c) or frozenset([ord(c)])

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 3 if self.t.startswith("(?:", self.i) else 1
            tree = self.alt()
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.t!r}")
            return tree
        if c == ".":
            self.take()
            return ("alt", [("set", ALL - {10}), *BEYOND])
        if c != "[":
            wide = self.t[self.i : self.i + 2] in ("\\D", "\\W", "\\S")
            part = ("set", self.one())
            return ("alt", [part, *BEYOND]) if wide else part
        self.take()
        negated = self.peek() == "^"
        self.i += negated
        got: set[int] = set()
        while self.peek() != "]":
            part = self.one()
            if self.peek() == "-" and self.t[self.i + 1 : self.i + 2] != "]" and len(part) == 1:
                self.take()
                part = frozenset(range(min(part), max(self.one()) + 1))
            got |= part
        self.take()
        return ("alt", [("set", ALL - got), *BEYOND]) if negated else ("set", frozenset(got))


class Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree, start: int) -> int:
        """Adds tree after start; its last state."""
        kind, arg = tree[0], tree[1]
        if kind == "set":
            end = self.state()
            s = self.state()
            self.eps[start].append(s)
            self.step[s] = (arg, end)
            return end
        if kind == "cat":
            for x in arg:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "alt":
            for x in arg:
                self.eps[self.add(x, start)].append(end)
            return end
        _, item, m, n = tree
        for _ in range(m):
            start = self.add(item, start)
        if n is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.add(item, loop)].append(loop)
            self.eps[loop].append(end)
        else:
            self.eps[start].append(end)
            for _ in range(n - m):
                start = self.add(item, start)
                self.eps[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        todo = list(states)
        seen = set(todo)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """next state = table[state + cls[byte]]; states are multiples of the number of classes.

    State 0 is dead.  Accepting states are those from ``accepting`` on; ``rule``
    (by state // classes) is the first rule accepted, -1 if none.
    """

    table: np.ndarray
    cls: np.ndarray
    start: int
    accepting: int
    rule: np.ndarray

    @property
    def classes(self) -> int:
        return int(self.cls.max()) + 1

    def listed(self) -> list[int]:
        """The table as a list, made once in a process."""
        if "_list" not in self.__dict__:
            self._list = self.table.tolist()
        return self._list

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_list"}


def relaxed(tree, most: int):
    """A tree that matches all that ``tree`` does, and counts no further than ``most``."""
    kind, arg = tree[0], tree[1]
    if kind == "set":
        return tree
    if kind == "rep":
        _, item, m, n = tree
        return ("rep", relaxed(item, most), min(m, most), n if n == 1 else None)
    return (kind, [relaxed(x, most) for x in arg])


def determine(nfa: Nfa, first: frozenset, accepts: dict[int, int], absorb: bool = False, limit: int = 50_000) -> Dfa:
    """Subset construction and minimisation.  With ``absorb``, whatever follows a match is accepted."""
    sets = [s[0] for s in nfa.step if s]
    kinds: dict[tuple, int] = {}
    cls = np.array([kinds.setdefault(tuple(b in s for s in set(sets)), len(kinds)) for b in range(256)])
    byte_of = [int(np.flatnonzero(cls == c)[0]) for c in range(len(kinds))]
    # Subsets are bit masks of the states that step on or accept; a state steps on its set's classes to one mask.
    useful = {s for s, x in enumerate(nfa.step) if x} | accepts.keys()
    mask = lambda states: sum(1 << s for s in states)
    classes = {of: [c for c, b in enumerate(byte_of) if b in of] for of in set(sets)}
    after = {s: (x[0], mask(nfa.closure([x[1]]) & useful)) for s, x in enumerate(nfa.step) if x}
    accepting, won = mask(accepts), 1 << min(accepts)
    start = mask(first & useful)
    ids, todo, rows, rules = {0: 0, start: 1}, [0, start], [], []
    for subset in todo:  # grows
        members, left = [], subset
        while left:
            low = left & -left
            members.append(low.bit_length() - 1)
            left ^= low
        rules.append(min((accepts[s] for s in members if s in accepts), default=-1))
        to_by: dict[frozenset, int] = {}
        for s in members:
            if s in after:
                of, to = after[s]
                to_by[of] = to_by.get(of, 0) | to
        reached = [0] * len(byte_of)
        for of, to in to_by.items():
            for c in classes[of]:
                reached[c] |= to
        row = []
        for to in reached:
            if absorb and (subset == won or to & accepting):
                to = won
            if to not in ids:
                ids[to] = len(todo)
                todo.append(to)
                if len(todo) > limit:
                    raise ValueError("the rules need too many states")
            row.append(ids[to])
        rows.append(row)
    t, rule = np.array(rows), np.array(rules)
    block = np.unique(rule, return_inverse=True)[1]
    salt = np.random.default_rng(5).integers(1, 1 << 62, len(byte_of) + 1, dtype=np.int64).astype(np.uint64)
    while True:  # Moore: split blocks until successors agree, rows of blocks known by a 64-bit hash
        b = mix(block.astype(np.uint64) + np.uint64(1))
        sign = b * salt[0]
        for c in range(len(byte_of)):
            sign += mix(b[t[:, c]] * salt[c + 1])
        new = np.unique(sign, return_inverse=True)[1]
        if new.max() == block.max():
            break
        block = new
    n = int(block.max()) + 1
    rep = np.zeros(n, int)
    rep[block[::-1]] = np.arange(len(block))[::-1]
    order = sorted(range(n), key=lambda b: (rule[rep[b]] >= 0, b != block[0]))  # dead first, accepting last
    place = np.argsort(order)
    c = len(kinds)
    table = (place[block[t[rep[order]]]] * c).astype(np.int32).ravel()
    new_rule = rule[rep[order]]
    return Dfa(table, cls.astype(np.int32), int(place[block[1]]) * c, int((new_rule < 0).sum()) * c, new_rule)


def compiled(rules: list[str], most: int = 3) -> tuple[Dfa, Dfa]:
    """(automaton that tells whether a text may hold a match, automaton of the matches from a given start).

    The first one runs over everything.  Deciding every place at once with exact
    counts would need states beyond number, so it counts repetitions no further
    than ``most``: it never misses a match, and the second one, which is exact, has the last word.
    """
    made = []
    for whole in (True, False):
        nfa = Nfa()
        head, word, other = nfa.state(), nfa.state(), nfa.state()
        accepts = {}
        for k, r in enumerate(rules):
            tree = Parser(r).parse()
            start = nfa.state()
            nfa.eps[head].append(start)
            end = nfa.add(relaxed(tree, most) if whole else tree, start)
            if end in nfa.closure([start]):
                raise ValueError(f"{r!r} matches nothing at all")
            accepts[end] = k
        nfa.eps[other].append(head)
        for s in (word, other):  # what the last byte was
            for to, of in ((word, WORDS), (other, EVERY - WORDS)):
                x = nfa.state()
                nfa.eps[s].append(x)
                nfa.step[x] = (of, to)
        made.append(determine(nfa, nfa.closure([other if whole else head]), accepts, absorb=whole))
    return made[0], made[1]


def hits(dfa: Dfa, d: np.ndarray, o: np.ndarray, lanes: int = 24) -> np.ndarray:
    """Which documents of a block may hold a match: one pass over every byte.

    Documents run side by side, one array step a byte; the few longest go on
    alone once fewer than ``lanes`` are left, from the state they had reached.
    """
    n = np.diff(o)
    order = np.argsort(-n, kind="stable")
    at, size = o[:-1][order], n[order]
    found = np.zeros(len(n), bool)
    code = dfa.cls[d]
    state = np.full(len(n), dfa.start, np.int32)
    j, live = 0, len(n)
    falling = np.sort(size)
    while True:
        live = len(n) - int(np.searchsorted(falling, j, "right"))
        if live < lanes:
            break
        stop = int(size[live - 1])  # all these lanes reach so far
        s, base, seen = state[:live], at[:live], np.zeros(live, bool)
        for k in range(j, stop):
            s = dfa.table[s + code[base + k]]
            seen |= s >= dfa.accepting
        state[:live] = s
        found[order[:live]] |= seen
        j = stop
    accepting = dfa.accepting
    for lane in range(live):
        if found[order[lane]]:
            continue
        table = dfa.listed()
        s = int(state[lane])
        for c in code[at[lane] + j : at[lane] + size[lane]].tolist():
            s = table[s + c]
            if s >= accepting:
                found[order[lane]] = True
                break
    return found


def spans(dfa: Dfa, d: np.ndarray, every: int = 16) -> list[tuple[int, int, int]]:
    """(start, end, rule) of the leftmost, then longest matches of one document, apart from each other.

    Starts are tried from the left, those inside a match left out.  At every
    ``every`` bytes a run notes what came of its state; a later run that reaches
    the same state there ends the same way, so no text is read again and again.
    """
    code = dfa.cls[d]
    ok = np.ones(len(d), bool)
    ok[1:] = ~IS_WORD[d[:-1]]
    starts = np.flatnonzero(ok & (dfa.table[dfa.start + code] > 0))
    table, codes, n, accepting = dfa.listed(), code.tolist(), len(d), dfa.accepting
    known: dict[tuple[int, int], tuple[int, int]] = {}
    out, last = [], 0
    for first in starts.tolist():
        if first < last:
            continue
        s, k, end, state, passed = dfa.start, first, 0, 0, []
        while k < n:
            s = table[s + codes[k]]
            if not s:
                break
            k += 1
            if s >= accepting:
                end, state = k, s
            if not k % every:
                if (k, s) in known:
                    if known[k, s][0]:
                        end, state = known[k, s]
                    break
                passed.append((k, s))
        for x in passed:
            known[x] = (end, state) if end > x[0] else (0, 0)
        if end:
            last = end
            out.append((first, end, int(dfa.rule[state // dfa.classes])))
    return out
