"""Regular expressions compiled together into one deterministic, minimal automaton over bytes."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re import _parser as P

import numpy as np

#: A byte that no UTF-8 text holds: it parts texts, and leads from every state to the start.
PART = 0xFF

_CATEGORIES = {
    C.CATEGORY_DIGIT: set(b"0123456789"),
    C.CATEGORY_SPACE: set(b" \t\n\r\f\v"),
    C.CATEGORY_WORD: set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}
_ALL = set(range(256)) - {PART}


class _Nfa:
    """Thompson's construction from the parse tree of Python's own expression parser."""

    def __init__(self, past_looks: bool = False) -> None:
        self.past_looks = past_looks  # leave out what an expression only looks ahead at
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        for op, arg in tree:
            at = self._one(op, arg, at, fold)
        return at

    def _one(self, op, arg, at: int, fold: bool) -> int:
        if op is C.ASSERT and self.past_looks:
            return at
        if op is C.SUBPATTERN:
            _, on, _, inner = arg
            return self.add(inner, at, fold or bool(on & re.IGNORECASE))
        if op is C.BRANCH:
            end = self.state()
            for tree in arg[1]:
                first = self.state()
                self.empty[at].append(first)
                self.empty[self.add(tree, first, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                at = self.add(tree, at, fold)
            if most is C.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(tree, loop, fold)].append(loop)
                return loop
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.add(tree, at, fold)
            self.empty[at].append(end)
            return end
        to = self.state()
        self.moves[at].append((frozenset(_bytes(op, arg, fold)), to))
        return to


def _bytes(op, arg, fold: bool) -> set[int]:
    if op is C.LITERAL:
        found = {arg}
    elif op is C.NOT_LITERAL:
        found = _ALL - {arg}
    elif op is C.ANY:
        found = _ALL - {10}
    elif op is C.RANGE:
        found = set(range(arg[0], arg[1] + 1))
    elif op is C.CATEGORY:
        found = _CATEGORIES[arg]
    elif op is C.IN:
        inverse = arg[0][0] is C.NEGATE
        found = set().union(*(_bytes(o, a, fold) for o, a in arg[inverse:]))
        return _ALL - found if inverse else found
    else:
        raise ValueError(f"not a regular expression of bytes: {op}")
    return {y for x in found for y in ({x, x ^ 32} if fold and chr(x).isascii() and chr(x).isalpha() else {x})}


@dataclass
class Automaton:
    """next_state[state * n_classes + class_of[byte]]; accepts[state] is a bit mask of the rules with a match that ends there."""

    class_of: np.ndarray
    next_state: np.ndarray
    n_classes: int
    accepts: np.ndarray
    #: after these two classes of bytes, one after the other, the state is known from any state before (-1: it isn't)
    known_after: np.ndarray
    #: the state from which nothing is accepted any more (-1: there is none)
    dead: int = -1

    @cached_property
    def walk(self) -> tuple[list[int], list[int], list[bool]]:
        """The arrays as lists, to go through them byte by byte."""
        return self.class_of.tolist(), self.next_state.tolist(), (self.accepts != 0).tolist()

    def longest(self, data: bytes, at: int, stop: int) -> int:
        """Where the longest match from `at` on ends, -1 if there is none."""
        class_of, step, accepting = self.walk
        state, width, found = 0, self.n_classes, -1
        for i in range(at, stop):
            state = step[state * width + class_of[data[i]]]
            if state == self.dead:
                break
            if accepting[state]:
                found = i + 1
        return found

    def starts(self, data: bytes, lo: int, hi: int) -> list[int]:
        """Of an automaton that reads backwards: the places from which a match starts, the last first."""
        class_of, step, accepting = self.walk
        state, width, found = 0, self.n_classes, []
        for i in range(hi - 1, lo - 1, -1):
            state = step[state * width + class_of[data[i]]]
            if accepting[state]:
                found.append(i)
        return found

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def alphabet(pattern: bytes) -> np.ndarray:
    """Which bytes a match of pattern can hold at all."""
    nfa, tree, used = _Nfa(past_looks=True), P.parse(pattern), np.zeros(256, bool)
    nfa.add(tree, nfa.state(), bool(tree.state.flags & re.IGNORECASE))
    for moves in nfa.moves:
        for chars, _ in moves:
            used[list(chars)] = True
    return used


def compile_rules(patterns: list[bytes], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """One automaton for all patterns.

    anywhere: it finds where matches of each pattern end in a text; else what it has read from its start must be a match.
    backwards: it reads from right to left, so that it finds where matches start.
    """
    nfa = _Nfa()
    start = nfa.state()
    final: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        tree = P.parse(pattern)
        first = nfa.state()
        if not backwards:
            nfa.empty[start].append(first)
            final[nfa.add(tree, first, bool(tree.state.flags & re.IGNORECASE))] = k
            continue
        known = len(nfa.empty)
        last = nfa.add(tree, first, bool(tree.state.flags & re.IGNORECASE))
        # turn all moves of this pattern around
        own = [first, *range(known, len(nfa.empty))]
        empty, moves = {i: nfa.empty[i] for i in own}, {i: nfa.moves[i] for i in own}
        for i in own:
            nfa.empty[i], nfa.moves[i] = [], []
        for i in own:
            for t in empty[i]:
                nfa.empty[t].append(i)
            for chars, t in moves[i]:
                nfa.moves[t].append((chars, i))
        nfa.empty[start].append(last)
        final[first] = k
    signatures: dict[tuple, int] = {}
    sets = [chars for moves in nfa.moves for chars, _ in moves]
    class_of = np.array([signatures.setdefault((b == PART, *(b in s for s in sets)), len(signatures)) for b in range(256)], np.uint8)
    n_classes = len(signatures)
    member = {s: frozenset(class_of[list(s)].tolist()) for s in set(sets)}

    # sets of states are bits of integers; reach[s]: what s reaches by empty moves; step[s]: for each class, what it leads to
    reach = []
    for s in range(len(nfa.empty)):
        todo, seen = [s], {s}
        for x in todo:
            for t in nfa.empty[x]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach.append(sum(1 << t for t in seen))
    step: list[list[tuple[int, int]]] = []
    for moves in nfa.moves:
        to: dict[int, int] = defaultdict(int)
        for chars, t in moves:
            for c in member[chars]:
                to[c] |= reach[t]
        step.append(list(to.items()))
    moving = sum(1 << s for s, x in enumerate(step) if x)

    # subset construction; where a match may begin anywhere the start is in every set
    begin = reach[start]
    always = begin if anywhere else 0
    number, rows, todo = {begin: 0}, [], [begin]
    for subset in todo:
        row, left = [always] * n_classes, subset & moving
        while left:
            low = left & -left
            for c, mask in step[low.bit_length() - 1]:
                row[c] |= mask
            left ^= low
        for found in row:
            if found not in number:
                number[found] = len(number)
                todo.append(found)
        rows.append([number[found] for found in row])
    table = np.array(rows, np.int64)
    accepts = np.array([sum({1 << k for s, k in final.items() if subset >> s & 1}) for subset in todo], np.int64)

    # minimisation by refining the partition until it is stable
    block = np.unique(accepts, return_inverse=True)[1].astype(np.uint64)
    weights = np.random.default_rng(5).integers(1, 1 << 63, n_classes + 1, dtype=np.uint64)  # rows of blocks as 64-bit sums
    while True:
        sums = block * weights[-1] + (block[table] * weights[:-1]).sum(axis=1)
        finer = np.unique(sums, return_inverse=True)[1].astype(np.uint64)
        if finer.max() == block.max():
            break
        block = finer
    # number the blocks so that the start is 0
    block = block.astype(np.int64)
    order = np.unique(block, return_index=True)[1]
    rename = np.zeros(len(order), np.int64)
    rename[np.argsort(order, kind="stable")] = np.arange(len(order))
    keep = np.sort(order)
    table, accepts = rename[block[table[keep]]], accepts[keep]
    known = np.full((n_classes, n_classes), -1, np.int64)
    for a in range(n_classes):
        after = table[np.unique(table[:, a])]
        same = (after == after[0]).all(axis=0)
        known[a, same] = after[0, same]
    # a state from which nothing can be accepted
    dead = [s for s in range(len(table)) if not accepts[s] and (table[s] == s).all()]
    return Automaton(class_of, table.astype(np.int32).ravel(), n_classes, accepts, known.ravel(), dead[0] if dead else -1)


#: Bytes of a lane.
LANE = 1024


def _lanes(auto: Automaton, classes: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes begin, and the state before each.

    A lane begins where two bytes have fixed the state whatever came before. In a long stretch without such a place, as of
    hexadecimal digits, the states are found by going through it byte by byte, which for one lane is faster than array steps.
    """
    n, width = len(classes), auto.n_classes
    if n <= lane:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    known = auto.known_after[classes[:-1] * width + classes[1:]]
    places = np.flatnonzero(known >= 0)
    targets = np.arange(lane, n - 2, lane)
    at = np.searchsorted(places, targets)
    sure = np.append(places, n)[at] - targets < 4 * lane
    sure &= at < len(places)
    begins = {0: 0}
    for p in np.unique(places[at[sure]]).tolist():
        begins[p + 2] = int(known[p])
    for p in targets[~sure].tolist():
        begins.setdefault(p, -1)
    at = np.array(sorted(p for p in begins if p < n), np.int64)
    state = np.array([begins[p] for p in at.tolist()], np.int32)
    open_ = np.flatnonzero(state < 0)
    if len(open_):
        step = auto.walk[1]
        for j in open_.tolist():
            now = int(state[j - 1])
            for c in classes[at[j - 1] : at[j]].tolist():
                now = step[now * width + c]
            state[j] = now
    return at, state


def scan(auto: Automaton, data: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """One pass over data from the start state: the places (after a byte) where rules accept, and the masks of these rules.

    The bytes are cut into lanes, and all lanes step through the transition array together.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = auto.class_of[data].astype(np.int32)
    width = auto.n_classes
    at, state = _lanes(auto, classes, lane)
    length = np.diff(np.append(at, n))
    order = np.argsort(-length, kind="stable")
    at, state, length = at[order], state[order], length[order]
    accepting = auto.accepts != 0
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    found_at, found = [], []
    for step in range(length[0]):
        k = active[step]
        if k < len(at):
            at, state = at[:k], state[:k]
        state = auto.next_state[state * width + classes[at]]
        at = at + 1
        hit = accepting[state]
        if hit.any():
            found_at.append(at[hit])
            found.append(auto.accepts[state[hit]])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, masks = np.concatenate(found_at), np.concatenate(found)
    order = np.argsort(where, kind="stable")
    return where[order], masks[order]
