"""Regular expressions compiled to one deterministic automaton over bytes.

A rule is parsed to a position automaton, all rules together are determinised by subset
construction over byte classes, and the result is minimised by partition refinement. The
outcome is a transition array, a byte-class array and, for each state, the set of rules
that accept there as a bit mask.

Syntax: literals, escapes (\\. \\xHH and such), classes, groups, |, and the repeats ?, *,
+, {n}, {n,} and {n,m}. Rules match bytes; case is folded for ASCII letters on request.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Nfa:
    """Edges on byte sets and on nothing, from one start to one end."""

    moves: list[list[tuple[frozenset[int], int]]]
    free: list[list[int]]

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


class Parser:
    def __init__(self, pattern: str, nfa: Nfa, fold: bool):
        self.p, self.i, self.nfa, self.fold = pattern, 0, nfa, fold

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def whole(self):
        tree = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} in {self.p!r}")
        return tree

    def either(self):
        parts = [self.chain()]
        while self.peek() == "|":
            self.take()
            parts.append(self.chain())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def chain(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low, _, high = (spec := self.p[self.i : self.p.index("}", self.i)]).partition(",")
                self.i += len(spec) + 1
                bounds = (int(low), int(high) if high else (None if "," in spec else int(low)))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, *bounds)
        return tree

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.either()
            if self.take() != ")":
                raise ValueError("missing )")
            return tree
        if c == "[":
            return ("set", self.charset())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({self.escape() if c == "\\" else ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def charset(self) -> frozenset[int]:
        flip = self.peek() == "^"
        if flip:
            self.take()
        out: set[int] = set()
        one = lambda: self.escape() if (c := self.take()) == "\\" else ord(c)
        while self.peek() != "]":
            low = high = one()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                high = one()
            out |= set(range(low, high + 1))
        self.take()
        out = set(self.folded(out))
        return frozenset(set(range(256)) - out if flip else out)

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(x) for b in found if b < 128 and chr(b).isalpha() for x in (chr(b).lower(), chr(b).upper())}
        return frozenset(found)


def build(tree, nfa: Nfa, start: int, backward: bool) -> int:
    """Adds tree to nfa from start and returns its end; backward: for texts read from the end."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "cat":
        for part in reversed(tree[1]) if backward else tree[1]:
            start = build(part, nfa, start, backward)
        return start
    if kind == "or":
        ends, end = [build(part, nfa, start, backward) for part in tree[1]], nfa.state()
        for e in ends:
            nfa.free[e].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        start = build(part, nfa, start, backward)
    if high is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[build(part, nfa, loop, backward)].append(loop)
        out = nfa.state()
        nfa.free[loop].append(out)
        return out
    out = nfa.state()
    nfa.free[start].append(out)
    for _ in range(high - low):
        start = build(part, nfa, start, backward)
        nfa.free[start].append(out)
    return out


@dataclass(frozen=True)
class Automaton:
    """step[state * classes + byte class] gives the next state; state 0 is the start.

    accepts: bit r of a state is set when rule r ends there. dead: the state that nothing
    leaves and nothing accepts, or -1.
    """

    step: np.ndarray
    byte_class: np.ndarray
    classes: int
    accepts: np.ndarray
    dead: int


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool, backward: bool = False) -> Automaton:
    """One minimal automaton for all (pattern, fold case) rules.

    anywhere: a match may begin at any byte, so the automaton never has to be restarted.
    """
    nfa = Nfa([], [])
    start, ends = nfa.state(), []
    for pattern, fold in rules:
        own = nfa.state()
        nfa.free[start].append(own)
        ends.append(build(Parser(pattern, nfa, fold).whole(), nfa, own, backward))

    # Bytes that no rule tells apart share a class.
    sets = {s for moves in nfa.moves for s, _ in moves}
    signature: dict[tuple[bool, ...], int] = {}
    byte_class = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)], np.uint8)
    classes = len(signature)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(classes)]

    def closure(found: frozenset[int]) -> frozenset[int]:
        out, todo = set(found), list(found)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    begin = closure(frozenset([start]))
    number, order, table = {begin: 0}, [begin], []
    for states in order:  # grows
        row = []
        for b in sample:
            to = closure(frozenset(t for s in states for chars, t in nfa.moves[s] if b in chars))
            to = to | begin if anywhere else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    step = np.array(table, np.int64)
    accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in s) for s in order], np.int64)

    # Refinement until no class of states splits.
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        key = np.column_stack([group, group[step]])
        _, first, new = np.unique(key, axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if new.max() == group.max():
            break
        group = new
    # The start's class becomes state 0.
    rename = np.arange(group.max() + 1)
    rename[[0, group[0]]] = rename[[group[0], 0]]
    group = rename[group]
    leader = np.zeros(group.max() + 1, np.int64)
    leader[group[::-1]] = np.arange(len(group))[::-1]
    small, acc = group[step[leader]], accepts[leader]
    dead = [s for s in range(len(small)) if not acc[s] and (small[s] == s).all()]
    return Automaton(small.astype(np.int32).ravel() * classes, byte_class, classes, acc, dead[0] * classes if dead else -1)


def scan(auto: Automaton, data: np.ndarray, lane: int = 512) -> np.ndarray:
    """For each byte the mask of the rules that accept after it, in one pass of all rules.

    data is cut into lanes which advance together, each from the start state; lanes whose
    true first state differs are then run on until they meet the states already found.
    """
    n = len(data)
    lanes = max(1, -(-n // lane))
    padded = np.zeros(lanes * lane, np.uint8)
    padded[:n] = auto.byte_class[data]
    columns = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    states = np.empty((lane, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for j in range(lane):
        now = auto.step[now + columns[j]]
        states[j] = now
    held = states.T.ravel() if lanes > 1 else states[:, 0]
    held = np.ascontiguousarray(held)
    at = 1
    wrong = np.flatnonzero(held[lane - 1 : lanes * lane - 1 : lane] != 0) + 1
    for k in wrong:  # in order: a lane set right may set the next one wrong, which is met when at reaches it
        at = k * lane
        s = int(held[at - 1])
        while at < n:
            s = int(auto.step[s + int(padded[at])])
            if s == held[at]:
                break
            held[at] = s
            at += 1
    return auto.accepts[held[:n] // auto.classes]
