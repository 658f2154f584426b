"""A combined deterministic automaton for many byte regexes.

Rule regexes become one nondeterministic automaton (unanchored), subset construction over byte classes makes it
deterministic, partition refinement makes it minimal, and its transition array scans all rules in one pass over the
bytes. Texts are cut at bytes that lead every state back to the start, so that numpy can step thousands of pieces at
once without any piece depending on another.

Regex syntax: literals, escapes (\\xHH and \\ before punctuation), classes with ranges, groups, |, and the repeats
? * + {n} {n,} {n,m}. All are over bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


def _parse(regex: str):
    """A syntax tree: ("set", frozenset of bytes), ("cat", items), ("or", items), ("repeat", item, low, high or None)."""
    at = 0

    def more() -> bool:
        return at < len(regex)

    def byte() -> int:
        nonlocal at
        c = regex[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = regex[at]
        at += 1
        if c == "x":
            at += 2
            return int(regex[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def members() -> frozenset:
        nonlocal at
        found, negated = set(), regex[at] == "^"
        at += negated
        while regex[at] != "]":
            low = high = byte()
            if regex[at] == "-" and regex[at + 1] != "]":
                at += 1
                high = byte()
            found |= set(range(low, high + 1))
        at += 1
        return frozenset(set(range(256)) - found if negated else found)

    def atom():
        nonlocal at
        c = regex[at]
        if c == "(":
            at += 1
            inside = either()
            at += 1
            return inside
        if c == "[":
            at += 1
            return "set", members()
        if c == ".":
            at += 1
            return "set", frozenset(range(256)) - {10}
        return "set", frozenset([byte()])

    def repeated():
        nonlocal at
        item = atom()
        while more() and regex[at] in "?*+{":
            c = regex[at]
            at += 1
            if c == "{":
                low, comma, high = regex[at : regex.index("}", at)].partition(",")
                at = regex.index("}", at) + 1
                item = "repeat", item, int(low), (int(high) if high else None) if comma else int(low)
            else:
                item = "repeat", item, int(c == "+"), 1 if c == "?" else None
        return item

    def either():
        nonlocal at
        options = [[]]
        while more() and regex[at] != ")":
            if regex[at] == "|":
                at += 1
                options.append([])
            else:
                options[-1].append(repeated())
        return "or", [("cat", x) for x in options]

    return either()


def folded(regex: str) -> str:
    """A pattern of letters, with each letter in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in regex)


def _reversed(tree):
    kind, rest = tree[0], tree[1:]
    if kind == "cat":
        return "cat", [_reversed(x) for x in reversed(rest[0])]
    if kind == "or":
        return "or", [_reversed(x) for x in rest[0]]
    return ("repeat", _reversed(rest[0]), *rest[1:]) if kind == "repeat" else tree


class _Nfa:
    def __init__(self) -> None:
        self.skips: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.skips.append([])
        self.steps.append(None)
        return len(self.skips) - 1

    def add(self, tree, begin: int) -> int:
        """Builds tree from begin on and returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[begin] = tree[1], end
            return end
        if kind == "cat":
            for x in tree[1]:
                end = self.state()
                self.skips[begin].append(end)
                begin = self.add(x, end)
            return begin
        if kind == "or":
            end = self.state()
            for x in tree[1]:
                first = self.state()
                self.skips[begin].append(first)
                self.skips[self.add(x, first)].append(end)
            return end
        _, item, low, high = tree
        for _ in range(low):
            nxt = self.state()
            self.skips[begin].append(nxt)
            begin = self.add(item, nxt)
        if high is None:
            loop, end = self.state(), self.state()
            self.skips[begin].append(loop)
            inside = self.state()
            self.skips[loop] += [inside, end]
            self.skips[self.add(item, inside)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            nxt = self.state()
            self.skips[begin] += [nxt, end]
            begin = self.add(item, nxt)
        self.skips[begin].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """step[state * classes + class_of[byte]] is the next state; accepts[state] has bit r where rule r ends; state 0 starts."""

    class_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray
    classes: int

    @cached_property
    def plain(self) -> tuple[list[int], list[int], list[int], int]:
        """step, class_of and accepts as lists, and the state that nothing leaves (or -1)."""
        rows = self.step.reshape(-1, self.classes)
        dead = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(1) & (self.accepts == 0))
        return self.step.tolist(), self.class_of.tolist(), self.accepts.tolist(), int(dead[0]) if len(dead) else -1

    @cached_property
    def resets(self) -> np.ndarray:
        """For each byte, whether it leads from every state to the start."""
        return (self.step.reshape(-1, self.classes) == 0).all(0)[self.class_of]


def compile_dfa(trees: list, unanchored: bool = True) -> Dfa:
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for r, tree in enumerate(trees):
        first = nfa.state()
        nfa.skips[start].append(first)
        ends[nfa.add(tree, first)] = r
    again = nfa.closure([start]) if unanchored else frozenset()
    sets = {x[0] for x in nfa.steps if x}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {k: i for i, k in enumerate(dict.fromkeys(signature))}
    class_of = np.array([number[k] for k in signature], np.uint8)
    sample = [signature.index(k) for k in number]

    key = nfa.closure([start])
    known, todo, rows, accepts = {key: 0}, [key], [], []
    for states in todo:  # grows as new state sets turn up
        live = [nfa.steps[x] for x in states if nfa.steps[x]]
        accepts.append(sum({1 << ends[x] for x in states if x in ends}))
        row = []
        for b in sample:
            nxt = nfa.closure([to for chars, to in live if b in chars]) | again
            if nxt not in known:
                known[nxt] = len(known)
                todo.append(nxt)
            row.append(known[nxt])
        rows.append(row)
    step, accepts = np.array(rows), np.array(accepts)
    part, n = np.unique(accepts, return_inverse=True)[1], 0
    while part.max() + 1 > n:  # states stay together while no byte tells them apart
        n = part.max() + 1
        part = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
    order = np.concatenate([[part[0]], np.setdiff1d(np.arange(n), part[0])])
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    first = np.array([np.flatnonzero(part == p)[0] for p in order])
    return Dfa(class_of, rank[part[step[first]]].astype(np.int32).ravel(), accepts[first].astype(np.int64), len(sample))


def scan(dfa: Dfa, data: np.ndarray, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) after which some rule has a match's end, and the accept bits there. data: uint8.

    Pieces begin after a byte that leads to the start from every state, at least `piece` bytes after the last begin, so
    each is scanned from the start state with nothing lost; where no such byte comes, a piece is as long as it takes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    resets = np.flatnonzero(dfa.resets[data]) + 1
    pick = np.searchsorted(resets, np.arange(piece, len(data), piece))
    begins = np.unique(np.concatenate([[0], resets[pick[pick < len(resets)]]]))
    begins = begins[begins < len(data)]
    lengths = np.diff(np.append(begins, len(data)))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    codes, state = dfa.class_of[data], np.zeros(len(begins), np.int32)
    hot, found, bits = dfa.accepts > 0, [], []
    for i, n in enumerate(alive.tolist()):
        if n < 4:
            break
        state[:n] = now = dfa.step[state[:n] * dfa.classes + codes[begins[:n] + i]]
        if (hit := hot[now]).any():
            found.append(begins[:n][hit] + i)
            bits.append(dfa.accepts[now[hit]])
    else:
        i = int(lengths[0])
    table, _, accepts, _ = dfa.plain
    for k in np.flatnonzero(lengths > i).tolist():  # the few longest pieces go on one by one
        s, at, own, what = int(state[k]), int(begins[k]) + i, [], []
        for c in codes[at : int(begins[k] + lengths[k])].tobytes():
            s = table[s * dfa.classes + c]
            if accepts[s]:
                own.append(at)
                what.append(accepts[s])
            at += 1
        found.append(np.array(own, np.int64))
        bits.append(np.array(what, np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, what = np.concatenate(found), np.concatenate(bits)
    order = np.argsort(place, kind="stable")
    return place[order], what[order]


def longest(dfa: Dfa, data: bytes, at: int, stop: int, by: int) -> int:
    """The farthest place up to stop, stepping by +1 or -1 from at, where the anchored automaton accepts; at if none."""
    (table, class_of, accepts, dead), best, s = dfa.plain, at, 0
    while at != stop:
        s = table[s * dfa.classes + class_of[data[at if by > 0 else at - 1]]]
        if s == dead:
            break
        at += by
        if accepts[s]:
            best = at
    return best
