"""Regular expressions over bytes, compiled to minimal deterministic transition arrays.

The accepted syntax: literal characters, \\xNN and \\c escapes, classes with ranges and negation,
groups, alternation, and the quantifiers ? * + {m} {m,} {m,n}.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    """Regex text to a tree of ("set", mask) / ("cat", parts) / ("alt", parts) / ("rep", node, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.take()
            parts.append(self.cat())
        return ("alt", parts)

    def cat(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            q = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q, (0, 0))
            if q == "{":
                body = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(body) + 1
                a, comma, b = body.partition(",")
                low, high = int(a), int(b) if b else (None if comma else int(a))
            node = ("rep", node, low, high)
        return node

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def mask(self, members: set[int]) -> tuple[str, frozenset[int]]:
        if self.fold:
            members = {x for m in members for x in ((m, m ^ 32) if chr(m).isalpha() and m < 128 else (m,))}
        return ("set", frozenset(members))

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.alt()
            self.take()
            return node
        if self.peek() != "[":
            return self.mask({self.byte()})
        self.take()
        negate = self.peek() == "^"
        if negate:
            self.take()
        members: set[int] = set()
        while self.peek() != "]":
            a = self.byte()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                members |= set(range(a, self.byte() + 1))
            else:
                members.add(a)
        self.take()
        return self.mask(set(range(256)) - members if negate else members)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, node, start: int) -> int:
        """Wires node from start; the state in which it ends."""
        kind = node[0]
        if kind == "set":
            mid, end = self.state(), self.state()
            self.empty[start].append(mid)
            self.on[mid] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                branch = self.state()
                self.empty[start].append(branch)
                self.empty[self.add(part, branch)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop, end]
            self.empty[self.add(inner, loop)] += [loop, end]
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end


class Dfa:
    """table[state * width + classes[byte]] is the next state times width; accepts[state] is a bit per rule."""

    def __init__(self, rules: list[tuple[str, bool]], search: bool):
        """rules: patterns, and whether letters match in either case. search: matches may start anywhere."""
        nfa = _Nfa()
        start = nfa.state()
        final: dict[int, int] = {}
        for k, (pattern, fold) in enumerate(rules):
            own = nfa.state()
            nfa.empty[start].append(own)
            end = nfa.add(_Parser(pattern, fold).alt(), own)
            final[end] = final.get(end, 0) | 1 << k
        marks = np.zeros((256, 0), dtype=bool)
        sets = sorted({x[0] for x in nfa.on if x}, key=sorted)
        if sets:
            marks = np.array([[b in s for s in sets] for b in range(256)])
        kinds, self.classes = np.unique(marks, axis=0, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.uint8)
        self.width = len(kinds) + 1  # and padding, on which a state stays
        sample = [int(np.flatnonzero(self.classes == k)[0]) for k in range(len(kinds))]

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for q in nfa.empty[todo.pop()]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            return frozenset(q for q in seen if nfa.on[q] or q in final)

        root = closed({start})
        ids, order, rows = {root: 0}, [root], []
        for subset in order:  # grows
            moves = [nfa.on[q] for q in subset if nfa.on[q]]
            row = []
            for b in sample:
                to = closed({q for s, q in moves if b in s}) | (root if search else frozenset())
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
            rows.append(row)
        accepts = np.array([sum(final[q] for q in s if q in final) if len(s & final.keys()) < 2 else int(np.bitwise_or.reduce([final[q] for q in s if q in final])) for s in order], dtype=np.int64)
        self._minimise(np.array(rows, dtype=np.int64).reshape(len(order), len(kinds)), accepts, np.array([not s for s in order]))

    def _minimise(self, step: np.ndarray, accepts: np.ndarray, dead: np.ndarray) -> None:
        """Merges states that no input tells apart, by refining classes until they are stable."""
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        first = np.unique(block, return_index=True)[1]
        rank = np.argsort(np.argsort(first))  # the start state becomes 0
        number = rank[block]
        keep = np.sort(first)
        table = np.column_stack([number[step[keep]], np.arange(len(keep))]).astype(np.int32)
        self.table = (table * self.width).ravel()
        self.accepts = accepts[keep]
        stuck = (table[:, :-1] == np.arange(len(keep))[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) * self.width if stuck.any() else -1

    @property
    def pad(self) -> int:
        return self.width - 1
