"""Regular expressions over bytes, compiled to one deterministic automaton.

The syntax is literals, ``[...]`` classes, groups, ``|``, ``?``, ``*``, ``+`` and
``{m}``, ``{m,}``, ``{m,n}``. Subset construction over all rules at once, then Moore's
minimisation, give one transition array for the whole rule set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def parse(pattern: str) -> tuple:
    """A tree of ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, most)."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped() -> int:
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one() -> int:
        c = take()
        return escaped() if c == "\\" else ord(c)

    def charset() -> tuple:
        out, negated = set(), peek() == "^"
        if negated:
            take()
        while peek() != "]":
            low = high = one()
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                high = one()
            out |= set(range(low, high + 1))
        take()
        return ("set", frozenset(set(range(256)) - out if negated else out))

    def atom() -> tuple:
        c = take()
        if c == "(":
            out = alternatives()
            take()
            return out
        if c == "[":
            return charset()
        return ("set", frozenset({escaped() if c == "\\" else ord(c)}))

    def repeated() -> tuple:
        out = atom()
        while peek() in tuple("?*+{"):
            c = take()
            if c == "{":
                close = pattern.index("}", at)
                low, comma, high = pattern[at:close].partition(",")
                nonlocal_skip(close + 1)
                out = ("rep", out, int(low), int(high) if high else None if comma else int(low))
            else:
                out = ("rep", out, int(c == "+"), 1 if c == "?" else None)
        return out

    def nonlocal_skip(to: int) -> None:
        nonlocal at
        at = to

    def sequence() -> tuple:
        parts = []
        while peek() not in ("", "|", ")"):
            parts.append(repeated())
        return ("cat", parts)

    def alternatives() -> tuple:
        parts = [sequence()]
        while peek() == "|":
            take()
            parts.append(sequence())
        return ("alt", parts)

    return alternatives()


def reverse(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return (kind, [reverse(x) for x in (tree[1] if kind == "alt" else tree[1][::-1])])


class _Nfa:
    """Thompson's construction: empty moves, and one set of bytes with a target at most."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def build(self, tree: tuple, start: int) -> int:
        """Add tree after start; returns its end."""
        kind = tree[0]
        if kind == "set":
            end, mid = self.state(), self.state()
            self.empty[start].append(mid)
            self.move[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            first = self.state()
            self.empty[start].append(first)
            start = self.build(part, first)
        self.empty[start].append(end)
        return end


@dataclass
class Automaton:
    """classes[byte] and next[state, class]; accepts[state], a bit for each rule; state 0 is the start, dead the state that no byte leaves (-1: none)."""

    classes: bytes
    next: np.ndarray
    accepts: np.ndarray
    dead: int

    def rows(self) -> tuple[bytes, list]:
        """The class of each byte, and the start's row; a row holds the next row for each class, then the rules accepted (-2) and whether it is dead (-1)."""
        rows: list[list] = [[] for _ in self.accepts]
        for k, row in enumerate(rows):
            row.extend(rows[x] for x in self.next[k].tolist())
            row += [int(self.accepts[k]), k == self.dead]
        return self.classes, rows[0]


def compile_rules(trees: list[tuple], search: bool) -> Automaton:
    """One minimal automaton for all rules; with search, rules may start at any byte."""
    nfa = _Nfa()
    start, final = nfa.state(), {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        final[nfa.build(tree, first)] = 1 << k

    def closure(states: frozenset) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.move[x] or x in final)

    base = closure(frozenset({start}))
    sets = {m[0] for m in nfa.move if m}
    by_use: dict[tuple, list[int]] = {}
    for b in range(256):
        by_use.setdefault(tuple(b in s for s in sets), []).append(b)
    classes = list(by_use.values())  # bytes that no rule tells apart
    found, todo, moves = {base: 0}, [base], []
    while todo:
        here, row = todo.pop(0), []
        for group in classes:
            to = frozenset(nfa.move[x][1] for x in here if nfa.move[x] and group[0] in nfa.move[x][0])
            to = closure(to) | (base if search else frozenset())
            if to not in found:
                found[to] = len(found)
                todo.append(to)
            row.append(found[to])
        moves.append(row)
    accepts = np.array([sum({final[x] for x in s if x in final}) for s in found], np.int64)
    table = np.array(moves)
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # Moore: split blocks until no byte tells two of their states apart
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = {b: k for k, b in enumerate(dict.fromkeys(block.tolist()))}  # the start's block is first
    first = [int(np.flatnonzero(block == b)[0]) for b in order]
    small = np.vectorize(order.get)(block[table[first]])
    accepts = accepts[first]
    dead = [k for k in range(len(first)) if not accepts[k] and (small[k] == k).all()]
    place = {b: k for k, group in enumerate(classes) for b in group}
    return Automaton(bytes(place[b] for b in range(256)), small, accepts, dead[0] if dead and not search else -1)
