"""Recognisers for context-free grammars, as automata whose transitions are made when they are first needed.

A grammar is a text of rules in EBNF. Each rule becomes a small network of nodes; a configuration is a node and what to return to; a state is the set
of all configurations that a text read so far allows, so no choice has to be made and none undone. States are interned and moves kept: a token costs a
look-up after its first time.

What stands between brackets is recognised on its own: at an opening bracket the state is put aside, and a state starts that knows nothing but the
places after the bracket in the rules. At the closing one it tells from which place to which it came. So the number of states depends on what occurs at
one level of brackets, not on how deep they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

BAD = -1
OPENING, CLOSING = frozenset("([{"), frozenset(")]}")

_ITEM = re.compile(r"\s*(?:'([^']+)'|([A-Za-z_]\w*)|([()|*+?]))")

class Exhausted(Exception):
    """A text of which a grammar allows too many readings at once to follow them all."""


MOST = 30_000  # configurations of a state

Config = tuple  # (node, parent): parent is another configuration to return to, or ("base", node)


class Grammar:
    """rules: lines ``name = alternatives``; words in quotes and in capitals are tokens. classes: what a token in capitals stands for besides itself. opening
    and closing: further tokens that stand around something like brackets; a rule with the one has the other as well."""

    def __init__(self, rules: str, start: str, classes: dict[str, Iterable[str]] | None = None, opening: Iterable[str] = (), closing: Iterable[str] = ()):
        self.opening, self.closing = OPENING | set(opening), CLOSING | set(closing)
        self.classes = {k: [k, *v] for k, v in (classes or {}).items()}
        self.edges: list[list[tuple[str, object, int]]] = []
        self.starts: dict[str, int] = {}
        self.ends: set[int] = set()
        texts: dict[str, str] = {}
        for line in re.split(r"\n(?=\w+ =)", rules.strip()):
            name, text = line.split(" =", 1)
            texts[name.strip()] = text
        for name in texts:
            self.starts[name] = self._node()
        for name, text in texts.items():
            self.items = [m.groups() for m in _ITEM.finditer(text)]
            self.at = 0
            end = self._node()
            self._choice(self.starts[name], end)
            if self.at != len(self.items):
                raise ValueError(f"rule {name}: {self.items[self.at]}")
            self.ends.add(end)
        self.empty_ends = self._skips()
        base = self._closure({(self.starts[start], None)})
        self.states: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, object]] = []
        self.start = self._id(base)
        self.outers: dict[frozenset, int] = {}
        self.outer_list: list[dict[int, list]] = []
        self.pops: dict[tuple, int] = {}

    # networks of nodes

    def _node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _choice(self, a: int, b: int) -> None:
        while True:
            self._sequence(a, b)
            if self.at < len(self.items) and self.items[self.at][2] == "|":
                self.at += 1
                continue
            return

    def _sequence(self, a: int, b: int) -> None:
        at = a
        while self.at < len(self.items) and self.items[self.at][2] not in ("|", ")"):
            word, name, sign = self.items[self.at]
            self.at += 1
            left, right = self._node(), self._node()
            if sign == "(":
                self._choice(left, right)
                self.at += 1
            elif word is not None:
                self.edges[left].append(("t", word, right))
            elif name.isupper():
                for w in self.classes.get(name, [name]):
                    self.edges[left].append(("t", w, right))
            else:
                if name not in self.starts:
                    raise ValueError(f"no rule {name}")
                self.edges[left].append(("n", name, right))
            self.edges[at].append(("e", None, left))
            if self.at < len(self.items) and self.items[self.at][2] in ("*", "+", "?"):
                sign = self.items[self.at][2]
                self.at += 1
                if sign in "*?":
                    self.edges[left].append(("e", None, right))
                if sign in "*+":
                    self.edges[right].append(("e", None, left))
            at = right
        self.edges[at].append(("e", None, b))

    def _skips(self) -> set[int]:
        """Nodes from which nothing but the end of the rule comes, so that no return to them is needed."""
        out = set(self.ends)
        while True:
            more = {i for i, es in enumerate(self.edges) if i not in out and es and all(k == "e" and t in out for k, _, t in es)}
            if not more:
                return out
            out |= more

    # configurations

    def _closure(self, configs: Iterable[Config]) -> frozenset:
        seen: set[Config] = set()
        todo = list(configs)
        while todo:
            c = todo.pop()
            if c in seen:
                continue
            seen.add(c)
            if len(seen) > MOST:
                raise Exhausted
            node, parent = c
            if node in self.ends:
                if parent is not None and parent[0] != "base":
                    todo.append(parent)
                continue
            for kind, what, target in self.edges[node]:
                if kind == "e":
                    todo.append((target, parent))
                elif kind == "n":
                    todo.append((self.starts[what], parent if target in self.empty_ends else (target, parent)))
        return frozenset(c for c in seen if c[0] in self.ends and c[1] is None or any(k == "t" for k, _, _ in self.edges[c[0]]))

    def _id(self, configs: frozenset) -> int:
        if not configs:
            return BAD
        i = self.ids.get(configs)
        if i is None:
            i = self.ids[configs] = len(self.states)
            self.states.append(configs)
            self.moves.append({})
        return i

    def _after(self, s: int, token: str) -> set[Config]:
        return {(target, parent) for node, parent in self.states[s] for kind, what, target in self.edges[node] if kind == "t" and what == token}

    def _move(self, s: int, token: str) -> object:
        after = self._after(s, token)
        if token in self.opening:
            if not after:
                return BAD
            outer: dict[int, list] = {}
            for node, parent in after:
                outer.setdefault(node, []).append(parent)
            key = frozenset(after)
            o = self.outers.get(key)
            if o is None:
                o = self.outers[key] = len(self.outer_list)
                self.outer_list.append(outer)
            inner = self._id(self._closure({(n, ("base", n)) for n in outer}))
            return (inner, o) if inner != BAD else BAD
        if token in self.closing:
            came = frozenset((parent[1], target) for target, parent in after if parent is not None and parent[0] == "base")
            return came or BAD
        if token == "?NL":  # a line end that may be left out or end something
            return self._id(self.states[s] | self._closure(self._after(s, "NL")))
        return self._id(self._closure(after))

    def accepts(self, s: int) -> bool:
        return any(node in self.ends and parent is None for node, parent in self.states[s])

    def run(self, tokens: Iterable[str]) -> int | None:
        """None if the tokens are a sentence, else the number of the first token that can't follow, or -1 if more should come."""
        moves, s, stack = self.moves, self.start, []
        n = -1
        for n, t in enumerate(tokens):
            m = moves[s].get(t)
            if m is None:
                m = moves[s][t] = self._move(s, t)
            if m.__class__ is int:
                if m == BAD:
                    return n
                s = m
            elif m.__class__ is tuple:
                s, o = m
                stack.append(o)
            else:
                if not stack:
                    return n
                key = (stack.pop(), m)
                s = self.pops.get(key)
                if s is None:
                    outer = self.outer_list[key[0]]
                    s = self.pops[key] = self._id(self._closure({(to, parent) for came, to in m for parent in outer.get(came, ())}))
                if s == BAD:
                    return n
        return None if not stack and self.accepts(s) else -1
