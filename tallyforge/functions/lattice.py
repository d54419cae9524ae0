"""Readings of a garbled equation as paths of a lattice.

Between the characters of a text lie nodes, each edge is one way to read what stands between two of them, with a cost: as
it is, as a glyph that looks like it, with a sign that was lost or with a sign that may be wrong. A path is a reading.
Nodes are told apart by what decides whether a path can still be an equation: the letters read so far, the equals
signs, whether a loose edge was taken and where a bracket has to close. For each node the costs that a path from it can
have are kept as the bits of an integer, so that paths of one cost are listed without dead ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

#: Fixed values of our own: what a sign is misread for, signs of the same shape together.
LOOKALIKES = {"0": "OoQD", "1": "lI|!i", "2": "Zz", "4": "A", "5": "Ss", "6": "bG", "7": "?", "8": "Bß", "9": "gq", "-": "—–~", "=": "|lI", "+": "Tt", "": "Tt"}
#: Costs of a glyph read for another, of a sign put in or brackets set, and of a sign turned.
GLYPH, SIGN, TURN = 1, 2, 4
#: Readings cost at most this much more than the cheapest one.
BUDGET = 6
PLAIN = frozenset("0123456789.+-*/^()= ;,\n")
DIGIT_FOR = {g: d for d, glyphs in LOOKALIKES.items() if d.isdigit() for g in glyphs} | {d: d for d in "0123456789"}


class Edge(NamedTuple):
    end: int
    text: str
    cost: int
    loose: bool = False
    #: Where a bracket that this edge opens has to close; 0 for none.
    close: int = 0


class Node(NamedTuple):
    at: int
    letters: frozenset
    equals: int
    loose: bool
    close: int


def edges(text: str) -> list[list[Edge]]:
    """The edges that leave each place of a text."""
    out: list[list[Edge]] = [[] for _ in text]
    numeric = [c in DIGIT_FOR for c in text]
    for i, c in enumerate(text):
        if c in PLAIN or c.isascii() and c.isalpha():
            out[i].append(Edge(i + 1, c, 0))
        out[i] += [Edge(i + 1, plain, GLYPH) for plain, glyphs in LOOKALIKES.items() if c in glyphs]
        turned = {"+": "-", "-": "+", "*": "/", "/": "*"}.get(c)
        if turned:
            out[i].append(Edge(i + 1, turned, TURN, True))
        if c.isalpha() and text[i + 1 : i + 2] == "2" and not text[i + 2 : i + 3].isdigit():
            out[i].append(Edge(i + 1, f"{c}^", SIGN))
    _lost_points(text, numeric, out)
    _lost_signs(text, out)
    _lost_brackets(text, out)
    _right_side(text, out)
    return out


def _lost_points(text: str, numeric: list[bool], out: list[list[Edge]]) -> None:
    """A decimal point between the two digits of a number that has no more of them."""
    for i in range(len(text) - 1):
        apart = (i == 0 or not numeric[i - 1] and text[i - 1] != ".") and (i + 2 >= len(text) or not numeric[i + 2] and text[i + 2] != ".")
        if numeric[i] and numeric[i + 1] and apart:
            out[i] += [Edge(e.end, f"{e.text}.", e.cost + SIGN) for e in list(out[i]) if e.text.isdigit()]


def _lost_signs(text: str, out: list[list[Edge]]) -> None:
    """A sign in a gap between two operands, or a point where both are digits."""
    i = 0
    while i < len(text):
        end = i
        while end < len(text) and text[end] == " ":
            end += 1
        if 0 < i < end < len(text):
            left, right = text[i - 1], text[end]
            if (left.isalnum() or left in ")?") and (right.isalnum() or right in "(?|"):
                out[i] += [Edge(end, f" {sign} ", SIGN) for sign in "+-*="]
                if left in DIGIT_FOR and right in DIGIT_FOR:
                    out[i].append(Edge(end, ".", GLYPH))
        i = max(end, i + 1)


def _lost_brackets(text: str, out: list[list[Edge]]) -> None:
    """Brackets around the sum of two operands that follows a slash."""
    operand = lambda at: next((k for k in range(at, len(text)) if not (text[k].isalnum() or text[k] in ".?")), len(text))
    skip = lambda at: next((k for k in range(at, len(text)) if text[k] != " "), len(text))
    for i in (i for i, c in enumerate(text) if c == "/"):
        first = skip(i + 1)
        sign = skip(operand(first))
        second = skip(sign + 1)
        close = operand(second)
        if first < operand(first) and text[sign : sign + 1] in ("+", "-") and second < close:
            out[first] += [e._replace(text=f"({e.text}", cost=e.cost + SIGN, close=close) for e in list(out[first]) if not e.close and not e.loose]


def _right_side(text: str, out: list[list[Edge]]) -> None:
    """The sign of a number that is all of the right side."""
    left, equals, right = text.rpartition("=")
    number = right.strip().removeprefix("-").strip()
    if equals and number and all(c in DIGIT_FOR or c == "." for c in number):
        at = len(left) + 1 + len(right) - len(right.lstrip())
        if text[at] == "-":
            out[at].append(Edge(at + 1, "", TURN, True))
        else:
            out[at] += [Edge(e.end, f"-{e.text}", e.cost + TURN, True) for e in list(out[at]) if e.text[:1].isdigit()]


def limits(text: str) -> tuple[int, int]:
    """Letters and equals signs that a reading can have: one each, or two where the text is parted."""
    return (2, 2) if re.search(r"[;,\n]|\band\b", text) else (1, 1)


@lru_cache(4096)
def letters_of(read: str) -> frozenset:
    return frozenset(c.lower() if c in "XY" else c for c in read if c.isalpha())


class Lattice:
    def __init__(self, text: str):
        # 'and' between two equations is no product of letters
        self.text = re.sub(r"\s*\band\b\s*", ", ", text)
        self.edges = edges(self.text)
        self.most_letters, self.most_equals = limits(text)
        self.start = Node(0, frozenset(), 0, False, 0)
        #: Of each node: the cost, the next node and what is read of each edge that leads to an end.
        self.next: dict[Node, list[tuple[int, Node, str]]] = {}
        self.costs = self._costs()

    def step(self, node: Node, edge: Edge) -> tuple[Node, str] | None:
        """The node behind an edge and the text read on the way; None if no equation can come of it."""
        more = letters_of(edge.text)
        letters = node.letters if more <= node.letters else node.letters | more
        equals = node.equals + edge.text.count("=")
        close = node.close or edge.close
        if len(letters) > self.most_letters or equals > self.most_equals or node.loose and edge.loose or node.close and (edge.close or edge.end > node.close):
            return None
        closes = close and edge.end == close
        return Node(edge.end, letters, equals, node.loose or edge.loose, 0 if closes else close), edge.text + (")" if closes else "")

    def _costs(self) -> dict[Node, int]:
        """Bit k of a node's number: a path of cost k leads from it to the end."""
        places: list[dict[Node, list[tuple[int, Node, str]]]] = [{} for _ in range(len(self.text) + 1)]
        places[0][self.start] = []
        for at, nodes in enumerate(places[:-1]):
            for node, steps in nodes.items():
                for edge in self.edges[at]:
                    after = self.step(node, edge)
                    if after:
                        steps.append((edge.cost, *after))
                        places[after[0].at].setdefault(after[0], [])
        out: dict[Node, int] = {n: 1 for n in places[-1] if n.equals and n.letters}
        for nodes in reversed(places[:-1]):
            for node, steps in nodes.items():
                self.next[node] = [s for s in steps if s[1] in out]
                bits = 0
                for cost, after, _ in self.next[node]:
                    bits |= out[after] << cost
                if bits:
                    out[node] = bits
        return out

    def least(self) -> int | None:
        """The cost of the cheapest reading that can be an equation; None if there is none."""
        bits = self.costs.get(self.start, 0)
        return (bits & -bits).bit_length() - 1 if bits else None

    def paths(self, cost: int) -> Iterator[tuple[str, bool]]:
        """(reading, loose) of all paths of one cost."""
        stack: list[tuple[Node, int, str]] = [(self.start, cost, "")] if self.costs.get(self.start, 0) >> cost & 1 else []
        while stack:
            node, left, read = stack.pop()
            if node.at == len(self.text):
                yield " ".join(read.split()), node.loose
                continue
            for spent, after, text in self.next[node]:
                if spent <= left and self.costs[after] >> (left - spent) & 1:
                    stack.append((after, left - spent, read + text))
