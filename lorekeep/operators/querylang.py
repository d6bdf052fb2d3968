"""Keyword queries: terms, phrases, required and excluded parts, groups, boosts.

``a b`` asks for either, ``+a`` requires, ``-a`` and ``NOT a`` exclude; ``AND`` binds closer than ``OR``;
``"a b"`` is a phrase, ``(...)`` a group, ``^2`` a boost, ``*`` every chunk, ``body:`` the one field.
What a word's text has several terms of is a phrase of them; what has none is left out. A query that
is empty asks for nothing; one that is malformed, or excludes only, raises ``QueryError``.

A parsed query is evaluated twice by the same rules: on what a block of postings can hold at most,
and on what a chunk holds. Both are columns, so a query is one aggregation however it is nested.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of over so many bytes are in no index.
MOST_BYTES = 40
_TERM = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r'\s+|(?P<phrase>"[^"]*")|(?P<open>\()|(?P<close>\))|(?P<boost>\^[0-9]+(?:\.[0-9]+)?)|(?P<sign>[+-](?=\S))|(?P<word>[^\s()"^]+)')


class QueryError(ValueError):
    """A query that can't be understood."""


@dataclass(frozen=True)
class Leaf:
    """Terms next to each other; without terms: every chunk."""

    terms: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    must: tuple[Leaf | Group, ...] = ()
    should: tuple[Leaf | Group, ...] = ()
    never: tuple[Leaf | Group, ...] = ()
    boost: float = 1.0


Node = Leaf | Group
NOTHING = Group()


def terms_of(text: str) -> tuple[str, ...]:
    """As ``functions.text.search_terms`` has them."""
    return tuple(t for t in _TERM.findall(text.lower()) if len(t.encode()) <= MOST_BYTES)


def _tokens(query: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at]!r} at {at}")
        if m.lastgroup:
            found.append((m.lastgroup, m[0]))
        at = m.end()
    return found


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.at = _tokens(query), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def group(self) -> Node:
        """Clauses up to the end or a closing bracket. Runs joined by AND are groups of required clauses."""
        clauses: list[tuple[str, Node | None]] = []  # sign, what; None: it had no terms
        joined = False  # the clause before is part of a run
        while self.peek()[0] not in ("end", "close"):
            kind, text = self.peek()
            operator = text if kind == "word" and text in ("AND", "OR") else ""
            if operator:
                self.take()
                if not clauses or self.peek()[0] in ("end", "close") or self.peek()[1] in ("AND", "OR"):
                    raise QueryError(f"{operator} needs a clause on either side")
            sign, node = self.clause()
            if operator == "AND":
                before = clauses.pop()
                parts = [*before[1].parts] if joined and isinstance(before[1], _Run) else [before]
                clauses.append(("", _Run([*parts, (sign, node)])))
            else:
                clauses.append((sign, node))
            joined = operator == "AND"
        return _made([(s, n.made() if isinstance(n, _Run) else n) for s, n in clauses])

    def clause(self) -> tuple[str, Node | None]:
        kind, text = self.take()
        sign = ""
        if kind == "word" and text == "NOT":
            sign = "-"
            kind, text = self.take()
        while kind == "sign":
            sign = "-" if "-" in (sign, text) else "+"
            kind, text = self.take()
        if kind == "open":
            node: Node | None = self.group()
            if self.take()[0] != "close":
                raise QueryError("a bracket is not closed")
            node = None if node == NOTHING else node
        elif kind == "phrase":
            node = _leaf(text[1:-1])
        elif kind == "word" and text not in ("AND", "OR", "NOT"):
            name, colon, rest = text.partition(":")
            if colon and re.fullmatch(r"[A-Za-z_]+", name):
                if name != "body":
                    raise QueryError(f"no field {name!r}")
                if not rest and self.peek()[0] == "phrase":
                    rest = self.take()[1][1:-1]
                text = rest
            node = Leaf(()) if text == "*" else _leaf(text)
        else:
            raise QueryError(f"unexpected {text or 'end'!r}")
        if self.peek()[0] == "boost":
            boost = float(self.take()[1][1:])
            node = node and type(node)(**{**node.__dict__, "boost": node.boost * boost})
        return sign, node


@dataclass
class _Run:
    parts: list[tuple[str, Node | None]]

    def made(self) -> Node | None:
        node = _made([("-" if s == "-" else "+", n) for s, n in self.parts])
        return None if node == NOTHING else node


def _leaf(text: str) -> Leaf | None:
    terms = terms_of(text)
    return Leaf(terms) if terms else None


def _made(clauses: list[tuple[str, Node | None]]) -> Node:
    of = lambda sign: tuple(n for s, n in clauses if s == sign and n is not None)
    must, should, never = of("+"), of(""), of("-")
    if never and not must and not should:
        raise QueryError("a query that only excludes has no answer")
    if not never and len(must) + len(should) == 1:
        return (must + should)[0]
    return Group(must, should, never)


def parse(query: str) -> Node:
    parser = _Parser(query)
    node = parser.group()
    if parser.peek()[0] != "end":
        raise QueryError("a bracket is closed that none opened")
    return node


def leaves(node: Node) -> list[Leaf]:
    """Distinct leaves, whatever their boosts."""
    found = [Leaf(node.terms)] if isinstance(node, Leaf) else [x for part in (*node.must, *node.should, *node.never) for x in leaves(part)]
    return list(dict.fromkeys(found))


def matched(node: Node, has: dict[Leaf, Column], possibly: bool = False) -> Column:
    """Whether the node matches, from what each leaf does. possibly: leaves that may match, so nothing is excluded."""
    if isinstance(node, Leaf):
        return has[Leaf(node.terms)]
    of = lambda parts: [matched(p, has, possibly) for p in parts]
    found = reduce(and_, of(node.must)) if node.must else reduce(or_, of(node.should), F.lit(False))
    return found if possibly or not node.never else reduce(and_, (~c for c in of(node.never)), found)


def scored(node: Node, score: dict[Leaf, Column], has: dict[Leaf, Column], possibly: bool = False) -> Column:
    """The sum of the scores of what matches; 0 where the node does not. possibly: of leaves that may match."""
    if isinstance(node, Leaf):
        return F.when(has[Leaf(node.terms)], score[Leaf(node.terms)] * node.boost).otherwise(0.0)
    parts = reduce(add, (scored(p, score, has, possibly) for p in (*node.must, *node.should)), F.lit(0.0))
    return F.when(matched(node, has, possibly), parts * node.boost).otherwise(0.0)
