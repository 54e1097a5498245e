"""The tag filter language: text -> syntax tree -> one boolean Column over a map of tags.

    filter  := '*' | or
    or      := and ('OR' and)*
    and     := not ('AND' not)*
    not     := '!' not | '(' or ')' | term
    term    := key ':' value | key ':' prefix '*' | key ':' '[' value (',' value)* ']'

Keys are letters, ``_`` and ``-``; values also digits and ``.``. ``*`` alone selects every series. The list
form is an extension, accepted with ``sets=True``. Anything else is an :class:`InvalidQuery`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from chronoloom.errors import InvalidQuery


class Node:
    """A filter. ``to_column(tags)`` is true or false for every row, never null."""

    def to_column(self, tags: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class AllStar(Node):
    def to_column(self, tags: Column) -> Column:
        return F.lit(True)

    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Eq(Node):
    key: str
    value: str

    def to_column(self, tags: Column) -> Column:
        return F.coalesce(F.try_element_at(tags, F.lit(self.key)) == F.lit(self.value), F.lit(False))

    def __str__(self) -> str:
        return f"{self.key}:{self.value}"


@dataclass(frozen=True)
class Wildcard(Node):
    """The tag begins with ``prefix``; the empty prefix asks for the key alone."""

    key: str
    prefix: str

    def to_column(self, tags: Column) -> Column:
        return F.coalesce(F.startswith(F.try_element_at(tags, F.lit(self.key)), F.lit(self.prefix)), F.lit(False))

    def __str__(self) -> str:
        return f"{self.key}:{self.prefix}*"


@dataclass(frozen=True)
class Not(Node):
    node: Node

    def to_column(self, tags: Column) -> Column:
        return ~self.node.to_column(tags)

    def __str__(self) -> str:
        return f"!({self.node})"


@dataclass(frozen=True)
class And(Node):
    nodes: tuple[Node, ...]

    def to_column(self, tags: Column) -> Column:
        found = self.nodes[0].to_column(tags)
        for node in self.nodes[1:]:
            found = found & node.to_column(tags)
        return found

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.nodes)) + ")"


@dataclass(frozen=True)
class Or(Node):
    nodes: tuple[Node, ...]

    def to_column(self, tags: Column) -> Column:
        found = self.nodes[0].to_column(tags)
        for node in self.nodes[1:]:
            found = found | node.to_column(tags)
        return found

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.nodes)) + ")"


#: The letters of keys and values, and the words of the language.
_LEX = re.compile(
    r"""(?P<space>[ \r\t\n\f]+)
      | (?P<set>[a-zA-Z_-]+:\[[^\[\]]*\])
      | (?P<prefix>[a-zA-Z_-]+:[a-zA-Z0-9_.-]*\*)
      | (?P<word>[a-zA-Z_-]+:[a-zA-Z0-9_.-]+)
      | (?P<and>AND) | (?P<or>OR) | (?P<not>!) | (?P<open>\() | (?P<close>\))""",
    re.VERBOSE,
)
_VALUE = re.compile(r"[a-zA-Z0-9_.-]+\Z")


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; raises on the first character that begins none."""
    found, at = [], 0
    while at < len(text):
        hit = _LEX.match(text, at)
        if not hit:
            raise InvalidQuery(f"unexpected text at {at} in filter {text!r}")
        if hit.lastgroup != "space":
            found.append((hit.lastgroup, hit.group()))
        at = hit.end()
    return found


class _Parser:
    def __init__(self, text: str, sets: bool):
        self.text, self.sets, self.found, self.at = text, sets, tokens(text), 0

    def fail(self) -> InvalidQuery:
        return InvalidQuery(f"invalid filter: {self.text!r}")

    def take(self, kind: str) -> str | None:
        if self.at < len(self.found) and self.found[self.at][0] == kind:
            self.at += 1
            return self.found[self.at - 1][1]
        return None

    def chain(self, kind: str, inner, build) -> Node:
        nodes = [inner()]
        while self.take(kind):
            nodes.append(inner())
        return nodes[0] if len(nodes) == 1 else build(tuple(nodes))

    def either(self) -> Node:
        return self.chain("or", self.both, Or)

    def both(self) -> Node:
        return self.chain("and", self.single, And)

    def single(self) -> Node:
        negations = 0
        while self.take("not"):
            negations += 1
        node = self.atom()
        for _ in range(negations):
            node = Not(node)
        return node

    def atom(self) -> Node:
        if self.take("open"):
            node = self.either()
            if not self.take("close"):
                raise self.fail()
            return node
        if (found := self.take("word")) is not None:
            return Eq(*found.split(":", 1))
        if (found := self.take("prefix")) is not None:
            key, prefix = found.split(":", 1)
            return Wildcard(key, prefix[:-1])
        if self.sets and (found := self.take("set")) is not None:
            key, values = found.split(":", 1)
            members = [v.strip() for v in values[1:-1].split(",")]
            if not all(map(_VALUE.match, members)):
                raise self.fail()
            return Eq(key, members[0]) if len(members) == 1 else Or(tuple(Eq(key, v) for v in members))
        raise self.fail()


def parse_filter(text: str | None, sets: bool = False) -> Node:
    """Parse a filter; ``None`` is ``*``. Depth of nesting is limited by Python's recursion limit."""
    if text is None or text.strip() == "*":
        return AllStar()
    parser = _Parser(text, sets)
    try:
        node = parser.either()
    except RecursionError:
        raise parser.fail() from None
    if parser.at != len(parser.found):
        raise parser.fail()
    return node
