"""Lexer and Pratt parser of the expression language."""

from __future__ import annotations

import datetime as dt
import re
import sys
from dataclasses import dataclass, field

from dunlin.settings import DialectError

MOST_DEPTH = 400
# a level takes a few Python frames, in parsing and again in compiling
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MOST_DEPTH))


@dataclass(frozen=True)
class Token:
    kind: str  # num str date name op end
    value: object
    start: int
    end: int

    def word(self) -> str:
        return self.value.upper() if self.kind == "name" else ""


@dataclass
class Node:
    pass


@dataclass
class Lit(Node):
    value: object  # number, str, bool, None, date, datetime, EmptyDate
    kind: str


@dataclass
class Name(Node):
    name: str
    qualifier: str | None = None


@dataclass
class Unary(Node):
    op: str
    arg: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Call(Node):
    name: str
    args: list[Node] = field(default_factory=list)


#: The empty date, as it stands inside expressions.
EMPTY_DATE = dt.date(1, 1, 1)

_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[^\W\d]\w*(?:(?:\.|->)[^\W\d]\w*)?", re.UNICODE)
_DOTTED = re.compile(r"\.(AND|OR|NOT|T|F|Y|N|NULL)\.", re.I)
_OPS = ("**", "<>", "!=", "<=", ">=", "==", "+", "-", "*", "/", "%", "^", "(", ")", ",", "=", "<", ">", "#", "$", "!", ";", "?", ":", "@", "&")
_DATE = re.compile(r"\{\s*\^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[\s,]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*([AaPp][Mm]?)?)?\s*\}")


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c.isspace():
            at += 1
            continue
        if text.startswith("&&", at):
            at = text.find("\n", at)
            if at < 0:
                break
            continue
        if m := _DOTTED.match(text, at):
            word = m[1].upper()
            value = {"T": True, "Y": True, "F": False, "N": False}.get(word)
            if word in ("AND", "OR", "NOT"):
                out.append(Token("name", word, at, m.end()))
            else:
                out.append(Token("lit", value, at, m.end()))
            at = m.end()
        elif c in "'\"" or c == "[":
            close = text.find("]" if c == "[" else c, at + 1)
            if close < 0:
                raise DialectError(f"unclosed string at {at}", 10)
            out.append(Token("str", text[at + 1 : close], at, close + 1))
            at = close + 1
        elif c == "{":
            close = text.find("}", at)
            if close < 0:
                raise DialectError(f"unclosed date at {at}", 10)
            out.append(Token("date", text[at : close + 1], at, close + 1))
            at = close + 1
        elif m := _NUMBER.match(text, at):
            s = m[0]
            out.append(Token("num", float(s) if re.search("[.eE]", s) else int(s), at, m.end()))
            at = m.end()
        elif m := _NAME.match(text, at):
            out.append(Token("name", m[0].replace("->", "."), at, m.end()))
            at = m.end()
        else:
            op = next((o for o in _OPS if text.startswith(o, at)), None)
            if op is None:
                if c == ".":
                    op = "."
                else:
                    raise DialectError(f"unexpected {c!r} at {at}", 10)
            out.append(Token("op", op, at, at + len(op)))
            at += len(op)
    out.append(Token("end", None, n, n))
    return out


def date_literal(text: str) -> Lit:
    if not text.strip("{} \t:/-."):
        return Lit(EMPTY_DATE, "D")
    m = _DATE.fullmatch(text.strip())
    if not m:
        raise DialectError(f"bad date {text}", 2032)
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    try:
        if m[4] is None:
            return Lit(dt.date(y, mo, d), "D")
        hour = int(m[4])
        if m[7]:
            hour = hour % 12 + (12 if m[7][0] in "pP" else 0)
        return Lit(dt.datetime(y, mo, d, hour, int(m[5]), int(m[6] or 0)), "T")
    except ValueError as e:
        raise DialectError(f"bad date {text}", 2032) from e


_POWER = {"OR": 10, "AND": 20, "=": 40, "==": 40, "<>": 40, "!=": 40, "#": 40, "<": 40, "<=": 40, ">": 40, ">=": 40, "$": 40, "+": 50, "-": 50, "*": 60, "/": 60, "%": 60, "^": 70, "**": 70}
_NOT, _MINUS = 30, 65


class Parser:
    """A Pratt parser over tokens; subclasses may stop at their own words."""

    def __init__(self, tokens: list[Token], at: int = 0):
        self.tokens, self.at, self.depth = tokens, at, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def next(self) -> Token:
        t = self.tokens[self.at]
        self.at += 1
        return t

    def is_op(self, op: str) -> bool:
        return self.now.kind == "op" and self.now.value == op

    def expect(self, op: str) -> None:
        if not self.is_op(op):
            raise DialectError(f"{op!r} expected at {self.now.start}", 10)
        self.at += 1

    def expression(self, power: int = 0) -> Node:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise DialectError("expression too deep", 1308)
        try:
            left = self.prefix()
            while True:
                more = self.postfix(left, power)
                if more is not None:
                    left = more
                    continue
                t = self.now
                op = t.value if t.kind == "op" else t.word() if t.word() in ("AND", "OR") else None
                mine = _POWER.get(op, 0) if op else 0
                if mine <= power:
                    return left
                self.at += 1
                right = self.expression(mine - 1 if op in ("^", "**") else mine)
                left = Binary({"!=": "<>", "#": "<>", "**": "^"}.get(op, op), left, right)
        finally:
            self.depth -= 1

    def postfix(self, left: Node, power: int) -> Node | None:
        """What a subclass lets follow an operand, or None."""
        return None

    def prefix(self) -> Node:
        t = self.next()
        if t.kind == "num":
            return Lit(t.value, "I" if isinstance(t.value, int) else "B")
        if t.kind == "str":
            return Lit(t.value, "C")
        if t.kind == "date":
            return date_literal(t.value)
        if t.kind == "lit":
            return Lit(t.value, "X" if t.value is None else "L")
        if t.kind == "op":
            if t.value == "(":
                inner = self.group()
                self.expect(")")
                return inner
            if t.value == "!":
                return Unary("NOT", self.expression(_NOT))
            if t.value in "+-":
                arg = self.expression(_MINUS)
                return arg if t.value == "+" else Unary("-", arg)
        if t.kind == "name":
            word = t.word()
            if word == "NOT":
                return Unary("NOT", self.expression(_NOT))
            if self.is_op("(") and "." not in t.value:
                self.at += 1
                return self.call(word)
            if word == "NULL":
                return Lit(None, "X")
            if "." in t.value:
                q, n = t.value.split(".", 1)
                return Name(n, q) if q.upper() != "M" else Name(n, "M")
            return Name(t.value)
        raise DialectError(f"unexpected {t.value!r} at {t.start}", 10)

    def group(self) -> Node:
        return self.expression()

    def call(self, name: str) -> Node:
        args: list[Node] = []
        if self.is_op("*") and name == "COUNT":
            self.at += 1
            args.append(Lit(1, "I"))
        elif not self.is_op(")"):
            args.append(self.expression())
            while self.is_op(","):
                self.at += 1
                args.append(self.expression())
        self.expect(")")
        return Call(name, args)


def parse_expression(text: str) -> Node:
    p = Parser(tokenize(text))
    node = p.expression()
    if p.now.kind != "end":
        raise DialectError(f"unexpected {p.now.value!r} at {p.now.start}", 10)
    return node


def walk(node: Node):
    """A node and all below it."""
    yield node
    for child in children(node):
        yield from walk(child)


def children(node: Node) -> list[Node]:
    if isinstance(node, Unary):
        return [node.arg]
    if isinstance(node, Binary):
        return [node.left, node.right]
    if isinstance(node, Call):
        return list(node.args)
    return []
