"""The procedural layer: procedures, conditions, loops and variables, run on the driver.

Statements that touch tables go to the session, whose work is distributed; only control flow and scalar
variables live here. Scalar expressions without functions are computed in place, all others by Spark.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dunlin.lang.expr import Binary, Call, Lit, Name, Node, Unary, parse_expression
from dunlin.operators.commands import FUNCTIONS, REFUSED, SCOPES, clauses
from dunlin.settings import DialectError

MOST_CALLS = 48


@dataclass
class Block:
    kind: str
    text: str = ""
    parts: list = field(default_factory=list)  # (condition or head, body)
    line: int = 0


class Exit(Exception):
    pass


class Loop(Exception):
    pass


class Return(Exception):
    def __init__(self, value):
        self.value = value


OPENERS = {"IF": "ENDIF", "DO CASE": "ENDCASE", "DO WHILE": "ENDDO", "FOR": "ENDFOR", "SCAN": "ENDSCAN"}
ENDS = {"ENDIF", "ENDCASE", "ENDDO", "ENDFOR", "NEXT", "ENDSCAN", "ENDPROC", "ENDFUNC"}


def lines_of(source: str) -> list[tuple[int, str]]:
    """Statements with their line numbers: comments dropped, `;` at a line's end continues it, constants put in."""
    out, held, start, constants, active = [], "", 0, {}, [True]
    for n, raw in enumerate(source.splitlines(), 1):
        line = raw.strip()
        if not held and (line.startswith("*") or not line):
            continue
        line = re.sub(r"&&.*$", "", line).rstrip()
        if line.startswith("#"):
            word, _, rest = line[1:].strip().partition(" ")
            word, rest = word.upper(), rest.strip()
            if word == "DEFINE":
                name, _, value = rest.partition(" ")
                constants[name.upper()] = value.strip()
            elif word == "IFDEF":
                active.append(rest.upper() in constants)
            elif word == "IFNDEF":
                active.append(rest.upper() not in constants)
            elif word == "ELSE":
                active[-1] = not active[-1]
            elif word == "ENDIF":
                active.pop()
            continue
        if not all(active):
            continue
        start = start if held else n
        if line.endswith(";"):
            held += line[:-1] + " "
            continue
        text, held = held + line, ""
        text = re.sub(r"'[^']*'|\"[^\"]*\"|[^\W\d]\w*", lambda m: constants.get(m[0].upper(), m[0]), text)
        if text:
            out.append((start, text))
    return out


def head(text: str) -> str:
    words = text.upper().split()
    two = " ".join(words[:2])
    return two if two in ("DO CASE", "DO WHILE") else words[0]


def parse(source: str) -> tuple[list, dict[str, tuple[list[str], list]]]:
    """The main body, and procedures by name with their parameters."""
    rows, at = lines_of(source), 0
    procedures: dict[str, tuple[list[str], list]] = {}

    def body(stops: set[str]) -> list:
        nonlocal at
        out = []
        while at < len(rows):
            n, text = rows[at]
            h = head(text)
            if h in stops or h in ENDS:
                return out
            at += 1
            if h in OPENERS:
                out.append(block(h, text, n))
            else:
                out.append(Block("STATEMENT", text, line=n))
        return out

    def block(h: str, text: str, n: int) -> Block:
        nonlocal at
        b = Block(h, text, line=n)
        end = {OPENERS[h], "NEXT"} if h == "FOR" else {OPENERS[h]}
        middle = {"IF": {"ELSE"}, "DO CASE": {"CASE", "OTHERWISE"}}.get(h, set())
        label = text
        while True:
            inner = body(end | middle)
            b.parts.append((label, inner))
            if at >= len(rows):
                raise DialectError(f"{OPENERS[h]} is missing for line {n}", 1211)
            label = rows[at][1]
            h2 = head(label)
            at += 1
            if h2 in end:
                return b
            if h2 not in middle:
                raise DialectError(f"unexpected {label!r} in line {rows[at - 1][0]}", 1211)

    main = []
    while at < len(rows):
        n, text = rows[at]
        h = head(text)
        if h in ("PROCEDURE", "FUNCTION"):
            at += 1
            m = re.match(r"\w+\s+(\w+)\s*(?:\(([^)]*)\))?", text)
            inner = body({"PROCEDURE", "FUNCTION"})
            if at < len(rows) and head(rows[at][1]) in ("ENDPROC", "ENDFUNC"):
                at += 1
            params = [p.strip().split()[0] for p in (m[2] or "").split(",") if p.strip()]
            procedures[m[1].upper()] = (params, inner)
        elif h in ENDS:
            raise DialectError(f"unexpected {text!r} in line {n}", 1211)
        else:
            main += body({"PROCEDURE", "FUNCTION"})
    return main, procedures


class Interpreter:
    """Runs scripts against a session. Variables are lists of scopes; names are looked up from the inside."""

    def __init__(self, session):
        self.session = session
        self.scopes: list[dict[str, object]] = [session.memory]
        self.procedures: dict[str, tuple[list[str], list]] = {}
        self.results: list[object] = []
        self.output: list[object] = []
        self.depth, self.on_error, self.error, self.line = 0, None, None, 0
        session.variables = lambda: {k: v for s in self.scopes for k, v in s.items()}
        session.commands.value, session.commands.assign = self.value, self.put

    def load(self, source: str) -> list:
        main, found = parse(source)
        self.procedures |= found
        return main

    def run(self, source: str) -> object:
        main = self.load(source)
        try:
            self.block(main)
        except Return as r:
            return r.value
        return None

    def call(self, name: str, *args) -> object:
        """A procedure by value; missing parameters are .F."""
        if name.upper() not in self.procedures:
            raise DialectError(f"procedure {name} is not found", 1)
        if self.depth >= MOST_CALLS:
            raise DialectError("calls are nested too deep", 1809)
        params, inner = self.procedures[name.upper()]
        scope: dict[str, object] = {p.lower(): a for p, a in zip(params, (*args, *[False] * len(params)))}
        scope["\0args"] = list(args)
        self.scopes.append(scope)
        self.depth += 1
        try:
            self.block(inner)
        except Return as r:
            return r.value
        finally:
            self.depth -= 1
            self.scopes.pop()
        return True

    # -- variables and expressions

    def get(self, name: str):
        for scope in reversed(self.scopes):
            if name.lower() in scope:
                return scope[name.lower()]
        raise DialectError(f"variable {name} is not found", 12)

    def put(self, name: str, value, local: bool = False) -> None:
        name = name.strip().lower().removeprefix("m.")
        if m := re.fullmatch(r"(\w+)\s*[\[(](.+)[\])]", name):
            self.element(m[1], m[2], value)
            return
        if not local:
            for scope in reversed(self.scopes):
                if name in scope:
                    scope[name] = value
                    return
        self.scopes[-1][name] = value

    def element(self, name: str, subscripts: str, value=None, read: bool = False):
        a = self.session.arrays.get(name.lower())
        if a is None:
            raise DialectError(f"{name} is no array", 232)
        at = [int(self.value(x)) for x in subscripts.split(",")]
        row, width = at[0] - 1, len(a[0]) if a and isinstance(a[0], list) else 0
        if width and len(at) == 1:
            at, row = [0, row % width + 1], row // width
        try:
            if read:
                return a[row][at[1] - 1] if width else a[row]
            if width:
                a[row][at[1] - 1] = value
            else:
                a[row] = value
        except IndexError:
            raise DialectError("subscript is out of range", 31) from None

    def macro(self, text: str) -> str:
        """`&name` gives way to the variable's text."""
        return re.sub(r"(?<!&)&(\w+)\.?", lambda m: str(self.get(m[1])), text)

    def value(self, text: str):
        return self.evaluate(parse_expression(text))

    def evaluate(self, node: Node):
        if isinstance(node, Lit):
            return node.value
        if isinstance(node, Name):
            found, v = self.session.field_value(node)
            return v if found else self.get(node.name)
        if isinstance(node, Unary):
            v = self.evaluate(node.arg)
            return None if v is None else not v if node.op == "NOT" else -v
        if isinstance(node, Call):
            if node.name in self.procedures:
                return self.call(node.name, *(self.evaluate(a) for a in node.args))
            if node.name.lower() in self.session.arrays:
                return self.element(node.name, ",".join(str(self.evaluate(a)) for a in node.args), read=True)
            if node.name == "PCOUNT":
                return len(self.scopes[-1].get("\0args", []))
            if node.name in ("ERROR", "MESSAGE", "LINENO"):
                return self.line if node.name == "LINENO" else (getattr(self.error, "code", 0) or 0) if node.name == "ERROR" else str(self.error or "")
            if node.name == "LOOKUP":
                field, value, key = node.args[:3]
                return self.session.commands.lookup(field.name, self.evaluate(value), key.name)
            if node.name in FUNCTIONS:
                return self.session.commands.function(node.name, [a.name if isinstance(a, Name) and node.name not in ("SEEK", "KEYMATCH") else self.evaluate(a) for a in node.args])
            return self.by_spark(Call(node.name, [self.constant(a) for a in node.args]))
        if isinstance(node, Binary):
            if node.op in ("AND", "OR"):
                a = self.evaluate(node.left)
                if a is (node.op == "OR"):
                    return a
                b = self.evaluate(node.right)
                return b if b is (node.op == "OR") else None if a is None or b is None else b
            a, b = self.evaluate(node.left), self.evaluate(node.right)
            plain = (int, float)
            if all(isinstance(x, plain) and not isinstance(x, bool) for x in (a, b)) and node.op in "+ - * = < > <= >= <> ==".split():
                return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "=": lambda: a == b, "==": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b}[node.op]()
            if isinstance(a, str) and isinstance(b, str) and node.op in ("+", "=="):
                return a + b if node.op == "+" else a == b
            return self.by_spark(Binary(node.op, self.literal(a), self.literal(b)))
        raise DialectError("no expression", 10)

    def constant(self, node: Node) -> Node:
        return self.literal(self.evaluate(node))

    @staticmethod
    def literal(v) -> Lit:
        kind = "X" if v is None else "L" if isinstance(v, bool) else "T" if isinstance(v, dt.datetime) else "D" if isinstance(v, dt.date) else "C"
        return Lit(v, kind)

    def by_spark(self, node: Node):
        from dunlin.plans.compile import Compiler
        from dunlin.settings import Settings

        settings = Settings(**{**self.session.settings.__dict__, "sql": False})
        v = Compiler(lambda n: None, settings, self.session.functions).value(node)
        return self.session.spark.range(1).select(v.col.alias("v")).first().v

    def true(self, text: str) -> bool:
        return self.value(self.macro(text)) is True

    # -- statements

    def block(self, body: list) -> None:
        for b in body:
            self.line = b.line
            try:
                self.step(b)
            except (Exit, Loop, Return):
                raise
            except Exception as e:
                if self.on_error is None:
                    raise
                self.error, handler, self.on_error = e, self.on_error, None
                try:
                    self.statement(handler)
                finally:
                    self.on_error = handler

    def step(self, b: Block) -> None:
        if b.kind == "STATEMENT":
            self.statement(b.text)
        elif b.kind == "IF":
            for label, inner in b.parts:
                if head(label) == "ELSE" or self.true(label[2:]):
                    self.block(inner)
                    return
        elif b.kind == "DO CASE":
            for label, inner in b.parts[1:]:
                if head(label) == "OTHERWISE" or self.true(label[4:]):
                    self.block(inner)
                    return
        elif b.kind == "DO WHILE":
            condition = re.sub(r"(?i)^do\s+while", "", b.text)
            while self.true(condition) and self.inner(b.parts[0][1]):
                pass
        elif b.kind == "FOR":
            if m := re.match(r"(?i)for\s+each\s+(\w+)\s+in\s+(\w+)", b.text):
                for x in list(self.session.arrays[m[2].lower()]):
                    self.put(m[1], x)
                    if not self.inner(b.parts[0][1]):
                        break
                return
            m = re.match(r"(?i)for\s+(\w+)\s*=\s*(.+?)\s+to\s+(.+?)(?:\s+step\s+(.+))?$", b.text)
            if not m:
                raise DialectError(f"bad FOR in line {b.line}", 10)
            v, last, by = self.value(m[2]), self.value(m[3]), self.value(m[4]) if m[4] else 1
            while v <= last if by > 0 else v >= last:
                self.put(m[1], v)
                if not self.inner(b.parts[0][1]):
                    return
                v = self.get(m[1]) + by
            self.put(m[1], v)
        elif b.kind == "SCAN":
            c = clauses(b.text[4:], SCOPES)
            area = self.session.work_area(c.get("IN"))
            scope = self.session.commands.scope(c)
            here = self.session.area
            for row in area.scan(scope["for_"], scope["while_"], scope["scope"], scope["n"]):
                self.session.commands.moved(area)
                go = self.inner(b.parts[0][1])
                self.session.area = here
                if not go:
                    return

    def inner(self, body: list) -> bool:
        """One turn of a loop; False to leave it."""
        try:
            self.block(body)
        except Loop:
            return True
        except Exit:
            return False
        return True

    def statement(self, text: str) -> None:
        text = self.macro(text)
        h, rest = head(text), text.strip().partition(" ")[2].strip()
        if h == "EXIT":
            raise Exit
        if h == "LOOP":
            raise Loop
        if h == "RETURN":
            raise Return(self.value(rest) if rest else True)
        if h in ("LOCAL", "PRIVATE", "PUBLIC"):
            for name in rest.split(","):
                if h == "PUBLIC":
                    self.scopes[0].setdefault(name.strip().lower(), False)
                else:
                    self.put(name.strip().split(" ")[0], False, local=True)
        elif h in ("PARAMETERS", "LPARAMETERS"):
            args = self.scopes[-1].get("\0args", [])
            for k, name in enumerate(rest.split(",")):
                self.put(name, args[k] if k < len(args) else False, local=True)
        elif h in ("DIMENSION", "DECLARE"):
            from dunlin.operators.arrays import Arrays

            for m in re.finditer(r"(\w+)\s*[\[(]\s*([^\])]+)[\])]", rest):
                Arrays(self.session.arrays).dimension(m[1], *(int(self.value(x)) for x in m[2].split(",")))
        elif h == "STORE":
            m = re.match(r"(?i)(.+)\s+to\s+(.+)$", rest)
            for name in m[2].split(","):
                self.put(name, self.value(m[1]))
        elif h == "RELEASE":
            for name in rest.split(","):
                for scope in reversed(self.scopes):
                    if scope.pop(name.strip().lower(), self) is not self:
                        break
        elif text.upper().startswith("ON ERROR"):
            self.on_error = text[8:].strip() or None
        elif h == "DO":
            m = re.match(r"(?i)(\w+)(?:\s+with\s+(.+))?$", rest)
            args = parse_expression(f"F({m[2]})").args if m[2] else []
            value = self.call(m[1], *(self.evaluate(a) for a in args))
            self.results.append(value)
        elif text.startswith("?"):
            self.output.append(self.value(text.lstrip("? ")))
        elif text.startswith("="):
            self.value(text[1:])
        elif m := re.match(r"(?i)(?:m\.)?([^\W\d]\w*(?:\s*[\[(][^=]*[\])])?)\s*=(?!=)\s*(.+)$", text):
            self.put(m[1], self.value(m[2]))
        elif self.session.commands.run(text):
            pass
        elif h in ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "USE", "SET", "PACK", "ZAP", "RECALL"):
            scope = {k: v for s in self.scopes for k, v in s.items() if isinstance(k, str) and not k.startswith("\0")}
            out = self.session.execute(re.sub(r"(?i)\bm\.(\w+)", r":\1", text), **{k: v for k, v in scope.items() if k.isidentifier() and k not in ("text", "self")})
            if isinstance(out, DataFrame):
                self.results.append(out)
        elif h in REFUSED:
            raise DialectError(f"{h} is not supported", 1999)
        # a word that is no command of the dialect is parsed and does nothing
