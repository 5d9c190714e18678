"""Record commands and functions on work areas: moves, searches, filters, orders, relations, single records.

A command works on the current area, or on the one named by IN. Each area keeps its place, order, filter and
relations for as long as its table is open; it reads the table's version in force. Commands on one record
(REPLACE, DELETE, RECALL, BLANK) change the current record only and refuse scopes and conditions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from dunlin.lang.expr import tokenize
from dunlin.operators.buffering import Buffer
from dunlin.operators.nav import Area
from dunlin.settings import DialectError
from dunlin.sources.store import DELETED, HIDDEN, RECNO

SCOPES = ("ALL", "REST", "NEXT", "RECORD", "FOR", "WHILE", "IN")
SETTINGS = ("FILTER", "ORDER", "KEY", "RELATION", "SKIP")
FUNCTIONS = frozenset("RECNO RECCOUNT DELETED EOF BOF FOUND FILTER ORDER KEY TAG TAGCOUNT TAGNO ALIAS SELECT USED SEEK LOOKUP KEYMATCH RELATION TARGET".split())
#: Commands of the dialect that would change or read something and are not offered: an error, never silence.
REFUSED = frozenset("SAVE RESTORE SCATTER GATHER IMPORT EXPORT SORT JOIN INSERT MODIFY RENAME COMPILE RUN ERASE CLOSE VALIDATE".split())


def clauses(text: str, words: tuple[str, ...]) -> dict[str, str]:
    """The text before the first of the words, under "", and what follows each of them outside brackets."""
    out, key, start, depth = {}, "", 0, 0
    for t in tokenize(text):
        if t.kind == "op" and t.value in ("(", ")"):
            depth += 1 if t.value == "(" else -1
        elif depth == 0 and t.word() in words and t.word() not in out and t.word() != key:
            out[key], key, start = text[start : t.start].strip(), t.word(), t.end
    out[key] = text[start:].strip()
    return out


def listed(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, start, depth = [], 0, 0
    for t in tokenize(text):
        if t.kind == "op" and t.value in ("(", ")"):
            depth += 1 if t.value == "(" else -1
        elif t.kind == "op" and t.value == "," and depth == 0:
            out.append(text[start : t.start].strip())
            start = t.end
    out.append(text[start:].strip())
    return [x for x in out if x]


class Commands:
    """The commands of one session. `value` computes an expression, `assign` sets a variable."""

    def __init__(self, session):
        self.session = session
        self.value: Callable[[str], object] = session.value
        self.assign: Callable[[str, object], None] = lambda name, v: session.memory.__setitem__(name.strip().lower().removeprefix("m."), v)

    def run(self, text: str) -> bool:
        """Runs a record command; False if the text is something else."""
        word, _, rest = text.strip().partition(" ")
        word, rest = word.upper(), rest.strip()
        second, _, more = rest.partition(" ")
        two = f"{word} {second.upper()}"
        if word == "SET" and second.upper() in SETTINGS:
            getattr(self, f"set_{second.lower()}")(re.sub(r"(?i)^to\b", "", more.strip()).strip())
        elif two in ("BEGIN TRANSACTION", "END TRANSACTION") or word == "ROLLBACK":
            {"B": self.session.begin, "E": self.session.commit, "R": self.session.rollback}[word[0]]()
        elif two in ("APPEND BLANK", "APPEND FROM", "COPY TO", "COPY STRUCTURE", "DELETE TAG", "INDEX ON", "TOTAL ON"):
            getattr(self, two.lower().replace(" ", "_"))(more.strip())
        elif word in ("DELETE", "RECALL") and second.upper() != "FROM" and (not rest or second.upper() in SCOPES or word == "DELETE"):
            self.mark(word, rest)
        elif word in ("LOCATE", "CONTINUE", "SEEK", "GO", "GOTO", "SKIP", "REPLACE", "BLANK", "SUM", "COUNT", "AVERAGE", "REINDEX"):
            getattr(self, {"CONTINUE": "resume", "GOTO": "go"}.get(word, word.lower()))(rest)
        else:
            return False
        return True

    # -- areas

    def area(self, name: str | None = None) -> Area:
        return self.session.work_area(name.strip() if name else None)

    def moved(self, area: Area, seen: tuple = ()) -> None:
        """Children follow their parent: to the first record with its key, or beyond the end."""
        for on, alias in area.links:
            child = self.area(alias)
            if child in seen:
                continue
            key = area.now(on)
            if child.order is None:
                child.recno = int(key) if isinstance(key, (int, float)) and child.at(int(key)) is not None else None
            elif key is None:
                child.recno, child.found = None, False
            else:
                child.seek(key)
            child.row = None
            self.moved(child, (*seen, area))

    def scope(self, c: dict[str, str]) -> dict:
        kind = next((k for k in ("ALL", "REST", "NEXT", "RECORD") if k in c), None)
        n = int(self.value(c[kind])) if kind in ("NEXT", "RECORD") else 0
        return {"scope": kind or ("REST" if "WHILE" in c else "ALL"), "n": n, "for_": c.get("FOR"), "while_": c.get("WHILE")}

    # -- moves

    def locate(self, rest: str) -> None:
        c = clauses(rest, SCOPES)
        a = self.area(c.get("IN"))
        a.locate(**self.scope(c))
        self.moved(a)

    def resume(self, rest: str) -> None:
        a = self.area(clauses(rest, SCOPES).get("IN"))
        a.continue_()
        self.moved(a)

    def seek(self, rest: str) -> None:
        c = clauses(rest, ("ORDER", "IN"))
        self.sought(self.area(c.get("IN")), self.value(c[""]), c.get("ORDER"))

    def sought(self, a: Area, value: object, tag: str | None = None) -> bool:
        before = a.order
        if tag:
            a.set_order(re.sub(r"(?i)^tag\s+", "", tag))
        try:
            a.seek(value)
        finally:
            a.order = before
        self.moved(a)
        return a.found

    def go(self, rest: str) -> None:
        c = clauses(rest, ("IN",))
        a, to = self.area(c.get("IN")), re.sub(r"(?i)^record\s+", "", c[""])
        if to.upper() == "TOP":
            a.top()
        elif to.upper() == "BOTTOM":
            a.bottom()
        else:
            a.go(int(self.value(to)))
        self.moved(a)

    def skip(self, rest: str) -> None:
        c = clauses(rest, ("IN",))
        a = self.area(c.get("IN"))
        a.skip(int(self.value(c[""])) if c[""] else 1)
        self.moved(a)

    # -- single records

    def mark(self, word: str, rest: str) -> None:
        """DELETE and RECALL of the current record."""
        c = clauses(rest, SCOPES)
        if c[""] or len(c) > 1 and set(c) != {"", "IN"}:
            raise DialectError(f"{word} takes no scope and no condition", 10)
        a = self.area(c.get("IN"))
        if a.recno is not None:
            self.session.changes().mark_record(self.session.table_of(c.get("IN")), a.recno, word == "DELETE")
            a.row = None

    def replace(self, rest: str) -> None:
        c = clauses(rest, SCOPES)
        if set(c) - {"", "IN"}:
            raise DialectError("REPLACE takes no scope and no condition", 10)
        a, values = self.area(c.get("IN")), {}
        for part in listed(c[""]):
            m = re.match(r"(?is)(?:\w+\.)?(\w+)\s+with\s+(.+)$", part)
            if not m:
                raise DialectError(f"REPLACE needs WITH: {part}", 10)
            values[m[1]] = self.value(m[2])
        if a.recno is not None:
            self.edit(self.session.table_of(c.get("IN")), a, lambda b: b.replace(a.recno, **values))

    def blank(self, rest: str) -> None:
        c = clauses(rest, (*SCOPES, "FIELDS"))
        if set(c) - {"", "IN", "FIELDS"}:
            raise DialectError("BLANK takes no scope and no condition", 10)
        a = self.area(c.get("IN"))
        if a.recno is not None:
            self.edit(self.session.table_of(c.get("IN")), a, lambda b: b.blank(a.recno, *listed(c.get("FIELDS", ""))))

    def edit(self, table: str, a: Area, change: Callable[[Buffer], None]) -> None:
        b = Buffer(self.session.store, table)
        change(b)
        b.update(force=True)
        a.row = None

    def append_blank(self, rest: str) -> None:
        alias = clauses(rest, ("IN",)).get("IN")
        table, store = self.session.table_of(alias), self.session.store
        store.append(table, store.spark.range(1).select())
        a = self.area(alias)
        a.recno, a.row = a.df.agg(F.max(RECNO)).first()[0], None
        self.moved(a)

    # -- orders, filters, relations

    def index_on(self, rest: str) -> None:
        c = clauses(rest, ("TAG", "TO", "FOR", "OF", "ASCENDING", "DESCENDING", "DESC", "UNIQUE", "CANDIDATE", "ADDITIVE", "COMPACT"))
        tag = c.get("TAG") or c.get("TO")
        if not tag:
            raise DialectError("INDEX needs TAG", 10)
        a = self.area()
        a.index_on(tag, c[""], "DESCENDING" in c or "DESC" in c, "UNIQUE" in c, c.get("FOR"), "CANDIDATE" in c)
        a.top()
        self.moved(a)

    def delete_tag(self, rest: str) -> None:
        a = self.area()
        for tag in list(a.orders) if rest.upper() == "ALL" else [x.upper() for x in listed(rest)]:
            if a.orders.pop(tag, None) is None:
                raise DialectError(f"tag {tag} is not found", 1683)
            a.order = None if a.order == tag else a.order

    def reindex(self, rest: str) -> None:
        """Orders are computed from the rows, so nothing is to be done."""

    def set_order(self, rest: str) -> None:
        c = clauses(rest, ("IN", "ASCENDING", "DESCENDING"))
        a, tag = self.area(c.get("IN")), re.sub(r"(?i)^tag\s+", "", c[""])
        if tag.isdigit():
            tag = list(a.orders)[int(tag) - 1] if 0 < int(tag) <= len(a.orders) else None
        a.set_order(tag or None)
        if a.order and ("DESCENDING" in c or "ASCENDING" in c):
            a.orders[a.order].desc = "DESCENDING" in c

    def set_filter(self, rest: str) -> None:
        c = clauses(rest, ("IN",))
        a = self.area(c.get("IN"))
        if c[""]:
            a.condition(c[""])  # an expression that cannot be read is an error here
        a.filter = c[""] or None

    def set_key(self, rest: str) -> None:
        c = clauses(rest, ("IN", "RANGE"))
        a = self.area(c.get("IN"))
        text = c.get("RANGE", c[""])
        if text and a.order is None:
            raise DialectError("no order is set", 26)
        parts = [self.value(x) if x else None for x in (listed(text) if not text.startswith(",") else ["", text[1:]])]
        a.set_key(parts[0] if parts else None, parts[1] if len(parts) > 1 else None)
        if "RANGE" in c and len(parts) == 1:
            a.high = None

    def set_relation(self, rest: str) -> None:
        a = self.area()
        if m := re.match(r"(?i)off\s+into\s+(\w+)$", rest):
            a.links = [x for x in a.links if x[1].lower() != m[1].lower()]
            return
        additive = re.search(r"(?i)\s+additive$", rest)
        links = list(a.links) if additive else []
        for part in listed(rest[: additive.start()] if additive else rest):
            m = re.match(r"(?is)(.+?)\s+into\s+(\w+)$", part)
            if not m:
                raise DialectError("SET RELATION needs INTO", 10)
            self.area(m[2])
            links.append((m[1], m[2]))
        a.links = links
        self.moved(a)

    def set_skip(self, rest: str) -> None:
        self.area().many = {x.lower() for x in listed(rest)}

    # -- whole areas

    def results(self, rest: str, make: Callable) -> None:
        c = clauses(rest, (*SCOPES, "TO"))
        a = self.area(c.get("IN"))
        values = make(a, listed(c[""]), self.scope(c))
        for name, v in zip(listed(c.get("TO", "")), values):
            self.assign(name, v)

    def sum(self, rest: str) -> None:
        self.results(rest, lambda a, e, s: a.sum(*e, **s))

    def average(self, rest: str) -> None:
        self.results(rest, lambda a, e, s: a.sum(*e, average=True, **s))

    def count(self, rest: str) -> None:
        self.results(rest, lambda a, e, s: (a.scoped(**s).count(),))

    def total_on(self, rest: str) -> None:
        c = clauses(rest, (*SCOPES, "TO", "FIELDS"))
        out = self.area(c.get("IN")).total(c[""], listed(c["FIELDS"]) if "FIELDS" in c else None, c.get("FOR"))
        self.session.store.create(c["TO"], out)

    def copy_to(self, rest: str) -> None:
        c = clauses(rest, (*SCOPES, "FIELDS", "TYPE"))
        if "TYPE" in c:
            raise DialectError("COPY TO makes tables only", 1999)
        a = self.area(c.get("IN"))
        df = a.scoped(**self.scope(c)).orderBy(*a.sorting())
        have = {x.lower(): x for x in df.columns if x not in HIDDEN}
        wanted = [have[x.lower()] for x in listed(c["FIELDS"])] if "FIELDS" in c else list(have.values())
        self.session.store.create(c[""], df.select(*(f"`{x}`" for x in wanted)))

    def copy_structure(self, rest: str) -> None:
        c = clauses(rest, ("TO",))
        self.session.copy_structure(self.session.table_of(None), c["TO"])

    def append_from(self, rest: str) -> None:
        c = clauses(rest, ("FOR",))
        self.session.append_from(self.session.table_of(None), c[""], c.get("FOR"))

    # -- functions

    def function(self, name: str, args: list) -> object:
        """What a function of the current area, or of the one named last, gives."""
        if name == "USED":
            return self.session.area in self.session.areas if not args else self.session.used(str(args[0]))
        if name == "SELECT":
            return int(self.session.area) if not args else next((int(k) for k, (alias, _) in self.session.areas.items() if alias.lower() == str(args[0]).lower()), 0)
        if name == "ALIAS":
            return self.session.areas.get(self.session.area, ("",))[0]
        if name in ("SEEK", "KEYMATCH"):
            a, tag = self.area(args[1] if len(args) > 1 else None), args[2] if len(args) > 2 else None
            place = a.recno
            found = self.sought(a, args[0], tag)
            if name == "KEYMATCH":
                a.recno, a.row = place, None
            return found
        if name in ("TAG", "RELATION", "TARGET"):
            a, n = self.area(args[1] if len(args) > 1 else None), int(args[0]) if args else 1
            have = list(a.orders) if name == "TAG" else [x[name == "TARGET"].upper() for x in a.links]
            return have[n - 1] if 0 < n <= len(have) else ""
        if name == "TAGNO":
            a = self.area()
            tag = str(args[0]).upper() if args else a.order
            return list(a.orders).index(tag) + 1 if tag in a.orders else 0
        a = self.area(args[0] if args and name != "KEY" else None)
        if name in ("RECNO", "RECCOUNT"):
            return a.recno if name == "RECNO" and a.recno is not None else a.df.count() + (name == "RECNO")
        if name == "DELETED":
            row = a.record()
            return bool(row[DELETED]) if row is not None else False
        if name == "KEY":
            tag = list(a.orders)[int(args[0]) - 1] if args else a.order
            return a.orders[tag].key.upper() if tag else ""
        return {"EOF": a.recno is None, "BOF": a.bof, "FOUND": a.found, "FILTER": a.filter or "", "ORDER": a.order or "", "TAGCOUNT": len(a.orders)}[name]

    def lookup(self, field: str, value: object, key: str, tag: str | None = None) -> object:
        """LOOKUP(): the field of the first record whose key is the value, and the place moves there."""
        a = self.area()
        row = a.locate(f"{key} == __sought", extra={"__sought": value})
        return row[next(c for c in row.asDict() if c.lower() == field.lower())] if row is not None else ""
