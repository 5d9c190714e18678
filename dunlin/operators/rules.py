"""Rules of stored tables, kept with the table and applied by every change before it is put in force.

In order: defaults of columns that an INSERT leaves out, field rules (1582), NOT NULL (1581), record rules
(1583), uniqueness among live rows (1884), and links to parent tables (1539). Only new and changed rows are
judged, a field's rule only where the field has changed (in a new row: where it is not NULL); a rule holds only if it is true. A change of a
parent is restricted by rows that would lose it, or goes on to them: their deletion marks or keys change in
the same step. Each kind of check is one job over all rows, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin.lang.expr import parse_expression
from dunlin.operators.stats import orphans, repeated
from dunlin.plans.compile import Compiler, frame_resolver
from dunlin.settings import DialectError, Settings
from dunlin.sources.store import DELETED, HIDDEN, RECNO

#: A table's rules: column -> text, column -> text, columns, texts, column lists, links.
KINDS = ("defaults", "fields", "required", "record", "unique", "parents")
MODES = ("restrict", "cascade", "ignore")


def described(columns: list[str], **rules) -> dict:
    """Rules to keep with a table. A link is {key, table, parent, delete, update}; restrict is the mode if none is named."""
    known = {c.lower(): c for c in columns}

    def column(name: str) -> str:
        if name.lower() not in known:
            raise DialectError(f"column {name} is not found", 1806)
        return known[name.lower()]

    out: dict = {}
    for kind, value in rules.items():
        if kind not in KINDS:
            raise DialectError(f"unknown kind of rule {kind}", 10)
        if kind in ("defaults", "fields"):
            out[kind] = {column(c): text for c, text in value.items()}
        elif kind == "required":
            out[kind] = [column(c) for c in value]
        elif kind == "unique":
            out[kind] = [[column(c) for c in keys] for keys in value]
        elif kind == "parents":
            out[kind] = [{"delete": "restrict", "update": "restrict", **link, "key": column(link["key"]), "table": link["table"].lower()} for link in value]
            if any(link[m] not in MODES for link in out[kind] for m in ("delete", "update")):
                raise DialectError(f"a link's mode is one of {', '.join(MODES)}", 10)
        else:
            out[kind] = list(value)
    return out


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.col(DELETED))


def defaults(rules: dict, given: set[str]) -> dict[str, Column]:
    """Values of the columns that are not given."""
    comp = Compiler(lambda n: None, Settings(sql=False))
    return {c: comp.value(parse_expression(text)).col for c, text in rules.get("defaults", {}).items() if c.lower() not in given}


def holds(df: DataFrame, rule: str) -> Column:
    """Whether a rule is true; what cannot be read or is not logical is not."""
    try:
        return F.coalesce(Compiler(frame_resolver(df.schema), Settings(sql=False)).condition(parse_expression(rule)), F.lit(False))
    except DialectError:
        return F.lit(False)


def check(tables: dict[str, dict], read, name: str, rules: dict, rows: DataFrame, whole: DataFrame, old: list[str]) -> None:
    """Raises what is broken first. rows: live new and changed rows, with columns `__old_x` of the fields x in old."""

    def changed(c: str) -> Column:
        return ~F.col(f"`{c}`").eqNullSafe(F.col(f"`__old_{c}`")) if c in old else F.lit(True)

    plain = rows.select(*(c for c in rows.columns if not c.startswith("__old_")))
    tests = [(~holds(plain, rule) & changed(c), DialectError(f"field {c}: rule {rule} is broken", 1582)) for c, rule in rules.get("fields", {}).items()]
    tests += [(F.col(f"`{c}`").isNull(), DialectError(f"{c} takes no NULL", 1581)) for c in rules.get("required", [])]
    tests += [(~holds(plain, rule), DialectError(f"rule {rule} is broken", 1583)) for rule in rules.get("record", [])]
    if tests:
        found = rows.agg(*(F.coalesce(F.max(t), F.lit(False)).alias(f"t{k}") for k, (t, _) in enumerate(tests))).first()
        for hit, (_, error) in zip(found, tests):
            if hit:
                raise error
    for keys in rules.get("unique", []):
        if not repeated(whole, *keys).isEmpty():
            raise DialectError(f"{', '.join(keys)} is not unique", 1884)
    for link in rules.get("parents", []):
        parent = whole if link["table"] == name else live(read(tables[link["table"]])) if link["table"] in tables else None
        if parent is None or not orphans(rows, link["key"], parent, link["parent"]).isEmpty():
            raise DialectError(f"{link['key']} has no parent in {link['table']}", 1539)


def enforced(store, name: str, before: dict, after: dict, seen: dict[str, dict] | None = None) -> dict[str, dict]:
    """Checks a table's change; the changes of other tables that come with it."""
    tables = {**store.now(), **(seen or {}), name: after}
    links = [(child, link) for child, t in tables.items() if child != name for link in t.get("rules", {}).get("parents", []) if link["table"] == name]
    rules = after.get("rules")
    if not rules and not links:
        return {}
    was, now = store.read(before), store.read(after)
    if rules:
        both = [c for c in now.columns if c in was.columns and c not in HIDDEN]
        old = was.select(F.col(RECNO).alias("__at"), F.col(DELETED).alias("__gone"), *(F.col(f"`{c}`").alias(f"__old_{c}") for c in both))
        same = F.col("__at").isNotNull() & F.col(DELETED).eqNullSafe(F.col("__gone"))
        for c in both:
            same &= F.col(f"`{c}`").eqNullSafe(F.col(f"`__old_{c}`"))
        rows = live(now).join(old, F.col(RECNO) == F.col("__at"), "left").where(~same)
        check(tables, store.read, name, rules, rows, live(now), both)
    changes: dict[str, dict] = {}
    for child, link in links:
        made = cascade(store, child, tables[child], link, was, now)
        if made is not None:
            changes |= {child: made, **enforced(store, child, tables[child], made, {**(seen or {}), name: after, **changes})}
            tables |= changes
    return changes


def cascade(store, child: str, table: dict, link: dict, was: DataFrame, now: DataFrame) -> dict | None:
    """What a parent's change does to one child table; None if nothing."""
    key, parent = link["key"], link["parent"]
    kids = store.read(table)
    columns, changed = kids.columns, False
    if link["update"] == "cascade":
        old = live(was).select(F.col(RECNO).alias("__at"), F.col(parent).alias("__from"))
        moved = live(now).select(RECNO, F.col(parent).alias("__to")).join(old, F.col(RECNO) == F.col("__at")).where(~F.col("__from").eqNullSafe(F.col("__to")))
        moved = moved.select("__from", "__to").dropDuplicates(["__from"])
        if not kids.join(moved, F.col(key) == F.col("__from"), "left_semi").isEmpty():
            changed = True
            kids = kids.join(moved, F.col(key) == F.col("__from"), "left")
            kids = kids.withColumn(key, F.when(F.col("__from").isNotNull(), F.col("__to")).otherwise(F.col(key))).select(columns)
    lost = live(was).select(F.col(parent).alias("__lost")).join(live(now).select(F.col(parent).alias("__kept")), F.col("__lost") == F.col("__kept"), "left_anti").where("__lost is not null").distinct()
    hit = live(kids).join(lost, F.col(key) == F.col("__lost"), "left_semi")
    if link["delete"] != "ignore" and not hit.isEmpty():
        if link["delete"] == "restrict":
            raise DialectError(f"rows of {child} need {parent}", 1539)
        changed = True
        kids = kids.join(lost, F.col(key) == F.col("__lost"), "left").withColumn(DELETED, F.col(DELETED) | F.col("__lost").isNotNull())
    return {**table, "parts": [store.part(child, kids.select(columns))]} if changed else None
