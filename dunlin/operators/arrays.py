"""Array functions on a session's arrays: lists of rows on the driver, never distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dunlin.settings import DialectError
from dunlin.sources.export import described
from dunlin.sources.store import HIDDEN


class Arrays:
    """Arrays by name; an array is a list of values, or of rows of equal length. Elements count from 1."""

    def __init__(self, held: dict[str, list]):
        self.held = held

    def get(self, name: str) -> list:
        if name.lower() not in self.held:
            raise DialectError(f"{name} is no array", 232)
        return self.held[name.lower()]

    def dimension(self, name: str, rows: int, columns: int | None = None) -> list:
        """A new array of .F., or the old one with its elements kept in order."""
        old = self.flat(self.held.get(name.lower(), []))
        size = rows * (columns or 1)
        values = (old + [False] * size)[:size]
        self.held[name.lower()] = values if columns is None else [values[k : k + columns] for k in range(0, size, columns)]
        return self.held[name.lower()]

    @staticmethod
    def flat(a: list) -> list:
        return [x for row in a for x in row] if a and isinstance(a[0], list) else list(a)

    def columns(self, name: str) -> int:
        a = self.get(name)
        return len(a[0]) if a and isinstance(a[0], list) else 0

    def alen(self, name: str, what: int = 0) -> int:
        """Elements (0), rows (1) or columns (2)."""
        a = self.get(name)
        return len(self.flat(a)) if what == 0 else len(a) if what == 1 else self.columns(name)

    def aelement(self, name: str, row: int, column: int | None = None) -> int:
        width = self.columns(name)
        if column is None or not width:
            return row
        if not (1 <= row <= len(self.get(name)) and 1 <= column <= width):
            raise DialectError("subscript is out of range", 31)
        return (row - 1) * width + column

    def asubscript(self, name: str, element: int, what: int) -> int:
        width = self.columns(name) or 1
        if not 1 <= element <= self.alen(name):
            raise DialectError("subscript is out of range", 31)
        return (element - 1) // width + 1 if what == 1 else (element - 1) % width + 1

    def acopy(self, source: str, target: str, first: int = 1, count: int = -1, at: int = 1) -> int:
        src = self.flat(self.get(source))[first - 1 :]
        src = src if count < 0 else src[:count]
        if target.lower() not in self.held:
            self.held[target.lower()] = list(src)
            return len(src)
        width, dst = self.columns(target), self.flat(self.get(target))
        src = src[: max(len(dst) - at + 1, 0)]
        dst[at - 1 : at - 1 + len(src)] = src
        self.held[target.lower()] = [dst[k : k + width] for k in range(0, len(dst), width)] if width else dst
        return len(src)

    def adel(self, name: str, n: int, column: bool = False) -> int:
        """Removes an element, row or column; what follows moves up and .F. fills the end."""
        a = self.get(name)
        if not self.columns(name):
            a.append(False)
            del a[n - 1]
        elif column:
            for row in a:
                row.append(False)
                del row[n - 1]
        else:
            a.append([False] * len(a[0]))
            del a[n - 1]
        return 1

    def ains(self, name: str, n: int, column: bool = False) -> int:
        """Makes room for an element, row or column; the last one drops out."""
        a = self.get(name)
        if not self.columns(name):
            a.insert(n - 1, False)
            a.pop()
        elif column:
            for row in a:
                row.insert(n - 1, False)
                row.pop()
        else:
            a.insert(n - 1, [False] * len(a[0]))
            a.pop()
        return 1

    def asort(self, name: str, start: int = 1, count: int = -1, desc: bool = False, fold: bool = False) -> int:
        """Sorts elements, or rows by the column of the first element's place."""
        a, width = self.get(name), self.columns(name)

        def key(v):
            return (v is not None, str(type(v) if not isinstance(v, (int, float)) else float), v.lower() if fold and isinstance(v, str) else v if v is not None else 0)

        if width:
            row, column = (start - 1) // width, (start - 1) % width
            stop = len(a) if count < 0 else row + count
            a[row:stop] = sorted(a[row:stop], key=lambda r: key(r[column]), reverse=desc)
        else:
            stop = len(a) if count < 0 else start - 1 + count
            a[start - 1 : stop] = sorted(a[start - 1 : stop], key=key, reverse=desc)
        return 1

    def ascan(self, name: str, value, start: int = 1, count: int = -1) -> int:
        values = self.flat(self.get(name))
        stop = len(values) if count < 0 else start - 1 + count
        for k in range(start - 1, min(stop, len(values))):
            v = values[k]
            if v == value or isinstance(v, str) and isinstance(value, str) and v.startswith(value):
                return k + 1
        return 0

    def afields(self, name: str, df: DataFrame) -> int:
        """Name, type, length, decimals and nullability of a table's columns."""
        self.held[name.lower()] = [[c["name"].upper(), c["type"], c["length"], c["decimals"], c["nullable"]] for c in described(df.schema)]
        return len(self.held[name.lower()])

    def alines(self, name: str, text: str, flags: int = 0, *marks: str) -> int:
        """Lines of a text: 1 trims, 2 keeps the last empty one, 4 drops empty ones, 8 ignores the marks' case, 16 keeps the marks."""
        import re

        pattern = "|".join(map(re.escape, marks)) if marks else "\r\n|\r|\n"
        parts = re.split(f"({pattern})", text, flags=re.I if flags & 8 else 0)
        lines = [parts[k] + (parts[k + 1] if flags & 16 and k + 1 < len(parts) else "") for k in range(0, len(parts), 2)]
        if lines and not lines[-1] and not flags & 2 and len(lines) > 1:
            lines.pop()
        lines = [x.strip() for x in lines] if flags & 1 else lines
        self.held[name.lower()] = [x for x in lines if x] if flags & 4 else lines
        return len(self.held[name.lower()])

    def copy_to_array(self, name: str, df: DataFrame, fields: list[str] | None = None) -> int:
        rows = df.select(*(fields or [c for c in df.columns if c not in HIDDEN])).collect()
        self.held[name.lower()] = [list(r) for r in rows]
        return len(rows)
