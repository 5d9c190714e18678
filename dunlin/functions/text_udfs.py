"""Functions of texts that Spark has no expressions for, as Arrow-batched UDFs, and their plain Python forms."""

from __future__ import annotations

import datetime as dt
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sound groups of letters.
SOUND = {c: d for d, letters in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in letters}


def soundex(s: str | None) -> str | None:
    """First letter and three digits; H, W and vowels let a digit repeat; 0000 for no letters."""
    if s is None:
        return None
    s = s.strip().upper()
    if not s:
        return "0000"
    out, last = s[0], SOUND.get(s[0], "")
    for c in s[1:]:
        d = SOUND.get(c, "")
        if d and d != last:
            out += d
        last = d
        if len(out) == 4:
            break
    return out.ljust(4, "0")


def difference(a: str | None, b: str | None) -> int | None:
    if a is None or b is None:
        return None
    return sum(x == y for x, y in zip(soundex(a), soundex(b)))


def normalize(s: str | None) -> str | None:
    """Upper case without blanks outside string constants, `->` as a dot."""
    if s is None:
        return None
    out, quote = [], ""
    k = 0
    while k < len(s):
        c = s[k]
        if quote:
            out.append(c)
            quote = "" if c == quote else quote
        elif c in "'\"[":
            quote = "]" if c == "[" else c
            out.append(c)
        elif s.startswith("->", k):
            out.append(".")
            k += 1
        elif not c.isspace():
            out.append(c.upper())
        k += 1
    return "".join(out)


def like_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def like(pattern: str | None, s: str | None) -> bool | None:
    if pattern is None or s is None:
        return None
    return re.match(like_regex(pattern), s) is not None


def strextract(s, begin, end="", occurrence=1, flags=0):
    """Text between two delimiters; flags: 1 ignores case, 2 takes the rest if the end is missing."""
    if s is None or begin is None:
        return None
    hay = s.lower() if flags & 1 else s
    begin_, end_ = (begin.lower(), (end or "").lower()) if flags & 1 else (begin, end or "")
    at = 0
    if begin_:
        at = -1
        for _ in range(max(occurrence, 1)):
            at = hay.find(begin_, at + 1)
            if at < 0:
                return ""
        at += len(begin_)
    if not end_:
        return s[at:]
    stop = hay.find(end_, at)
    if stop < 0:
        return s[at:] if flags & 2 else ""
    return s[at:stop]


def memo_lines(s: str | None, width: int = 50) -> list[str]:
    """Lines of a text, wrapped at blanks to a width; longer words are cut."""
    out: list[str] = []
    for line in re.split(r"\r\n|\r|\n", s or ""):
        out += textwrap.wrap(line, max(width, 1), drop_whitespace=True, break_long_words=True) or [""]
    return out


def transform(value, picture: str = "") -> str | None:
    """A value by a picture: @! upper, @0 hexadecimal, 9 # , . * $ X and literal places for numbers and texts."""
    if value is None or value is pd.NaT:
        return ".NULL."
    if isinstance(value, bool):
        return (("Y" if value else "N") if "Y" in picture.upper() else ".T." if value else ".F.")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.strftime("%m/%d/%Y %I:%M:%S %p" if isinstance(value, dt.datetime) else "%m/%d/%Y")
    flags = ""
    if picture.startswith("@"):
        flags, _, picture = picture[1:].partition(" ")
        flags = flags.upper()
    if isinstance(value, str):
        s = value.upper() if "!" in flags else value
        if not picture:
            return s
        out, k = [], 0
        for c in picture:
            if c.upper() in "X9#AN!Y":
                if k >= len(s):
                    out.append(" ")
                    continue
                out.append(s[k].upper() if c == "!" else s[k])
                k += 1
            else:
                out.append(c)
                k += "R" not in flags and k < len(s)
        return "".join(out)
    if "0" in flags:
        return f"0x{int(value) & 0xFFFFFFFF:08X}"
    if not picture:
        return f"{value:g}" if isinstance(value, float) and abs(value) < 1e15 and not float(value).is_integer() else str(int(value)) if float(value).is_integer() else str(value)
    places = len(picture.partition(".")[2].strip())
    digits = f"{abs(float(value)):.{places}f}"
    whole, _, frac = digits.partition(".")
    out, rest = [], list(whole)
    head = picture.partition(".")[0]
    for c in reversed(head):
        if c in "9#*$0":
            out.append(rest.pop() if rest else "*" if c == "*" else "0" if c == "0" else " ")
        elif c == ",":
            out.append("," if rest else "*" if "*" in head else " ")
        else:
            out.append(c)
    if rest:
        return re.sub("[9#]", "*", picture)
    text = "".join(reversed(out))
    if float(value) < 0 and float(digits):
        k = len(text) - len(text.lstrip(" "))
        text = text[: k - 1] + "-" + text[k:] if k else "-" + text
    return text + ("." + frac if places else "")


def crc16(s: str | None) -> str | None:
    """CRC-16/CCITT of a text's bytes, as a number in text."""
    if s is None:
        return None
    crc = 0xFFFF
    for b in s.encode("cp1252", "replace"):
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return str(crc)


def strconv(s, how: int):
    """Conversions between encodings: 5, 6 UTF-16; 7, 8 lower, upper; 9, 10 to and from UTF-8; 13, 14 base64; 15, 16 hexadecimal."""
    import base64

    if s is None:
        return None
    raw = s.encode("cp1252", "replace")
    made = {
        5: lambda: s.encode("utf-16-le").decode("latin-1"),
        6: lambda: s.encode("latin-1", "replace").decode("utf-16-le", "replace"),
        7: s.lower,
        8: s.upper,
        9: lambda: s.encode("utf-8").decode("cp1252", "replace"),
        10: lambda: raw.decode("utf-8", "replace"),
        13: lambda: base64.b64encode(raw).decode(),
        14: lambda: base64.b64decode(s + "=" * (-len(s) % 4)).decode("cp1252", "replace"),
        15: lambda: raw.hex().upper(),
        16: lambda: bytes.fromhex(s).decode("cp1252", "replace"),
    }
    return made.get(how, lambda: s)()


def apply(fn, kind: str, *cols: Column) -> Column:
    """fn over the values of columns, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        clean = [s.astype(object).where(s.notna(), None) for s in series]
        return pd.Series([fn(*row) for row in zip(*clean)], dtype=object)

    return run(*cols)
