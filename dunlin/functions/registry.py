"""The dialect's functions: name to builder of a typed column."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlin.functions import text_udfs as U
from dunlin.lang.expr import EMPTY_DATE, Call, parse_expression
from dunlin.plans import compare
from dunlin.plans.values import NUMERIC, Val, empty_date, guarded, literal, null, number, stamp, text
from dunlin.settings import DialectError

if TYPE_CHECKING:
    from dunlin.plans.compile import Compiler

Builder = Callable[["Compiler", list[Val]], Val]
FUNCTIONS: dict[str, Builder] = {}


def named(*names: str):
    def put(f: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return put


def build(compiler: Compiler, node: Call) -> Val:
    f = FUNCTIONS.get(node.name)
    if f is None:
        if compiler.settings.strict:
            raise DialectError(f"unknown function {node.name}", 1)
        return null()
    try:
        return f(compiler, [compiler.value(a) for a in node.args])
    except IndexError:
        raise DialectError(f"too few arguments for {node.name}", 1229) from None


def C(col: Column) -> Val:
    return Val(col, "C")


def I(col: Column) -> Val:  # noqa: E743
    return Val(col.cast("int"), "I")


def B(col: Column) -> Val:
    return Val(col, "B")


def L(col: Column) -> Val:
    return Val(col, "L")


def int_(v: Val) -> Column:
    return F.lit(int(v.lit)) if v.is_lit and isinstance(v.lit, (int, float)) else number(v).cast("int")


# -- texts

named("UPPER")(lambda c, a: C(F.upper(text(a[0]))))
named("LOWER")(lambda c, a: C(F.lower(text(a[0]))))
named("ALLTRIM", "ALLT")(lambda c, a: C(F.trim(text(a[0]))))
named("TRIM", "RTRIM")(lambda c, a: C(F.rtrim(text(a[0]))))
named("LTRIM")(lambda c, a: C(F.ltrim(text(a[0]))))
named("LEN", "TXTWIDTH")(lambda c, a: I(F.length(text(a[0]))))
named("LEFT", "LEFTC")(lambda c, a: C(F.substring(text(a[0]), F.lit(1), F.greatest(int_(a[1]), F.lit(0)))))
named("SPACE")(lambda c, a: C(F.repeat(F.lit(" "), F.greatest(int_(a[0]), F.lit(0)))))
named("REPLICATE")(lambda c, a: C(F.repeat(text(a[0]), F.greatest(int_(a[1]), F.lit(0)))))
named("CHRTRAN", "CHRTRANC")(lambda c, a: C(F.translate(text(a[0]), a[1].lit, a[2].lit) if a[1].is_lit and a[2].is_lit else chrtran(*map(text, a[:3]))))
named("OCCURS")(lambda c, a: I(F.when(F.length(text(a[0])) == 0, 0).otherwise((F.length(text(a[1])) - F.length(F.replace(text(a[1]), text(a[0])))) / F.length(text(a[0])))))
named("PROPER")(lambda c, a: C(F.initcap(text(a[0]))))
named("ISDIGIT")(lambda c, a: L(text(a[0]).rlike(r"^\d")))
named("ISALPHA")(lambda c, a: L(text(a[0]).rlike(r"^\p{L}")))
named("ISUPPER")(lambda c, a: L(text(a[0]).rlike(r"^\p{Lu}")))
named("ISLOWER")(lambda c, a: L(text(a[0]).rlike(r"^\p{Ll}")))
named("ISLEADBYTE")(lambda c, a: L(F.lit(False)))


def chrtran(s: Column, old: Column, new: Column) -> Column:
    def one(x: Column) -> Column:
        at = F.position(x, old)
        return F.when(at == 0, x).otherwise(F.substring(new, at, F.lit(1)))

    return F.array_join(F.transform(F.split(s, ""), one), "")


@named("RIGHT", "RIGHTC")
def right(c, a):
    s, n = text(a[0]), F.greatest(int_(a[1]), F.lit(0))
    return C(F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), n))


@named("SUBSTR", "SUBSTRC")
def substr(c, a):
    s, start = text(a[0]), F.greatest(int_(a[1]), F.lit(1))
    return C(F.substring(s, start, F.greatest(int_(a[2]), F.lit(0)) if len(a) > 2 else F.length(s)))


def _str(v: Val, width: Column, places: Column | int, most: int) -> Column:
    out = F.repeat(F.lit("*"), width)
    x = number(v)
    for d in range(most + 1):
        made = F.format_string(f"%.{d}f", F.round(x, d))
        ok = F.length(made) <= width
        out = F.when(ok if isinstance(places, int) else ok & (places >= d), F.lpad(made, width, " ")).otherwise(out)
    return guarded(out, v)


@named("STR")
def str_(c, a):
    width = F.greatest(int_(a[1]), F.lit(0)) if len(a) > 1 else F.lit(10)
    if len(a) > 2 and not a[2].is_lit:
        return C(_str(a[0], width, int_(a[2]), 18))
    places = max(int(a[2].lit or 0), 0) if len(a) > 2 else 0
    return C(_str(a[0], width, places, min(places, 18)))


@named("STRZERO")
def strzero(c, a):
    s = str_(c, a).col
    cut = F.ltrim(s)
    body = F.when(F.startswith(cut, F.lit("-")), F.concat(F.lit("-"), F.lpad(F.substring(cut, F.lit(2), F.length(cut)), F.length(s) - 1, "0")))
    return C(body.otherwise(F.lpad(cut, F.length(s), "0")))


def _pad(a: list[Val]) -> tuple[Column, Column, Column]:
    s = text(a[0]) if a[0].kind in "CX" else F.trim(_str(a[0], F.lit(20), 0, 0))
    n = F.greatest(int_(a[1]), F.lit(0))
    fill = F.substring(text(a[2]), 1, 1) if len(a) > 2 else F.lit(" ")
    return s, n, fill


named("PADL")(lambda c, a: C((lambda s, n, f: F.lpad(s, n, f))(*_pad(a))))
named("PADR")(lambda c, a: C((lambda s, n, f: F.rpad(s, n, f))(*_pad(a))))


@named("PADC")
def padc(c, a):
    s, n, f = _pad(a)
    left = F.floor((n - F.length(s)) / 2).cast("int")
    return C(F.when(F.length(s) >= n, F.substring(s, F.lit(1), n)).otherwise(F.rpad(F.lpad(s, F.length(s) + left, f), n, f)))


def nth(needle: Column, hay: Column, n: Column) -> Column:
    """Place of the n-th occurrence, overlapping ones counted; 0 if there is none."""

    def step(acc: Column, _: Column) -> Column:
        at = F.position(needle, hay, acc + 1)
        return F.when((acc < 0) | (at == 0), -1).otherwise(at)

    found = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)
    return F.when(F.length(needle) == 0, 0).otherwise(F.greatest(found, F.lit(0)))


def _at(needle: Val, hay: Val, a: list[Val], fold: bool) -> Column:
    x, y = text(needle), text(hay)
    if fold:
        x, y = F.lower(x), F.lower(y)
    if len(a) < 3:
        return guarded(F.when(F.length(x) == 0, 0).otherwise(F.position(x, y)), needle, hay)
    return guarded(nth(x, y, int_(a[2])), needle, hay)


named("AT", "AT_C")(lambda c, a: I(_at(a[0], a[1], a, False)))
named("ATC", "ATCC")(lambda c, a: I(_at(a[0], a[1], a, True)))


@named("RAT", "RATC")
def rat(c, a):
    x, y = text(a[0]), text(a[1])
    n = int_(a[2]) if len(a) > 2 else F.lit(1)
    at = nth(F.reverse(x), F.reverse(y), n)
    return I(guarded(F.when(at == 0, 0).otherwise(F.length(y) - F.length(x) - at + 2), *a[:2]))


@named("STUFF", "STUFFC")
def stuff(c, a):
    s, at, n, new = text(a[0]), F.greatest(int_(a[1]), F.lit(1)), F.greatest(int_(a[2]), F.lit(0)), text(a[3])
    at = F.least(at, F.length(s) + 1)
    return C(F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + n, F.length(s))))


@named("STRTRAN")
def strtran(c, a):
    if len(a) > 3:
        raise DialectError("STRTRAN takes three arguments", 1230)
    s, old, new = text(a[0]), text(a[1]), text(a[2]) if len(a) > 2 else F.lit("")
    return C(F.when(F.length(old) == 0, s).otherwise(F.replace(s, old, new)))


#: Letters of code page 1252 from 128 to 159; undefined places stay themselves.
HIGH = bytes(range(128, 160)).decode("cp1252", "replace")


@named("CHR")
def chr_(c, a):
    n = int_(a[0])
    page = F.create_map(*(x for k, ch in enumerate(HIGH) if ch != "�" for x in (F.lit(128 + k), F.lit(ch))))
    return C(F.when(n.between(128, 159), F.coalesce(F.try_element_at(page, n), F.char(n))).otherwise(F.char(n)))


@named("ASC")
def asc(c, a):
    first = F.substring(text(a[0]), 1, 1)
    page = F.create_map(*(x for k, ch in enumerate(HIGH) if ch != "�" for x in (F.lit(ch), F.lit(128 + k))))
    return I(F.when(F.length(first) == 0, 0).otherwise(F.coalesce(F.try_element_at(page, first), F.ascii(first))))


@named("LIKE", "LIKEC")
def like(c, a):
    if a[0].is_lit and isinstance(a[0].lit, str):
        pattern = "(?s)^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in a[0].lit) + "$"
        return L(text(a[1]).rlike(pattern))
    parts = F.transform(F.split(text(a[0]), ""), lambda x: F.when(x == "*", ".*").when(x == "?", ".").when(x == "", "").otherwise(F.concat(F.lit("\\Q"), x, F.lit("\\E"))))
    return L(F.regexp_like(text(a[1]), F.concat(F.lit("(?s)^"), F.array_join(parts, ""), F.lit("$"))))


@named("GETWORDCOUNT")
def word_count(c, a):
    return I(F.size(_words(a, 1)))


@named("GETWORDNUM")
def word_num(c, a):
    return C(F.coalesce(F.get(_words(a, 2), int_(a[1]) - 1), guarded(F.lit(""), a[0])))


def _words(a: list[Val], at: int) -> Column:
    marks = a[at].lit if len(a) > at and a[at].is_lit else " \t\r\n"
    return F.filter(F.split(text(a[0]), "[" + re.escape(marks).replace("]", "\\]") + "]"), lambda x: x != "")


def soundex(s: Column) -> Column:
    """First letter and the next letters' sound groups, a run of one group once; see text_udfs.soundex."""
    up = F.upper(F.trim(s, F.lit(" \t\r\n")))
    groups = F.translate(F.regexp_replace(up, "[^A-Z]", "0"), "".join(U.SOUND) + "AEHIOUWY", "".join(U.SOUND.values()) + "0" * 8)
    later = F.replace(F.substring(F.regexp_replace(groups, r"([1-6])\1+", "$1"), 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.rpad(F.concat(F.substring(up, 1, 1), later), 4, "0")


@named("SOUNDEX")
def soundex_(c, a):
    return C(soundex(text(a[0])))


@named("DIFFERENCE")
def difference(c, a):
    x, y = soundex(text(a[0])), soundex(text(a[1]))
    same = [(F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int") for k in range(1, 5)]
    return Val(sum(same[1:], same[0]), "I")


named("NORMALIZE")(lambda c, a: C(U.apply(U.normalize, "string", text(a[0]))))


@named("TRANSFORM")
def transform(c, a):
    picture = str(a[1].lit) if len(a) > 1 else ""
    v = a[0].col.cast("double") if a[0].kind in "NY" else a[0].col
    return C(U.apply(lambda x: U.transform(x, picture), "string", v))


@named("STREXTRACT")
def strextract(c, a):
    begin, end, occurrence, flags = ([v.lit for v in a[1:]] + ["", "", 1, 0][len(a) - 1 :])[:4]
    s = text(a[0])
    if begin is None:
        return null("C")
    if int(flags) & 1:  # case folding may change lengths
        return C(U.apply(lambda x: U.strextract(x, begin, end, int(occurrence), int(flags)), "string", s))
    if begin:
        at = F.position(F.lit(begin), s)
        for _ in range(1, int(occurrence)):
            at = F.when(at > 0, F.position(F.lit(begin), s, at + 1)).otherwise(0)
        rest = F.when(at > 0, F.substring(s, at + len(begin), F.length(s)))
    else:
        rest = s
    if end:
        stop = F.position(F.lit(end), rest)
        rest = F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).when(F.lit(bool(int(flags) & 2)), rest)
    return C(guarded(F.coalesce(rest, F.lit("")), a[0]))


named("STRCONV", "CPCONVERT")(lambda c, a: C(U.apply(lambda s, how=int(a[-1].lit if a[-1].kind != "C" else a[0].lit): U.strconv(s, how), "string", text(next(v for v in a if v.kind == "C")))))


@named("ALINES")
def alines(c, a):
    flags = int(a[1].lit) if len(a) > 1 and a[1].kind == "I" else 0
    marks = [v.lit for v in a[1:] if v.kind == "C"]
    parts = F.split(text(a[0]), "|".join(map(re.escape, marks)) if marks else "\r\n|\r|\n")
    if flags & 1:
        parts = F.transform(parts, F.trim)
    if flags & 4:
        parts = F.filter(parts, lambda x: x != "")
    return Val(parts, "A")


def _memo(c, a, at: int) -> int:
    return int(a[at].lit) if len(a) > at else c.settings.memowidth


@named("MEMLINES")
def memlines(c, a):
    w = _memo(c, a, 1)
    return Val(U.apply(lambda s: None if s is None else len(U.memo_lines(s, w)) if s else 0, "int", text(a[0])), "I")


@named("MLINE")
def mline(c, a):
    w = c.settings.memowidth
    return C(U.apply(lambda s, n: None if s is None else (U.memo_lines(s, w) + [""])[min(int(n) - 1, len(U.memo_lines(s, w)))] if n >= 1 else "", "string", text(a[0]), int_(a[1])))


def _line_of(find: str, fold: bool):
    def make(c, a):
        w = c.settings.memowidth

        def at(x, s):
            if x is None or s is None:
                return None
            lines = [line.lower() if fold else line for line in U.memo_lines(s, w)]
            hits = [k + 1 for k, line in enumerate(lines) if (x.lower() if fold else x) in line]
            return (hits[-1] if find == "last" else hits[0]) if hits else 0

        return Val(U.apply(at, "int", text(a[0]), text(a[1])), "I")

    return make


named("ATLINE")(_line_of("first", False))
named("ATCLINE")(_line_of("first", True))
named("RATLINE")(_line_of("last", False))


@named("TEXTMERGE")
def textmerge(c, a):
    parts = re.split(r"<<(.*?)>>", str(a[0].lit))
    cols = [F.lit(p) if k % 2 == 0 else shown(c.value(parse_expression(p))) for k, p in enumerate(parts)]
    return C(F.concat(*cols))


def shown(v: Val) -> Column:
    if v.kind in "DT":
        return dtoc_col(v)
    return v.col.cast("string")


# -- conversion and dates

named("DAY")(lambda c, a: I(F.dayofmonth(a[0].col)))
named("MONTH")(lambda c, a: I(F.month(a[0].col)))
named("YEAR")(lambda c, a: I(F.year(a[0].col)))
named("HOUR")(lambda c, a: I(F.hour(stamp(a[0]))))
named("MINUTE")(lambda c, a: I(F.minute(stamp(a[0]))))
named("SEC")(lambda c, a: I(F.second(stamp(a[0]))))
named("DOW")(lambda c, a: I(F.dayofweek(a[0].col)))
named("CDOW")(lambda c, a: C(F.date_format(a[0].col, "EEEE")))
named("CMONTH")(lambda c, a: C(F.date_format(a[0].col, "MMMM")))
named("DATE")(lambda c, a: Val(F.make_date(*map(int_, a[:3])), "D") if len(a) > 2 else Val(F.current_date(), "D"))
named("DATETIME")(lambda c, a: Val(F.localtimestamp(), "T"))
named("SECONDS")(lambda c, a: B((F.unix_micros(F.current_timestamp()) % 86_400_000_000) / 1e6))
named("TTOD")(lambda c, a: Val(a[0].col.cast("date"), "D"))
named("DTOT")(lambda c, a: Val(stamp(a[0]), "T"))
named("TTOC")(lambda c, a: C(F.date_format(stamp(a[0]), "MM/dd/yyyy hh:mm:ss a")))


@named("VAL")
def val(c, a):
    found = F.regexp_extract(F.ltrim(text(a[0])), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return B(guarded(F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0)), a[0]))


@named("CTOD")
def ctod(c, a):
    s = F.trim(text(a[0]))
    tries = [F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in ("M/d/yyyy", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy")]
    return Val(guarded(F.coalesce(*tries, empty_date()), a[0]), "D")


@named("CTOT")
def ctot(c, a):
    s = F.trim(text(a[0]))
    forms = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss", "M/d/yyyy", "yyyy-M-d")
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in forms]
    return Val(guarded(F.coalesce(*tries, stamp(Val(empty_date(), "D"))), a[0]), "T")


def dtoc_col(v: Val, style: int = 0) -> Column:
    blank = 8 if style == 1 else 10
    made = F.date_format(v.col, "yyyyMMdd" if style == 1 else "MM/dd/yyyy")
    return F.when(F.year(v.col) == 1, F.lit(" " * blank)).otherwise(made)


named("DTOC")(lambda c, a: C(dtoc_col(a[0], int(a[1].lit) if len(a) > 1 else 0)))
named("DTOS")(lambda c, a: C(dtoc_col(a[0], 1)))


@named("GOMONTH")
def gomonth(c, a):
    n = int_(a[1])
    if a[0].kind == "T":
        return Val(a[0].col + F.make_ym_interval(F.lit(0), n), "T")
    return Val(F.add_months(a[0].col, n), "D")


# -- numbers

named("INT")(lambda c, a: B((lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"))(number(a[0]))))
named("ABS")(lambda c, a: Val(F.abs(a[0].col), a[0].kind) if a[0].kind in NUMERIC else B(F.abs(number(a[0]))))
named("SQRT")(lambda c, a: B(F.when(number(a[0]) >= 0, F.sqrt(number(a[0])))))
named("SIGN")(lambda c, a: I(F.signum(number(a[0]))))
named("CEILING")(lambda c, a: B(F.ceil(number(a[0])).cast("double")))
named("FLOOR")(lambda c, a: B(F.floor(number(a[0])).cast("double")))
named("EXP")(lambda c, a: B(F.exp(number(a[0]))))
named("LOG")(lambda c, a: B(F.ln(number(a[0]))))
named("LOG10")(lambda c, a: B(F.log10(number(a[0]))))


@named("ROUND")
def round_(c, a):
    n = int(a[1].lit) if len(a) > 1 and a[1].is_lit else 0
    if len(a) > 1 and not a[1].is_lit:
        scale = F.pow(F.lit(10.0), int_(a[1]))
        return B(F.signum(number(a[0])) * F.floor(F.abs(number(a[0])) * scale + 0.5) / scale)
    return B(F.round(number(a[0]), n))


@named("MOD")
def mod(c, a):
    from dunlin.plans.compile import modulo

    return B(modulo(number(a[0]), number(a[1])))


def _extreme(pick):
    def make(c, a):
        if any(v.kind == "X" for v in a):
            return null(next((v.kind for v in a if v.kind != "X"), "X"))
        same = all(v.kind == a[0].kind for v in a)
        if not same and all(v.kind in NUMERIC for v in a):
            return B(guarded(pick(*map(number, a)), *a))
        if not same and all(v.kind in "DT" for v in a):
            return Val(guarded(pick(*map(stamp, a)), *a), "T")
        if not same:
            raise DialectError("MAX and MIN take values of one kind", 9)
        return Val(guarded(pick(*(v.col for v in a)), *a), a[0].kind) if len(a) > 1 else a[0]

    return make


named("MAX")(_extreme(F.greatest))
named("MIN")(_extreme(F.least))


# -- conditions


@named("BETWEEN")
def between(c, a):
    cond = compare.ordered(">=", a[0], a[1], c.settings) & compare.ordered("<=", a[0], a[2], c.settings)
    return L(guarded(cond, *a[:3]))


@named("INLIST")
def inlist(c, a):
    cond = F.lit(False)
    for v in a[1:]:
        if v.kind == "X":
            return null("L")
        cond = cond | compare.equal(a[0], v, c.settings, exact=True)
    same = a[0].kind == "C" and c.settings.collate != "GENERAL" or a[0].kind in NUMERIC
    if same and all(v.is_lit and v.kind == a[0].kind for v in a[1:]):
        cond = a[0].col.isin([v.lit for v in a[1:]])
    return L(guarded(cond, *a))


def _branch(vals: list[Val]) -> tuple[list[Column], str]:
    kinds = {v.kind for v in vals if v.kind != "X"}
    if not kinds:
        return [v.col for v in vals], "X"
    if len(kinds) == 1:
        return [v.col for v in vals], kinds.pop()
    if kinds <= NUMERIC:
        return [number(v) for v in vals], "B"
    if kinds <= {"D", "T"}:
        return [stamp(v) for v in vals], "T"
    return [v.col.cast("string") for v in vals], "C"


@named("IIF")
def iif(c, a):
    (x, y), kind = _branch(a[1:3])
    cond = a[0].col if a[0].kind == "L" else F.lit(None).cast("boolean")
    return Val(F.when(cond, x).otherwise(y), kind)


@named("ICASE")
def icase(c, a):
    conds, vals = a[0 : len(a) // 2 * 2 : 2], a[1::2]
    rest = [a[-1]] if len(a) % 2 else []
    cols, kind = _branch(vals[: len(conds)] + rest)
    out = cols[-1] if rest else F.lit(None)
    for k in range(len(conds) - 1, -1, -1):
        out = F.when(conds[k].col if conds[k].kind == "L" else F.lit(None).cast("boolean"), cols[k]).otherwise(out)
    return Val(out, kind)


named("ISNULL")(lambda c, a: L(a[0].col.isNull()))
named("NVL")(lambda c, a: (lambda cols, k: Val(F.coalesce(*cols), k))(*_branch(a[:2])))


@named("EMPTY")
def empty(c, a):
    v = a[0]
    if v.kind == "X":
        return L(F.lit(True))
    if v.kind == "C":
        hit = F.trim(v.col, F.lit(" \t\r\n")) == ""
    elif v.kind in NUMERIC:
        hit = v.col == 0
    elif v.kind == "L":
        hit = ~v.col
    elif v.kind in "DT":
        hit = F.year(v.col) == EMPTY_DATE.year
    else:
        hit = F.length(v.col) == 0
    return L(F.coalesce(hit, F.lit(True)))


@named("ISBLANK")
def isblank(c, a):
    v = a[0]
    if v.kind == "C":
        return L(F.coalesce(F.trim(v.col) == "", F.lit(True)))
    return L(v.col.isNull() if v.kind != "D" else v.col.isNull() | (F.year(v.col) == 1))


@named("VARTYPE", "TYPE")
def vartype(c, a):
    return literal({"I": "N", "B": "N"}.get(a[0].kind, a[0].kind))


@named("EVALUATE", "EVAL")
def evaluate(c, a):
    if not a[0].is_lit:
        raise DialectError("EVALUATE takes a constant text", 9)
    return c.value(parse_expression(a[0].lit))


@named("SYS")
def sys_(c, a):
    n = int(a[0].lit)
    if n == 2007:
        return C(U.apply(U.crc16, "string", text(a[1])))
    if n == 15:
        return C(chrtran(text(a[2]), F.lit("".join(map(chr, range(256)))), text(a[1])))
    if n == 2015:
        return C(F.concat(F.lit("_"), F.upper(F.substring(F.replace(F.uuid(), F.lit("-")), 1, 9))))
    if n in (1, 10, 11):
        return C(F.date_format(F.current_date(), "yyyyMMdd")) if n == 1 else C(a[1].col.cast("string"))
    if n == 14:
        return C(F.lit("CDX"))
    return C(F.lit({0: "spark # dunlin", 21: "0", 22: "", 2021: "", 2029: "48"}.get(n, "")))


named("COCREATEGUID")(lambda c, a: C(F.upper(F.uuid())))
named("CANDIDATE", "PRIMARY")(lambda c, a: L(F.lit(False)))
named("CPCURRENT", "CPDBF")(lambda c, a: literal(1252))
named("MESSAGEBOX")(lambda c, a: literal(6))
