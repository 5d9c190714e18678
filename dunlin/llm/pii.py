"""PII: format-preserving Feistel pseudonyms.

Main path: DataFrame functions only. Validated values are permuted within their own format by a keyed
Feistel network, so a value has the same pseudonym in every document and no two values share one:

* card numbers (13 to 19 digits, blanks or hyphens between, Luhn): permuted but for the last digit,
  which becomes the Luhn digit of the new number. In a longer run of digits each number is validated
  alone: first the usual layouts (solid, 4-4-4-4, 4-6-5 and such), then a whole run of 13 to 19 digits,
  then other groups of 3 to 7 digits; the leftmost counts where valid ones overlap, the longest of its place;
* IPv4 addresses (four numbers to 255): the 32-bit number is permuted;
* phone numbers (+country code, or a bracketed area code, or groups of 3, 3 and 4; 9 to 15 digits)
  and numbers in the groups 3-2-4: the digits after a country code are permuted;
* dates (valid, 1900-01-01 to 2099-11-12; y-m-d, y/m/d, d.m.y, m/d/y): the day number is permuted, so
  one day written in two ways stays one day;
* e-mail addresses: letters and digits before the @ are permuted, each within its kind;
* secrets (`token = "..."` and the like): letters and digits are permuted, hexadecimal stays so.

All else stays as it is, numbers that fail validation too. A null text stays null, an empty one
empty; every row gives one row, with its other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that holds the key, and what the registered queries use where it is unset, as in tests.
KEY_SETTING, TEST_KEY = "spark.dunlin.pii.key", "not secret"

_OCT = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns, each anchored so that it starts and ends outside a longer number or word.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+"
SECRET = r"(?i:\b(?:api[_-]?key|token|secret|password|passwd|pwd)\b[\"']?\s*[=:]\s*[\"']?)[A-Za-z0-9_+/=-]{16,}"
IP = rf"(?<![0-9.]){_OCT}(?:\.{_OCT}){{3}}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])"
#: Usual layouts of card numbers, the shorter ones (which a phone number's digits may fill) apart.
_LONG_CARD = "|".join(f"[0-9]{{4}}(?:{c}[0-9]{{4}}){{3}}(?:{c}[0-9]{{1,3}})?|[0-9]{{4}}{c}[0-9]{{6}}{c}[0-9]{{5}}" for c in " -")
_CARD = "|".join(("[0-9]{13,19}", _LONG_CARD, *(f"[0-9]{{4}}(?:{c}[0-9]{{4}}){{2}}{c}[0-9]{{1,3}}|[0-9]{{4}}{c}[0-9]{{6}}{c}[0-9]{{4}}|[0-9]{{6}}{c}[0-9]{{7,13}}" for c in " -")))
_GROUPS = "[0-9]{3,7}(?:[ -][0-9]{3,7}){1,5}"
#: A phone number ends before a card number that ends its run, and after nine digits before any.
_NO_LONG_CARD, _NO_CARD = (rf"(?!(?<![0-9])(?:{p})(?![0-9]|[ -][0-9]))" for p in (_LONG_CARD, _CARD))
_NO_CARD += rf"(?!(?<=[0-9]{'[ ().-]{0,2}[0-9]' * 8}[ .-])(?:{_CARD})(?![0-9]))"
PHONE = (
    rf"(?<![0-9+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?{_NO_LONG_CARD}[0-9]{{2,4}}(?:[ .-]?{_NO_CARD}[0-9]{{2,4}}){{1,4}}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|[.-][0-9])"
)
#: A whole run of 13 or more digits, up to where another value starts; card() finds the numbers in it.
_PART = rf"(?>[0-9](?:-?[0-9]){{12,18}}(?![0-9]|-[0-9])|[0-9]++(?:-(?!{PHONE})[0-9]++)*+)"
CARD = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}}){_PART}(?: (?!{EMAIL}|{IP}|{DATE}|{PHONE}){_PART})*+(?<=[0-9]{'[ -]?[0-9]' * 12})"  # written out, as a look-behind may not hold such a group repeated
ANY = "|".join((SECRET, EMAIL, IP, DATE, PHONE, CARD))
KINDS = ("secret", "email", "ip", "date", "phone", "card")


def bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 512)


def drawn(hashed: Column, i: Column) -> Column:
    """The i-th 16-bit number of a 512-bit digest, i from 0 and taken modulo 32."""
    return F.conv(F.substring(hashed, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def shifted(c: Column, by: Column, hexadecimal: bool) -> Column:
    """A letter or digit moved on within its kind; anything else stays."""
    code = F.ascii(c)

    def within(low: int, size: int) -> Column:
        return F.char(F.lit(low) + (code - low + by) % size)

    letters = 6 if hexadecimal else 26
    return (
        F.when(code.between(48, 57), within(48, 10))
        .when(code.between(97, 96 + letters), within(97, letters))
        .when(code.between(65, 64 + letters), within(65, letters))
        .otherwise(c)
    )


def permuted(s: Column, tweak: Column, key: str, hexadecimal: bool = False, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of strings with the same places of letters, digits and other characters."""
    half = (F.length(s) / 2).cast("int")
    state = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))

    def step(acc: Column, n: Column) -> Column:
        def moved(h: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(acc.l)), lambda i: shifted(F.substring(acc.l, i, F.lit(1)), drawn(h, i - 1), hexadecimal)), "")

        left = F.when(F.length(acc.l) > 0, bind(digest(F.lit(key), n.cast("string"), tweak, F.length(s).cast("string"), acc.r), moved)).otherwise("")
        return F.struct(acc.r.alias("l"), left.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step, lambda a: F.concat(a.l, a.r))


def permuted_number(x: Column, a: int, b: int, tweak: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    state = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def value(n: Column, part: Column) -> Column:
        return F.conv(F.substring(digest(F.lit(key), F.lit(tweak), n.cast("string"), part.cast("string")), 1, 12), 16, 10).cast("long")

    def step(acc: Column, n: Column) -> Column:
        odd = n % 2 == 1
        return F.struct(F.when(odd, (acc.l + value(n, acc.r)) % a).otherwise(acc.l).alias("l"), F.when(odd, acc.r).otherwise((acc.r + value(n, acc.l)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step, lambda s: s.l * b + s.r)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counted once."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def laid_out(form: Column, digits: Column) -> Column:
    """digits in the places of the digits of form."""

    def at(i: Column) -> Column:
        c = F.substring(form, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(form, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def card_number(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permuted(F.substring(d, F.lit(1), F.length(d) - 1), F.lit("card"), key)
        return bind(body, lambda b: laid_out(m, F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return bind(F.regexp_replace(m, "[^0-9]", ""), new)


#: Groups of digits of a card number at most, but for a whole run.
WIDEST = 6


def _apart(found: Column) -> Column:
    """Of windows in order of their places those that overlap no earlier one taken."""
    start = F.struct(F.filter(found, lambda c: F.lit(False)).alias("taken"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        more = F.struct(F.concat(acc.taken, F.array(c)).alias("taken"), (c.at + c.wide - 1).alias("end"))
        return F.when(c["at"] > acc.end, more).otherwise(acc)

    return F.aggregate(found, start, step, lambda acc: acc.taken)


def card(m: Column, key: str) -> Column:
    """(value, n): a run of digits with its valid card numbers replaced, and how many of them changed."""

    def within(parts: Column) -> Column:
        n = F.size(parts)

        def window(k: Column, wide: Column) -> Column:
            text = F.regexp_replace(F.array_join(F.slice(parts, k, wide), ""), "[ -]$", "")
            digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
            rank = F.when(text.rlike(f"^(?:{_CARD})$"), 0).when(digits.between(13, 19) & ((wide == n) | text.rlike(f"^(?:{_GROUPS})$")), 1)
            return F.struct(k.alias("at"), wide.alias("wide"), text.alias("text"), rank.alias("rank"))

        def valid(c: Column) -> Column:
            return F.when(c.rank.isNotNull(), luhn_sum(F.regexp_replace(c.text, "[^0-9]", "")) % 10 == 0).otherwise(False)

        wides = lambda k: F.sequence(F.least(F.lit(WIDEST), n - k + 1), F.lit(1), F.lit(-1))
        found = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.filter(F.transform(wides(k), lambda w: window(k, w)), valid)))
        whole = F.filter(F.array(window(F.lit(1), n)), lambda c: (n > WIDEST) & valid(c))
        return bind(F.concat(whole, found), lambda f: bind(_apart(F.filter(f, lambda c: c.rank == 0)), lambda usual: _replaced_windows(parts, _with_others(usual, f), key)))

    return bind(F.regexp_extract_all(m, F.lit("([0-9]+[ -]?)"), F.lit(1)), within)


def _with_others(usual: Column, found: Column) -> Column:
    """usual and the windows of other layouts that overlap none of them, by place."""
    clear = lambda c: ~F.exists(usual, lambda u: (u["at"] < c["at"] + c.wide) & (c["at"] < u["at"] + u.wide))
    return F.array_sort(F.concat(usual, _apart(F.filter(found, lambda c: F.when(c.rank == 1, clear(c)).otherwise(False)))))


def _replaced_windows(parts: Column, taken: Column, key: str) -> Column:
    def use(t: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            before = F.when(i > 0, F.element_at(t, F.greatest(i, F.lit(1)))["at"] + F.element_at(t, F.greatest(i, F.lit(1))).wide).otherwise(1)
            last = F.element_at(parts, c["at"] + c.wide - 1)
            new = card_number(c.text, key)
            return F.struct(F.concat(F.array_join(F.slice(parts, before, c["at"] - before), ""), new, F.regexp_extract(last, "[ -]?$", 0)).alias("value"), (new != c.text).cast("int").alias("n"))

        end = F.when(F.size(t) > 0, F.element_at(t, F.greatest(F.size(t), F.lit(1)))["at"] + F.element_at(t, F.greatest(F.size(t), F.lit(1))).wide).otherwise(1)
        rest = F.array_join(F.slice(parts, end, F.size(parts)), "")
        return bind(F.transform(t, piece), lambda p: F.struct(F.concat(F.array_join(F.transform(p, lambda x: x.value), ""), rest).alias("value"), F.aggregate(p, F.lit(0), lambda acc, x: acc + x.n).alias("n")))

    return bind(taken, use)


def ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    n = F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return bind(permuted_number(n, 65536, 65536, "ip", key), lambda v: F.concat_ws(".", *(F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0))))


def phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    every = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(every.between(9, 15), F.concat(code, bind(digits, lambda d: laid_out(rest, permuted(d, F.lit("number"), key))))).otherwise(m)


#: 1900-01-01 is this many days before 1970-01-01; the permuted days are 365 * 200 from there.
FIRST_DAY, YEARS, DAYS = -25567, 365, 200


def date(m: Column, key: str) -> Column:
    forms = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy"))
    out = m
    for pattern, form in forms:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), F.lit("1970-01-01").cast("date")) - FIRST_DAY
        out = F.when(m.rlike(pattern), F.coalesce(bind(day, _day_in(form, m, key)), m)).otherwise(out)
    return out


def _day_in(form: str, m: Column, key: str):
    def use(day: Column) -> Column:
        new = F.date_add(F.lit("1900-01-01").cast("date"), permuted_number(day.cast("long"), YEARS, DAYS, "date", key).cast("int"))
        return F.when(day.between(0, YEARS * DAYS - 1), F.date_format(new, form)).otherwise(m)

    return use


def email(m: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), F.lit("email"), key), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9_+/=-]{16,}$", 0)
    head = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    low = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.concat(head, F.when(low, permuted(value, F.lit("hex"), key, hexadecimal=True)).otherwise(permuted(value, F.lit("secret"), key)))


def kind_of(m: Column) -> Column:
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.rlike(f"^{SECRET}$"), "secret").when(F.contains(m, F.lit("@")), "email").when(full(IP), "ip").when(full(DATE), "date").when(full(PHONE), "phone").otherwise("card")
    )


def replaced(m: Column, key: str) -> Column:
    """(value, n): a match with its private values replaced, and how many of them changed."""
    k = kind_of(m)
    makers = {"secret": secret, "email": email, "ip": ip, "date": date, "phone": phone}
    out = m
    for name, make in makers.items():
        out = F.when(k == name, make(m, key)).otherwise(out)
    return F.when(k == "card", card(m, key)).otherwise(bind(out, lambda o: F.struct(o.alias("value"), (o != m).cast("int").alias("n"))))


def session_key(spark: SparkSession) -> str:
    """The key of the session; a known one where none is set, which hides nothing from its readers."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the private values of text_col replaced under the caller's key; count_col, if named, counts the values changed."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col(f"`{text_col}`")
    may = text.rlike("[0-9@]|(?i:token|secret|passw|pwd|api[_-]?key)") & text.rlike(ANY)
    old, new, parts = "__dunlin_old", "__dunlin_new", "__dunlin_parts"
    wide = docs.withColumn(old, F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    wide = wide.withColumn(new, F.transform(old, lambda m: replaced(m, key))).withColumn(parts, F.when(F.col(old).isNotNull(), F.split(text, ANY, -1)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(parts, 1, F.size(new)), new, lambda a, b: F.concat(a, b.value)), ""), F.element_at(parts, -1))
    changed = F.aggregate(new, F.lit(0), lambda acc, x: acc + x.n)
    out = wide.withColumn(text_col, F.when(F.col(old).isNotNull(), joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(old).isNotNull(), changed).otherwise(0).cast("long"))
    return out.drop(old, new, parts)
