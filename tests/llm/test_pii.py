import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dunlin.llm import pii as P
from dunlin.llm.pii import pseudonymise

KEY = "a test key"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def run(spark, texts, key=KEY, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    return [r.text for r in pseudonymise(df, key, **more).orderBy("doc_id").collect()]


def test_formats_and_links(spark):
    texts = [
        "card 4111111111111111 and 4111-1111-1111-1111.",
        "again 4111111111111111!!",
        "not a card 4111111111111112, not an ip 300.1.2.3, no date 2020-13-45",
        "call +1 (523) 555-1055 or (523) 555-1055, ssn 123-45-6789",
        "ip 152.143.123.131### born 1980-02-29 or 29.02.1980 or 02/29/1980",
        'that.92@mail4.example.com token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
        None,
        "",
        "plain text, version 2.0. and 12 apples",
    ]
    out = run(spark, texts)
    a, b = re.findall(r"\d[\d-]{14,}\d", out[0])
    assert a != "4111111111111111" and luhn(a) and re.sub("-", "", b) == a and b.count("-") == 3
    assert a in out[1] and out[1].endswith("!!")
    assert out[2] == texts[2]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}, ssn \d{3}-\d\d-\d{4}", out[3]) and "555-1055" not in out[3]
    m = re.fullmatch(r"ip ([\d.]+)### born (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4}) or (\d\d)/(\d\d)/(\d{4})", out[4])
    assert m and m[1] != "152.143.123.131" and all(int(x) < 256 for x in m[1].split("."))
    assert (m[2], m[3], m[4]) == (m[7], m[6], m[5]) == (m[10], m[8], m[9]) and out[4] != texts[4]
    assert re.fullmatch(r'[a-z]{4}\.\d\d@mail4\.example\.com token = "[0-9a-f]{40}"', out[5]) and "that.92" not in out[5] and "24be6443" not in out[5]
    assert out[6] is None and out[7] == "" and out[8] == texts[8]


def test_one_to_one_and_keyed(spark):
    ips = [f"10.0.{k // 256}.{k % 256}" for k in range(600)]
    days = [f"20{y:02d}-0{m}-1{d}" for y in range(10) for m in range(1, 9) for d in range(5)]
    for values in (ips, days):
        out = run(spark, values)
        assert len(set(out)) == len(values)
        assert run(spark, values[:20], key="other") != out[:20]


def test_other_columns_and_counts(spark):
    df = spark.createDataFrame([("a@b.com and a@b.com", "keep", 1)], "text string, __old string, parts int")
    row = pseudonymise(df, KEY, count_col="n").first()
    assert row["__old"] == "keep" and row.parts == 1 and row.n == 2 and len(set(row.text.split(" and "))) == 1
    assert pseudonymise(df.limit(0), KEY).count() == 0


def test_long_text(spark):
    text = "word " * 50_000 + "1.2.3.4 " * 500
    out = run(spark, [text])[0]
    assert out.startswith("word word") and len(set(out.split()[-500:])) == 1 and "1.2.3.4 " not in out


def test_cards_beside_other_digits(spark):
    card, other = "4111111111111111", "4845168114407329"
    new, new_other = run(spark, [card, other])
    grouped = " ".join(re.findall("....", new))
    texts = {
        f"7536784127813050 {other} x": None,
        f"{card} {other}": f"{new} {new_other}",
        f"{card} 12/27": f"{new} 12/27",
        f"{card} 2024": f"{new} 2024",
        "3 4111 1111 1111 1111": f"3 {grouped}",
        "77 4111 1111 1111 1111 123 9": f"77 {grouped} 123 9",
        f"{card}-123, 5 {card}": f"{new}-123, 5 {new}",
        "4111 1111 1111 1112 " + card: "4111 1111 1111 1112 " + new,
        "1 2 3 " * 20_000 + card: "1 2 3 " * 20_000 + new,
        "order 12 4111-1111-1111-1111 4845-1681-1440-7329": "order 12 " + " ".join("-".join(re.findall("....", x)) for x in (new, new_other)),
    }
    for (text, want), got in zip(texts.items(), run(spark, list(texts))):
        assert got == want or want is None and new_other in got and "7536784127813050" not in got
    df = spark.createDataFrame([(f"{card} {other} 2024",)], "text string")
    assert pseudonymise(df, KEY, count_col="n").first().n == 2


def test_other_values_beside_cards(spark):
    card = "4111111111111111"
    values = ["10.0.0.1", "2024-01-31", "31.01.2024", "01/31/2024", "555-123-4567", "+1 523 555 1055", "123-45-6789", "12ab@mail.example.com"]
    alone = run(spark, [card, *values])
    beside = run(spark, [f"{card} {v}" for v in values] + [f"{v} {card}" for v in values] + [f"{v} 4111 1111 1111 1111" for v in values])
    grouped = " ".join(re.findall("....", alone[0]))
    assert beside == [f"{alone[0]} {v}" for v in alone[1:]] + [f"{v} {alone[0]}" for v in alone[1:]] + [f"{v} {grouped}" for v in alone[1:]]


def sha(*parts):
    return hashlib.sha512("|".join(parts).encode()).hexdigest()


def plain_permuted(s, tweak, key, hexadecimal=False):
    """The network on strings, written out character by character."""
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for n in range(1, 9):
        h = sha(key, str(n), tweak, str(len(s)), right)
        moved = ""
        for i, c in enumerate(left):
            by, size = int(h[i % 32 * 4 : i % 32 * 4 + 4], 16), 6 if hexadecimal else 26
            low, size = ("0", 10) if "0" <= c <= "9" else ("a", size) if "a" <= c < chr(97 + size) else ("A", size) if "A" <= c < chr(65 + size) else (c, 1)
            moved += chr(ord(low) + (ord(c) - ord(low) + by) % size)
        left, right = right, moved
    return left + right


def plain_number(x, a, b, tweak, key):
    left, right = divmod(x, b)
    for n in range(1, 9):
        other = right if n % 2 else left
        v = int(sha(key, tweak, str(n), str(other))[:12], 16)
        left, right = ((left + v) % a, right) if n % 2 else (left, (right + v) % b)
    return left * b + right


def plain(text, key):
    """The pseudonyms of one value of a known kind."""
    if "@" in text:
        name, host = text.split("@")
        return plain_permuted(name, "email", key) + "@" + host
    if m := re.fullmatch(r"(token = \")(\w+)", text):
        return m[1] + plain_permuted(m[2], "hex" if re.fullmatch("[0-9a-f]+", m[2]) else "secret", key, bool(re.fullmatch("[0-9a-f]+", m[2])))
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", text):
        n = 0
        for x in text.split("."):
            n = n * 256 + int(x)
        n = plain_number(n, 65536, 65536, "ip", key)
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        first = dt.date(1900, 1, 1)
        return str(first + dt.timedelta(plain_number((dt.date.fromisoformat(text) - first).days, 365, 200, "date", key)))
    code = m[0] if (m := re.match(r"\+\d{1,3}(?=[ .(-])", text)) else ""
    digits = re.sub(r"\D", "", text[len(code) :])
    if code or len(digits) < 13:
        new = iter(plain_permuted(digits, "number", key))
    else:
        body = plain_permuted(digits[:-1], "card", key)
        new = iter(body + next(c for c in "0123456789" if luhn(body + c)))
    return code + "".join(next(new) if c.isdigit() else c for c in text[len(code) :])


def test_equals_the_network_written_out(spark):
    rnd = random.Random(3)
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + num(14)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return rnd.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    makers = [
        card,
        lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        lambda: str(dt.date(1900, 1, 1) + dt.timedelta(rnd.randrange(73_000))),
        lambda: f"+{rnd.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}",
        lambda: f"({num(3)}) {num(3)}-{num(4)}",
        lambda: f"{num(3)}-{num(2)}-{num(4)}",
        lambda: f"Some.Name{num(2)}@mail.example.com",
        lambda: 'token = "' + "".join(rnd.choice("0123456789abcdef") for _ in range(40)),
        lambda: 'token = "' + "".join(rnd.choice("XYZuvw019") for _ in range(24)),
    ]
    values = [rnd.choice(makers)() for _ in range(250)]
    assert run(spark, [f"so {v} it is" for v in values]) == [f"so {plain(v, KEY)} it is" for v in values]


def test_key_is_asked_for_and_changes_all(spark):
    df = spark.createDataFrame([(1, "ip 152.143.123.131", "p")], "doc_id int, text string, __key string")
    a, b = (pseudonymise(df, k).first().text for k in ("one", "two"))
    assert a != b and pseudonymise(df, "one").columns == df.columns
    with pytest.raises(ValueError):
        pseudonymise(df, "")
    # a permutation: no two of many dates share a pseudonym
    days = spark.range(0, 73_000, 7).select(P.permuted_number(F.col("id"), 365, 200, "date", KEY).alias("p"))
    assert days.distinct().count() == days.count() and days.agg(F.max("p")).first()[0] < 73_000
