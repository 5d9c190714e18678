import datetime as dt

import pytest

from dunlin.lang.expr import parse_expression
from dunlin.session import Session
from dunlin.settings import DialectError, Settings

GOLDEN = {
    "2 + 3 * 4": 14.0, "(2 + 3) * 4": 20.0, "2 ^ 3 ^ 2": 512.0, "-2 ^ 2": -4.0, "10 % 3": 1.0, "-10 % 3": 2.0, "10 % -3": -2.0, "7 % 0": 0.0, "MOD(7, 0)": 0.0, "5 / 0": None,
    ".T. AND .NOT. .F.": True, "NOT .T. OR .T.": True, ".NULL. AND .F.": False, ".NULL. OR .T.": True, "1 = 1.0": True, "'a' = 1": False, "1 < 2 AND 'b' > 'a'": True,
    "'ab ' - 'c' + 'd'": "abc d", "'ab' + 'cd'": "abcd", "'b' $ 'abc'": True, "'x' $ 'abc'": False,
    "UPPER('aé')": "AÉ", "ALLTRIM('  x ')": "x", "LEFT('abc', 9)": "abc", "LEFT('abc', -1)": "", "RIGHT('abc', 2)": "bc", "SUBSTR('abc', 0, 2)": "ab", "SUBSTR('abc', 5)": "", "SUBSTR('abcdef', 3)": "cdef",
    "STR(12.345, 6, 2)": " 12.35", "STR(5)": "         5", "STR(12345, 3)": "***", "STR(123.456, 5, 3)": "123.5", "STRZERO(7, 4)": "0007", "STRZERO(-7, 4)": "-007",
    "PADL('abc', 5)": "  abc", "PADL('abcdef', 3)": "abc", "PADR('ab', 4, '*')": "ab**", "PADC('ab', 5, '-')": "-ab--", "AT('a', 'banana', 2)": 4, "AT('aa', 'aaa', 2)": 2, "AT('x', 'abc')": 0, "RAT('a', 'banana')": 6,
    "RAT('a', 'banana', 3)": 2, "ATC('A', 'xa')": 2, "STUFF('abcdef', 2, 3, 'X')": "aXef", "CHRTRAN('abcabc', 'ab', 'x')": "xcxc", "STRTRAN('banana', 'an')": "ba", "STRTRAN('abc', '', 'x')": "abc", "REPLICATE('ab', 3)": "ababab",
    "LEN('abc')": 3, "CHR(65)": "A", "CHR(128)": "€", "ASC('€')": 128, "LIKE('a*c?', 'abbcd')": True, "LIKE('a', 'ab')": False, "LIKE('a.c', 'abc')": False, "OCCURS('a', 'banana')": 3, "PROPER('hello wORLD')": "Hello World",
    "ISDIGIT('1a')": True, "ISALPHA('é')": True, "ISUPPER('Ab')": True, "STREXTRACT('<a>x</a>', '<a>', '</a>')": "x", "STREXTRACT('a:b', ':', ';', 1, 2)": "b", "GETWORDCOUNT(' a b  c ')": 3, "GETWORDNUM('a b  c', 3)": "c",
    "SOUNDEX('Ashcraft')": "A226", "SOUNDEX('')": "0000", "DIFFERENCE('Smith', 'Smyth')": 4, "NORMALIZE(\"a-> b + 'x y'\")": "A.B+'x y'", "TRANSFORM(1234.5, '9,999.99')": "1,234.50", "TRANSFORM('abc', '@!')": "ABC",
    "VAL('12.5abc')": 12.5, "VAL('x')": 0.0, "VAL(' -3')": -3.0, "DTOC({^2020-02-03})": "02/03/2020", "DTOS({^2020-02-03})": "20200203", "DTOC({})": " " * 10, "CTOD('02/03/2020')": dt.date(2020, 2, 3), "CTOD('3.2.2020')": dt.date(2020, 2, 3),
    "EMPTY(CTOD('x'))": True, "{^2020-01-05} - {^2020-01-01}": 4.0, "{^2020-01-31} + 1": dt.date(2020, 2, 1), "{^2020-01-01 10:00:00} + 60": dt.datetime(2020, 1, 1, 10, 1), "{^2020-01-01 00:01:00} - {^2020-01-01}": 60.0,
    "GOMONTH({^2020-01-31}, 1)": dt.date(2020, 2, 29), "DOW({^2024-06-02})": 1, "CDOW({^2024-06-02})": "Sunday", "CMONTH({^2024-06-02})": "June", "YEAR({^2024-06-02})": 2024,
    "INT(-2.7)": -2.0, "ROUND(2.5, 0)": 3.0, "ROUND(-2.5, 0)": -3.0, "ROUND(1234, -2)": 1200.0, "ABS(-3)": 3, "MAX(1, 3, 2)": 3, "MIN(2, .NULL.)": None, "BETWEEN(2, 1, 3)": True, "BETWEEN(2, .NULL., 3)": None,
    "INLIST(3, 1, 2, 3)": True, "INLIST('ab', 'a')": False, "IIF(.NULL., 1, 2)": 2, "ICASE(.F., 1, .T., 2, 3)": 2, "ICASE(.F., 1)": None, "EMPTY('  ')": True, "EMPTY(0)": True, "EMPTY(.NULL.)": True, "ISNULL(.NULL.)": True,
    "NOSUCH(1)": None, "EVALUATE('1 + 1')": 2.0, "VARTYPE('x')": "C", "VARTYPE(1)": "N", "NVL(.NULL., 5)": 5, "1 <> 2": True, "1 # 1": False, "[a] = \"a\"": True,
}


@pytest.fixture(scope="module")
def values(spark):
    """All of them in one query."""
    from dunlin.plans.compile import Compiler

    comp = Compiler(lambda n: None, Settings())
    cols = [comp.value(parse_expression(e)).col.alias(f"c{k}") for k, e in enumerate(GOLDEN)]
    return dict(zip(GOLDEN, spark.range(1).select(*cols).first()))


def test_goldens(values):
    bad = {e: (values[e], want) for e, want in GOLDEN.items() if values[e] != want}
    assert not bad


def test_bad_texts():
    for text in ("1 +", "(1", "'a", "{^2020-13-01}", "1 2", "a b"):
        with pytest.raises(DialectError):
            parse_expression(text)
    with pytest.raises(DialectError):
        parse_expression("(" * 500 + "1" + ")" * 500)


def test_string_equality_matrix(spark):
    df = spark.createDataFrame([("Sm",), ("Smith",), ("Smithson",), ("smith",), ("",)], "name string")
    from dunlin.plans.compile import query

    got = lambda text, **s: {r.name for r in query(df, text, Settings(**s)).collect()}
    assert got("name = 'Smith'") == {"Sm", "Smith", "Smithson", ""}
    assert got("name = 'Smith'", ansi=True) == {"Smith"}
    assert got("name = 'Smith  '", ansi=True) == {"Smith"}
    assert got("name == 'Smith'") == {"Smith"}
    assert got("name = 'Smith'", sql=False) == {"Smith", "Smithson"}
    assert got("name = 'Smith'", sql=False, exact=True) == {"Smith"}
    assert got("name == 'SMITH'", collate="GENERAL") == {"Smith", "smith"}
    assert got("name <> 'Smith'") == {"smith"}
    assert got("name +") == set()


def test_general_collation(spark):
    from pyspark.sql import functions as F

    from dunlin.plans.compare import general_key

    words = ["CAFÉ", "café", "cafe", "Straße", "STRASSE ", "Æon", "AEON"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", general_key(F.col("w")).alias("k"))
    k = {r.w: r.k for r in df.collect()}
    assert k["CAFÉ"] == k["café"] != k["cafe"] and k["Straße"] == k["STRASSE "] and k["Æon"] == k["AEON"]


def test_session_values_and_functions(spark):
    s = Session(spark)
    s.memory["x"] = 4
    assert s.value("x + 1") == 5.0 and s.execute("?1 + 1") == 2.0
    from pyspark.sql import functions as F

    s.register_function("twice", lambda c: F.concat(c, c))
    assert s.value("TWICE('ab')") == "abab"
    assert s.value("TEXTMERGE('a<<x>>b')") == "a4b"
    with pytest.raises(DialectError):
        s.execute("SET COLLATE TO NORDIC")
