"""Registered queries on records, scripts, writes and functions: statements with their SQL, and code with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.operators.scripting import Interpreter
from dunlin.plans.compile import count, query
from dunlin.session import Session
from dunlin.settings import DialectError, Settings

TABLES = "region nation customer supplier part orders lineitem events".split()

#: name -> (statement, SQL, settings)
STATEMENTS: dict[str, tuple[str, str, dict]] = {
    "fn_atc": ("SELECT p_partkey, ATC('AN', p_name) AS a FROM part", "SELECT p_partkey, strpos(lower(p_name), 'an')::INTEGER AS a FROM part", {}),
    "fn_chr_asc": ("SELECT n_nationkey, ASC(n_name) AS a, CHR(65 + n_nationkey) AS c FROM nation", "SELECT n_nationkey, ascii(n_name)::INTEGER AS a, chr(65 + n_nationkey::INTEGER) AS c FROM nation", {}),
    "fn_replicate_space": ("SELECT n_nationkey, REPLICATE('ab', n_regionkey) AS r, '<' + SPACE(n_regionkey) + '>' AS s FROM nation", "SELECT n_nationkey, repeat('ab', n_regionkey) AS r, '<' || repeat(' ', n_regionkey) || '>' AS s FROM nation", {}),
    "fn_is_kinds": (
        "SELECT event_id, ISDIGIT(props) AS d, ISALPHA(event_type) AS a, ISUPPER(event_type) AS u, ISLOWER(event_type) AS l FROM events",
        "SELECT event_id, regexp_matches(props, '^[0-9]') AS d, regexp_matches(event_type, '^[A-Za-z]') AS a, regexp_matches(event_type, '^[A-Z]') AS u, regexp_matches(event_type, '^[a-z]') AS l FROM events",
        {},
    ),
    "fn_vartype": ("SELECT c_custkey, VARTYPE(c_name) AS c, VARTYPE(c_acctbal) AS n, VARTYPE(c_acctbal > 0) AS l FROM customer", "SELECT c_custkey, 'C' AS c, 'N' AS n, 'L' AS l FROM customer", {}),
    "fn_isblank": ("SELECT c_custkey, ISBLANK(c_name) AS b, ISBLANK(SPACE(3)) AS s FROM customer", "SELECT c_custkey, trim(c_name) = '' AS b, true AS s FROM customer", {}),
    "fn_ttoc_ctot": (
        "SELECT event_id, TTOC(ts) AS c, CTOT(TTOC(ts)) AS t FROM events",
        "SELECT event_id, strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS c, date_trunc('second', ts) AS t FROM events",
        {},
    ),
    "null_propagation": ("SELECT n_nationkey, NULL + n_nationkey AS a, 'x' + NULL AS b FROM nation WHERE NULL = NULL OR n_nationkey > 5", "SELECT n_nationkey, NULL::DOUBLE AS a, NULL::VARCHAR AS b FROM nation WHERE n_nationkey > 5", {}),
    "order_by_alias": ("SELECT TOP 5 c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_custkey < 100 ORDER BY twice DESC", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_custkey < 100 QUALIFY rank() OVER (ORDER BY twice DESC) <= 5", {}),
    "union_widening": ("SELECT n_nationkey AS v FROM nation UNION ALL SELECT s_acctbal AS v FROM supplier", "SELECT n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT s_acctbal FROM supplier", {}),
    "multi_from_join": (
        "SELECT n.n_name, r.r_name, c.c_custkey FROM region r, nation n INNER JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey AND c.c_acctbal > 9000",
        "SELECT n_name, r_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
        {},
    ),
    "having_alone": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING SUM(o_totalprice) > 1000", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000", {}),
    "comment_tail": ("SELECT n_name FROM nation WHERE n_regionkey = 1 && only America", "SELECT n_name FROM nation WHERE n_regionkey = 1", {}),
    "recno_of_table": ("SELECT RECNO() AS r, n_name FROM nation WHERE RECNO() <= 3", "SELECT r, n_name FROM (SELECT row_number() OVER () AS r, n_name FROM nation) WHERE r <= 3", {}),
}


def _session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    s.register_folder(sf_dir, TABLES)
    return s


def _nations(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the nations as table t, in order of their key, open in area 1."""
    s = _session(spark, sf_dir)
    s.store.create("t", s.views["nation"].orderBy("n_nationkey"))
    s.execute("USE t")
    return s


def _ran(spark: SparkSession, sf_dir: str, source: str) -> tuple[Session, Interpreter]:
    s = _nations(spark, sf_dir)
    i = Interpreter(s)
    i.run(source)
    return s, i


def _row(spark: SparkSession, i: Interpreter, **kinds: str) -> DataFrame:
    return spark.createDataFrame([tuple({"int": int, "double": float}.get(k, lambda v: v)(i.get(n)) for n, k in kinds.items())], ", ".join(f"{n} {k}" for n, k in kinds.items()))


def delete_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _ran(spark, sf_dir, "GO 3\nDELETE\nGO 5\nDELETE\nRECALL")
    return s.query("SELECT n_nationkey FROM t")


def script_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _ran(spark, sf_dir, "BEGIN TRANSACTION\nDELETE FROM t WHERE n_nationkey < 5\nROLLBACK\nBEGIN TRANSACTION\nDELETE FROM t WHERE n_nationkey > 20\nEND TRANSACTION")
    return s.query("SELECT n_nationkey FROM t")


def script_locate_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _ran(spark, sf_dir, "LOCATE FOR n_regionkey = 2\nDO WHILE FOUND()\nREPLACE n_name WITH LOWER(n_name)\nCONTINUE\nENDDO")
    return s.query("SELECT n_nationkey, n_name FROM t")


def script_scan_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, i = _ran(spark, sf_dir, "total = 0\nSCAN FOR n_regionkey = 1\ntotal = total + n_nationkey\nENDSCAN\nSUM n_nationkey TO s FOR n_regionkey = 3\nCOUNT TO c FOR n_regionkey = 3\nAVERAGE n_nationkey TO a FOR n_regionkey = 3")
    return _row(spark, i, total="int", s="double", c="int", a="double")


def script_filter_order_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, i = _ran(spark, sf_dir, "SET FILTER TO n_regionkey = 3\nINDEX ON n_name TAG nm DESCENDING\nGO TOP\nfirst = n_name\nSKIP 2\nthird = n_name\nGO BOTTOM\nlast = n_name\nSKIP\nended = EOF()\nr = RECCOUNT()")
    return _row(spark, i, first="string", third="string", last="string", ended="boolean", r="int")


def script_seek_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "INDEX ON n_regionkey TAG rk\nSET KEY TO 2\nCOUNT TO c\nSET KEY TO RANGE 1, 3\nCOUNT TO d\nSET KEY TO\nSEEK 4\nr = RECNO()\nf = FOUND()\nSEEK 99\ng = FOUND()\ne = EOF()"
    return _row(spark, _ran(spark, sf_dir, source)[1], c="int", d="int", r="int", f="boolean", g="boolean", e="boolean")


def script_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "USE region IN 2 ALIAS r\nSELECT r\nINDEX ON r_regionkey TAG rk\nSELECT t\nSET RELATION TO n_regionkey INTO r\nGO 9\na = r.r_name\nGO 1\nb = r.r_name\nt = TARGET(1)"
    return _row(spark, _ran(spark, sf_dir, source)[1], a="string", b="string", t="string")


def script_copy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _ran(spark, sf_dir, "INDEX ON n_regionkey TAG rk\nTOTAL ON n_regionkey TO sums FIELDS n_nationkey FOR n_nationkey < 20\nCOPY TO few FIELDS n_name FOR n_regionkey = 4\nAPPEND FROM few")
    return s.query("SELECT n_regionkey, n_nationkey FROM sums UNION ALL SELECT n_regionkey, n_nationkey FROM t WHERE ISNULL(n_regionkey)")


def script_blank_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _ran(spark, sf_dir, "GO 2\nBLANK FIELDS n_name\nAPPEND BLANK\nREPLACE n_nationkey WITH 77, n_name WITH 'NEW'")
    return s.query("SELECT n_nationkey, n_name FROM t")


def recno_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.execute("DELETE FROM t WHERE RECNO() = 2")
    s.execute("SET DELETED OFF")
    return s.query("SELECT RECNO() AS r, DELETED() AS d, RECCOUNT() AS n, n_name FROM t WHERE RECNO() < 4")


def filter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String = of filters: by prefix of the right side, and whole under EXACT."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    off = query(df, "c_mktsegment = 'BUILD'", Settings(sql=False)).selectExpr("c_custkey", "'off' AS mode")
    return off.union(query(df, "c_mktsegment = 'BUILDING  '", Settings(sql=False, exact=True)).selectExpr("c_custkey", "'on' AS mode"))


def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return spark.createDataFrame([(count(df, "c_acctbal < 0"), count(df, "no such ( filter"))], "n long, bad long")


def into_table_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.execute("SELECT n_name, n_regionkey AS rk FROM t WHERE n_regionkey = 1 INTO TABLE copied")
    s.execute("SELECT rk, COUNT(*) AS n FROM copied GROUP BY rk INTO ARRAY a")
    s.execute("CREATE TABLE made (k I, n N(10,0))")
    s.execute("INSERT INTO made FROM ARRAY a")
    s.memory |= {"k": 9, "n": 8}
    s.execute("INSERT INTO made FROM MEMVAR")
    return s.query("SELECT k, INT(n) AS n FROM made")


def zap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nations(spark, sf_dir)
    s.execute("CREATE TABLE gone (k I)")
    s.execute("DROP TABLE gone")
    s.execute("DROP TABLE IF EXISTS gone")
    s.execute("ZAP")
    return s.query("SELECT COUNT(*) AS n FROM t")


def _geography(spark: SparkSession, sf_dir: str, **modes: str) -> Session:
    """Regions and nations as stored tables, linked by region."""
    s = _session(spark, sf_dir)
    s.store.create("r", s.views["region"])
    s.store.create("t", s.views["nation"])
    s.set_rules("t", defaults={"n_name": "'UNNAMED'"}, fields={"n_nationkey": "n_nationkey < 1000"}, required=["n_nationkey"], unique=[["n_nationkey"]], parents=[{"key": "n_regionkey", "table": "r", "parent": "r_regionkey", **modes}])
    return s


def rules_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a rule leaves the table as it was; the code tells the rule."""
    s, codes = _geography(spark, sf_dir), []
    for text in (
        "INSERT INTO t (n_nationkey, n_regionkey) VALUES (2000, 1)",
        "INSERT INTO t (n_name, n_regionkey) VALUES ('X', 1)",
        "INSERT INTO t (n_nationkey, n_regionkey) VALUES (3, 1)",
        "UPDATE t SET n_regionkey = 99",
        "DELETE FROM r WHERE r_regionkey = 1",
        "INSERT INTO t (n_nationkey, n_regionkey) VALUES (100, 1)",
    ):
        try:
            s.execute(text)
            codes.append("done")
        except DialectError as e:
            codes.append(str(e.code))
    return s.query("SELECT n_nationkey, n_name, n_regionkey FROM t").withColumn("codes", F.lit(" ".join(codes)))


def links_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _geography(spark, sf_dir, delete="cascade", update="cascade")
    s.execute("UPDATE r SET r_regionkey = r_regionkey + 100 WHERE r_regionkey >= 2")
    s.execute("DELETE FROM r WHERE r_regionkey = 1 OR r_regionkey = 103")
    return s.query("SELECT n_nationkey, n_regionkey FROM t")


CODE = {
    "rules_refuse": (rules_refuse, "SELECT *, '1582 1581 1884 1539 1539 done' AS codes FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'UNNAMED', 1)"),
    "links_cascade": (links_cascade, "SELECT n_nationkey, CASE WHEN n_regionkey >= 2 THEN n_regionkey + 100 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey NOT IN (1, 3)"),
    "delete_current": (delete_current, "SELECT n_nationkey FROM nation WHERE n_nationkey <> 2"),
    "script_rollback": (script_rollback, "SELECT n_nationkey FROM nation WHERE n_nationkey <= 20"),
    "script_locate_replace": (script_locate_replace, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name FROM nation"),
    "script_scan_sum_count": (
        script_scan_sum_count,
        "SELECT (SELECT sum(n_nationkey) FROM nation WHERE n_regionkey = 1)::INTEGER AS total, sum(n_nationkey)::DOUBLE AS s, count(*)::INTEGER AS c, avg(n_nationkey)::DOUBLE AS a FROM nation WHERE n_regionkey = 3",
    ),
    "script_filter_order_skip": (
        script_filter_order_skip,
        "SELECT list_extract(l, 1) AS \"first\", list_extract(l, 3) AS third, list_extract(l, -1) AS \"last\", true AS ended, (SELECT count(*) FROM nation)::INTEGER AS r FROM (SELECT list(n_name ORDER BY n_name DESC) AS l FROM nation WHERE n_regionkey = 3)",
    ),
    "script_seek_key": (
        script_seek_key,
        "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 2)::INTEGER AS c, (SELECT count(*) FROM nation WHERE n_regionkey BETWEEN 1 AND 3)::INTEGER AS d, (SELECT min(n_nationkey) + 1 FROM nation WHERE n_regionkey = 4)::INTEGER AS r, true AS f, false AS g, true AS e",
    ),
    "script_relation": (
        script_relation,
        "SELECT (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 8) AS a, (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 0) AS b, 'R' AS t",
    ),
    "script_copy_total": (
        script_copy_total,
        "SELECT n_regionkey, sum(n_nationkey)::INTEGER AS n_nationkey FROM nation WHERE n_nationkey < 20 GROUP BY 1 UNION ALL SELECT NULL, NULL FROM nation WHERE n_regionkey = 4",
    ),
    "script_blank_append": (script_blank_append, "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN NULL ELSE n_name END AS n_name FROM nation UNION ALL SELECT 77, 'NEW'"),
    "recno_where": (recno_where, "SELECT n_nationkey + 1 AS r, n_nationkey = 1 AS d, (SELECT count(*) FROM nation) AS n, n_name FROM nation WHERE n_nationkey < 3"),
    "filter_exact": (filter_exact, "SELECT c_custkey, 'off' AS mode FROM customer WHERE starts_with(c_mktsegment, 'BUILD') UNION ALL SELECT c_custkey, 'on' FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_count": (filter_count, "SELECT count(*) AS n, 0::BIGINT AS bad FROM customer WHERE c_acctbal < 0"),
    "into_table_array": (into_table_array, "SELECT 1 AS k, count(*)::DOUBLE AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 9, 8"),
    "zap_drop": (zap_drop, "SELECT 0::BIGINT AS n"),
}
