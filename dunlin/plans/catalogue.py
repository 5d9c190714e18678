"""The registered queries of the dialect, and their SQL for comparison.

Most are dialect statements run by a session over the Parquet tables; changes run on stored copies, and
navigation on work areas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.operators import stats
from dunlin.plans import catalogue_records
from dunlin.session import Session
from dunlin.sources.store import DELETED, HIDDEN, RECNO

TABLES = "region nation customer supplier part orders lineitem events".split()


def session(spark: SparkSession, sf_dir: str, **settings) -> Session:
    s = Session(spark)
    s.register_folder(sf_dir, TABLES)
    for k, v in settings.items():
        setattr(s.settings, k, v)
    return s


#: name -> (statement, SQL, settings)
STATEMENTS: dict[str, tuple[str, str, dict]] = {}


def statement(name: str, text: str, oracle: str, **settings) -> None:
    STATEMENTS[name] = (text, oracle, settings)


# -- projection and filters
statement(
    "scan_project",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
)
statement("star_project", "SELECT n.*, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
statement(
    "filter_compound",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_discount >= 0.05 OR l_tax = 0) AND NOT l_returnflag == 'N'",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_discount >= 0.05 OR l_tax = 0) AND NOT l_returnflag = 'N'",
)
statement(
    "filter_date_literal",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= {^1995-01-01} AND o_orderdate < {^1996-01-01 00:00:00}",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
)
statement("string_eq_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILD'", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_mktsegment, 'BUILD') OR starts_with('BUILD', c_mktsegment)")
statement("string_eq_ansi", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING  '", "SELECT c_custkey FROM customer WHERE rtrim(c_mktsegment) = 'BUILDING'", ansi=True)
statement("string_exact_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment == 'BUILD' OR c_mktsegment == 'MACHINERY'", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILD', 'MACHINERY')")
statement("string_not_equal", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTO'", "SELECT c_custkey FROM customer WHERE NOT (starts_with(c_mktsegment, 'AUTO') OR starts_with('AUTO', c_mktsegment))")
statement("dollar_contains", "SELECT p_partkey FROM part WHERE 'an' $ p_name", "SELECT p_partkey FROM part WHERE contains(p_name, 'an')")
statement("like_wildcard", "SELECT p_partkey, p_type FROM part WHERE LIKE('*A?*', p_type)", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A_%'")
statement(
    "between_inlist",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE BETWEEN(l_quantity, 10, 12) AND INLIST(l_returnflag, 'A', 'R')",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')",
)
statement(
    "iif_icase",
    "SELECT o_orderkey, IIF(o_totalprice > 100000, 'high', 'low') AS band, ICASE(o_orderstatus == 'F', 1, o_orderstatus == 'O', 2, 3) AS code FROM orders",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders",
)
statement("div_zero_null", "SELECT l_orderkey, l_linenumber, l_extendedprice / (l_quantity - 10) AS r FROM lineitem WHERE l_quantity < 20", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity - 10, 0) AS r FROM lineitem WHERE l_quantity < 20")
statement(
    "mod_sign",
    "SELECT c_custkey, c_custkey % -7 AS a, MOD(c_custkey, 0) AS b, -c_custkey % 7 AS c FROM customer",
    "SELECT c_custkey, c_custkey - (-7.0::DOUBLE) * floor(c_custkey / -7.0::DOUBLE) AS a, 0.0::DOUBLE AS b, -c_custkey - 7.0::DOUBLE * floor(-c_custkey / 7.0::DOUBLE) AS c FROM customer",
)
statement("power_arith", "SELECT n_nationkey, n_nationkey ^ 2 + 1 AS p, -n_nationkey AS m FROM nation", "SELECT n_nationkey, power(n_nationkey::DOUBLE, 2) + 1 AS p, -n_nationkey::DOUBLE AS m FROM nation")
# -- joins
statement("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
statement("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
statement("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
statement("join_full", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey")
statement("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
statement(
    "join_three_way",
    "SELECT r.r_name, COUNT(*) AS n FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
)
statement("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s INNER JOIN nation n ON s.s_nationkey > n.n_nationkey + 20", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey + 20")
statement("join_prefix_string", "SELECT n.n_nationkey, r.r_regionkey FROM nation n INNER JOIN region r ON LEFT(n.n_name, 1) = r.r_name", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON starts_with(r.r_name, left(n.n_name, 1))")
statement("join_prefix_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a INNER JOIN nation b ON a.n_name = b.n_name", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON starts_with(a.n_name, b.n_name) OR starts_with(b.n_name, a.n_name)")
statement(
    "join_prefix_made",
    "SELECT c.c_custkey, n.n_nationkey FROM customer c INNER JOIN nation n ON c.c_name = 'Customer#00000' + LEFT(STRZERO(n.n_nationkey, 4), 3) AND c.c_acctbal > 0",
    "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON starts_with(c_name, 'Customer#00000' || left(lpad(n_nationkey::VARCHAR, 4, '0'), 3)) AND c_acctbal > 0",
)
# -- subqueries
statement("semi_in", "SELECT c.c_custkey FROM customer c WHERE c.c_custkey IN (SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
statement("anti_not_in", "SELECT c.c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT o.o_custkey FROM orders o)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
statement("exists_corr", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
statement("not_exists_corr", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey) OR c.c_acctbal > 9000", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) OR c.c_acctbal > 9000")
statement("scalar_uncorr", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
statement("scalar_corr_avg", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT AVG(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)", "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(p.o_totalprice) FROM orders p WHERE p.o_custkey = o.o_custkey)")
statement(
    "subquery_nested",
    "SELECT c.c_custkey FROM customer c WHERE c.c_nationkey IN (SELECT n.n_nationkey FROM nation n WHERE n.n_regionkey IN (SELECT r.r_regionkey FROM region r WHERE r.r_name == 'ASIA'))",
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
)
# -- aggregation
statement(
    "agg_pricing_summary",
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_net, ROUND(AVG(l_extendedprice), 6) AS avg_price, COUNT(*) AS n "
    "FROM lineitem WHERE l_shipdate <= {^1998-09-02} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_extendedprice), 6) AS avg_price, count(*) AS n "
    "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
statement("agg_whole_table", "SELECT COUNT(*) AS n, COUNT(o_orderdate) AS d, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", "SELECT count(*) AS n, count(o_orderdate) AS d, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
statement("agg_empty_input", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MAX(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0) AS s, avg(o_totalprice) AS a, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
statement(
    "agg_expr",
    "SELECT o_orderpriority, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, MAX(o_totalprice) - MIN(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority",
    "SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 4) AS mean, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority",
)
statement("having_count", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
statement("group_by_expr", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1")
statement("minmax_scalar", "SELECT l_orderkey, l_linenumber, MAX(l_discount, l_tax) AS hi, MIN(l_discount, l_tax) AS lo FROM lineitem", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
# -- order, distinct, top
statement("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus DESC", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement("order_by_nulls_top_ties", "SELECT TOP 5 p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 5")
statement("top_percent", "SELECT TOP 2 PERCENT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.02)")
statement("top_plain", "SELECT TOP 10 o_orderkey FROM orders ORDER BY 1", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10")
statement("order_by_aggregate", "SELECT TOP 3 c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 3")
# -- unions
statement("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
statement("union_all", "SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region", "SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region")
statement("union_mixed_chain", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT r_regionkey FROM region", "SELECT * FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT r_regionkey FROM region")
statement("union_top_order", "SELECT TOP 4 n_name AS t FROM nation UNION SELECT r_name FROM region ORDER BY 1 DESC", "SELECT t FROM (SELECT n_name AS t FROM nation UNION SELECT r_name FROM region) ORDER BY 1 DESC LIMIT 4")
# -- functions
statement("fn_string_case_trim", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, ALLTRIM('  x ') AS t, LEN(c_name) AS n FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, 'x' AS t, length(c_name)::INTEGER AS n FROM customer")
statement("fn_pad", "SELECT n_nationkey, PADL(n_name, 12, '*') AS l, PADR(n_name, 4) AS r, PADC('ab', 5, '-') AS c FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 4, ' ') AS r, '-ab--' AS c FROM nation")
statement("fn_substr", "SELECT n_nationkey, LEFT(n_name, 3) AS a, RIGHT(n_name, 2) AS b, SUBSTR(n_name, 0, 2) AS c, SUBSTR(n_name, 3) AS d FROM nation", "SELECT n_nationkey, left(n_name, 3) AS a, right(n_name, 2) AS b, substr(n_name, 1, 2) AS c, substr(n_name, 3) AS d FROM nation")
statement("fn_at_rat", "SELECT n_nationkey, AT('A', n_name) AS a, RAT('A', n_name) AS r, OCCURS('A', n_name) AS o FROM nation", "SELECT n_nationkey, strpos(n_name, 'A')::INTEGER AS a, CASE WHEN strpos(reverse(n_name), 'A') = 0 THEN 0 ELSE length(n_name) - strpos(reverse(n_name), 'A') + 1 END::INTEGER AS r, (length(n_name) - length(replace(n_name, 'A', '')))::INTEGER AS o FROM nation")
statement("fn_stuff_chrtran_strtran", "SELECT n_nationkey, STUFF(n_name, 2, 1, '??') AS s, CHRTRAN(n_name, 'AEI', 'xy') AS c, STRTRAN(n_name, 'A', '') AS t FROM nation", "SELECT n_nationkey, left(n_name, 1) || '??' || substr(n_name, 3) AS s, replace(replace(replace(n_name, 'A', 'x'), 'E', 'y'), 'I', '') AS c, replace(n_name, 'A', '') AS t FROM nation")
statement("fn_str_val", "SELECT n_nationkey, STR(n_nationkey, 4) AS s, VAL(STR(n_nationkey, 4)) AS v, STRZERO(n_nationkey, 3) AS z FROM nation", "SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 4, ' ') AS s, n_nationkey::DOUBLE AS v, lpad(n_nationkey::VARCHAR, 3, '0') AS z FROM nation")
statement("fn_proper_words", "SELECT n_nationkey, PROPER(n_name) AS p, GETWORDCOUNT(n_name) AS n, GETWORDNUM(n_name, 2) AS w FROM nation", "SELECT n_nationkey, list_aggregate(list_transform(string_split(n_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), 'string_agg', ' ') AS p, len(list_filter(string_split(n_name, ' '), lambda x: x <> ''))::INTEGER AS n, coalesce(list_filter(string_split(n_name, ' '), lambda x: x <> '')[2], '') AS w FROM nation")
statement("fn_strextract", "SELECT event_id, STREXTRACT(props, ':', ',') AS v FROM events", "SELECT event_id, CASE WHEN strpos(props, ':') > 0 AND strpos(substr(props, strpos(props, ':') + 1), ',') > 0 THEN split_part(substr(props, strpos(props, ':') + 1), ',', 1) ELSE '' END AS v FROM events")
_GROUPS = "translate(regexp_replace(upper(trim(n_name)), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
for _d in "123456":
    _GROUPS = f"regexp_replace({_GROUPS}, '{_d}+', '{_d}', 'g')"
statement(
    "fn_soundex",
    "SELECT n_nationkey, SOUNDEX(n_name) AS s, DIFFERENCE(n_name, 'CHINA') AS d FROM nation",
    f"SELECT n_nationkey, s, (s[1] = 'C')::INTEGER + (s[2] = '5')::INTEGER + (s[3] = '0')::INTEGER + (s[4] = '0')::INTEGER AS d FROM (SELECT n_nationkey, rpad(left(upper(trim(n_name)), 1) || replace({_GROUPS}[2:], '0', ''), 4, '0') AS s FROM nation)",
)
statement(
    "fn_strextract_more",
    "SELECT event_id, STREXTRACT(props, '\"', '\"', 3) AS third, STREXTRACT(props, ':', '~', 1, 2) AS rest, STREXTRACT(props, '', ':') AS head FROM events",
    "SELECT event_id, CASE WHEN len(string_split(props, '\"')) > 4 THEN string_split(props, '\"')[4] ELSE '' END AS third, CASE WHEN strpos(props, ':') > 0 THEN substr(props, strpos(props, ':') + 1) ELSE '' END AS rest, CASE WHEN strpos(props, ':') > 0 THEN split_part(props, ':', 1) ELSE '' END AS head FROM events",
)
statement("fn_transform", "SELECT o_orderkey, TRANSFORM(o_totalprice, '9,999,999.99') AS t FROM orders", "SELECT o_orderkey, lpad(format('{:,.2f}', o_totalprice), 12, ' ') AS t FROM orders")
statement("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, DOW(o_orderdate) AS w, CDOW(o_orderdate) AS n, CMONTH(o_orderdate) AS c FROM orders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, (dayofweek(o_orderdate) + 1)::INTEGER AS w, dayname(o_orderdate) AS n, monthname(o_orderdate) AS c FROM orders")
statement("fn_date_arith", "SELECT o_orderkey, TTOD(o_orderdate) + 30 AS p, TTOD(o_orderdate) - {^1995-01-01} AS n, o_orderdate + 90 AS t FROM orders", "SELECT o_orderkey, o_orderdate::DATE + 30 AS p, (o_orderdate::DATE - DATE '1995-01-01')::DOUBLE AS n, o_orderdate + INTERVAL 90 SECOND AS t FROM orders")
statement("fn_dtoc_dtos", "SELECT o_orderkey, DTOC(o_orderdate) AS c, DTOS(o_orderdate) AS s, CTOD(DTOC(o_orderdate)) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS c, strftime(o_orderdate, '%Y%m%d') AS s, o_orderdate::DATE AS d FROM orders")
statement("fn_gomonth", "SELECT o_orderkey, GOMONTH(TTOD(o_orderdate), 1) AS a, GOMONTH(TTOD(o_orderdate), -13) AS b FROM orders", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS a, (o_orderdate::DATE - INTERVAL 13 MONTH)::DATE AS b FROM orders")
statement("fn_round_int_abs", "SELECT c_custkey, ROUND(c_acctbal, 0) AS r, INT(c_acctbal) AS i, ABS(c_acctbal) AS a FROM customer", "SELECT c_custkey, round(c_acctbal, 0) AS r, trunc(c_acctbal) AS i, abs(c_acctbal) AS a FROM customer")
statement("fn_empty_isnull", "SELECT c_custkey, EMPTY(c_name) AS e, ISNULL(c_name) AS n, EMPTY(c_nationkey) AS z FROM customer", "SELECT c_custkey, trim(coalesce(c_name, '')) = '' AS e, c_name IS NULL AS n, coalesce(c_nationkey, 0) = 0 AS z FROM customer")
statement("fn_string_concat", "SELECT n_nationkey, n_name + '/' + LEFT(n_name, 1) AS a, 'x  ' - n_name AS b FROM nation", "SELECT n_nationkey, n_name || '/' || left(n_name, 1) AS a, 'x' || n_name || '  ' AS b FROM nation")
statement("collate_general", "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_mktsegment == 'building' GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE upper(c_mktsegment) = 'BUILDING' GROUP BY 1", collate="GENERAL")


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _, settings = STATEMENTS[name]
    return lambda spark, sf_dir: session(spark, sf_dir, **settings).query(text)


# -- what needs stored tables, cursors or work areas


def first_member_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column outside GROUP BY is the first row's, in record order."""
    s = session(spark, sf_dir)
    s.store.create("ordered", spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey"))
    return s.query("SELECT n_regionkey, n_name FROM ordered GROUP BY n_regionkey")


def into_cursor_requery(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.execute("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey INTO CURSOR per")
    return s.query("SELECT n, COUNT(*) AS customers FROM per GROUP BY n")


def _stored(spark: SparkSession, sf_dir: str, name: str) -> Session:
    s = session(spark, sf_dir)
    s.store.create("t", spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return s


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.execute("UPDATE t SET c_acctbal = c_acctbal * 2, c_name = UPPER(c_name) WHERE c_acctbal < 0")
    return s.query("SELECT c_custkey, c_name, c_acctbal FROM t")


def soft_delete_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.execute("DELETE FROM t WHERE c_acctbal < 0")
    return s.query("SELECT c_custkey FROM t")


def soft_delete_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.execute("DELETE FROM t WHERE c_acctbal < 0")
    s.execute("SET DELETED OFF")
    return s.query("SELECT COUNT(*) AS n FROM t")


def delete_recall_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.execute("DELETE FROM t WHERE c_acctbal < 1000")
    s.execute("RECALL t FOR c_acctbal < 0")
    s.execute("PACK t")
    return s.query("SELECT c_custkey FROM t")


def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "region")
    s.execute("INSERT INTO t (r_regionkey, r_name) VALUES (?, ?)", 99, "NOWHERE")
    return s.query("SELECT * FROM t")


def append_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.append_from("t", "customer", "c_custkey <= 5")
    return s.query("SELECT c_custkey, COUNT(*) AS n FROM t GROUP BY c_custkey")


def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "nation")
    s.execute("ALTER TABLE t ADD COLUMN note C(10)")
    s.execute("UPDATE t SET note = LEFT(n_name, 2)")
    s.execute("ALTER TABLE t DROP COLUMN n_name")
    return s.query("SELECT * FROM t")


def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "region")
    s.begin()
    s.execute("DELETE FROM t")
    s.rollback()
    s.begin()
    s.execute("UPDATE t SET r_name = LOWER(r_name)")
    s.commit()
    return s.query("SELECT * FROM t")


def _area(spark: SparkSession, sf_dir: str, name: str):
    return session(spark, sf_dir).navigate(name)


def nav_locate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _area(spark, sf_dir, "part")
    a.index_on("k", "p_partkey")
    a.locate("p_size > 40")
    a.continue_()
    return a.df.where(F.col(RECNO) == a.recno).drop(*HIDDEN).select("p_partkey", "p_size")


def nav_set_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _area(spark, sf_dir, "orders")
    a.index_on("k", "o_orderkey")
    a.set_key(100, 500)
    a.filter = "o_totalprice > 50000"
    return a.ordered().select("o_orderkey", "o_totalprice")


def nav_seek_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _area(spark, sf_dir, "nation")
    a.index_on("n", "n_name")
    a.seek("UNITED")
    return a.df.where(F.col(RECNO) == a.recno).select("n_name")


def nav_relation_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    s.store.create("o", spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey"))
    child = s.navigate("o")
    child.index_on("c", "o_custkey")
    return s.navigate("customer").relate(child, "c_custkey").select("c_custkey", "o_orderkey")


def nav_skip_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    child = s.navigate("orders")
    child.index_on("c", "o_custkey")
    return s.navigate("customer").relate(child, "c_custkey", many=True).select("c_custkey", "o_orderkey")


def total_on_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders of one status in order of their key."""
    a = _area(spark, sf_dir, "orders")
    a.index_on("k", "o_orderkey")
    out = a.total("o_orderstatus", fields=["o_totalprice"])
    return out.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


def sum_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _area(spark, sf_dir, "lineitem")
    total = a.sum("l_quantity", "l_tax * 100", for_="l_returnflag = 'R'")
    return spark.createDataFrame([tuple(round(x, 2) for x in total)], "q double, t double")


def stats_ndv_minmax_mcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = stats.analyze(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus", "o_orderpriority"], exact=True)
    data = [(n, rows, s.distinct, s.nulls, s.low, s.high, k, c) for n, s in found.items() for k, c in s.common.items()]
    return spark.createDataFrame(data, "name string, n_rows long, n_distinct long, n_nulls long, low string, high string, common string, n_common long")


def constraint_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return stats.orphans(read("customer"), "c_custkey", read("orders"), "o_custkey").select("c_custkey")


def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repeated(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey").select("o_custkey", F.col("count").alias("n"))


def rule_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.broken(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal >= 0 AND .NOT. EMPTY(c_name)").select("c_custkey")


def recno_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads by record number."""
    s = session(spark, sf_dir)
    s.store.create("t", spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey"))
    return s.table("t").where(~F.col(DELETED)).select(RECNO, "n_name").withColumnRenamed(RECNO, "recno")


_CODE = {
    "first_member_item": (first_member_item, "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1"),
    "into_cursor_requery": (into_cursor_requery, "SELECT n, count(*) AS customers FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"),
    "update_where": (update_where, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "soft_delete_visible": (soft_delete_visible, "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0"),
    "soft_delete_off": (soft_delete_off, "SELECT count(*) AS n FROM customer"),
    "delete_recall_pack": (delete_recall_pack, "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 1000"),
    "insert_values": (insert_values, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'"),
    "append_from": (append_from, "SELECT c_custkey, CASE WHEN c_custkey <= 5 THEN 2 ELSE 1 END::BIGINT AS n FROM customer"),
    "alter_table": (alter_table, "SELECT * EXCLUDE (n_name), left(n_name, 2) AS note FROM nation"),
    "transaction_rollback": (transaction_rollback, "SELECT r_regionkey, lower(r_name) AS r_name FROM region"),
    "nav_locate_first": (nav_locate_first, "SELECT p_partkey, p_size FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 1 OFFSET 1"),
    "nav_set_key_range": (nav_set_key_range, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 500 AND o_totalprice > 50000"),
    "nav_seek_prefix": (nav_seek_prefix, "SELECT n_name FROM nation WHERE starts_with(n_name, 'UNITED') ORDER BY n_name LIMIT 1"),
    "nav_relation_first_match": (nav_relation_first_match, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    "nav_skip_one_to_many": (nav_skip_one_to_many, "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "total_on_runs": (
        total_on_runs,
        "SELECT min(o_orderkey) AS o_orderkey, min(o_orderstatus) AS o_orderstatus, round(sum(o_totalprice), 2) AS total FROM (SELECT *, sum(c) OVER (ORDER BY o_orderkey) AS run FROM "
        "(SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER (ORDER BY o_orderkey) THEN 0 ELSE 1 END AS c FROM orders)) GROUP BY run",
    ),
    "sum_for": (sum_for, "SELECT round(sum(l_quantity), 2) AS q, round(sum(l_tax * 100), 2) AS t FROM lineitem WHERE l_returnflag = 'R'"),
    "stats_ndv_minmax_mcv": (
        stats_ndv_minmax_mcv,
        " UNION ALL ".join(
            f"SELECT '{c}' AS name, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(DISTINCT {c}) FROM orders) AS n_distinct, 0::BIGINT AS n_nulls, (SELECT min({c}) FROM orders) AS low, (SELECT max({c}) FROM orders) AS high, {c} AS common, count(*) AS n_common FROM orders GROUP BY {c}"
            for c in ("o_orderstatus", "o_orderpriority")
        ),
    ),
    "constraint_fk_orphans": (constraint_fk_orphans, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"),
    "constraint_unique": (constraint_unique, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "rule_broken": (rule_broken, "SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0 AND trim(c_name) <> '')"),
    "recno_scan": (recno_scan, "SELECT row_number() OVER (ORDER BY n_nationkey) AS recno, n_name FROM nation"),
}


STATEMENTS |= catalogue_records.STATEMENTS
_CODE |= catalogue_records.CODE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _statement(n) for n in STATEMENTS} | {n: f for n, (f, _) in _CODE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql, _) in STATEMENTS.items() if sql} | {n: sql for n, (_, sql) in _CODE.items()}
