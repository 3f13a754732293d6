"""The engine's queries over the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import registry_storage
from tessera.engine import Engine
from tessera.sources.schema import parse_schema
from tessera.sources.table import Table

Query = Callable[[SparkSession, str], DataFrame]

#: name: (table, statement, DuckDB's select list if the statement itself doesn't do, or whole SQL).
#: Integer columns of the files may be narrower than the engine's, so oracles widen them.
_STATEMENTS: dict[str, tuple[str, str, str]] = {
    "agg_flagship": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_orderkey) AS s, AVG(l_partkey) AS a FROM lineitem "
        "WHERE NOT (l_linenumber BETWEEN 2 AND 3) OR l_returnflag IN ('A','N') "
        "GROUP BY l_returnflag, l_linestatus ORDER BY n DESC",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s, AVG(l_partkey) AS a FROM lineitem "
        "WHERE NOT (l_linenumber BETWEEN 2 AND 3) OR l_returnflag IN ('A','N') GROUP BY l_returnflag, l_linestatus",
    ),
    "scan_star": (
        "part", "SELECT * FROM part",
        "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part",
    ),
    "project_alias": (
        "orders", "SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey AS again, o_custkey FROM orders", "",
    ),
    "filter_eq_int": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7", ""),
    "filter_eq_str": ("customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", ""),
    "filter_ne": (
        "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority != '1-URGENT'", "",
    ),
    "filter_range": (
        "customer",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 AND c_custkey <= 900 AND c_name >= 'Customer#000000100' AND c_mktsegment < 'G'",
        "",
    ),
    "filter_flip": ("lineitem", "SELECT l_orderkey, l_partkey FROM lineitem WHERE 100 < l_partkey AND 1000 >= l_orderkey", ""),
    "filter_bool": (
        "lineitem",
        "SELECT l_orderkey, l_suppkey FROM lineitem WHERE NOT (l_returnflag = 'N' OR l_linestatus = 'F') AND (l_suppkey < 5 OR l_suppkey > 95) OR l_orderkey = 1",
        "",
    ),
    "filter_in_int": (
        "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)", "",
    ),
    "filter_in_str": ("customer", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'none')", ""),
    "filter_between": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 200", ""),
    "filter_not_between": ("orders", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey BETWEEN 100 AND 200)", ""),
    "filter_none": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 5 AND 4", ""),
    "filter_all": ("orders", "SELECT o_orderkey FROM orders WHERE o_custkey >= 0 OR o_orderstatus = 'F'", ""),
    "agg_global": (
        "lineitem",
        "SELECT COUNT(*) AS n, COUNT(l_suppkey) AS c, SUM(l_partkey) AS s, AVG(l_partkey) AS a, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM lineitem",
        "SELECT COUNT(*) AS n, COUNT(l_suppkey) AS c, CAST(SUM(l_partkey) AS BIGINT) AS s, AVG(l_partkey) AS a, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM lineitem",
    ),
    "agg_minmax_str": ("part", "SELECT MIN(p_name) AS lo, MAX(p_type) AS hi FROM part WHERE p_size > 3", ""),
    "agg_empty": (
        "orders",
        "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0",
        "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0",
    ),
    "agg_empty_grouped": ("orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", ""),
    "agg_group1": ("customer", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", ""),
    "agg_group2": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_partkey) AS lo, MAX(l_suppkey) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "",
    ),
    "agg_group_int": (
        "lineitem",
        "SELECT l_linenumber, SUM(l_orderkey) AS s, AVG(l_suppkey) AS a FROM lineitem GROUP BY l_linenumber",
        "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(SUM(l_orderkey) AS BIGINT) AS s, AVG(l_suppkey) AS a FROM lineitem GROUP BY l_linenumber",
    ),
    "agg_group_many": (
        "lineitem",
        "SELECT l_partkey, COUNT(*) AS n, SUM(l_orderkey) AS s FROM lineitem GROUP BY l_partkey",
        "SELECT l_partkey, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_partkey",
    ),
    "agg_group_unselected_key": ("orders", "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", ""),
    "agg_distinct": (
        "orders", "SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY o_orderstatus, o_orderpriority", "",
    ),
    "agg_filtered": (
        "lineitem", "SELECT l_linestatus, COUNT(*) AS n, MAX(l_orderkey) AS hi FROM lineitem WHERE l_returnflag != 'R' GROUP BY l_linestatus", "",
    ),
    "agg_order_alias": (
        "lineitem",
        "SELECT l_suppkey AS supplier, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC LIMIT 10",
        "SELECT l_suppkey AS supplier, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10",
    ),
    "agg_order_pos": ("part", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY 1 DESC LIMIT 7", ""),
    "sort_multi": (
        "orders", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus DESC, 2, o_orderkey DESC LIMIT 50", "",
    ),
    "sort_hidden_col": ("customer", "SELECT c_name FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 20", ""),
    "topk": ("lineitem", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem ORDER BY l_partkey DESC, l_orderkey, l_suppkey LIMIT 25", ""),
    "topk_ties": (
        "lineitem", "SELECT l_orderkey, l_returnflag FROM lineitem ORDER BY l_returnflag LIMIT 30",
        "SELECT l_orderkey, l_returnflag FROM lineitem ORDER BY l_returnflag, file_row_number LIMIT 30",
    ),
    "limit_zero": ("orders", "SELECT o_orderkey FROM orders LIMIT 0", ""),
    "limit_physical": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 500 LIMIT 17", ""),
    "default_names": (
        "orders", "SELECT COUNT(*), COUNT(o_custkey), SUM(o_custkey), AVG(o_custkey), MIN(o_orderkey), MAX(o_orderstatus) FROM orders WHERE o_custkey > 3",
        'SELECT COUNT(*) AS "count(*)", COUNT(o_custkey) AS "count(o_custkey)", CAST(SUM(o_custkey) AS BIGINT) AS "sum(o_custkey)", AVG(o_custkey) AS "avg(o_custkey)", '
        'MIN(o_orderkey) AS "min(o_orderkey)", MAX(o_orderstatus) AS "max(o_orderstatus)" FROM orders WHERE o_custkey > 3',
    ),
    "meta_count_min_max": (
        "orders", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_custkey) AS hi, MAX(o_orderstatus) AS st FROM orders", "",
    ),
    "events_by_type": (
        "events", "SELECT event_type, COUNT(*) AS n, MIN(user_id) AS lo, MAX(user_id) AS hi FROM events GROUP BY event_type ORDER BY n DESC", "",
    ),
    "docs_by_lang": (
        "documents", "SELECT lang, source, COUNT(*) AS n, SUM(n_chars) AS s, AVG(n_chars) AS a FROM documents GROUP BY lang, source",
        "SELECT lang, source, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS s, AVG(n_chars) AS a FROM documents GROUP BY lang, source",
    ),
}


def _statement(table: str, sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).query(Table.from_parquet(spark, f"{sf_dir}/{table}.parquet"), sql)

    return run


def _sum_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that pass the 64-bit range on the way, and an average that doubles get wrong."""
    rows = [("a", 2**63 - 1), ("a", 1), ("a", -5), ("b", 2**53), ("b", 1), ("b", 1), ("b", -(2**53))]
    table = Table.from_rows(spark, parse_schema("k:str,x:int"), rows)
    return Engine(spark).query(table, "SELECT k, SUM(x) AS s, AVG(x) AS a FROM t GROUP BY k")


QUERIES: dict[str, Query] = {n: _statement(t, sql) for n, (t, sql, _) in _STATEMENTS.items()} | {
    "sum_wide": _sum_wide,
    **registry_storage.QUERIES,
}

ORACLES: dict[str, str] = {n: oracle or sql for n, (_, sql, oracle) in _STATEMENTS.items() if n != "topk_ties"} | {
    "topk_ties": "SELECT l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER () AS place FROM lineitem) ORDER BY l_returnflag, place LIMIT 30",
    "sum_wide": "SELECT k, CAST(SUM(x) AS BIGINT) AS s, AVG(x) AS a FROM (VALUES ('a', 9223372036854775807), ('a', 1), ('a', -5), "
    "('b', 9007199254740992), ('b', 1), ('b', 1), ('b', -9007199254740992)) AS t(k, x) GROUP BY k",
    **registry_storage.ORACLES,
}
