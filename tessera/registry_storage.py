"""Queries that write tables, read them back, and show results in order, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine, ExecuteOptions
from tessera.errors import SchemaError
from tessera.functions.render import render_bytes, render_table
from tessera.sources.csvio import import_csv, read_csv
from tessera.sources.schema import parse_schema
from tessera.sources.session import local_path, work_path
from tessera.sources.table import Table
from tessera.sources.writer import TableWriter, write_table

Query = Callable[[SparkSession, str], DataFrame]


def _text_file(spark: SparkSession, lines: DataFrame, end: str) -> str:
    """A folder with one text file of lines (value), which all tasks can read."""
    path = work_path(spark, "csv")
    lines.coalesce(1).write.option("lineSep", end).text(path)
    return path


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with quotes, commas, line ends and padding, read strictly."""
    text = 'id,name\r\n1,"a, b"\r\n 2 ,it\'s\r\n3,"two\r\nlines"\r\n4,"say ""hi"""\r\n5, padded \r\n6,""'
    frame = read_csv(spark, _text_file(spark, spark.createDataFrame([(text,)], "value string"), "\r\n"), parse_schema("id:int,name:str"))
    return Engine(spark).query(Table.from_dataframe(frame), "SELECT * FROM t WHERE id < 6")


def _csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV, imported as one file."""
    names = Table.from_parquet(spark, f"{sf_dir}/customer.parquet").frame()
    line = F.format_string('%d,"%s, %s"', "c_custkey", "c_name", "c_mktsegment")
    lines = spark.createDataFrame([("key,name",)], "value string").union(names.select(line))
    path = local_path(work_path(spark, "table"))
    import_csv(spark, _text_file(spark, lines, "\n"), path, parse_schema("key:int,name:str"))
    return Engine(spark).query(Table.from_parquet(spark, path), "SELECT key, name FROM t WHERE name >= 'Customer#000000010'")


def _numbered(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A result's rows with their place in it."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, {names}")


def _run_in_order(table: str, sql: str, names: str, options: ExecuteOptions = ExecuteOptions()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result, _ = Engine(spark).run(Table.from_parquet(spark, f"{sf_dir}/{table}.parquet"), sql, options)
        return _numbered(spark, result.rows, names)

    return run


def _table_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "table")
    write_table(Table.from_parquet(spark, f"{sf_dir}/supplier.parquet").frame(), path)
    return Engine(spark).query(Table.from_parquet(spark, path), "SELECT s_suppkey, s_name FROM t WHERE s_suppkey > 3")


def _rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended one by one; rows of a wrong form are refused and change nothing, as is a second writer."""
    path = local_path(work_path(spark, "table"))
    writer = TableWriter(spark, path, parse_schema("n:int,word:str")).with_row_group_size(10)
    refused = 0
    for row in [(i, f"w{i % 3}") for i in range(25)] + [("x", "y"), (1,), (2**63, "z")]:
        try:
            writer.add_row(row)
        except SchemaError:
            refused += 1
    writer.finish()
    try:
        TableWriter(spark, path, parse_schema("n:int"))
    except SchemaError:
        refused += 1
    table = Table.from_parquet(spark, path)
    rows = Engine(spark).run(table, "SELECT word, COUNT(*), SUM(n) FROM t GROUP BY word")[0].rows
    return spark.createDataFrame([(*r, refused, len(table.footers.groups)) for r in rows], "word string, n long, s long, refused int, row_groups int")


def _sequence_table(spark: SparkSession) -> Table:
    path = work_path(spark, "table")
    write_table(spark.range(0, 100_000, 1, 1).selectExpr("id", "format_string('s%02d', id % 16) AS s"), path)
    return Table.from_parquet(spark, local_path(path))


def _encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a written table's columns are encoded."""
    groups = _sequence_table(spark).footers.groups
    found = {c: {e for g in groups for e in g.encodings[c]} for c in ("id", "s")}
    rows = [(c, any("DELTA" in e for e in es), any("DICTIONARY" in e for e in es), len(groups)) for c, es in found.items()]
    return spark.createDataFrame(rows, "name string, delta boolean, dictionary boolean, row_groups int")


def _scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements skip on a table of 100,000 numbers in order."""
    table, rows = _sequence_table(spark), []
    for where, pruning in (("id >= 90000", True), ("id >= 90000", False), ("id < 8192", True), ("s = 'none'", True)):
        _, s = Engine(spark).run(table, f"SELECT COUNT(*) FROM t WHERE {where}", ExecuteOptions(use_pruning=pruning))
        rows.append((where.split()[0], where.split()[-1], pruning, s.row_groups_total, s.row_groups_scanned, s.row_groups_fully_matched, s.rows_scanned))
    return spark.createDataFrame(rows, "name string, bound string, pruning boolean, total int, scanned int, matched int, rows_scanned long")


def _accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table.from_parquet(spark, f"{sf_dir}/orders.parquet")
    return spark.createDataFrame([(n, table.column_type(n).label, table.row_count) for n in table.schema], "name string, type string, n long")


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as an aligned table, and a size for people; spaces run together."""
    result, _ = Engine(spark).run(Table.from_parquet(spark, f"{sf_dir}/region.parquet"), "SELECT r_name, COUNT(*) AS n FROM region GROUP BY r_name LIMIT 2")
    lines = [*render_table(result.columns, result.rows).splitlines(), render_bytes(1536)]
    return _numbered(spark, [(" ".join(line.split()),) for line in lines if "--" not in line], "line string")


_GROUP_ORDER = "SELECT o_orderstatus, o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderstatus, o_orderpriority"
_SERIAL = "SELECT l_partkey, l_orderkey FROM lineitem WHERE l_suppkey = 7 ORDER BY l_partkey DESC, l_orderkey LIMIT 40"

QUERIES: dict[str, Query] = {
    "csv_rows": _csv_rows,
    "csv_import": _csv_import,
    "run_input_order": _run_in_order("orders", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 140", "o_orderkey long"),
    "run_group_order": _run_in_order("orders", _GROUP_ORDER, "o_orderstatus string, o_orderpriority string, n long"),
    "run_serial": _run_in_order("lineitem", _SERIAL, "l_partkey long, l_orderkey long", ExecuteOptions(False, False)),
    "table_written": _table_written,
    "rows_written": _rows_written,
    "encodings": _encodings,
    "scan_statistics": _scan_statistics,
    "accessors": _accessors,
    "rendered": _rendered,
}

ORACLES: dict[str, str] = {
    "csv_rows": "SELECT * FROM (VALUES (1::BIGINT, 'a, b'), (2, 'it''s'), (3, 'two' || chr(13) || chr(10) || 'lines'), (4, 'say \"hi\"'), (5, ' padded ')) AS t(id, name)",
    "csv_import": "SELECT CAST(c_custkey AS BIGINT) AS key, c_name || ', ' || c_mktsegment AS name FROM customer WHERE c_name >= 'Customer#000000010'",
    "run_input_order": "SELECT row_number() OVER (ORDER BY p) - 1 AS place, CAST(o_orderkey AS BIGINT) AS o_orderkey "
    "FROM (SELECT *, row_number() OVER () AS p FROM orders) WHERE o_custkey BETWEEN 100 AND 140",
    "run_group_order": "SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS place, o_orderstatus, o_orderpriority, COUNT(*) AS n "
    "FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "run_serial": "SELECT row_number() OVER (ORDER BY l_partkey DESC, l_orderkey) - 1 AS place, CAST(l_partkey AS BIGINT) AS l_partkey, "
    "CAST(l_orderkey AS BIGINT) AS l_orderkey FROM lineitem WHERE l_suppkey = 7 ORDER BY place LIMIT 40",
    "table_written": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier WHERE s_suppkey > 3",
    "rows_written": "SELECT 'w' || (n % 3) AS word, COUNT(*) AS n, CAST(SUM(n) AS BIGINT) AS s, 4::INT AS refused, 3::INT AS row_groups "
    "FROM range(25) AS t(n) GROUP BY n % 3",
    "encodings": "SELECT * FROM (VALUES ('id', true, false, 13::INT), ('s', false, true, 13::INT)) AS t(name, delta, dictionary, row_groups)",
    "scan_statistics": "WITH groups AS (SELECT n // 8192 AS g, MIN(n) AS lo, MAX(n) AS hi, COUNT(*) AS rows FROM range(100000) AS t(n) GROUP BY 1) "
    "SELECT 'id' AS name, '90000' AS bound, true AS pruning, 13::INT AS total, COUNT(*)::INT AS scanned, COUNT_IF(lo >= 90000)::INT AS matched, "
    "SUM(rows)::BIGINT AS rows_scanned FROM groups WHERE hi >= 90000 "
    "UNION ALL SELECT 'id', '90000', false, 13, COUNT(*)::INT, 0, SUM(rows)::BIGINT FROM groups "
    "UNION ALL SELECT 'id', '8192', true, 13, COUNT(*)::INT, COUNT_IF(hi < 8192)::INT, SUM(rows)::BIGINT FROM groups WHERE lo < 8192 "
    "UNION ALL SELECT 's', chr(39) || 'none' || chr(39), true, 13, 0, 0, 0",
    "accessors": "SELECT name, type, n FROM (VALUES ('o_orderkey', 'Int64'), ('o_custkey', 'Int64'), ('o_orderstatus', 'Utf8'), ('o_orderpriority', 'Utf8')) AS t(name, type), "
    "(SELECT COUNT(*) AS n FROM orders)",
    "rendered": "WITH names AS (SELECT r_name, COUNT(*) AS n, row_number() OVER (ORDER BY r_name) AS place FROM region GROUP BY r_name ORDER BY r_name LIMIT 2) "
    "SELECT 0::BIGINT AS place, 'r_name n' AS line UNION ALL SELECT place, r_name || ' ' || n FROM names "
    "UNION ALL SELECT 3, '(2 rows)' UNION ALL SELECT 4, '1.50 KiB'",
}
