import pytest

from tessera import Engine, SchemaError, Table, parse_schema
from tessera.cli import main
from tessera.functions.render import render_bytes, render_table, render_value
from tessera.sources.csvio import import_csv, read_csv

READINGS = "id,sensor,value\n" + "".join(
    f"{i + 1},{('alpha', 'beta', 'gamma')[i % 3]},{v}\n"
    for i, v in enumerate([120, 480, 1100, 240, 600, 1300, 360, 720, 1500, 480, 840, 1700])
)


@pytest.fixture
def source(tmp_path):
    def write(text):
        path = tmp_path / "in.csv"
        path.write_bytes(text.encode() if isinstance(text, str) else text)
        return str(path)

    return write


def test_import_keeps_strings(spark, source, tmp_path):
    text = 'id,name\r\n1,"a, b"\r\n 2 ,it\'s\r\n3,"two\r\nlines"\r\n4,"say ""hi"""\r\n5, padded \r\n6,""\r\n7,\r\n'
    out = str(tmp_path / "t.parquet")
    assert import_csv(spark, source(text), out, parse_schema("id:int,name:str")) == 7
    rows = Engine(spark).run(Table.from_parquet(spark, out), "SELECT * FROM t")[0].rows
    assert rows == [(1, "a, b"), (2, "it's"), (3, "two\r\nlines"), (4, 'say "hi"'), (5, " padded "), (6, ""), (7, "")]


def test_headers(spark, source, tmp_path):
    schema = parse_schema("id:int,name:str")
    assert import_csv(spark, source("7,seven\n"), str(tmp_path / "a"), schema, header=False) == 1
    assert import_csv(spark, source("id,name\n"), str(tmp_path / "b"), schema) == 0


@pytest.mark.parametrize("text", ["id,name\nx,y\n", "id,name\n1\n", "id,name\n1,a,b\n", "name,id\n1,a\n", "ID,name\n1,a\n", "", "id,name\n,a\n", "id,name\n9223372036854775808,a\n", b"id,name\n1,\xff\n", "id,name\n5.0,a\n"])
def test_failed_import_leaves_nothing(spark, source, tmp_path, text):
    path = source(text)
    with pytest.raises(SchemaError):
        import_csv(spark, path, str(tmp_path / "t.parquet"), parse_schema("id:int,name:str"))
    assert [p.name for p in tmp_path.iterdir()] == ["in.csv"]


def test_import_in_parts(spark, source, tmp_path, monkeypatch):
    text = "id,name\n" + "".join(f'{i},"n, {i}"\n' for i in range(5000))
    out = str(tmp_path / "parts")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert import_csv(spark, source(text), out, parse_schema("id:int,name:str"), parts=True) == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len([p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")]) > 1
    rows = Engine(spark).run(Table.from_parquet(spark, out), "SELECT * FROM t")[0].rows
    assert rows == [(i, f"n, {i}") for i in range(5000)]
    with pytest.raises(SchemaError, match="exists"):
        import_csv(spark, source(text), out, parse_schema("id:int,name:str"), parts=True)


def test_header_over_several_lines(spark, source, tmp_path):
    lines = "\n".join(["x"] * 9)
    schema = parse_schema("id:int,name:str")
    found = read_csv(spark, source(f'1,"{lines}"\n2,b\n'), schema, header=False)
    assert [tuple(r) for r in found.collect()] == [(1, lines), (2, "b")]
    with pytest.raises(SchemaError, match="header"):
        read_csv(spark, source('id,"na\nme"\n1,a\n'), schema)


def test_existing_destination_is_kept(spark, source, tmp_path):
    path = source("id\n1\n")
    with pytest.raises(SchemaError, match="exists"):
        import_csv(spark, path, path, parse_schema("id:int"))
    assert open(path).read() == "id\n1\n"


def test_command_line(spark, source, tmp_path, capsys):
    table = str(tmp_path / "r.parquet")
    assert main(["load", source(READINGS), table, "--schema", "id:int,sensor:str,value:int"], spark) == 0
    capsys.readouterr()
    assert main(["query", table, "SELECT id, sensor, value FROM r WHERE value > 1000 ORDER BY value DESC LIMIT 3", "--format", "csv", "--explain"], spark) == 0
    out = capsys.readouterr()
    assert out.out == "id,sensor,value\n12,gamma,1700\n9,gamma,1500\n6,gamma,1300\n"
    assert "row groups: 1 of 1" in out.err
    assert main(["query", table, "SELECT sensor, COUNT(*) AS samples, AVG(value) AS average FROM t GROUP BY sensor ORDER BY average DESC"], spark) == 0
    assert capsys.readouterr().out.splitlines()[2:] == ["gamma         4     1400", "beta          4      660", "alpha         4      300", "(3 rows)"]
    assert main(["inspect", table], spark) == 0
    assert "rows: 12" in capsys.readouterr().out
    for bad in ("SELECT id FROM t LIMIT -1", "SELECT id FROM t WHERE id = 'x'", "SELECT nope FROM t", "SELECT id FROM t WHERE id = 1 OR"):
        assert main(["query", table, bad], spark) == 1
    assert main(["load", source(READINGS), table, "--schema", "id:int"], spark) == 1
    assert main(["query", str(tmp_path / "none"), "SELECT a FROM t"], spark) == 1


def test_rendering():
    values = [None, 7.0, 0.5, 1e20, 1.5e-7, -3, "a", -0.0]
    assert [render_value(v) for v in values] == ["NULL", "7", "0.5", "100000000000000000000", "0.00000015", "-3", "a", "-0"]
    assert render_table(["a", "bb"], [(1, "x"), (22, "y")]) == " a  bb\n--  --\n 1  x\n22  y\n(2 rows)"
    assert [render_bytes(n) for n in (5, 2048, 3 * 2**20)] == ["5 B", "2.00 KiB", "3.00 MiB"]
