"""What the SQL surface refuses, and its budgets."""

import pytest

from tessera.plans import sqlguard
from tessera.plans.sqlguard import SqlError


@pytest.fixture(scope="module")
def run(spark):
    tables = {"t": spark.range(3000), "u": spark.createDataFrame([(1, "one", [1, 2]), (2, None, [])], "id long, name string, list array<int>")}
    return lambda q, seconds=60.0, **how: sqlguard.run_sql(spark, q, tables, seconds, **how)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM IDENTIFIER('text.`{file}`')",
        "WITH a AS (SELECT * FROM IDENTIFIER('text.`{file}`')) SELECT * FROM a",
        "SELECT (SELECT max(value) FROM IDENTIFIER('text.`{file}`')) AS x",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') AS x",
        "SELECT * FROM text.`{file}`",
        "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM csv.`{file}`)",
        "SELECT * FROM t, LATERAL (SELECT * FROM text.`{file}`)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS x",
        "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') AS x",
        "SELECT transform(array(1), x -> java_method('java.lang.System', 'nanoTime')) AS x",
        "SELECT input_file_name() AS f FROM t",
        "SELECT current_user() AS u",
        "SELECT version() AS v",
        "SELECT raise_error('x') AS e",
        "SELECT * FROM range(10)",
        "SELECT * FROM read_files('{file}')",
        "SELECT from_avro(x'00', 'x') AS a",
        "SELECT xpath_string('<a>b</a>', 'a') AS x",
        "SELECT * FROM t TABLESAMPLE (1 ROWS) JOIN default.other",
        "SELECT * FROM global_temp.v",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t",
        "SELECT :p AS x",
        "EXPLAIN SELECT * FROM text.`{file}`",
        "EXPLAIN DROP TABLE t",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "SELECT 1 UNION ALL SELECT value FROM text.`{file}`",
        "SELECT * FROM (TABLE other)",
    ],
)
def test_refused(run, tmp_path, text):
    (tmp_path / "secret").write_text("secret")
    with pytest.raises(SqlError) as e:
        run(text.replace("{file}", str(tmp_path / "secret")))
    assert "secret" not in str(e.value).replace(str(tmp_path), "").replace("/secret", "") and "o1" not in str(e.value)


def test_allowed(run):
    assert run("SELECT upper(name) AS n, size(list) AS k, coalesce(name, '-') AS c FROM u ORDER BY id") == [{"n": "ONE", "k": 2, "c": "one"}, {"n": None, "k": 0, "c": "-"}]
    assert run("SELECT id, x FROM u LATERAL VIEW explode(list) e AS x ORDER BY x") == [{"id": 1, "x": 1}, {"id": 1, "x": 2}]
    assert run("SELECT id, x FROM u, LATERAL (SELECT id + 1 AS x) ORDER BY id")[1] == {"id": 2, "x": 3}
    assert run("SELECT id, sum(id) OVER (ORDER BY id) AS s FROM u ORDER BY id")[1]["s"] == 3
    assert run("SELECT v FROM VALUES (1), (2) AS w(v) WHERE v IN (SELECT id FROM u WHERE id > 1)") == [{"v": 2}]
    assert run("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT max(n) AS m FROM r") == [{"m": 4}]
    assert run("SELECT grouping(id) AS g, count(*) AS n FROM u GROUP BY CUBE (id) ORDER BY 1, 2")[-1] == {"g": 1, "n": 2}
    assert "Project" in next(iter(run("EXPLAIN SELECT id + 1 AS x FROM u")[0].values())) or run("EXPLAIN SELECT id FROM u")
    assert run("SELECT name FROM u WHERE name GLOB 'o?e'") == [{"name": "one"}]
    assert {r["name"] for r in run("SELECT name FROM catalog_tables")} == {"t", "u"}


def test_duplicate_names_are_numbered(run):
    assert run("SELECT 1 AS a, 2 AS a, 3 AS b, 4 AS a") == [{"a": 1, "a:1": 2, "b": 3, "a:2": 4}]


def test_budgets(run, monkeypatch):
    assert len(run("SELECT id FROM t LIMIT 1000")) == 1000
    with pytest.raises(SqlError, match="over 1000 rows"):
        run("SELECT id FROM t LIMIT 1001")
    assert len(run("SELECT " + ", ".join(f"1 AS c{i}" for i in range(24)))[0]) == 24
    with pytest.raises(SqlError, match="over 24 columns"):
        run("SELECT " + ", ".join(f"1 AS c{i}" for i in range(25)))
    with pytest.raises(SqlError, match="a value exceeds the size budget"):
        run("SELECT repeat('x', 1048577) AS big")
    assert len(run("SELECT repeat('x', 1048576) AS big")[0]["big"]) == 1 << 20
    with pytest.raises(SqlError, match="output exceeds"):
        run("SELECT repeat('x', 1000000) AS big FROM t LIMIT 5")
    with pytest.raises(SqlError, match="too long"):
        run("SELECT 1 -- " + "x" * (64 << 10))
    with pytest.raises(SqlError, match="2.0 s"):
        run("SELECT count(*) AS n FROM t a, t b, t c WHERE a.id * 3 + b.id * 5 + c.id < 0", seconds=2.0)


def test_work_budget_counts_rows_read(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "r"))
    tables = {"r": spark.read.parquet(str(tmp_path / "r"))}
    q = "SELECT sum(id) AS s FROM r"
    assert sqlguard.run_sql(spark, q, tables, 60.0, work=10**6) == [{"s": 200_000 * 199_999 // 2}]
    with pytest.raises(SqlError, match="rows read"):
        sqlguard.run_sql(spark, q, tables, 60.0, work=100_000)
    with pytest.raises(SqlError, match="does not exist|No such file|not found|missing"):
        for f in (tmp_path / "r").glob("*.parquet"):
            f.unlink()
        sqlguard.run_sql(spark, q, tables, 60.0)
