"""The read-only guard and the schema that prompts see."""

import pytest
from pyspark.sql.types import LongType

from clausegraph.plans import service
from clausegraph.plans.graph import order_graph


@pytest.fixture(scope="module")
def numbers(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    return spark


@pytest.mark.parametrize(
    "text",
    [
        "SELECT java_method--\n('java.lang.System','setProperty','judge','was here')",
        "SELECT reflect/**/('java.lang.System', 'exit', 0)",
        "SELECT `reflect` ('java.lang.System', 'exit', 0)",
        "SELECT try_reflect('java.lang.System', 'exit', 0)",
        "SELECT * FROM numbers WHERE id IN (SELECT java_method('java.lang.Math', 'abs', 1))",
        "WITH t AS (SELECT reflect('java.lang.Math', 'abs', 1) AS x) SELECT * FROM t",
        "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))",
        "SELECT count(*) FILTER (WHERE reflect('java.lang.Math', 'abs', 1) = '1') FROM numbers",
        "SELECT * FROM numbers ORDER BY java_method('java.lang.Math', 'abs', 1)",
        "SELECT * FROM numbers LATERAL VIEW explode(array(reflect('java.lang.Math', 'abs', 1))) e AS x",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM csv.`/etc/passwd` JOIN numbers",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`)",
        "SELECT * FROM spark_catalog.default.numbers",
        "SELECT * FROM others",
        "SELECT * FROM IDENTIFIER('num' || 'bers')",
        "SELECT IDENTIFIER('re' || 'flect')('java.lang.Math', 'abs', 1)",
        "SELECT * FROM read_files('/etc/hostname')",
        "SELECT input_file_name(), current_user()",
        "SELECT own(id) FROM numbers",
        "SELECT system.builtin.reflect('java.lang.Math', 'abs', 1)",
        "FROM numbers |> WHERE reflect('java.lang.Math', 'abs', 1) = '1'",
    ],
)
def test_guard_rejects_by_the_tree(numbers, text):
    numbers.udf.register("own", lambda x: x, LongType())
    with pytest.raises(service.Rejected):
        service.guard(numbers, text)
    assert numbers._jvm.java.lang.System.getProperty("judge") is None


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'reflect(1)' AS s, `java_method` FROM (SELECT id AS java_method FROM numbers)",
        "WITH t AS (SELECT id, 'DROP TABLE x' AS s FROM numbers), u AS (SELECT * FROM t) SELECT upper(s), sum(id) OVER (PARTITION BY s ORDER BY id) AS n FROM u",
        "SELECT date_trunc('year', DATE'2020-02-03'), regexp_extract('a1', '[0-9]', 0), round(1.5), coalesce(NULL, 1), CASE WHEN 1 > 0 THEN 2 END, size(array(1)), to_json(named_struct('a', 1))",
        "SELECT e.x FROM numbers LATERAL VIEW explode(array(1, id)) e AS x",
        "SELECT transform(collect_list(id), x -> x + 1) AS t FROM NUMBERS",
    ],
)
def test_guard_lets_reads_pass(numbers, text):
    assert service.run_readonly(numbers, text)[0]


def test_guard_reads_only_the_named_views(numbers):
    numbers.range(3).createOrReplaceTempView("secrets")
    assert service.guard(numbers, "SELECT * FROM secrets")
    with pytest.raises(service.Rejected, match="secrets is not one of the views"):
        service.run_readonly(numbers, "SELECT * FROM numbers, secrets", views=["numbers"])
    assert service.run_readonly(numbers, "WITH own AS (SELECT 1 AS one) SELECT * FROM own", views=[])[0] == [{"one": 1}]


def test_schema_hides_and_keeps(spark, sf):
    g = order_graph(spark, sf)
    schema = service.Schema(g, hidden_labels=["steps"], hidden_columns=["confidence", "content"])
    rows = {r["label"]: r for r in schema.as_rows()}
    assert "steps" not in rows and rows["chunks"]["n"] == g.chunks.count()
    assert [c["column"] for c in rows["refs"]["columns"]] == ["dst", "is_external", "ref_type", "src"]
    assert schema.as_rows() is schema.as_rows() and "content" not in schema.as_text()
    assert "operations (" in schema.as_text() and len(schema.as_text().splitlines()) == len(rows)
    kept = schema.as_rows()
    schema.invalidate()
    assert schema.as_rows() is not kept and schema.as_rows() == kept
