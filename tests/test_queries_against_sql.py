"""Every query that has SQL gives the rows that DuckDB gives."""

import datetime
import math

import duckdb
import pytest

from tessera.plans import queries

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in NAMES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, list):
        return [plain(x) for x in value]
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value + 0.0:.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, tables, duck, name):
    frame = queries.QUERIES[name](spark, tables)
    relation = duck.sql(queries.SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(x) for x in columns]
    wanted = sorted([plain(row[k]) for k in places] for row in relation.fetchall())
    assert sorted([plain(x) for x in row] for row in frame.select(*columns).collect()) == wanted


@pytest.mark.parametrize("name", ["normalize_vectors", "multimodal_combination", "mean_vector_by_group"])
def test_what_is_rounded_to_zero_keeps_its_sign(spark, tmp_path, name):
    """As in SQL, -0.000002 gives -0.0, which is not 0.0 in a row that is written."""
    rows = [(k, [-2e-6 if k < 3 else 2e-6, *[0.125] * 62, -1e-7], k // 3) for k in range(6)] + [(6, [-0.0, *[-0.125] * 62, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = sorted(map(str, connection.sql(queries.SQL[name]).fetchall()))
    assert "-0.0," in str(wanted) or "-0.0)" in str(wanted)
    assert sorted(str(tuple(x)) for x in queries.QUERIES[name](spark, str(tmp_path)).collect()) == wanted


def test_queries_without_sql_run(spark, tables):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, tables).count() > 0


def test_entry_points(spark, tables):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_keep_top_k(spark, tables, capsys):
    queries.tensor_topk_filtered(spark, tables).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [" in plan and "In(label, [1,3])" in plan
    queries.bm25_single_field(spark, tables).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan.replace("ReusedExchange", "") or "TakeOrderedAndProject" in plan
    assert "PythonUDF" not in plan
