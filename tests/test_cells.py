from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators.search import tensor_search
from tessera.plans.spec import Field, IndexSpec
from tessera.sources.indexes import Indexes

SCHEMA = "_id string, field string, chunk_idx int, chunk string, embedding array<float>"


def groups(spark, metric, seed=3, rows=600, size=8):
    """Vectors around 12 points, some of them equal, some null; two chunks for each document."""
    draw = np.random.default_rng(seed)
    points = draw.normal(0, 5, (12, size))
    vectors = points[draw.integers(0, 12, rows)] + draw.normal(0, 0.2, (rows, size))
    vectors[::7] = vectors[3]
    if metric == "prenormalized-angular":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    some = [(f"d{k // 2:03}", "a" if k % 3 else "b", k % 2, f"c{k}", None if k % 50 == 9 else [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(some, SCHEMA), vectors


@pytest.mark.parametrize("metric", C.BOUNDED)
def test_pages_are_those_of_the_whole_scan(spark, tmp_path, metric):
    chunks, vectors = groups(spark, metric)
    C.write_cells(chunks, str(tmp_path / "rows"), str(tmp_path / "centres"), metric=metric, cells=24)
    stored = spark.read.parquet(str(tmp_path / "rows"))
    assert stored.count() == chunks.where("embedding is not null").count()
    index = C.Cells.of_rows(stored, spark.read.parquet(str(tmp_path / "centres")), metric)
    docs = chunks.select("_id", F.substring("_id", 3, 1).alias("tens")).distinct()
    pages = ({"limit": 5, "offset": 90}, {"limit": 200, "offset": 150}, {"fields": ["b"]}, {"docs": docs, "where": F.col("tens") == "4", "limit": 40})
    for query, probes, options in zip((vectors[3], vectors[100] * 1.5, -vectors[5], vectors[40]), (1, 6, 1, 2), pages, strict=True):
        wanted, found = (
            Counter(str(tuple(x)) for x in frame.select("_id", "_score", "_highlights").collect())
            for frame in (tensor_search(chunks.where("embedding is not null"), query, metric=metric, **options), C.cell_search(index, query, probes=probes, **options))
        )
        assert found == wanted and wanted


def test_few_cells_are_read(spark, tmp_path, capsys):
    chunks, vectors = groups(spark, "euclidean")
    C.write_cells(chunks, str(tmp_path / "rows"), str(tmp_path / "centres"), metric="euclidean", cells=24)
    index = C.Cells.of_rows(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "centres")), "euclidean")
    exact, near = (C.needed(index, vectors[100], probes=2, exact=x) for x in (True, False))
    assert len(near) == 2 and {*near} <= {*exact} and len(exact) <= 8 < len(index.cells)
    files = [x[0] for x in index.of(exact).select(F.input_file_name()).distinct().collect()]
    assert {int(x.rsplit("cell_=", 1)[1].split("/")[0]) for x in files} == {*index.cells[exact].tolist()}
    C.cell_search(index, vectors[100], probes=2).explain("formatted")
    assert "PartitionFilters: [cell_" in capsys.readouterr().out


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([("a", "f", 0, "x", None)], SCHEMA)
    rows, centres = C.dealt(empty)
    index = C.Cells.of_rows(rows, C.measured(rows, centres, "euclidean"), "euclidean")
    assert C.cell_search(index, [1.0, 0.0]).count() == 0
    same = spark.createDataFrame([(str(k), "f", 0, "x", [1.0, 0.0]) for k in range(30)], SCHEMA)
    rows, centres = C.dealt(same, cells=5)
    index = C.Cells.of_rows(rows, C.measured(rows, centres, "euclidean"), "euclidean")
    assert [x["_id"] for x in C.cell_search(index, [1.0, 0.0], limit=3).collect()] == ["0", "1", "10"] and len(index.cells) == 1
    with pytest.raises(ValueError):
        C.cell_search(index, [1.0])
    for options in ({"metric": "hamming"}, {"cells": 0}, {"cells": C.MOST_CELLS + 1}):
        with pytest.raises(ValueError):
            C.dealt(same, **options)


def test_cells_of_an_index_follow_its_changes(spark, tmp_path, monkeypatch):
    indexes = Indexes(spark, str(tmp_path / "indexes"))
    indexes.create_index(IndexSpec("i", (Field("title", "text", ("filter",)),), ("title",), mode="structured", dimensions=16))
    words = "red blue dog cat fish bird tree stone river cloud".split()
    rows = [(k, f"k{k:02}", f"{words[k % 10]} {words[k // 10]}") for k in range(60)]
    indexes.build_cells("i")  # nothing to deal
    indexes.add_documents("i", spark.createDataFrame(rows, "pos int, _id string, title string"))

    def found(q, **options):
        return [(x["_id"], round(x["_score"], 9)) for x in indexes.search("i", q, **options).orderBy(F.desc("_score"), "_id").collect()]

    def plain(q, **options):
        with monkeypatch.context() as m:
            m.setattr(Indexes, "_cells", lambda self, state: None)
            return found(q, **options)

    before = found("red dog")
    indexes.build_cells("i", cells=8)
    state = indexes._state("i")
    assert indexes._cells_version(state) == state.version and found("red dog") == before == plain("red dog")
    indexes.build_cells("i", cells=8)  # once is enough
    assert len(found("red dog", approximate=True)) == 10
    indexes.delete_documents("i", ["k20"])
    indexes.add_documents("i", spark.createDataFrame([(0, "new", "red dog"), (1, "k02", "cloud cloud")], "pos int, _id string, title string"))
    assert indexes._cells_version(indexes._state("i")) == state.version
    assert found("red dog") == plain("red dog") and found("red dog")[0][0] == "new" and "k20" not in dict(found("blue red", limit=60)) and found("dog red", limit=60) == plain("dog red", limit=60)
    indexes.compact("i")
    assert indexes._cells_version(indexes._state("i")) is None and found("red dog") == plain("red dog")
