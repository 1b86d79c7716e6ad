"""The inverted-file index against the exact lists."""

import random

import pytest

from clausegraph.operators import retrieval as R
from clausegraph.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, n, d=12, alike=0.0, seed=5):
    """Unit vectors around 20 centres; a share of them are nearly one."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(20)]
    rows = []
    for i in range(n):
        c = centres[0] if rng.random() < alike else rng.choice(centres)
        v = [x + rng.gauss(0, 0.01 if c is centres[0] else 0.4) for x in c]
        size = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / size for x in v], 0))
    return spark.createDataFrame(rows, SCHEMA)


def listed(df):
    return sorted((r["qid"], r["rank"], r["doc"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_the_probed_cells(spark, tmp_path, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = items.where("vec_id % 50 = 0")
    index = V.build(items, str(tmp_path))
    exact = R.dense(items, asked)
    probes = V.probes_for(index, asked)
    assert probes < len(index.centres)
    found = V.search(index, asked, probes=probes)
    shares = [r["recall"] for r in V.recall(found, exact).collect()]
    assert len(shares) == asked.count() and sum(shares) / len(shares) >= 0.9
    held = {(r["qid"], r["doc"]): r["score"] for r in exact.collect()}
    assert all(held.get((r["qid"], r["doc"]), r["score"]) == r["score"] for r in found.collect())
    assert index.rows.count() == items.count()


@pytest.mark.parametrize(("alike", "cell_rows", "block"), [(0.0, 8192, 512), (0.4, 50, 7), (1.0, 30, 5)])
def test_certain_search_is_exact_with_hot_cells(spark, tmp_path, monkeypatch, alike, cell_rows, block):
    monkeypatch.setattr(V, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(V, "BLOCK_QUERIES", block)
    items = made(spark, 600, alike=alike)
    index = V.build(items, str(tmp_path), cells=15)
    largest = index.rows.groupBy("cell", "part").count().agg({"count": "max"}).first()[0]
    assert largest <= 2 * cell_rows
    asked = items.where("vec_id % 9 = 0")
    assert listed(V.search(index, asked, 7, probes=2, certain=True)) == listed(R.dense(items, asked, 7))


def test_ties_at_the_border_and_vectors_of_any_length(spark, tmp_path):
    rows = [(i, [1.0, float(i % 2)] if i % 3 else [3.0, 0.0], 0) for i in range(60)]
    items = spark.createDataFrame(rows, SCHEMA)
    index = V.build(items, str(tmp_path), cells=4)
    assert listed(V.search(index, items, 5, probes=1, certain=True)) == listed(R.dense(items, items, 5))


def test_index_of_little(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (None, [0.0, 1.0], 0)]
    items = spark.createDataFrame(rows, SCHEMA)
    index = V.build(items, f"{tmp_path}/few", cells=50)
    found = V.search(index, items, 10, certain=True).collect()
    assert {(r["qid"], r["doc"], r["score"]) for r in found} == {(a, b, float(a == b)) for a in (1, None) for b in (1, None)}
    nothing = V.build(items.limit(0), f"{tmp_path}/none")
    assert V.search(nothing, items, 10, certain=True).count() == 0
    assert V.search(index, items.limit(0), 10, certain=True).count() == 0


def test_the_sample_bounds_what_is_fitted(spark):
    items = made(spark, 500).select(V.F.col("vec_id").alias("doc"), V.F.col("embedding").alias("v"))
    assert V.fit_centres(items, 10, 500, a_cell=8).shape == (10, 12)
