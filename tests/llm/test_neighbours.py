"""Nearest neighbours: exact where all leaves are visited, measured recall where not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import neighbours as nb

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, asks, k=10):
    """{query_id: [(vec_id, score)]} over usable vectors of the most frequent length."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    lengths = [len(v) for _, v in good]
    usual = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    good = [(i, v) for i, v in good if len(v) == usual]
    out = {}
    for i, q in good:
        if asks(i):
            found = out.setdefault(i, {})
            for j, v in good:
                if j != i:
                    d = float(np.sqrt(((v - q) ** 2).sum()))
                    found[j] = min(d, found.get(j, d))
    return {i: sorted(((d, j) for j, d in found.items()))[:k] for i, found in out.items()}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 8)) + 10 * rng.integers(0, 5, size=(3_000, 1))
    tree = nb.fit_tree(x, 40)
    leaf = tree.assign(x)
    assert 20 < tree.leaves < 80 and set(leaf) <= set(range(tree.leaves))
    order = tree.visits(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visits(x[0], 7) == order[:7]
    assert np.mean([tree.visits(v, 1)[0] == n for v, n in zip(x[:200], leaf[:200], strict=True)]) > 0.8
    assert nb.fit_tree(np.ones((50, 4)), 9).leaves == 1


def test_all_leaves_are_exact(spark):
    """Copies, repeated rows, odd vectors, ids with two vectors; clashing columns; small parts and leaves."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], 0) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 0.5], 0) for i in range(300)]  # one vector, a large part of all rows
    rows += rows[:30] + [(1000, [9.0, 9.0, 9.0], 0), (1100, [9.0, 9.0, 9.0], 0)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (2000, None, 0), (2001, [], 0), (2100, [0.0, 0.0, 0.0], 0), (2003, [1.0, None, 1.0], 0), (2200, [1.0, float("nan"), 1.0], 0), (2005, [1.0, float("inf"), 1.0], 0), (2300, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a", F.lit("x")).withColumn("leaf", F.lit(1)).repartition(7)
    got = answers(nb.neighbours(df, F.col("vec_id") % 20 == 0, target=1.0, leaf=16, part=50))
    assert got == brute(rows, lambda i: i % 20 == 0)


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    assert answers(nb.neighbours(spark.createDataFrame(few, SCHEMA), F.col("vec_id") == 0)) == brute(few, lambda i: i == 0)
    assert nb.neighbours(spark.createDataFrame(few[:1], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert nb.neighbours(spark.createDataFrame(few, SCHEMA), F.col("vec_id") == 7).count() == 0
    assert nb.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("spread", [0.3, 8.0])
def test_recall(spark, spread):
    """Clustered vectors and vectors without any structure."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2_500, 16)) + spread * rng.normal(size=(30, 16))[rng.integers(0, 30, 2_500)]
    rows = [(i, [float(v) for v in np.float32(row)], 0) for i, row in enumerate(x)]
    got = answers(nb.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, leaf=32))
    want = brute(rows, lambda i: i % 20 == 0)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    true = {i: dict((j, d) for d, j in found) for i, found in brute(rows, lambda i: i % 20 == 0, 3_000).items()}
    assert all(d == true[i][j] for i, found in got.items() for d, j in found)
    assert np.mean([j in {t for _, t in want[i]} for i, found in got.items() for _, j in found]) >= 0.9


def test_query(spark, sf):
    from shelfmark.llm.common import table

    rows = [tuple(r) for r in table(spark, sf, "embeddings").collect()]
    got, want = answers(nb.op11_neighbours(spark, sf)), brute(rows, lambda i: i % 100 == 0)
    assert set(got) == set(want)
    assert np.mean([j in {t for _, t in want[i]} for i, found in got.items() for _, j in found]) >= 0.9
