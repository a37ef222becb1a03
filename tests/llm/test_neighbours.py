from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomindex.llm.neighbours import Neighbours, Tree, box_distance, chi_square_quantile, local_leaves, packed, unpacked, usable_vectors
from loomindex.session import shared_dir

SCHEMA = "symbol_id bigint, model string, dimensions int, embedding array<double>, vector string"


def table(spark, n=600, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dims))
    x = centres[rng.integers(0, 60, n)] + 0.25 * rng.standard_normal((n, dims))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    rows = [(i, "m", dims, [float(v) for v in r], "clash") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA), x


def brute(x, k, floor):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(u)):
        g = np.round(u @ u[i], 6)
        order = [j for j in np.lexsort((np.arange(len(u)), -g)) if j != i and g[j] >= floor][:k]
        out[i] = order
    return out


def test_recall_and_order_against_brute_force(spark):
    df, x = table(spark)
    truth = brute(x, 5, 0.85)
    rows = Neighbours(df, 5, 0.85, unit_size=64, load=200).search().collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    two_levels = Neighbours(df, 5, 0.85, unit_size=32, cells=2, load=20)
    assert not two_levels._subtrees.isEmpty() and two_levels._parts.filter("parts > 1").count() > 0
    again = {}
    for r in sorted(two_levels.search().collect(), key=lambda r: r["rank"]):
        again.setdefault(r.query_id, []).append(r.id)
    assert sum(len(set(truth[i]) & set(again.get(i, []))) for i in truth) / sum(map(len, truth.values())) >= 0.95
    hits = sum(len(set(truth[i]) & set(got.get(i, []))) for i in truth)
    assert hits / sum(map(len, truth.values())) >= 0.95
    exact = [i for i in got if got[i] == truth[i]]
    assert len(exact) >= 0.9 * len(got)


def test_without_floor_some_queries(spark):
    df, x = table(spark, 300)
    truth = brute(x, 5, -2)
    got = {}
    for r in Neighbours(df, 5, unit_size=50).search(F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert set(got) == {i for i in range(300) if i % 10 == 0}
    assert sum(len(got[i] & set(truth[i])) for i in got) / sum(len(truth[i]) for i in got) >= 0.9


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "m", 2, [1.0, 0.0]), (1, "m", 2, [1.0, 0.0]), (2, "m", 2, [1e200, 1e190]), (3, "m", 2, [0.0, 0.0]), (4, "m", 2, [nan, 1.0]), (5, "m", 2, [None, 1.0]), (6, "m", 3, [1.0, 0.0]), (7, "m", 2, None),
        (8, "m", 0, []), (9, None, 2, [1.0, 0.0]), (None, "m", 2, [1.0, 0.0]), (10, "m", 2, [inf, 1.0]), (11, "other", 2, [1.0, 0.0]), (12, "m", 3, [1.0, 0.0, 0.0]), (13, "m", None, [1.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert sorted((r.id, r.model) for r in usable_vectors(df).collect()) == [(1, "m"), (2, "m"), (11, "other"), (12, "m")]
    got = sorted((r.query_id, r.id, r.cosine) for r in Neighbours(df, floor=0.85).search().collect())
    assert got == [(1, 2, 1.0), (2, 1, 1.0)]
    assert Neighbours(df.limit(0)).search().count() == 0


def test_chi_square_and_tree():
    assert abs(chi_square_quantile(0.95, 8) - 15.5073) < 1e-3 and abs(chi_square_quantile(0.9, 2) - 4.60517) < 1e-4
    points = np.random.default_rng(0).standard_normal((2000, 4))
    tree = Tree(points, 8)
    cells = tree.assign(points)
    assert set(cells) == set(range(8)) and np.bincount(cells).max() < 500
    assert Tree(np.ones((10, 4)), 8).leaves == 1 and Tree(np.zeros((0, 4)), 3).leaves == 1
    reach = np.full(2000, 0.3)
    rows, leaves = tree.within(points, reach)
    low, high = (np.stack([f(points[cells == c], axis=0) for c in range(8)]) for f in (np.min, np.max))
    near = {(i, c) for i, c in zip(*np.nonzero(box_distance(points, low, high) <= 0.3))}
    assert near <= set(zip(rows.tolist(), leaves.tolist()))
    assert sorted(np.concatenate(local_leaves(points)).tolist()) == list(range(2000))
    assert box_distance(np.array([[0.0, 3.0]]), np.array([[1.0, 1.0]]), np.array([[2.0, 2.0]]))[0, 0] == 2.0


def test_temporary_tables_stay_linear_however_many_units_are_met(spark):
    n, dims = 1500, 64
    x = np.random.default_rng(3).standard_normal((n, dims))
    df = spark.createDataFrame([(i, "m", dims, [float(v) for v in r], None) for i, r in enumerate(x)], SCHEMA)
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p for p in folder.rglob("*.parquet")}
    found = Neighbours(df, 5, unit_size=256).search()
    assert found.count() == 5 * n
    written = sum(p.stat().st_size for p in folder.rglob("*.parquet") if p not in before)
    assert written < 4 * x.nbytes
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "vectors" in line]


def test_packed_vectors_come_back_as_they_were():
    rng = np.random.default_rng(1)
    rows = [rng.integers(-999, 1000, 6) / 1000, rng.standard_normal(6), rng.standard_normal(6).astype(np.float32), [32.767, -32.767, 0.001, 0, 1, -1], [1e200, 1e-200, 1, 0, -1, 3], [32768, 0, 0, 1, 0, 0], [1e-7, 0, 0, 0, 0, 1]]
    x = np.array(rows, np.float64)
    column = packed(x)
    assert [len(v.as_py()) for v in column] == [13, 49, 25, 13, 49, 25, 49]
    assert (unpacked(column, 6) == x).all() and (unpacked(pa.chunked_array([column.slice(2, 3), column.slice(0, 0), column.slice(5)]), 6) == x[2:]).all()
    assert unpacked(packed(np.zeros((0, 6))), 6).shape == (0, 6)


def test_of_different_vectors_of_one_id_the_smallest_counts(spark):
    rows = [(1, "m", 2, [1.0, 0.0]), (1, "m", 2, [0.5, 0.123456789]), (1, "m", 2, [0.5, 7.0]), (2, "m", 2, [1.0, 0.0]), (3, "m", 2, [0.5, 0.123456789])]
    got = {(r.query_id, r.id, r.cosine) for r in Neighbours(spark.createDataFrame([(*r, None) for r in rows], SCHEMA), floor=0.999).search().collect()}
    assert got == {(1, 3, 1.0), (3, 1, 1.0)}
