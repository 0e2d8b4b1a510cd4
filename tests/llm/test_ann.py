import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from claimspark.llm import ann
from claimspark.llm.common import partitions


def vectors(n=1500, d=16, seed=1):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, d)).astype(np.float32) * draw.uniform(0.5, 1.5, size=(n, 1)).astype(np.float32)
    v[:300] = v[0] + draw.normal(size=(300, d)).astype(np.float32) * 1e-3  # a crowd
    return v


def truth(v, queries, k):
    x = v.astype(np.float64)
    out = {}
    for i in queries:
        scores = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i][:k]
        out[i] = [(j, scores[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    v = vectors()
    table = spark.createDataFrame([(i, x.tolist(), 1, [0.0]) for i, x in enumerate(v)], "vec_id long, embedding array<float>, id int, v array<double>")
    rows = ann.nearest(table, table.filter("vec_id % 20 = 0"), k=10, block_rows=200).collect()
    want = truth(v, range(0, len(v), 20), 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {len(x) for x in got.values()} == {10} and set(got) == set(want)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in want]) >= 0.9
    for i, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - v[i].astype(float) @ v[j].astype(float)) < 1e-12 for j, s in found)


def test_few_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (40, None), (60, [0.0, 0.0]), (1, [1.0, 1.0]), (9, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def recall_of(spark, v, every=200):
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": list(v)}))
    got = {}
    for r in ann.nearest(table, table.filter(f"vec_id % {every} = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return [len(got[i] & {j for j, _ in want}) / 20 for i, want in truth(v, range(0, len(v), every), 20).items()]


@pytest.mark.parametrize("shape", ["spread with one outlier", "lognormal", "clusters and a crowd"])
def test_recall_with_production_parameters(spark, shape):
    draw = np.random.default_rng(5)
    v = draw.normal(size=(10_000, 64))
    if shape == "clusters and a crowd":
        v = draw.normal(size=(400, 64))[draw.integers(0, 400, len(v))] + 0.25 * v
        v[::3] = v[0] + 0.05 * draw.normal(size=v[::3].shape)  # a third of all rows
    v /= np.linalg.norm(v, axis=1)[:, None]
    if shape == "spread with one outlier":
        v[7] *= 3
    if shape == "lognormal":
        v *= np.exp(draw.normal(size=(len(v), 1)) * 0.25)
    recall = recall_of(spark, v)
    print(shape, "recall", np.mean(recall), "worst", min(recall))
    assert np.mean(recall) >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    """A third of all rows is one vector: only its smallest ids can be among the best, and all its queries find them."""
    draw = np.random.default_rng(6)
    v = draw.normal(size=(3000, 8))
    v[1::3] = 10 * v[1]
    v[1] = v[4]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(4, v[4].tolist())] * 5
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=5, block_rows=64).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    copies = range(1, 3000, 3)
    for q in (i for i in copies if i % 20 == 0):
        assert got[q] == [i for i in copies if i != q][:5]


def test_ascent_follows_the_bound():
    """Near vectors are looked for deep, unlikely ones in ever more trees; the chance to miss one holds."""
    cosines = np.array([1.0, 0.99, 0.9, 0.7, 0.44, 0.3, 0.0, -1.0, -np.inf])
    depth, deep = ann.ascent(cosines, 64, 48, 0.08)
    assert list(depth) == sorted(depth, reverse=True) and depth[0] == 48 and deep[0] == 1 and list(depth[-3:]) == [0, 0, 0]
    for c, d, j in zip(cosines, depth, deep):
        if d:
            share = 1 - np.arccos(c) / np.pi
            assert (1 - share**d) ** j * (1 - share ** (d + 1) if d < 48 else 1) ** (64 - j) <= 0.08 + 1e-9


def test_scores_of_a_stretch_are_not_held_at_once():
    """All queries visit the whole of a stretch, as at the root: a task holds a bounded number of their scores."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=(8192, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    codes = ann.Planes(64, 1, 48, 1).strings(ann.query_points(v))[:, 0]
    halves = pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())
    strings = pa.table({"cell": np.zeros(len(v), np.int64), "tree": np.zeros(len(v), np.int32), "code": codes, "entry": np.arange(len(v)), "only": np.arange(len(v)), "half": halves})
    stretch = ann.sort_stretch(strings)
    n = 2048
    visits = pa.table({
        "row": np.arange(n), "id": np.arange(n), "unit": pa.array([x.astype(np.float32).tobytes() for x in v[:n]], pa.binary()),
        "bound": np.full(n, -np.inf), "longest": np.ones(n), "code": codes[:n], "depth": np.zeros(n, np.int32),
    })
    tracemalloc.start()
    found = ann.search_stretch(stretch, visits, 20, 48, 1e-3)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 64
    scores = v[:n] @ v.T
    scores[np.arange(n), np.arange(n)] = -np.inf
    got = set(zip(found["row"].to_pylist(), found["entry"].to_pylist()))
    best = np.argsort(-scores, axis=1)[:, :20]
    assert all((i, int(j)) in got for i in range(n) for j in best[i])


def test_the_index_has_several_files_for_each_shuffle_partition(spark):
    """A search task reads one file whole, so its share of the index is cut finer than a shuffle."""
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": range(400), "embedding": list(vectors(400))}))
    forest = ann.Forest(rows, 5, "vec_id", "embedding", 4, 12, 1, 50)
    joined = forest.index.groupBy("cell").count()  # by bucket, without an exchange
    assert joined.rdd.getNumPartitions() == 4 * partitions(spark)
