import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours, pairs
from quern.llm.graph import Graph
from quern.llm.neighbours import nearest, similar_pairs

S = "vec_id long, elements array<float>"


def brute(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("shard_rows", [10_000, 600])
def test_recall_of_all_vectors(spark, shard_rows):
    r = np.random.default_rng(1)
    x = (r.normal(size=(80, 64))[r.integers(0, 80, 2400)] + r.normal(size=(2400, 64))) * r.uniform(0.01, 100, (2400, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], S)
    got = nearest(df, shard_rows=shard_rows).toPandas()
    true, _ = brute(x, 10)
    assert (got.groupby("vec_id").size() == 10).all() and got.vec_id.nunique() == 2400
    hits = sum(len(set(g.near_id) & set(true[i])) for i, g in got.groupby("vec_id"))
    assert hits >= 0.9 * 24_000


def test_unusable_copies_and_clashing_columns(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 64)).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(100 + i, x[0]) for i in range(30)] + [(5, x[5])]
    bad = [(200, None), (201, []), (202, [0.0] * 64), (203, [float("nan")] + [1.0] * 63), (204, [1.0] * 63), (205, [None] + [1.0] * 63), (206, [float("inf")] + [1.0] * 63), (None, x[1]), (207, [1e-30] * 64), (208, [1e30] * 64)]
    df = spark.createDataFrame([(*t, "k", 1, 0.5) for t in rows + bad], S + ", key string, shard int, cosine double")
    got = nearest(df, k=3).toPandas()
    assert set(got.vec_id) == set(range(40)) | set(range(100, 130)) | {207, 208}
    assert (got.vec_id != got.near_id).all() and (got.groupby("vec_id").size() == 3).all()
    assert sorted(got[got.vec_id == 0].near_id) == [100, 101, 102] and sorted(got[got.vec_id == 120].near_id) == [0, 100, 101]
    pairs = {tuple(p) for p in similar_pairs(df, 0.9, k=3).toPandas().to_numpy().tolist()}
    assert (0, 100) in pairs and (207, 208) in pairs and all(a < b for a, b in pairs)
    assert len(pairs) == 6 + 27 * 3 + 1  # the first four copies among themselves, the others with the first three


def test_empty_and_single(spark):
    assert nearest(spark.createDataFrame([], S)).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0] * 64)], S)).count() == 0


def test_cells_that_many_probe_and_cells_that_directions_cannot_divide(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 64))
    x[300:] = x[0] * r.uniform(0.1, 9, 600)[:, None]  # a hot direction, all of different length
    df = spark.createDataFrame(list(enumerate(x.tolist())), S)
    want = nearest(df, k=3, shard_rows=100).toPandas()
    q = neighbours.fitted(neighbours.usable_vectors(df, 64), 900, 64, 100)
    assert q.subs.max() > 1
    hot = want[want.vec_id >= 300]
    assert (hot.groupby("vec_id").size() == 3).all() and hot.vec_id.nunique() == 600 and (hot.cosine > 0.999999).mean() > 0.99
    monkeypatch.setattr(neighbours, "ANSWERS", 1)
    monkeypatch.setattr(neighbours, "REPAID", 1)
    assert neighbours.fitted(neighbours.usable_vectors(df, 64), 900, 64, 100).blocks.max() > 1
    got = nearest(df, k=3, shard_rows=100).toPandas()
    assert set(got.vec_id) == set(want.vec_id) and (got.groupby("vec_id").size() == 3).all()
    both = want.merge(got, on=["vec_id", "near_id"])
    assert len(both[both.vec_id < 300]) >= 0.95 * len(want[want.vec_id < 300])


def test_graph_of_one_shard():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, np.arange(3000))
    assert len(g.layers) > 1 and all(l.dtype == np.int32 and l.shape[0] == 3000 for l in g.layers)
    place, cos = g.search(x[:500], 10, 24)
    true, _ = brute(x, 10)
    assert (place[:, 0] == np.arange(500)).all() and np.allclose(cos[:, 0], 1, atol=1e-5) and (np.diff(cos, axis=1) <= 0).all()
    assert np.mean([len(set(p[1:]) & set(t[:9])) / 9 for p, t in zip(place, true)]) > 0.95
    assert (Graph(x[:1], np.arange(1)).search(x[:2], 3, 5)[0] == [[0, -1, -1]] * 2).all() and (Graph(x[:0], np.arange(0)).search(x[:1], 2, 2)[0] == -1).all()


@pytest.mark.parametrize("case", ["without structure", "one dense group", "many cells"])
def test_no_neighbour_is_missed(spark, case):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 64))
    if case == "one dense group":  # more near vectors than a shard holds
        x[300:] = x[0] + 0.2 * x[300:]
    if case == "many cells":
        x = r.normal(size=(30, 64))[np.arange(1500) % 30] + 0.3 * x
    df = spark.createDataFrame(list(enumerate(x.astype(np.float32).tolist())), S)
    true, s = brute(x.astype(np.float32).astype(float), 10)
    got = nearest(df, shard_rows=60).groupBy("vec_id").agg({"near_id": "collect_list"}).toPandas().to_numpy()
    assert {i: set(l) for i, l in got} == {i: set(t) for i, t in enumerate(true)}
    want = {(min(i, j), max(i, j)) for i, t in enumerate(true.tolist()) for j in t if s[i, j] >= 0.9}
    assert {tuple(p) for p in similar_pairs(df, 0.9, shard_rows=60).collect()} == want


def test_ids_with_several_vectors_and_equal_cosines(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(30, 64)).astype(np.float32).tolist()
    twice = [2 * v for v in x[4]]
    df = spark.createDataFrame([*enumerate(x), (5, x[4]), (40, x[4]), (41, x[4]), (6, twice), (6, twice), (7, x[6])], S)
    lists = {i: list(l) for i, l in nearest(df, k=3).orderBy("vec_id", (-F.col("cosine")), "near_id").groupBy("vec_id").agg(F.collect_list("near_id")).collect()}
    # 4, 5, 6, 40 and 41 have vectors of one direction; the smaller ids come first, whatever the length
    assert lists[4] == [5, 6, 40] and lists[40] == [4, 5, 6] and lists[41] == [4, 5, 6]
    assert lists[5] == [4, 6, 40]  # its own other vector does not count
    assert lists[6] == [4, 5, 7]


def test_blocks_are_compared_as_far_as_they_can_reach():
    r = np.random.default_rng(8)
    x = pairs.unit_rows(r.normal(size=(2, 64))[np.arange(400) % 2] + 0.1 * r.normal(size=(400, 64)))
    (a,), (b,) = (list(pairs.packed(n, np.arange(400)[n::2], x[n::2], x[n::2], np.full(200, 0.9))) for n in (0, 1))

    def run(one, other):
        named = [pa.array([other["block"][0].as_py()]), *[other[c] for c in pairs.BLOCK.names[1:]]]
        both = pa.RecordBatch.from_arrays([*one.columns, *named], names=[*pairs.BLOCK.names, "other", *[c + "_b" for c in pairs.BLOCK.names[1:]]])
        return pa.Table.from_batches(pairs._comparer(64, 5, 0.9)(iter([both])), schema=pairs.FOUND).to_pandas()

    assert len(run(a, b)) == 0
    got = run(a, a)
    true, s = brute(x[::2].astype(float), 5)
    assert {i: set(g.near) for i, g in got.groupby("vec")} == {2 * i: set((2 * t).tolist()) for i, t in enumerate(true)}
    assert np.allclose(got.cosine, s[got.vec // 2, got.near // 2], atol=1e-12)
