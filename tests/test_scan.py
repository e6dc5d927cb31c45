"""Blocks of vectors: results against brute force, and how much leaves or enters a task."""

import numpy as np
import pytest

from colstrata.operators import knn, quantile, scan, vector_index


def _table(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


def _received(df):
    """df's rows, and the most rows that a step in Python gave back."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            got = node.metrics().get("pythonNumRowsReceived")
            most = max(most, got.get().value() if got.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_rabitq_keeps_what_lies_within_the_bounds_in_its_task(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, most = _received(knn.rabitq_top_k(_table(spark, x), 5, metric, block_rows=200))
    assert len(rows) == 2000 and most <= 400 * 5 * 2
    y = x.astype(float)
    coder = knn.RaBitQ(64, y.mean(0))
    est, wide = coder.estimate(y, *coder.encode(y))
    d = ((y[:, None] - y[None]) ** 2).sum(2) if metric == "l2" else 1 - y @ y.T
    if metric == "ip":
        est, wide = 1 - ((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - est) / 2, wide / 2
    d, own = np.round(d, 6) + 0.0, np.eye(400, dtype=bool)
    kth = np.sort(np.where(own, np.inf, est + wide), axis=1)[:, 4]
    d[own | (est - wide > kth[:, None])] = np.inf
    want = {(i, int(j)) for i in range(400) for j in np.argsort(d[i], kind="stable")[:5]}
    assert {(r["query_id"], r["vec_id"]) for r in rows} == want


def test_top_k_sends_no_more_than_k_rows_a_query_and_block(spark):
    x = np.ones((300, 4), np.float32)
    df = _table(spark, x).toDF("id", "v")
    rows, most = _received(knn.top_k(df, df, 3, block_rows=150))
    assert most <= 300 * 3 * 2
    assert {(r["query_id"], r["vec_id"]) for r in rows} == {(i, j) for i in range(300) for j in [j for j in range(4) if j != i][:3]}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("kind", ["normal", "far", "grid", "small", "mixed"])
def test_nearest_equals_brute_force(monkeypatch, metric, kind):
    monkeypatch.setattr(scan, "_FIRST", 64)
    monkeypatch.setattr(scan, "_TILE", 128)
    monkeypatch.setattr(scan, "_ROWS", 100)
    monkeypatch.setattr(scan, "_PAIRS", 1000)
    rng = np.random.default_rng(5)
    x = {"normal": lambda: rng.normal(size=(700, 12)), "far": lambda: rng.normal(size=(700, 12)) + 1000, "grid": lambda: rng.integers(-1, 2, (700, 6)), "small": lambda: rng.normal(size=(5, 3)), "mixed": lambda: rng.normal(size=(700, 8)) * 10.0 ** rng.integers(-6, 4, (700, 1))}[kind]().astype(float)
    n = len(x)
    for owner in (np.arange(n), np.arange(n) // 3, np.sort(rng.integers(0, 12, n)), np.zeros(n, int)):
        counts = lambda r, c: owner[r] != owner[c]
        r, c, d = scan.nearest(scan.ranking(x, x, metric, 4, counts), n, owner, 5)
        got = {}
        for i, j, z in zip(r.tolist(), c.tolist(), d.tolist()):
            got.setdefault(i, []).append((z, int(owner[j])))
        y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if metric == "cosine" else x
        for i in range(0, n, 7):
            full = np.round(((x - x[i]) ** 2).sum(1) if metric == "l2" else 1 - np.einsum("ij,j->i", y, y[i]), 4) + 0.0
            best = {}
            for z, o in zip(full.tolist(), owner.tolist()):
                if o != owner[i]:
                    best[o] = min(z, best.get(o, np.inf))
            want = sorted((z, o) for o, z in best.items())[:5]
            mine = sorted(got.get(i, []))
            if kind in ("grid", "small", "normal"):
                assert mine == want
            else:
                # a last bit may round another way where distances are large
                assert np.allclose([z for z, _ in mine], [z for z, _ in want], rtol=1e-12, atol=2e-4)


def test_top_k_with_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (5, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = sorted(map(tuple, knn.top_k(df, df, 2).collect()))
    assert got == [(1, 2, 1.0), (1, 5, 4.0), (2, 1, 1.0), (2, 5, 5.0), (5, 1, 4.0), (5, 2, 5.0)]
    with pytest.raises(Exception, match="one length"):
        bad = spark.createDataFrame([(1, [0.0]), (2, [1.0, 0.0])], "id bigint, v array<float>")
        knn.top_k(bad, bad, 1).collect()


def test_discoveries_answer_as_one_by_one():
    rng = np.random.default_rng(2)
    for ef, p, window in ((64, 0.14, 128), (900, 0.2, 7)):
        many, one = quantile.Discoveries(40, ef, p, window), [quantile.Discovery(ef, p, window) for _ in range(40)]
        for _ in range(300):
            rows = np.flatnonzero(rng.random(40) < 0.7)
            found, looked_at = rng.integers(0, 20, len(rows)), rng.integers(0, 40, len(rows))
            assert many.done(rows, found, looked_at).tolist() == [one[r].done(int(f), int(n)) for r, f, n in zip(rows, found, looked_at)]


@pytest.mark.parametrize("filtered", [False, True])
def test_index_search_sends_k_rows_a_query_for_all_shards_of_a_task(spark, tmp_path, monkeypatch, filtered):
    monkeypatch.setattr(scan, "cores", lambda df: 1)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (900, 6)).astype(np.float32)
    df = _table(spark, x)
    path = f"file://{tmp_path}/index"
    vector_index.write(df, path, "l2", shard_rows=30)
    iv = df.toDF("id", "v")
    among = df.where("vec_id % 3 > 0").select("vec_id") if filtered else None
    # the beam is as wide as a shard, so all shards are scanned
    rows, most = _received(vector_index.search(spark, path, iv, 5, ef=100, among=among, same_set=True, block_rows=300))
    data = iv.where("id % 3 > 0") if filtered else iv
    assert sorted((r["query_id"], r["vec_id"], r["dist"]) for r in rows) == sorted(map(tuple, knn.top_k(iv, data, 5).collect()))
    assert {r["way"] for r in rows} == {"exact"} and most <= 900 * 5 * 3


def test_index_search_by_graphs_is_the_same_in_any_bundles(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    df = _table(spark, rng.normal(size=(1200, 8)).astype(np.float32))
    path = f"file://{tmp_path}/index"
    vector_index.write(df, path, "l2", shard_rows=300)
    found = []
    for n in (1, 100):
        monkeypatch.setattr(scan, "cores", lambda df, n=n: n)
        found.append(sorted(map(tuple, vector_index.search(spark, path, df.toDF("id", "v"), 12, ef=14, early=True, same_set=True, block_rows=500).collect())))
    assert found[0] == found[1] and len(found[0]) == 1200 * 12 and {r[4] for r in found[0]} == {"graph"}
