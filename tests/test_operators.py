"""Edge cases of predicates, rows, postings, vectors and text, against plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstrata.functions import text as tx
from colstrata.functions.filters import Filter, all_of, is_degenerate, normalise, prune_values, to_column
from colstrata.operators import embed, knn, postings, quantile, rows, vector_index
from colstrata.sources import check, tables


def test_set_quantifiers_and_empty_sets(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, [2]), (4, [5, 9])], "id int, s array<bigint>")

    def ids(**k):
        return sorted(r[0] for r in df.where(to_column(Filter("s", **k), df.schema)).collect())

    assert ids(values=(2,)) == [1, 3]
    assert ids(values=(2,), quantifier="all") == [3]
    assert ids(values=(1, 2), quantifier="all") == [1, 3]
    assert ids(values=(1, 2), quantifier="all", exclude=True) == [2, 4]
    assert ids(kind="range", low=2, high=4, low_closed=False) == []
    assert ids(kind="range", low=5, quantifier="all") == [4]
    assert ids(kind="range", low=2, exclude=True) == [2]


@pytest.mark.parametrize("n", [1, 128, 129])
@pytest.mark.parametrize("exclude", [False, True])
def test_value_lists(spark, n, exclude):
    df = spark.range(300)
    got = {r[0] for r in df.where(to_column(Filter("id", values=tuple(range(0, 2 * n, 2)), exclude=exclude), df.schema)).collect()}
    want = {i for i in range(300) if (i in range(0, 2 * n, 2)) != exclude}
    assert got == want


def test_ranges(spark):
    df = spark.createDataFrame([(-2.5,), (0.0,), (1.0,), (3.5,)], "x float")
    for lo in (None, 0.0):
        for hi in (None, 1.0):
            for lc in (True, False):
                for hc in (True, False):
                    f = Filter("x", "range", low=lo, high=hi, low_closed=lc, high_closed=hc)
                    got = {r[0] for r in df.where(to_column(f, df.schema)).collect()}
                    want = {x for x in (-2.5, 0.0, 1.0, 3.5) if (lo is None or x > lo or (lc and x == lo)) and (hi is None or x < hi or (hc and x == hi))}
                    assert got == want


def test_pushdown(spark, sf):
    t = tables.table(spark, sf, "lineitem")
    q = t.where(all_of([Filter("l_suppkey", values=(1, 2)), Filter("l_quantity", "range", low=3.0)], t.schema)).select("l_orderkey")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "In(l_suppkey" in plan and "GreaterThanOrEqual(l_quantity,3.0)" in plan and "l_comment" not in plan


def test_normaliser():
    assert normalise(Filter("b", "range", low=1, high=1), T.BooleanType()).values == (True,)
    assert is_degenerate(Filter("b", values=(0, 1)), T.BooleanType())
    assert normalise(Filter("i", "range", low=-1, high=1 << 40), T.IntegerType()).low is None
    assert normalise(Filter("f", values=(1.5,)), T.FloatType()).kind == "range"
    assert prune_values(Filter("v", values=(-1, 5, 99)), 0, 10).values == (5,)
    with pytest.raises(ValueError):
        Filter("x", "like")


def test_fold_case_needs_equal_bytes(spark):
    df = spark.createDataFrame([("Click",), ("click ",), ("CLICK",)], "s string")
    assert df.where(to_column(Filter("s", values=("cLICK",), fold_case=True), df.schema)).count() == 2


def test_shards_cover_all():
    for total in (0, 1, 5, 1023, 1024, 1025):
        for n in (1, 3, 4):
            b = rows.shard_bounds(total, n)
            assert sum(1 for i in range(total) for lo, hi in b if i >= lo and (hi is None or i <= hi)) == total


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025])
def test_blocks(spark, n):
    t = spark.range(n).withColumn("v", (F.col("id") * 7 % 100).cast("double"))
    stats = rows.block_stats(t, "id", "v")
    assert stats.count() == -(-n // 1024)
    assert rows.early_reject(stats, 200, 300).first()[0] is True
    assert rows.prune(t, "v", 5, 20).count() == t.where("v BETWEEN 5 AND 20").count()
    assert rows.cutoff(t, "id", -1).count() == n and rows.cutoff(t, "id", 0).count() == 0


def test_footers(spark, tmp_path):
    path = f"file://{tmp_path}/some table"
    spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("v"), "id").repartition(3).write.parquet(path)
    found = check.footers(spark, path, "v")
    s = found.agg(F.sum("rows"), F.sum("nulls"), F.min("least"), F.max("most")).first()
    assert tuple(s) == (1000, 100, 1.0, 999.0)
    assert check.footer_reject(found, 2000, 3000).first()[0] is True and check.footer_reject(found, 5, 6).first()[0] is False
    assert check.footer_estimate(found, 0, 5000).first()["rows"] == 1000


def test_check_table(spark):
    rows_ = [(0, [1, 2], [1.0, 2.0], 1.0), (1, [2, 1], [1.0], float("nan")), (1, [3, 3], [float("nan"), 1.0], None), (-5, [None], None, 1.0), (None, None, [], 1.0)]
    df = spark.createDataFrame(rows_, "id bigint, s array<bigint>, v array<float>, x double")
    got = {(r["block"], r["attr"], r["problem"]): r["n"] for r in check.check_table(df, "id", 10, {"v": 2}).collect()}
    assert got == {(0, "s", "unsorted"): 2, (0, "v", "length"): 1, (0, "v", "not a number"): 1, (0, "x", "not a number"): 1, (0, "id", "repeated id"): 1, (-1, "id", "negative id"): 1, (-1, "s", "null element"): 1, (-1, "id", "null id"): 1, (-1, "v", "length"): 1}


def test_postings_are_stored(spark, tmp_path):
    t = spark.range(5000).select("id", (F.col("id") % 50).alias("v"))
    path = f"file://{tmp_path}/index"
    postings.write(postings.build(t, "id", "v"), path)
    p = postings.read(spark, path)
    hit = postings.rows(p, F.col("value") == 7)
    assert "EqualTo(value,7)" in hit._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in hit.collect()} == set(range(7, 5000, 50))
    counted = postings.count(p, F.col("value") < 2)
    assert "rids" not in counted._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1] and counted.first()[0] == 200
    assert postings.mismatches(p, t, "id", "v").count() == 0
    spoilt = p.withColumn("rids", F.when(F.col("value") == 3, F.slice("rids", 2, 1000)).otherwise(F.col("rids")))
    assert [tuple(r) for r in postings.mismatches(spoilt, t, "id", "v").collect()] == [(3, 3, 1)]
    with pytest.raises(ValueError):
        t.write.parquet(f"file://{tmp_path}/other")
        postings.read(spark, f"file://{tmp_path}/other")
    floats = spark.createDataFrame([(1, 1.0000001), (2, 1.0000002), (3, 2.0)], "id bigint, v double")
    assert {tuple(r) for r in postings.merged_floats(postings.build(floats, "id", "v")).collect()} == {(1.0, 2), (2.0, 1)}


def test_registry_is_stored(spark, tmp_path):
    path = f"file://{tmp_path}/enabled"
    r = postings.Registry(["a", "j['x']", "j['y']"])
    assert r.save(spark, path) and not r.save(spark, path)
    r.column_updated("none")
    assert not r.save(spark, path)
    r.column_updated("a")
    assert r.save(spark, path)
    again = postings.Registry.load(spark, path)
    assert again.enabled == {"a": False, "j['x']": True, "j['y']": True} and again.path == path
    spark.createDataFrame([(99, "a", True)], "version int, attr string, enabled boolean").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError):
        postings.Registry.load(spark, path)


def test_postings(spark):
    t = spark.createDataFrame([(0, 3, [1, 2]), (1, None, []), (2, 3, [2]), (1 << 21, 4, [7])], "id bigint, v int, s array<int>")
    p = postings.build(t, "id", "s")
    assert {r[0] for r in postings.rows(p, F.col("value") == 2).collect()} == {0, 2}
    assert postings.count(p, F.lit(True)).first()[0] == 4
    assert {r[0] for r in postings.excluded(t, "id", p, F.col("value") == 2).collect()} == {1, 1 << 21}
    assert postings.mismatches(p, t, "id", "s").count() == 0
    assert postings.mismatches(p, t.where("id > 0"), "id", "s").count() == 2
    assert postings.num_values(p, F.lit(True), range(100)).first()[0] == 100
    with pytest.raises(ValueError):
        postings.build(spark.createDataFrame([(1, [1.0])], "id int, v array<float>"), "id", "v")
    r = postings.Registry(["a", "j['x']", "j['y']"])
    assert r.resolve("a['q']") == "a"
    r.column_updated("j['x']")
    assert r.resolve("j['y']") is None and r.resolve("a") == "a"
    r.column_updated("a")
    assert r.resolve("a") is None


def test_knn_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id bigint, v array<double>")
    want = {}
    for i in range(60):
        d = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 6), j) for j in range(60) if j != i)[:5]
        want[i] = [j for _, j in d]
    for block in (7, 1000):
        got = {}
        for r in knn.top_k(df, df, 5, "l2", block_rows=block).orderBy("query_id", "dist", "vec_id").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want
    assert knn.top_k(df.limit(0), df, 5).count() == 0
    assert knn.plan(10, 1000, 10, 64) == "exact"


def test_rabitq_recall(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    got = {(r[0], r[1]) for r in knn.rabitq_top_k(e, 10).select("query_id", "vec_id").collect()}
    iv = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = {(r[0], r[1]) for r in knn.top_k(iv, iv, 10).select("query_id", "vec_id").collect()}
    assert len(got & want) / len(want) > 0.9


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_stored_graphs(spark, tmp_path, metric):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0])], "vec_id bigint, embedding array<float>")
    path = f"file://{tmp_path}/{metric}"
    vector_index.write(df, path, metric, shard_rows=300)
    asked = df.where("vec_id < 40").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    stored = df.where("vec_id < 900").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    for among in (None, df.where("vec_id % 2 = 0 AND vec_id < 900").select("vec_id"), df.where("vec_id < 20").select("vec_id")):
        got = {(r["query_id"], r["vec_id"]) for r in vector_index.search(spark, path, asked, 15, ef=60, among=among, early=True, same_set=True, block_rows=30).collect()}
        data = stored if among is None else stored.join(among.withColumnRenamed("vec_id", "id"), "id", "left_semi")
        want = {(r["query_id"], r["vec_id"]) for r in knn.top_k(asked, data, 15, metric).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    ways = {r["way"]: r["d"] for r in vector_index.search(spark, path, asked, 5, ef=20).groupBy("way").agg(F.max("distances").alias("d")).collect()}
    assert set(ways) == {"graph"} and 0 < ways["graph"] < 40 * 300
    assert vector_index.search(spark, path, asked.limit(0), 5).count() == 0
    vector_index.write(df.limit(0), path)
    assert vector_index.search(spark, path, asked, 5).count() == 0


def test_windowed_quantile_and_discovery():
    rng = np.random.default_rng(0)
    w = quantile.WindowedPSquare(0.5, 100)
    assert w.value() == 0.0
    for v in rng.normal(size=1000):
        w.add(v)
    for v in rng.normal(50, 1, size=150):
        w.add(v)
    assert 45 < w.value() < 55
    d, rounds = quantile.Discovery(100), 0
    while not d.done(max(0, 60 - rounds), 60):
        rounds += 1
    assert d.patience == 9 and rounds < 60 and quantile.Discovery(5000).patience == 6


def test_check_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None), (5, [float("nan"), 1.0])], "id int, v array<float>")
    assert {r[0]: r[1] for r in knn.check_vectors(df, "id", "v", 2).collect()} == {2: "length", 3: "empty", 4: "null", 5: "not finite"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=200, max_size=400))
def test_psquare_is_within_range(xs):
    e = quantile.PSquare(0.5)
    for x in xs:
        e.add(x)
    assert min(xs) <= e.value() <= max(xs)


def test_psquare_close():
    e = quantile.PSquare(0.9)
    for x in np.random.default_rng(0).normal(size=5000):
        e.add(float(x))
    assert abs(e.value() - 1.2816) < 0.1


def test_truncate(spark):
    texts = ["", "abc", "aé" * 10, "😀" * 5, "x" * 100, "日本語テキスト"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (1, 4, 7, 30):
        got = {r[0]: r[1] for r in df.select("t", tx.truncate_bytes(F.col("t"), limit)).collect()}
        for t in texts:
            assert got[t] == t.encode()[:limit].decode(errors="ignore"), (t, limit)


def test_dispatch():
    assert tx.dispatch("openai:new") == ("openai", "new")
    assert tx.dispatch("jina/own", "http://x") == ("jina", "own")
    assert tx.dispatch("bert") == ("local", "bert")
    with pytest.raises(ValueError):
        tx.dispatch("voyage/none")
    with pytest.raises(ValueError):
        tx.dispatch("voyage/voyage-large-2")
    assert tx.dispatch("voyage/voyage-code-2") == ("voyage", "voyage-code-2")
    assert tx.limits("voyage/voyage-law-2") == (1024, 16_000) and tx.limits("jina:new") == (None, 8192) and tx.limits("bert") == (None, None)
    assert tx.valid_key("k") and not tx.valid_key(" k") and not tx.valid_key("")


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "c"), (2, ""), (3, None)], "id int, t string")
    got = [(r[0], np.array(r[1])) for r in embed.embed_hash(df, "id", "t").collect()]
    assert sorted(i for i, _ in got) == [1, 1, 2, 3]
    assert sum(abs(np.linalg.norm(v) - 1) < 1e-5 for _, v in got) == 2 and sum(not v.any() for _, v in got) == 2
    assert {round(float(np.abs(v).max()), 4) for i, v in got if i == 1} == {0.8944, 1.0}
    other = embed.embed_with(df.where("t IS NULL OR t <> 'c'"), "id", "t", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), max_tokens=1)
    assert {r[0]: r[1] for r in other.collect()} == {1: [5.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    long = spark.createDataFrame([(1, "x" * 100)], "id int, t string")
    assert embed.embed_with(long, "id", "t", lambda: lambda texts: np.array([[len(t)] for t in texts]), max_tokens=4).first()[1] == [32.0]


def test_embed_errors_go_with_their_rows(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "fine") for i in range(6)], "id int, t string")

    def load():
        def encode(texts):
            if "bad" in texts:
                raise embed.EmbedError("http_error", 500)
            return np.ones((len(texts), 2))

        return encode

    got = {r["id"]: r["error"] for r in embed.embed_with(df, "id", "t", load, batch=1, errors=True).collect()}
    assert got == {i: "EmbedError: http_error (500)" if i == 3 else None for i in range(6)}
    with pytest.raises(Exception, match="http_error"):
        embed.embed_with(df, "id", "t", load, batch=1).collect()


def test_remote_encoder():
    asked = []

    def told(status, text):
        def transport(url, headers, body, timeout):
            asked.append((url, headers["Authorization"], body, timeout))
            return status, text

        return embed.RemoteEncoder(embed.Settings("openai/text-embedding-3-small", api_key="key", timeout=3), transport)

    ok = told(200, '{"data": [{"embedding": [1, 2]}, {"embedding": [3, 4]}]}')
    assert ok(["a", "b"]).tolist() == [[1, 2], [3, 4]] and ok.dims == 2 and ok.max_input == 8192
    assert asked[0] == ("https://api.openai.com/v1/embeddings", "Bearer key", b'{"input": ["a", "b"], "model": "text-embedding-3-small"}', 3)
    code = lambda c: '{"error": {"code": "%s"}}' % c
    for status, text, kind, kept in (
        (401, "", "invalid_key", 401), (400, code("invalid_api_key"), "invalid_key", 400), (404, "x", "unsupported_model", 404), (400, code("model_not_found"), "unsupported_model", 400),
        (429, "", "request_failed", None), (400, code("insufficient_quota"), "request_failed", None), (500, code("other"), "http_error", 500), (200, "no", "http_error", 200), (200, '{"data": []}', "http_error", 200),
    ):
        with pytest.raises(embed.EmbedError) as e:
            told(status, text)(["a"])
        assert (e.value.kind, e.value.status) == (kind, kept)
    for model, key, kind in (("voyage/voyage-large-2", "k", "unsupported_model"), ("bert", "k", "unsupported_model"), ("jina/jina-clip-v2", " k", "invalid_key")):
        with pytest.raises(embed.EmbedError) as e:
            embed.RemoteEncoder(embed.Settings(model, api_key=key))
        assert e.value.kind == kind
    made = []
    one = embed.cached(("x", 1), lambda: made.append(1) or len)
    assert embed.cached(("x", 1), lambda: made.append(1) or len) is one and made == [1]


def test_pooling():
    t = np.arange(12, dtype=float).reshape(1, 3, 4)
    assert embed.pooled(t, np.array([[1, 1, 0]])).tolist() == [[2, 3, 4, 5]]
    assert embed.pooled(t, np.array([[1, 1, 0]]), "cls").tolist() == [[0, 1, 2, 3]]


def test_stream(spark, tmp_path):
    from colstrata.streaming.ingest import append_filtered

    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(100).write.parquet(src)
    schema = spark.range(1).schema
    for _ in range(2):
        append_filtered(spark, src, out, f"file://{tmp_path}/ck", schema, [Filter("id", "range", low=90)]).awaitTermination(120)
        spark.range(95, 105).write.mode("append").parquet(src)
    assert spark.read.schema(schema).parquet(out).count() == 20


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 1])], "a bigint, s array<bigint>")
    tables.write(df, f"file://{tmp_path}/t", sort="a")
    back = tables.read(spark, f"file://{tmp_path}/t", {"a": "int64", "s": "int64set"})
    assert back.first()["s"] == [1, 3]
    with pytest.raises(ValueError):
        tables.read(spark, f"file://{tmp_path}/t", {"a": "string"})
    with pytest.raises(ValueError):
        tables.schema_of({"a": "decimal"})
    assert tables.with_row_id(back).select("row_id").first()[0] == 0
