"""The data-preparation operators against brute force, on small fixtures and their edge cases."""

import io
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colstrata.llm import ann, fertility, jaccard, lm, mixing, packing, quality, spm, substring, vocab, warc
from colstrata.llm import textkernel as tk

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, _r int"
TRICKY = [
    (1, "one two three four five six", "en", "a", 27, "x", 1),
    (1, "one two three four five six", "en", "a", 27, "x", 1),
    (2, "One, two. Three four five six", "en", None, 29, None, None),
    (None, "no id here at all today", None, "b", 23, "y", 2),
    (3, None, "en", "a", None, "z", 3),
    (4, "", "xx", "c", 0, "z", 3),
    (5, " \n\t ", "de", "c", 4, "z", 3),
    (6, "日本語のテキスト 😀  x y é", "ja", "d", 20, "z", 3),
    (7, "w" * 30_000, "en", "d", 30_000, "z", 3),
    (8, "long " * 40_000, "en", "e", 200_000, "z", 3),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame(TRICKY, SCHEMA)


@pytest.fixture(scope="module")
def empty(tricky):
    return tricky.limit(0)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# -- kernels


def test_words_and_chunks():
    col = pa.array([t for _, t, *_ in TRICKY])
    buf, off = tk.flat(col)
    s, e, d = tk.words(buf, off)
    want = [(i, w) for i, (_, t, *_) in enumerate(TRICKY) for w in (t or "").encode().split()]
    assert [(int(i), buf[a:b].tobytes()) for i, a, b in zip(d, s, e)] == want
    s, e, d = tk.chunks(buf, off)
    back = defaultdict(bytes)
    for i, a, b in zip(d, s, e):
        back[int(i)] += buf[a:b].tobytes()
    assert all(back[i] == (t or "").encode() for i, (_, t, *_) in enumerate(TRICKY))
    h = tk.hash_spans(buf, s, e)
    assert len(set(h.tolist())) == len({buf[a:b].tobytes() for a, b in zip(s, e)})


# -- 1


def _nearest(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 9)
    return np.sort(d, 1)[:, k - 1]


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 16)), np.repeat(rng.normal(size=(5, 16)), 40, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(None, [1.0] * 16), (9001, None), (9002, []), (9003, [1.0]), (9004, [0.0] * 16), (9005, [float("nan")] * 16), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "e") for r in rows + bad], "vec_id bigint, embedding array<float>, rank string")
    got = ann.neighbours(df, k=10, shard_rows=400, block_rows=700).toPandas()
    assert set(got.vec_id) == set(range(len(x))) and (got.groupby("vec_id").size() == 10).all()
    kth = _nearest(x, 10)
    assert (got.distance.to_numpy() <= kth[got.vec_id] + 1e-5).mean() >= 0.9
    assert (got.vec_id != got.neighbour_id).all()
    part = ann.neighbours(df, queries=F.col("vec_id") % 100 == 0, among=F.col("vec_id") >= 1000, shard_rows=400, block_rows=7).toPandas()
    assert set(part.vec_id) == set(range(0, len(x), 100)) and part.neighbour_id.min() >= 1000
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id = 1")).count() == 0
    assert ann.neighbours(df.where("vec_id IN (1, 2)"), metric="l2").count() == 2


def test_ann_probes_few_of_many_cells(spark):
    """Recall where a query isn't searched everywhere, and how few cells that takes where vectors form groups."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = np.stack(e.orderBy("vec_id").toPandas()["embedding"].to_numpy())
    asked = F.col("vec_id") % 100 == 0
    got = ann.neighbours(e, queries=asked, shard_rows=200, cells=24).toPandas()
    kth = _nearest(x, 10)
    ids = e.orderBy("vec_id").toPandas()["vec_id"].to_numpy()
    at = np.searchsorted(ids, got.vec_id.to_numpy())
    assert set(got.vec_id) == {i for i in ids.tolist() if i % 100 == 0}
    assert (got.distance.to_numpy() <= kth[at] + 1e-5).mean() >= 0.9


    rng = np.random.default_rng(1)
    groups = (rng.normal(size=(200, 1, 64)) + rng.normal(size=(200, 30, 64)) * 0.2).reshape(-1, 64).astype(np.float32)
    assert ann.fit_probes(groups, ann.fit_centroids(groups, 64), 10, 0.98) <= 8
    assert ann.fit_probes(x, ann.fit_centroids(x, 24), 10, 0.98) <= 24


def test_ann_ties_go_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(i, [-1.0, float(i), 1.0]) for i in range(60, 90)], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in ann.neighbours(df, k=5).orderBy("vec_id", "rank").collect():
        got[r["vec_id"]].append(r["neighbour_id"])
    assert all(got[i] == [j for j in range(7) if j != i][:5] for i in range(60))


# -- 2


def _brute_lm(corpus, order, strength):
    """A plain model of texts: log_prob(text) by the smoothing's formula, and p(w | context)."""
    enc = vocab.byte_bpe(vocab.TOKENIZERS)
    kinds, count, total = enc.n_vocab + 1, Counter(), 0

    def sequence(t):
        return ["<"] * (order - 1) + enc.encode_ordinary(t) + [">"]

    for t in corpus:
        s = sequence(t)
        for i in range(order - 1, len(s)):
            total += 1
            for n in range(1, order + 1):
                count[tuple(s[i - n + 1 : i + 1])] += 1
            for n in range(1, order):
                count["of", tuple(s[i - n : i])] += 1

    def p(ctx, w):
        s = strength[len(ctx)]
        if not ctx:
            return (count[(w,)] + s / kinds) / (total + s)
        return (count[(*ctx, w)] + s * p(ctx[1:], w)) / (count["of", ctx] + s)

    def score(t):
        s = sequence(t)
        return sum(math.log(p(tuple(s[i - order + 1 : i]), s[i])) for i in range(order - 1, len(s)))

    return score, p


@pytest.mark.parametrize("order,block,shard", [(3, 6 << 20, 2_000_000), (2, 3_000, 700), (4, 20_000, 5_000)])
def test_lm_equals_brute_force(docs, tricky, order, block, shard):
    strength = (1000.0, 100.0, 20.0, 5.0)[:order]
    some = docs.where("doc_id BETWEEN 20 AND 60").select("doc_id", "text").union(tricky.where("doc_id IS NULL OR doc_id <> 8").select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    own, _ = _brute_lm([t for _, t in rows if t is not None], order, strength)
    other = docs.where("doc_id < 30")
    held, _ = _brute_lm([r["text"] for r in other.collect()], order, strength)
    for corpus, score in ((None, own), (other, held)):
        got = lm.lm_scores(some, corpus, order, strength, block_bytes=block, shard_symbols=shard).collect()
        want = [(i, None if t is None else score(t)) for i, t in rows]
        key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0)
        assert len(got) == len(want)
        for (i, x), (j, y) in zip(sorted(((r["doc_id"], r["log_prob"]) for r in got), key=key), sorted(want, key=key)):
            assert i == j and (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6 * max(1, abs(y)))


def test_lm_edges(docs, tricky, empty):
    assert lm.lm_scores(empty).count() == 0
    kinds = vocab.byte_bpe(vocab.TOKENIZERS).n_vocab + 1
    for r in lm.lm_scores(tricky.where("doc_id IS NULL OR doc_id <> 8"), empty).collect():
        assert r["log_prob"] is None and r["doc_id"] == 3 or abs(r["log_prob"] + r["n_symbols"] * math.log(kinds)) < 1e-6 * r["n_symbols"] * 20
    with pytest.raises(ValueError):
        lm.lm_scores(docs, order=5)


def test_lm_sums_to_one():
    texts = ["a b c a b d", "a b c", "", "b c a a"]
    strength = (1000.0, 100.0, 20.0)
    _, p = _brute_lm(texts, 3, strength)
    enc = vocab.byte_bpe(vocab.TOKENIZERS)
    a, b = enc.encode_ordinary("a b")
    for ctx in ((), (a,), (a, b), ("<", "<"), ("<", a), (7, 8)):
        assert sum(p(ctx, w) for w in [*range(enc.n_vocab), ">"]) == pytest.approx(1)
    ids = [enc.encode_ordinary(t) for t in texts]
    text, _ = lm.marked(np.concatenate([np.array(x, np.uint64) + np.uint64(1) for x in ids]), np.array([len(x) for x in ids]), 3)
    m = lm.Automaton(lm._grams(text, 3), int((text != lm.BEGIN).sum()), enc.n_vocab + 1, strength)
    for state in range(len(m.fail)):
        _, gain = m.step(np.full(enc.n_vocab + 1, state), np.append(np.arange(1, enc.n_vocab + 1), lm.END))
        assert np.exp(gain).sum() == pytest.approx(1)


def test_lm_tells_texts_that_occur_twice(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    t = [" ".join(words[i] for i in rng.integers(0, 3000, 80)) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(t)] + [(1000 + i, t[i]) for i in range(40)]
    got = {r["doc_id"]: r["log_prob"] / r["n_symbols"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), block_bytes=20_000, shard_symbols=9_000).collect()}
    twice = [got[i] for i in range(40)] + [got[1000 + i] for i in range(40)]
    once = sorted(got[i] for i in range(40, 400))
    assert min(twice) > once[int(0.99 * len(once))]


# -- 3


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = labels.select("doc_id", quality.rating(labels["quality"], labels["toxic"]).alias("grade"))
    known = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) > 0
    kept = quality.select_quality(docs, rated.where(known)).select("doc_id")
    held = rated.where(~known)
    both = held.join(kept.distinct().withColumn("kept", F.lit(1)), "doc_id", "left").fillna(0, ["kept"])
    rate = {r["grade"]: r["r"] for r in both.groupBy("grade").agg(F.avg("kept").alias("r")).collect()}
    print(rate)
    assert rate[2] > 0.97 and rate[1] < 0.3 and rate[0] < 0.35


def test_quality_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(8)
    score, cuts, grade = rng.normal(size=30), np.array([-0.7, 0.2, 1.1]), rng.integers(0, 4, 30)

    def loss(score, cuts):
        total = 0.0
        for s, g in zip(score, grade):
            below = lambda k: 0.0 if k < 0 else 1.0 if k > 2 else 1 / (1 + math.exp(s - cuts[k]))  # noqa: B023, E731
            total -= math.log(below(g) - below(g - 1))
        return total / len(grade)

    by_score, by_cut = quality.slopes(score, cuts, grade)
    for values, got, at in ((score, by_score, 0), (cuts, by_cut, 1)):
        for i in range(len(values)):
            up, down = values.copy(), values.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            args = [(up, cuts), (down, cuts)] if at == 0 else [(score, up), (score, down)]
            assert got[i] == pytest.approx((loss(*args[0]) - loss(*args[1])) / 2e-5, abs=1e-7)


def test_quality_scores_equal_plain_sums(spark, docs, tricky):
    bits = 10
    rng = np.random.default_rng(9)
    model = quality.Ordinal(rng.normal(size=1 << bits), np.array([-1.0, 0.5]), bits)
    some = docs.where("doc_id < 25").select("doc_id", "text").union(tricky.select("doc_id", "text").where("doc_id IN (2, 4, 5, 6, 7)").withColumn("doc_id", F.col("doc_id") + 10_000))
    mask = (1 << bits) - 1

    def buckets(t):
        raw = t.encode()
        low = tk.lower(np.frombuffer(raw, np.uint8)).tobytes() if raw else b""
        word = lambda c: not tk.SEPARATORS[c]
        mark = lambda c: bool(tk.SEPARATORS[c]) and c not in (9, 10, 11, 12, 13, 32)

        def runs(data, inside):
            out, cur = [], b""
            for c in data:
                if inside(c):
                    cur += bytes([c])
                elif cur:
                    out.append(cur)
                    cur = b""
            return out + ([cur] if cur else [])

        def hashed(x, seed):
            return int(tk.hash_spans(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), seed)[0]) & mask

        words, marks = runs(low, word), runs(raw, mark)
        ids = {hashed(x, 1) for x in words} | {hashed(x, 2) for x in marks}
        size, n = max(1, len(raw)), max(1, len(words))
        share = lambda ok: math.floor(10 * sum(map(ok, raw)) / size)
        shape = [share(lambda c: 65 <= c <= 90), share(mark), share(lambda c: 48 <= c <= 57), math.floor(10 * len(ids) / n) * 32 + math.floor(math.log2(n)), math.floor(len(raw) / n)]
        return ids | {int(tk.mix(np.array([x + ((k + 3) << 40)], np.uint64))[0]) & mask for k, x in enumerate(shape)}

    t = texts(some)
    got = quality.score_quality(some, model).collect()
    assert len(got) == len(t)
    for r in got:
        score = sum(model.weights[i] for i in buckets(t[r["doc_id"]]))
        above = [1 / (1 + math.exp(c - score)) for c in model.thresholds]
        assert r["expected_grade"] == pytest.approx(sum(above)) and r["tail_probability"] == pytest.approx(above[-1])
    a, b = quality.features(np.frombuffer(b"x " + b"#" * 40 + b"!", np.uint8), np.array([0, 43]), 18), quality.features(np.frombuffer(b"x " + b"#" * 41, np.uint8), np.array([0, 43]), 18)
    assert set(a[0]) != set(b[0])


def test_quality_edges(spark, tricky, empty):
    grades = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (6, 2), (7, 1), (None, 1), (8, None)], "doc_id bigint, grade int")
    model = quality.train(tricky, grades)
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = quality.score_quality(tricky, model).collect()
    assert len(scored) == len(TRICKY) and all((r["expected_grade"] is None) == (r["doc_id"] == 3) for r in scored)
    assert quality.select_quality(empty, grades).count() == 0
    assert quality.select_quality(tricky, grades.limit(0)).count() == 0


# -- 4


def test_suffix_array_and_backward_search():
    rng = np.random.default_rng(0)
    for trial in range(60):
        t = rng.integers(0, int(rng.choice([2, 4, 200])), int(rng.integers(1, 300))).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 5)], 5)
        b, order = t.tobytes(), substring.suffix_array(t)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        fm = substring.FMIndex(t, order)
        for _ in range(10):
            i = int(rng.integers(0, len(b)))
            p = b[i : i + int(rng.integers(1, 9))]
            lo, hi = (np.array([x]) for x in fm.whole())
            for c in p[::-1]:
                lo, hi = fm.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum(b[j : j + len(p)] == p for j in range(len(b)))


def _passages(pairs, length):
    where, words = defaultdict(list), {}
    for i, t in sorted(pairs):
        w = words[i] = (t or "").encode().split()
        for j in range(len(w) - length + 1):
            where[tuple(w[j : j + length])].append((i, j))
    out, cut = set(), {}
    for i, w in words.items():
        rep, late = np.zeros(len(w) + 1, int), np.zeros(len(w), bool)
        cur = None
        for j in range(len(w) - length + 1):
            o = where[tuple(w[j : j + length])]
            if len(o) > 1:
                if cur and j <= cur[1]:
                    cur[1] = j + length
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [j, j + length]
                if o[0] != (i, j):
                    late[j : j + length] = True
        if cur:
            out.add((i, *cur))
        cut[i] = late
        del rep
    return out, cut, words


@pytest.mark.parametrize("length,shard", [(50, 1 << 17), (12, 1 << 30)])
def test_repeats_equal_brute_force(docs, length, shard):
    some = docs.select("doc_id", "text", "n_chars", "lang")
    want, cut, words = _passages(map(tuple, some.select("doc_id", "text").collect()), length)
    got = substring.repeated_passages(some, length=length, shard_bytes=shard).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == want
    assert all(int(cut[r["doc_id"]][r["start_word"] : r["end_word"]].sum()) == r["later_words"] for r in got)
    left = {r["doc_id"]: r for r in substring.cut_repeats(some, length=length, shard_bytes=shard).collect()}
    for i, w in words.items():
        rest = [x for x, late in zip(w, cut[i]) if not late]
        if w and not rest:
            assert i not in left
        else:
            assert left[i]["text"].encode().split() == rest and left[i]["n_chars"] == len(left[i]["text"])


def test_repeats_edges(tricky, empty):
    got = substring.repeated_passages(tricky, length=6, run_words=3).collect()
    assert {r["doc_id"] for r in got} == {8}
    cut = substring.cut_repeats(tricky, length=6, run_words=3)
    assert cut.columns == tricky.columns
    rows = cut.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in TRICKY)
    assert [r["n_chars"] for r in rows if r["doc_id"] == 8][0] < 100
    assert substring.repeated_passages(empty).count() == 0 and substring.cut_repeats(empty).count() == 0


# -- 5


def test_warc_round_trip(spark, sf, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(None, "http://x\r\ny", "<p>"), (900, None, "é" * 400_000), (901, "http://z", None), (902, "", ""), (903, "u", "a\r\n\r\nb"), (903, "u", "a\r\n\r\nb")], "page_id bigint, url string, html string")
    both = pages.select("page_id", "url", "html").union(odd)
    b = warc.write_bundles(both.coalesce(1), frame_bytes=20_000, bundle_bytes=200_000)
    rows = b.collect()
    assert len(rows) > 1
    for r in rows:
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(r["data"]), read_across_frames=True).read()
        assert len(whole) == r["raw_bytes"] and len(warc.read_seek_table(r["data"])) == r["n_frames"]
    back = sorted(map(tuple, warc.read_records(b).collect()), key=str)
    want = sorted(((i, u and u.replace("\r\n", ""), h) for i, u, h in map(tuple, both.collect())), key=str)
    assert back == want
    assert warc.read_records(b, spark.createDataFrame([(903,), (900,), (5555,)], "i bigint")).count() == 3
    assert warc.locate(b).count() == both.count()
    names = [warc.parse_record(warc.read_frame(r["data"], x["frame"])[x["offset"] : x["offset"] + x["length"]])["headers"]["WARC-Record-ID"] for r in rows for x in r["index"]]
    assert len(set(names)) == len(names) == both.count()
    files = {r["bundle_id"]: r["path"] for r in warc.write_files(b, str(tmp_path / "bundles")).collect()}
    for r in rows:
        for x in r["index"][::7]:
            whole = warc.parse_record(warc.read_frame(r["data"], x["frame"])[x["offset"] : x["offset"] + x["length"]])
            assert warc.read_at(files[r["bundle_id"]], x["frame"], x["offset"], x["length"]) == whole
    assert warc.write_bundles(both.limit(0)).count() == 0


# -- 6


def test_mixing_sql_and_edges(spark, sf, docs, tricky, empty):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, mixing.mix_sources(docs, copy="copy").select("doc_id", "text", "lang", "source", "n_chars", "copy").collect()))
    assert got == sorted(c.execute(mixing.MIX_SQL).fetchall())
    out = mixing.mix_sources(tricky, weights={"a": 3.0, "c": 1.0})
    assert out.columns == tricky.columns and {r["source"] for r in out.collect()} <= {"a", "c"}
    rates = {r["source"]: r for r in mixing.source_rates(tricky).collect()}
    assert rates["c"]["tokens"] == 0 and rates["c"]["rate"] == 0 and None in rates
    joined = mixing.mix_sources(tricky, copy="k", most_sources=1).collect()
    assert sorted(map(str, joined)) == sorted(map(str, mixing.mix_sources(tricky, copy="k").collect()))
    assert mixing.mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(tricky, copy="TEXT")


# -- 7


def test_pieces_equal_the_library(docs, tricky, empty):
    sp = vocab.piece_bpe(vocab.TOKENIZERS)
    both = docs.where("doc_id BETWEEN 20 AND 60").select("doc_id", "text").union(tricky.select("doc_id", "text"))
    t = texts(both)
    for most in (10**9, 700, 0):
        rows = spm.encode_pieces(both, most_units=most, round_trip=True).collect()
        assert all(r["decodes"] is (None if t[r["doc_id"]] is None else True) for r in rows)
        assert len(rows) == both.count()
        assert all(r["ids"] == (None if t[r["doc_id"]] is None else sp.encode(t[r["doc_id"]])) for r in rows)
    back = spm.decode_pieces(spm.encode_pieces(both)).collect()
    assert all(r["text"] == t[r["doc_id"]] for r in back)
    assert spm.encode_pieces(empty).count() == 0
    assert spm.decode_pieces(spm.encode_pieces(empty)).count() == 0


def test_decoding_tells_what_differs(spark):
    p = spm.pieces(vocab.TOKENIZERS, "piece_bpe_32k.model")
    sp, spelling = vocab.piece_bpe(vocab.TOKENIZERS), spm._Spelling(p)
    told = ["", " a", "  b ", "x\ny", "abc", "é😀"]
    ids = [sp.encode(x) for x in told]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    for other, want in ((told, [True] * 6), (["", " a", "  b", "x\ny", "abd", "é😀"], [True, True, False, True, False, True]), (["", " a", "  c ", "x\ny", "abd", "é😀"], [True, True, False, True, False, True])):
        buf, off = tk.flat(pa.array(other))
        assert spelling.equal(np.concatenate([np.array(x, np.int32) for x in ids]), ends, buf, off).tolist() == want
    rows = spark.createDataFrame([(1, [1, None, 999_999]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in spm.decode_pieces(rows).collect()} == {1: "", 2: None, 3: ""}


def test_lattice_sorts_once_and_starts_no_python(spark):
    p = spm.pieces(vocab.TOKENIZERS, "piece_bpe_32k.model")
    words = ["▁thing", "o", "ththonble", "▁▁▁x", "zé", "😀a", "a😀"]
    units = spark.createDataFrame(list(enumerate(words)), "h bigint, unit string").repartition(1, "h")
    table = spm.piece_table(spark, vocab.TOKENIZERS, "piece_bpe_32k.model")
    folded = spm.lattice(units, table, p.longest)
    rows = folded.collect()
    assert sorted(r["h"] for r in rows) == list(range(len(words)))
    for r in rows:
        u = words[r["h"]]
        spans = [(s, e) for s in range(len(u)) for e in range(s + 1, len(u) + 1) if e == s + 1 or u[s:e] in p.table]
        assert r["unit"] == u
        assert sorted((x["s"], x["e"], x["id"]) for x in r["edges"]) == sorted((s, e, p.table.get(u[s:e], (-1,))[0]) for s, e in spans)
    # an aggregate of lists falls back to sorting in both halves, with two sorters in each
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    # rows from Python lists run in workers of a second daemon, which stay in the executor
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()


def test_encoders_are_given_back():
    vocab.piece_bpe(vocab.TOKENIZERS)
    vocab.byte_bpe(vocab.TOKENIZERS)
    vocab.forget()
    assert vocab.piece_bpe.cache_info().currsize == vocab.byte_bpe.cache_info().currsize == 0


def test_known_ids_are_small():
    sizes, codes = np.array([2, 1, 3]), np.array([7, 40_000, 5, 1, 2, 3], np.int32)
    known = spm._Known(np.array([9, 3, 5], np.uint64), sizes, codes)
    assert known.keys.tolist() == [3, 5, 9] and known.sizes.tolist() == [1, 3, 2] and known.begin.tolist() == [2, 3, 0]
    assert known.sizes.itemsize == known.begin.itemsize == 1 and known.codes.itemsize == 2 and known.codes.tolist() == codes.tolist()


def test_viterbi_fold(spark):
    p = spm.pieces(vocab.TOKENIZERS, "piece_bpe_32k.model")
    words = ["▁thing", "theand", "o", "ththonble", "▁▁▁x", "zé"]
    units = spark.createDataFrame(list(enumerate(words)), "h bigint, unit string")
    low = min(s for _, _, s in p.rows) - 10
    folded = spm.lattice(units, spm.piece_table(spark, vocab.TOKENIZERS, "piece_bpe_32k.model"), p.longest)
    path = folded.select("unit", F.transform(spm._viterbi(F.col("edges"), F.char_length("unit"), low), lambda x: x["id"]).alias("ids"))
    for r in path.collect():
        want = p.viterbi(r["unit"])
        assert sum(p.rows[0][2] * 0 + dict((i, s) for _, i, s in p.rows)[i] for i in r["ids"]) == pytest.approx(sum(dict((i, s) for _, i, s in p.rows)[i] for i in want))


# -- 8


def _sets(pairs, n):
    out = {}
    for i, t in pairs:
        buf, off = tk.flat(pa.array([t]))
        low = tk.lower(buf)
        s, e, _ = tk.words(low, off, tk.SEPARATORS)
        w = [low[a:b].tobytes() for a, b in zip(s, e)]
        if w:
            k = min(n, len(w))
            out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def _brute(sets, t=0.5):
    """Similar pairs of documents by their sets, and the least document of each one's class."""
    want, root = {}, {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= t:
                want[a, b] = j
                ra, rb = top(a), top(b)
                root[max(ra, rb)] = min(ra, rb)
    return want, {k: top(k) for k in keys}


def _links(want):
    n = Counter()
    for a, b in want:
        n[a] += 1
        n[b] += 1
    return n


def test_jaccard_equals_brute_force(docs):
    sets = _sets(map(tuple, docs.select("doc_id", "text").collect()), 3)
    want, root = _brute(sets)
    links = _links(want)
    for blocks, few in ((1024, 400_000), (3, 0)):
        got = jaccard.near_classes(docs, block_rows=blocks, broadcast_rows=few).collect()
        assert sorted(map(tuple, got)) == sorted((i, root[i], n) for i, n in links.items())
    pairs = {(r["doc_id"], r["near_id"]): r["jaccard"] for r in jaccard.jaccard_pairs(docs, block_rows=3).collect()}
    assert pairs and all(abs(want[k] - j) < 1e-12 for k, j in pairs.items())
    _, again = _brute({k: {k} for k in sets}, 2)
    for a, b in sorted(pairs):
        again = {k: min(again[a], again[b]) if r in (again[a], again[b]) else r for k, r in again.items()}
    assert again == root


def test_jaccard_of_a_large_cluster(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(1000)]
    for i in range(1000, 1200):
        w = list(base)
        for k in rng.integers(0, 60, int(rng.integers(1, 6))):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"y{i}_{k}" for k in range(40))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = _sets(rows, 3)
    # copies of one set are one node of so many documents
    few = {i: s for i, s in sets.items() if i == 0 or i >= 1000}
    want, root = _brute(few)
    links = Counter({0: 999})
    for a, b in want:
        links[a] += 1000 if b == 0 else 1
        links[b] += 1000 if a == 0 else 1
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_classes(df, block_rows=64).collect()}
    assert set(got) == set(range(1000)) | (set(links) - {0})
    for i, (c, n) in got.items():
        k = 0 if i < 1000 else i
        assert (c, n) == (root[k], links[k]), i
    assert jaccard.drop_near_duplicates(df).count() == len({root[k] for k in few})


def test_overlaps_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 900, int(n)).astype(np.uint64)) for n in rng.integers(1, 400, 80)]
    at, grams = np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.concatenate(sets)
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(80), np.arange(80)))
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert jaccard._sparse_overlap(grams, at, a, b).tolist() == want
    assert jaccard._Ranked(grams, np.diff(at)).overlaps(a, b).tolist() == want


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 5000, int(n)).astype(np.uint64)) for n in rng.integers(1, 900, 60)]
    grams, ends = np.concatenate(a), np.concatenate([[0], np.cumsum([len(x) for x in a])])
    data, at = jaccard._bitmaps(grams, ends)
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(60), np.arange(60)))
    bound = jaccard._bound(data, at, np.diff(ends), i, j)
    assert all(b >= len(np.intersect1d(a[x], a[y])) for b, x, y in zip(bound, i, j))


def test_jaccard_edges(tricky, empty):
    assert sorted(map(tuple, jaccard.near_classes(tricky).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert list(map(tuple, jaccard.jaccard_pairs(tricky).collect())) == [(1, 2, 1.0)]
    kept = jaccard.drop_near_duplicates(tricky)
    assert kept.columns == tricky.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in TRICKY if r[0] != 2)
    for f in (jaccard.near_classes, jaccard.jaccard_pairs, jaccard.drop_near_duplicates):
        assert f(empty).count() == 0


def test_rows_of_a_key_past_two_gib_stay():
    big = pa.array([bytes(1_200_000_000)], pa.binary())
    held = [pa.record_batch([pa.array([7]), pa.array([i]), big], names=["tile", "doc_id", "data"]) for i in range(2)]
    got = list(jaccard._grouped(iter(held), 0))
    assert [b.column(1).to_pylist() for b in got] == [[0, 1]]
    _, at = jaccard._bytes_of(got[0].column(2))
    assert at.tolist() == [0, 1_200_000_000, 2_400_000_000]


def test_near_duplicates_go_by_id_and_text(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (7, a + " more"), (7, b), (8, c), (8, c + " more"), (9, ""), (9, ""), (None, c), (None, c), (10, None), (10, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()))
    of_8 = {t: n for (i, t), n in got.items() if i == 8}
    assert len(of_8) == 1 and set(of_8.values()) == {1}
    assert {k: n for k, n in got.items() if k[0] != 8} == {(5, a): 1, (7, b): 1, (9, ""): 1, (None, c): 2, (10, None): 2}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a bigint, b bigint")
    got = dict(map(tuple, jaccard.components(edges, "a", "b").collect()))
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


# -- 9


def test_figures(docs):
    rows = docs.where("doc_id < 40").select("text").collect()
    t = [r[0] for r in rows] + ["", None, "a   b c", "😀 日本語"]
    f = fertility.figures(pa.array(t), vocab.TOKENIZERS)
    enc, sp = vocab.byte_bpe(vocab.TOKENIZERS), vocab.piece_bpe(vocab.TOKENIZERS)
    for i, x in enumerate(t):
        ids = enc.encode_ordinary(x or "")
        assert f["n_tokens"][i] == len(ids)
        if ids:
            assert f["chars_per_token"][i] == pytest.approx(len(x) / len(ids))
        if len(ids) > 1:
            c = np.array(list(Counter(ids).values())) / len(ids)
            assert f["token_evenness"][i] == pytest.approx(-(c * np.log2(c)).sum() / np.log2(len(ids)))
        codes = [p for w in (x or "").encode().split() for p in sp.encode(w.decode())]
        assert f["fallback_share"][i] == pytest.approx(sum(sp.is_byte(p) for p in codes) / max(1, len(codes)))


def test_fertility_keeps_clean_documents(spark, tricky, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = fertility.fertility_rules(docs).select("doc_id").distinct().withColumn("kept", F.lit(1))
    rate = {r["quality"]: r["r"] for r in labels.join(kept, "doc_id", "left").fillna(0, ["kept"]).groupBy("quality").agg(F.avg("kept").alias("r")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.8
    out = fertility.fertility_rules(tricky)
    assert out.columns == tricky.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in TRICKY if r[0] not in (3, 4, 5))
    assert fertility.fertility_rules(empty).count() == 0


def test_fertility_judges_sparse_lengths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 400")
    junk = spark.createDataFrame([(-1, "qzx" * 40_000, "en"), (-2, "qzx" * 40_000, None), (-3, "\u2603" * 30_000, "new")], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in fertility.fertility_rules(docs.union(junk)).select("doc_id").collect()}
    assert len(kept) > 300 and not kept & {-1, -2, -3}


def _decisions(rows, least, width=3.0, floors=(0.04, 0.01, 0.015)):
    """The rows kept, from plain quartiles: (text, lang) in, positions out."""
    f = fertility.figures(pa.array([t for t, _ in rows], pa.string()), vocab.TOKENIZERS)
    figs = [tuple(float(f[k][i]) for k in fertility.FIGURES) for i in range(len(rows))]
    groups = [([f"lang:{g}"] if g is not None else []) + [f"script:{f['script'][i]}", "all"] for i, (_, g) in enumerate(rows)]
    cls = [max(1, int(x)).bit_length() for x in f["n_tokens"]]
    seen, held = set(), defaultdict(list)
    for i in range(len(rows)):
        key = (int(f["n_tokens"][i]), tuple(groups[i]), figs[i])
        if f["n_tokens"][i] and key not in seen:
            seen.add(key)
            for g in groups[i]:
                held[g, cls[i]].append(figs[i])
                held[g, 0].append(figs[i])
    band = {}
    for k, v in held.items():
        if len(v) >= least:
            band[k] = [tuple(sorted(x[j] for x in v)[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75)) for j in range(3)]
    kept = []
    for i in range(len(rows)):
        if not f["n_tokens"][i] or not f["words"][i]:
            continue
        options = [((abs(c - cls[i]) if c else 1 << 20), p, c) for p, g in enumerate(groups[i]) for c in range(65) if (g, c) in band]
        ok = True
        if options:
            _, p, c = min(options)
            longer = max(0, c - cls[i]) if c else 0
            for j, (lo, hi) in enumerate(band[groups[i][p], c]):
                half = max(hi - lo, floors[j]) * width * 2 ** (longer / 2)
                ok &= figs[i][j] >= lo - half and (figs[i][j] <= hi + half or (j == 2 and longer > 0))
        if ok:
            kept.append(i)
    return kept


@pytest.mark.parametrize("least,broadcast", [(20, 50_000), (6, 0), (10_000, 50_000)])
def test_fertility_decisions_equal_brute_force(spark, docs, least, broadcast):
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    rows += [("qzx" * 40_000, "en"), ("a b c", None), ("", "en"), ("  ", "de"), (None, None), ("日本語のテキスト", "ja"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "k int, text string, lang string")
    got = fertility.fertility_rules(df, least=least, broadcast_rows=broadcast)
    assert sorted(r["k"] for r in got.select("k").collect()) == _decisions(rows, least)


def test_fertility_keeps_clashing_columns(docs):
    odd = docs.withColumns({f"_f_{k}": F.lit(i) for i, k in enumerate((*fertility._COLUMNS, *fertility._LIMITS, "of", "band_cls"))})
    out = fertility.fertility_rules(odd)
    assert out.columns == odd.columns and out.count() == fertility.fertility_rules(docs).count()


# -- 10


def test_best_fit_is_tight():
    rng = np.random.default_rng(2)
    for _ in range(50):
        most = int(rng.integers(1, 70))
        n = rng.integers(1, most + 1, int(rng.integers(0, 80)))
        row, rows = packing.best_fit(n, most)
        want, room = [], []
        for i in np.argsort(-n, kind="stable"):
            fit = [r for r in room if r >= n[i]]
            if fit:
                room[room.index(min(fit))] -= n[i]
            else:
                room.append(most - n[i])
        used = np.bincount(row, n, rows) if rows else np.zeros(0)
        assert rows == len(room) and sorted(most - used) == sorted(room)
        del want


def test_packing_round_trip(docs, tricky, empty):
    enc = vocab.byte_bpe(vocab.TOKENIZERS)
    both = docs.where("doc_id BETWEEN 20 AND 60").select("doc_id", "text").union(tricky.where("doc_id IS NULL OR doc_id <> 1").select("doc_id", "text"))
    packs = packing.pack_tokens(both, length=256, group_bytes=1 << 16)
    got, rows = defaultdict(list), packs.collect()
    for r in rows:
        cu, n = r["cu_seqlens"], r["n_tokens"]
        assert cu[0] == 0 and cu[-1] == n and len(r["input_ids"]) == len(r["position_ids"]) == 256 and len(cu) == len(r["doc_ids"]) + 1
        assert set(r["input_ids"][n:]) <= {50256} and set(r["position_ids"][n:]) <= {0}
        for k, (i, o) in enumerate(zip(r["doc_ids"], r["doc_offsets"])):
            got[i].append((o, r["input_ids"][cu[k] : cu[k + 1]]))
            assert r["position_ids"][cu[k] : cu[k + 1]] == list(range(cu[k + 1] - cu[k]))
    for i, t in texts(both).items():
        assert sum((x for _, x in sorted(got[i])), []) == enc.encode_ordinary(t or "") + [50256]
    by_id = {r["pack_id"]: r for r in rows}
    assert len(by_id) == len(rows)
    for r in packing.to_binary(packs).collect():
        want = by_id[r["pack_id"]]
        for a, b in (("ids", "input_ids"), ("cu_seqlens", "cu_seqlens"), ("positions", "position_ids")):
            assert np.frombuffer(r[a], "<i4").tolist() == want[b]
    assert packing.pack_tokens(empty).count() == 0 and packing.to_binary(packing.pack_tokens(empty)).count() == 0


def test_repeated_rows_have_packs_of_their_own(spark):
    rows = spark.createDataFrame([(None, "a b c")] * 40, "doc_id bigint, text string").repartition(3)
    ids = [r["pack_id"] for r in packing.pack_tokens(rows, length=5, group_bytes=10).collect()]
    assert len(set(ids)) == len(ids) > 10


# -- the pipeline


def _mixed(rows, seed=7):
    """The rows with their copies, by plain sums: (doc_id, text, source) in and out."""
    import hashlib

    tokens = Counter()
    n = lambda t: len([x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x])
    for _, t, g in rows:
        tokens[g] += n(t)
    raw = {g: math.sqrt(x) for g, x in tokens.items()}
    out = []
    for i, t, g in rows:
        rate = round(raw[g] / sum(raw.values()) * sum(tokens.values()) / tokens[g], 6) if tokens[g] else 0
        key = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{key}/{seed}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, t, g)] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def _cut(rows, length=50):
    """The rows without passages that stand earlier, by plain windows."""
    import re

    _, late, _ = _passages([(i, t) for i, t, _ in rows], length)
    out = []
    for i, t, g in rows:
        pieces = list(re.finditer(rb"[^\t-\r ]+[\t-\r ]*", t.encode()))
        if not late[i].any():
            out.append((i, t, g))
        elif not late[i].all():
            lead = t.encode()[: pieces[0].start()]
            out.append((i, (lead + b"".join(m.group() for m, x in zip(pieces, late[i]) if not x)).decode(), g))
    return out


def test_pipeline_equals_brute_force_by_stage(spark, sf):
    """Multisets of each stage's rows, each against plain Python on what the stage was given."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    first = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    want = [first[i][:3] for i in _decisions([(t, g) for _, t, _, g in first], 50)]
    kept = p.quality_rules(spark, docs, sf)
    assert Counter(rows(kept)) == Counter(want)
    _, root = _brute(_sets([(i, t) for i, t, _ in want], 3))
    want = [x for x in want if root.get(x[0], x[0]) == x[0]]
    left = p.near_duplicates(spark, kept, sf)
    assert Counter(rows(left)) == Counter(want)
    want = _cut(want)
    cut = p.substring_dedup(spark, left, sf)
    assert Counter(rows(cut)) == Counter(want)
    want = _mixed(want)
    mixed = p.mix(spark, cut, sf)
    assert Counter(rows(mixed)) == Counter(want)
    sp = vocab.piece_bpe(vocab.TOKENIZERS)
    whole = Counter((r["doc_id"], tuple(r["ids"])) for r in p.run(spark, sf).collect())
    assert whole == Counter((i, tuple(sp.encode(t))) for i, t, _ in want)


CLASHING = ("_d", "_h", "_cut", "_gone", "_rate", "_rate_source", "_copies", "_x0", "_x1", "_x2", "_f_n_tokens", "_f_lang", "sid", "h", "kept", "cell", "node", "component", "t", "d", "k", "rep", "_c", "copy", "doc", "n", "size")


def test_stages_take_any_column_and_empty_tables(spark, tricky, empty):
    import corpus_pipeline as p

    for docs in (tricky, empty):
        df = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING) if c not in docs.columns})
        plain = docs
        for _, f in p.STAGES[:-1]:
            df, plain = f(spark, df, ""), f(spark, plain, "")
            assert df.columns[: len(docs.columns)] == docs.columns and set(CLASHING) <= set(df.columns)
            key = lambda r: (r["doc_id"], r["text"], r["source"])
            assert Counter(map(key, df.collect())) == Counter(map(key, plain.collect()))
        assert p.STAGES[-1][1](spark, df, "").count() == df.count()


def test_joined_paths_take_any_column(spark, tricky):
    df = tricky.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING) if c not in tricky.columns})
    key = lambda r: tuple(r)
    for few, many in (
        (substring.cut_repeats(df, length=6, run_words=3), substring.cut_repeats(df, length=6, run_words=3, broadcast_rows=-1)),
        (jaccard.drop_near_duplicates(df, once=True), jaccard.drop_near_duplicates(df, once=True, broadcast_rows=-1)),
        (mixing.mix_sources(df), mixing.mix_sources(df, most_sources=1)),
    ):
        assert Counter(map(key, few.collect())) == Counter(map(key, many.collect()))


def test_no_folder_of_one_machine_on_a_cluster():
    from colstrata.llm.staging import shared_folder

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf(conf)

    assert shared_folder(Session(**{"spark.checkpoint.dir": "x", "spark.master": "yarn"})) == "x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(ValueError):
            shared_folder(Session(**{"spark.master": master}))
    assert shared_folder(Session(**{"spark.master": "local[2]"})).startswith("file://")
