"""SentencePiece encoding and decoding with a piece table and a relational lattice.

Texts are cut where no piece can span, so what is left are short units that are
encoded alike wherever they stand. Each distinct unit gives its lattice: its
substrings of bounded length are exploded, equi-joined to the piece table, and
grouped again by unit, and a higher-order aggregate folds the edges to the path.

For a unigram model the fold is Viterbi: the best sum of scores at each position.
The public model is a BPE one, and for those Viterbi gives other ids than the
model does (for 39 % of the words of the test texts), so their fold merges: the
edge of the best score that joins two neighbouring pieces, again and again, which
is the model's own rule. Boundaries are bits of a number, so a step is a few bit
operations for each edge. Units beyond 60 characters, as of scripts without spaces,
are merged with a heap instead, from the same piece table.
"""

from __future__ import annotations

import heapq
import itertools
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from . import vocab
from .staging import stage

_SPACE = "▁"
_SLICE = 1 << 18
_BITS = 60


class Pieces:
    """The pieces of a model file: text, score and kind, and what can stand next to what within one."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models")
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation")
        self.merges = model.trainer_spec.model_type == 2
        self.dummy_prefix = n.add_dummy_prefix
        self.kinds = [p.type for p in model.pieces]
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type in (1, 4, 5)]
        self.table = {p: (i, s) for p, i, s in self.rows}
        self.unknown = self.kinds.index(2)
        #: the id of each byte, or the unknown piece where the model has no bytes
        self.bytes = [self.unknown] * 256
        self.all = [p.piece for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.longest = max(len(p) for p, _, _ in self.rows)
        pairs = {(ord(a), ord(b)) for p, _, _ in self.rows for a, b in itertools.pairwise(p)}
        chars = sorted({c for pair in pairs for c in pair})
        self.cls = np.zeros(0x110000, np.uint16)
        self.cls[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        self.joins = np.zeros(self.width * self.width, bool)
        for a, b in pairs:
            self.joins[int(self.cls[a]) * self.width + int(self.cls[b])] = True

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by best-scored merges, with a heap."""
        part = list(unit)
        after, before, alive = [*range(1, len(part)), -1], list(range(-1, len(part) - 1)), [True] * len(part)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (got := self.table.get(x := part[i] + part[j])):
                heapq.heappush(heap, (-got[1], i, j, x))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, x = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or part[i] + part[j] != x:
                continue
            part[i], alive[j] = x, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self.ids(p for p, a in zip(part, alive) if a)

    def viterbi(self, unit: str) -> list[int]:
        """Ids of one unit by the best sum of scores."""
        low = min(s for _, _, s in self.rows) - 10
        best, back = [0.0], [0]
        for e in range(1, len(unit) + 1):
            top, at = best[e - 1] + low, e - 1
            if got := self.table.get(unit[e - 1]):
                top = best[e - 1] + got[1]
            for s in range(max(0, e - self.longest), e - 1):
                if (got := self.table.get(unit[s:e])) and best[s] + got[1] > top:
                    top, at = best[s] + got[1], s
            best.append(top)
            back.append(at)
        cut, e = [], len(unit)
        while e:
            cut.append(unit[back[e] : e])
            e = back[e]
        return self.ids(reversed(cut))

    def ids(self, parts) -> list[int]:
        out = []
        for p in parts:
            got = self.table.get(p)
            out += [got[0]] if got else [self.bytes[b] for b in p.encode()]
        return out


@lru_cache(maxsize=2)
def pieces(folder: str, name: str) -> Pieces:
    """The pieces, loaded once in a process."""
    return Pieces(os.path.join(folder, name))


def _units(buf: np.ndarray, offsets: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and start, end and document of each unit."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = tk.byte_to_char(buf)[offsets]
    n = len(offsets) - 1
    some = np.diff(chars) > 0
    lead = some.astype(np.int64) if p.dummy_prefix else np.zeros(n, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.diff(chars) + lead)])
    out = np.full(int(ends[-1]), ord(_SPACE), np.uint32)
    out[np.arange(len(cps)) + np.repeat(np.cumsum(lead), np.diff(chars))] = np.where(cps == 32, ord(_SPACE), cps)
    if not len(out):
        z = np.zeros(0, np.int64)
        return out, z, z, z
    cls = p.cls[out].astype(np.int32)
    start = np.ones(len(out), bool)
    start[1:] = ~p.joins[cls[:-1] * p.width + cls[1:]]
    start[ends[:-1][some]] = True
    s = np.flatnonzero(start)
    return out, s, np.append(s[1:], len(out)), np.searchsorted(ends, s, "right") - 1


def _hashed(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return tk.hash_spans(cps.view(np.uint8), s * 4, e * 4)


def _spelled(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[str]:
    raw = cps.tobytes()
    return [raw[a * 4 : b * 4].decode("utf-32-le", "replace") for a, b in zip(s.tolist(), e.tolist())]


def _strings(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The spans as an Arrow column, as _spelled() has them."""
    raw = np.frombuffer(tk.gather(cps, s, e - s).tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
    heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at = heads[np.concatenate([[0], np.cumsum(e - s)])]
    return pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def distinct_units(docs: DataFrame, folder: str, name: str, text: str = "text") -> DataFrame:
    """h, unit, n: the distinct units of all texts, and in how many tasks each was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab.forget()
        p, seen = pieces(folder, name), np.zeros(0, np.uint64)
        for batch in batches:
            buf, offsets = tk.flat(batch.column(0))
            for a, b in tk.slices(offsets, _SLICE):
                cps, s, e, _ = _units(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p)
                h, first = np.unique(_hashed(cps, s, e), return_index=True)
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, h), len(seen) - 1)
                    new = seen[at] != h
                    h, first = h[new], first[new]
                if len(h):
                    # a shorter way round the shuffle; it may forget
                    seen = np.insert(seen, np.searchsorted(seen, h), h) if len(seen) < 2_000_000 else h
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _strings(cps, s[first], e[first])], names=["h", "unit"])

    picked = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")
    return picked.mapInArrow(lambda batches: tk.released(run(batches)), "h bigint, unit string").groupBy("h").agg(F.min("unit").alias("unit"), F.count("*").alias("n"))


def piece_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """piece, id and score of the pieces that text can match."""
    piece, at, score = zip(*pieces(folder, name).rows)
    # as Arrow it needs no Python worker, and so no second daemon in each executor
    return spark.createDataFrame(pa.table({"piece": piece, "id": pa.array(at, pa.int32()), "score": score}))


def lattice(units: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """h, unit and the edges of each unit: pieces at their places, and each single character.

    An edge is (cost, s, e, id, ends, inner): bits of its two ends, and of the
    boundaries inside. A character that is no piece has id -1.
    """
    n = F.char_length("unit")
    starts = units.select("h", "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("h", "unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("len"))
    subs = spans.withColumn("sub", F.substring(F.col("unit"), F.col("s") + 1, F.col("len")))
    # the piece table is a fixed file of some ten thousand rows
    joined = subs.join(F.broadcast(table), F.col("sub") == F.col("piece"), "left").where("id IS NOT NULL OR len = 1")
    e = F.col("s") + F.col("len")

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), x)

    edge = F.struct(
        (-F.col("score")).alias("cost"),
        F.col("s").alias("s"),
        e.alias("e"),
        F.coalesce(F.col("id"), F.lit(-1)).alias("id"),
        bit(F.col("s")).bitwiseOR(bit(e)).alias("ends"),
        (bit(e) - bit(F.col("s") + 1)).alias("inner"),
    )
    # As a window, grouping sorts once; an aggregate would hold four sorters a task, of a
    # page of memory each, as it falls back to sorting in both its halves. The first
    # character is an edge of every unit, so its row stands for the unit.
    edges = F.collect_list(edge).over(Window.partitionBy("h"))
    return joined.withColumn("edges", edges).where("s = 0 AND len = 1").select("h", "unit", F.sort_array("edges").alias("edges"))


def _merged(edges: Column, n: Column) -> Column:
    """The edges of the path by best-scored merges.

    The fold carries the boundaries that are left and the edges that can still be
    merged: those whose ends stand and that have a boundary inside.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), n + 1) - F.lit(1)
    many = F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(x["ends"].alias("ends"), x["inner"].alias("inner")))
    none = F.array().cast("array<struct<ends:bigint,inner:bigint>>")

    def named(x: Column, use: Callable[[Column], Column]) -> Column:
        """use(x), with x computed once: within a lambda, a column used twice is computed twice."""
        return F.transform(F.array(x), use)[0]

    def step(acc: Column, _: Column) -> Column:
        m, rest = acc["m"], acc["rest"]
        best = F.get(F.filter(rest, lambda x: F.bit_count(m.bitwiseAND(x["inner"])) == 1), 0)["inner"]

        def after(gone: Column) -> Column:
            def kept(left: Column) -> Column:
                open_ = F.filter(rest, lambda x: (left.bitwiseAND(x["ends"]) == x["ends"]) & (left.bitwiseAND(x["inner"]) != 0))
                return F.struct(left.alias("m"), F.when(gone == 0, none).otherwise(open_).alias("rest"))

            return named(m - m.bitwiseAND(gone), kept)

        # without an edge to merge, the rest of the steps has nothing to look at
        done = F.struct(m.alias("m"), none.alias("rest"))
        return F.when(F.size(rest) == 0, done).otherwise(named(F.coalesce(best, F.lit(0).cast("bigint")), after))

    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    bounds = F.aggregate(steps, F.struct(full.alias("m"), many.alias("rest")), step)["m"]
    return named(bounds, lambda m: F.filter(edges, lambda x: (m.bitwiseAND(x["ends"]) == x["ends"]) & (m.bitwiseAND(x["inner"]) == 0)))


def _viterbi(edges: Column, n: Column, low: float) -> Column:
    """The edges of the path with the least cost, folded over positions."""
    state = "array<struct<cost:double,path:array<struct<cost:double,s:int,e:int,id:int,ends:bigint,inner:bigint>>>>"
    first = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<struct<cost:double,s:int,e:int,id:int,ends:bigint,inner:bigint>>").alias("path"))).cast(state)

    def step(done: Column, e: Column) -> Column:
        here = F.filter(edges, lambda x: x["e"] == e)
        costs = F.transform(here, lambda x: F.struct((F.element_at(done, x["s"] + 1)["cost"] + F.coalesce(x["cost"], F.lit(-low))).alias("cost"), (-x["s"]).alias("late"), x.alias("edge")))
        best = F.array_min(costs)
        return F.concat(done, F.array(F.struct(best["cost"].alias("cost"), F.concat(F.element_at(done, best["edge"]["s"] + 1)["path"], F.array(best["edge"])).alias("path"))).cast(state))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, step), -1)["path"]


def encode_units(units: DataFrame, folder: str, name: str) -> DataFrame:
    """h, ids of each unit."""
    spark, p = units.sparkSession, pieces(folder, name)
    short = units.where(F.char_length("unit") <= _BITS)
    folded = lattice(short, piece_table(spark, folder, name), p.longest)
    n = F.char_length("unit")
    low = min(s for _, _, s in p.rows) - 10
    path = F.sort_array(F.transform(_merged(F.col("edges"), n) if p.merges else _viterbi(F.col("edges"), n, low), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    by_byte = F.array(*[F.lit(i) for i in p.bytes])

    def spelled(x: Column) -> Column:
        code = F.hex(F.encode(F.substring(F.col("unit"), x["s"] + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda i: F.element_at(by_byte, F.conv(F.substring(code, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))

    ids = F.flatten(F.transform(path, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(spelled(x))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = pieces(folder, name)
        one = q.merge if q.merges else q.viterbi
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(u) for u in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["h", "ids"])

    long = units.where(F.char_length("unit") > _BITS).select("h", "unit").mapInArrow(lambda batches: tk.released(run(batches)), "h bigint, ids array<int>")
    return folded.select("h", ids.alias("ids")).unionByName(long)


def _frequent(units: DataFrame, most: int) -> DataFrame:
    """All units if there are `most` or fewer, or else those met in as many tasks as it takes to have no more."""
    by_n = {r["n"]: r["units"] for r in units.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("units")).collect()}
    total, least = 0, 10_001
    for n in sorted(by_n, reverse=True):
        total += by_n[n]
        if total > most:
            break
        least = n
    return units.where(F.col("n") >= least)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in the least bytes that hold them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


class _Known:
    """The ids of units by hash, in flat arrays."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, codes: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.sizes = keys[by], _narrow(sizes)[by]
        self.begin = _narrow(np.cumsum(sizes) - sizes)[by]
        self.codes = _narrow(codes)

    def encode(self, cps: np.ndarray, s: np.ndarray, e: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and the number of each."""
        h, first, which = np.unique(_hashed(cps, s, e), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        missing = self.keys[at] != h if len(self.keys) else np.ones(len(h), bool)
        if not missing.any():
            size = self.sizes[at][which].astype(np.int64)
            return tk.gather(self.codes, self.begin[at][which], size).astype(np.int32), size
        one = p.merge if p.merges else p.viterbi
        made = [one(u) for u in _spelled(cps, s[first[missing]], e[first[missing]])]
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if len(self.keys):
            begin[~missing], size[~missing] = self.begin[at[~missing]], self.sizes[at[~missing]]
        known = tk.gather(self.codes, begin[~missing], size[~missing]).astype(np.int32)
        fresh = np.fromiter(itertools.chain.from_iterable(made), np.int32)
        size[missing] = np.fromiter(map(len, made), np.int64, len(made))
        begin[~missing] = np.cumsum(size[~missing]) - size[~missing]
        begin[missing] = len(known) + np.cumsum(size[missing]) - size[missing]
        return tk.gather(np.concatenate([known, fresh]), begin[which], size[which]), size[which]


def encode_pieces(docs: DataFrame, folder: str = vocab.TOKENIZERS, name: str = "piece_bpe_32k.model", text: str = "text", doc_id: str = "doc_id", most_units: int = 4_000_000, round_trip: bool = False) -> DataFrame:
    """doc_id and ids of each document, as the model itself encodes its text; with round_trip also `decodes`: whether the ids spell the text.

    The ids of distinct units are broadcast, about 40 bytes each: all up to
    most_units of them, and of more the ones met most often, which bounds what the
    driver holds. A task that meets another unit encodes it by the same rule from
    the piece table, with the same ids.

    Nulls: a null text has null ids (and null `decodes`), an empty one none; a
    null doc_id stays null. Very long texts are encoded whole. Repeated rows give a
    row each. Of merges that tie in score, the leftmost goes first. An empty table
    gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    units = _frequent(stage(distinct_units(picked, folder, name, "t"), "units"), most_units)
    parts = max(1, -(-units.count() // 10_000))
    coded = stage(encode_units(units.select("h", "unit").repartition(parts, "h"), folder, name), "unit-ids").toArrow()
    ids = coded.column("ids").combine_chunks()
    some = len(coded) > 0
    shared = spark.sparkContext.broadcast(_Known(coded.column("h").to_numpy().view(np.uint64), np.diff(ids.offsets.to_numpy()) if some else np.zeros(0, np.int64), ids.flatten().to_numpy() if some else np.zeros(0, np.int32)))
    del coded, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, known = pieces(folder, name), shared.value
        spelling = _Spelling(p) if round_trip else None
        for batch in batches:
            buf, offsets = tk.flat(batch.column(1))
            for a, b in tk.slices(offsets, _SLICE):
                part, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                cps, s, e, doc = _units(part, off, p)
                flat, size = known.encode(cps, s, e, p)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, size, b - a).astype(np.int64))])
                none = batch.column(1).slice(a, b - a).is_null()
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()), mask=none if none.true_count else None)]
                if spelling is not None:
                    columns.append(pa.array(spelling.equal(flat, ends, part, off), mask=np.asarray(none)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decodes"][: len(columns)])

    return picked.mapInArrow(lambda batches: tk.released(run(batches)), "doc_id bigint, ids array<int>" + (", decodes boolean" if round_trip else ""))


class _Spelling:
    """The bytes that each id spells."""

    def __init__(self, p: Pieces):
        spell = [b"" if k == 3 else bytes([int(x[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else x.replace(_SPACE, " ").encode() for x, k in zip(p.all, p.kinds)]
        # one more for ids beyond the vocabulary, which spell nothing
        self.size = np.array([*map(len, spell), 0])
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(spell), np.uint8)
        self.dummy_prefix = p.dummy_prefix

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of lists of ids, as bytes and offsets; a list's first space is the model's own."""
        ids = ids.astype(np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.size) - 1), len(self.size) - 1, ids)
        out = tk.gather(self.pool, self.begin[ids], self.size[ids])
        offsets = np.concatenate([[0], np.cumsum(self.size[ids])])[ends]
        if self.dummy_prefix and len(out):
            some = np.flatnonzero(np.diff(offsets) > 0)
            lead = np.zeros(len(offsets) - 1, np.int64)
            lead[some] = out[offsets[some]] == 32
            keep = np.ones(len(out), bool)
            keep[offsets[:-1][lead > 0]] = False
            out, offsets = out[keep], offsets - np.concatenate([[0], np.cumsum(lead)])
        return out, offsets

    def equal(self, ids: np.ndarray, ends: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each list of ids spells its text."""
        out, at = self.decode(ids, ends)
        same = np.diff(at) == np.diff(offsets)
        if same.all():
            wrong = np.flatnonzero(out != buf)
            same[np.searchsorted(offsets, wrong, "right") - 1] = False
            return same
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(out[at[i] : at[i + 1]], buf[offsets[i] : offsets[i + 1]])
        return same


def decode_pieces(coded: DataFrame, folder: str = vocab.TOKENIZERS, name: str = "piece_bpe_32k.model", ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with a column `text` of what their ids spell, in place of `ids`.

    Nulls: null ids give a null text, and a null id within a list spells nothing,
    nor do control pieces and ids beyond the vocabulary; an empty list gives an
    empty text. Repeated rows are decoded each; very long lists whole. An empty
    table gives an empty table. Other columns pass through; one of the name
    `text` is an error.
    """
    names = [c for c in coded.columns if c != ids]
    if text.lower() in {c.lower() for c in names}:
        raise ValueError(f"column {text} is there already")
    schema = coded.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _Spelling(pieces(folder, name))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lists = column.fill_null([]) if column.null_count else column
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            out, at = spelling.decode(lists.flatten().fill_null(-1).to_numpy(), ends)
            raw = out.tobytes()
            made = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(at.tolist())], pa.string(), mask=np.asarray(column.is_null()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), made], names=[*names, text])

    return coded.mapInArrow(lambda batches: tk.released(run(batches)), schema)
