"""Language-model scores from a weighted backoff automaton over the tokens of a public vocabulary.

The model is an n-gram model of all documents with hierarchical Dirichlet
smoothing: p(w | h) = (c(h w) + s p(w | h')) / (c(h) + s), where h' is h without its
first token, s a strength for each order, and below the unigrams all tokens are
alike. Its counts are additive, so they are gathered by shards of the n-grams'
hashes, evenly whatever the text; what is gathered grows with the corpus.

Texts are encoded once, in blocks of some megabytes, and written as ids. Each block
sends each shard its own n-grams with their counts, and gets back how often the
corpus has them; so no task and not the driver holds the model, and a block gets the
part of it that its texts can reach. That part becomes the block's automaton: a
state for each context, an arc for each n-gram, and a failure arc to the context
without its first token, whose weight is log(s / (c(h) + s)). The texts of a block
are read left to right once, thousands of them in step, each carrying its state and
its sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import vocab
from .jaccard import _binary, _bytes_of, _grouped
from .staging import stage

#: Symbols are token ids plus 1. One stands before a text, and one after it.
BEGIN, END = 0xFFFF, 0xFFFE
_LANE = 1024
SCORED, COUNTED = 1, 2
BLOCK_SCHEMA = "block bigint, role int, n_symbols bigint, docs binary, unnamed binary, sizes binary, symbols binary"
SCORE_SCHEMA = "doc_id bigint, n_symbols bigint, log_prob double, perplexity double"


def _blocks(docs: DataFrame, role: int, folder: str, vocabulary: str, block_bytes: int) -> DataFrame:
    """One row for each block of documents: their ids, numbers of tokens (-1 for a null text) and symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            buf, offsets = tk.flat(batch.column(1))
            none = np.asarray(batch.column(1).is_null())
            unnamed = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for a, b in tk.slices(offsets, block_bytes):
                got, ends = vocab.encode_bpe(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], folder, vocabulary)
                sizes = np.where(none[a:b], -1, np.diff(ends)).astype(np.int32)
                one = lambda x: _binary(x, np.array([0, x.nbytes]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(role << 60) + (part << 32) + at]), pa.array([role], pa.int32()), pa.array([int((sizes[sizes >= 0] + 1).sum())])]
                    + [one(ids[a:b].astype(np.int64)), one(unnamed[a:b].astype(np.uint8)), one(sizes), one(_squeezed(_planes(got + 1, 2)))],
                    names=["block", "role", "n_symbols", "docs", "unnamed", "sizes", "symbols"],
                )
                at += 1

    return docs.mapInArrow(lambda batches: tk.released(run(batches)), BLOCK_SCHEMA)


def marked(symbols: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with order - 1 markers before and one after each, and their offsets."""
    ends = np.concatenate([[0], np.cumsum(sizes + order)])
    out = np.full(int(ends[-1]), BEGIN, np.uint64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)) * order + order - 1, sizes)] = symbols
    out[ends[1:] - 1] = END
    return out, ends


def _grams(text: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams that end at predicted symbols, by n from 1, with their counts.

    An n-gram is a number with 16 bits for each symbol, so shorter ones are less.
    The contexts before a text, of markers alone, count once for each text.
    """
    place = np.flatnonzero(text != BEGIN)
    texts = int((text == END).sum())
    out, key = [], np.zeros(len(place), np.uint64)
    for n in range(1, order + 1):
        key = key | text[place - (n - 1)] << np.uint64(16 * (n - 1))
        keys, counts = np.unique(key, return_counts=True)
        if n < order and texts:
            start = np.uint64((1 << 16 * n) - 1)
            where = int(np.searchsorted(keys, start))
            keys, counts = np.insert(keys, where, start), np.insert(counts, where, texts)
        out.append((keys, counts))
    return out


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The numbers' low bytes, all first ones before all second ones, which packs well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def _from_planes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


def _squeezed(x: np.ndarray) -> np.ndarray:
    """The bytes as a Zstandard frame."""
    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes()), np.uint8)


def _loosened(raw: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


def _width(most: int) -> int:
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)


def _sharded(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by shard, and shards + 1 offsets."""
    shard = (tk.mix(keys) % np.uint64(shards)).astype(np.uint16 if shards < 65_536 else np.int64)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _asked(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """shard, block, role, keys and counts: a block's n-grams for each shard."""
    schema = "shard int, block bigint, role int, keys binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, symbols = _of(batch, "sizes", i, np.int32), _symbols(batch, i)
                grams = _grams(marked(symbols, sizes[sizes >= 0], order)[0], order)
                keys, counts = (np.concatenate([g[k] for g in grams]) for k in (0, 1))
                by, ends = _sharded(keys, shards)
                keys, counts = keys[by], counts[by]
                some = np.flatnonzero(np.diff(ends))
                packed, packed_n = [], []
                for k in some.tolist():
                    x, n = keys[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
                    packed.append(_squeezed(_planes(np.diff(x, prepend=np.uint64(0)), 2 * order)))
                    packed_n.append(_squeezed(_planes(n, _width(int(n.max())))))
                if len(some):
                    first = [pa.array(some.astype(np.int32)), *(pa.array([batch.column(batch.schema.get_field_index(c))[i].as_py()] * len(some), kind) for c, kind in (("block", pa.int64()), ("role", pa.int32())))]
                    both = [_binary(np.concatenate(x), np.concatenate([[0], np.cumsum([len(y) for y in x])])) for x in (packed, packed_n)]
                    yield pa.RecordBatch.from_arrays([*first, *both], names=["shard", "block", "role", "keys", "counts"])

    return blocks.mapInArrow(lambda batches: tk.released(run(batches)), schema)


def _of(batch: pa.RecordBatch | pa.Table, name: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_py(), kind)


def _symbols(batch: pa.RecordBatch | pa.Table, row: int) -> np.ndarray:
    return _from_planes(_loosened(batch.column("symbols")[row].as_py()), 2)


def _told(asked: DataFrame, order: int) -> DataFrame:
    """block, shard and told: how often the corpus has each n-gram that a block asked of a shard for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 0):
            shard = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
            for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
                one = batch.slice(p, q - p)
                role = one.column(2).to_numpy()
                raw, at = _bytes_of(one.column(3))
                raw_n, at_n = _bytes_of(one.column(4))
                keys, counts = [], []
                for i in range(q - p):
                    x = np.cumsum(_from_planes(_loosened(raw[at[i] : at[i + 1]].data), 2 * order), dtype=np.uint64)
                    keys.append(x)
                    n = _loosened(raw_n[at_n[i] : at_n[i + 1]].data)
                    n = _from_planes(n, len(n) // len(x))
                    counts.append(n if role[i] & COUNTED else np.zeros_like(n))
                size = np.array([len(x) for x in keys])
                keys, counts = np.concatenate(keys), np.concatenate(counts)
                by = np.argsort(keys, kind="stable")
                head = np.concatenate([[True], keys[by][1:] != keys[by][:-1]])
                total = np.add.reduceat(counts[by], np.flatnonzero(head))
                told = np.empty(len(keys), np.uint64)
                told[by] = total[np.cumsum(head) - 1]
                ends = np.concatenate([[0], np.cumsum(size)])
                some = np.flatnonzero(role & SCORED)
                packed = [_squeezed(_planes(t := told[ends[i] : ends[i + 1]], _width(int(t.max())))) for i in some.tolist()]
                if len(some):
                    data = _binary(np.concatenate(packed), np.concatenate([[0], np.cumsum([len(x) for x in packed])]))
                    picked = one.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([picked.column(1), picked.column(0), data], names=["block", "shard", "told"])

    rows = asked.repartition("shard").sortWithinPartitions("shard", "block")
    return rows.mapInArrow(lambda batches: tk.released(run(batches)), "block bigint, shard int, told binary")


class Automaton:
    """States and arcs in flat arrays, with an open-addressed table of arcs.

    levels: for n from 1, the sorted n-grams and how often the corpus has them;
    with every n-gram, all that end it and all that begin it must be there.
    """

    def __init__(self, levels: Sequence[tuple[np.ndarray, np.ndarray]], total: int, kinds: int, strength: Sequence[float]):
        order = len(levels)
        self.order = order
        self.unknown = float(np.log(strength[0] / kinds / (total + strength[0])))
        # states: the root, then the contexts that the corpus has
        state, at, backoff, fail = [], 1, [np.array([np.log(strength[0] / (total + strength[0]))])], [np.zeros(1, np.int64)]
        prob, source, symbol, logp, nxt = [], [], [], [], []
        for n in range(1, order + 1):
            keys, count = levels[n - 1]
            count = count.astype(float)
            tail = np.searchsorted(levels[n - 2][0], keys & np.uint64((1 << 16 * (n - 1)) - 1)) if n > 1 else None
            if n == 1:
                p = (count + strength[0] / kinds) / (total + strength[0])
                of = np.zeros(len(keys), np.int64)
            else:
                head = np.searchsorted(levels[n - 2][0], keys >> np.uint64(16))
                # markers are never predicted, so n-grams that end in one have no context
                head = np.minimum(head, len(levels[n - 2][0]) - 1)
                before = levels[n - 2][1][head].astype(float)
                p = (count + strength[n - 1] * prob[-1][np.minimum(tail, len(prob[-1]) - 1)]) / (before + strength[n - 1])
                of = state[-1][head]
            prob.append(p)
            last = keys & np.uint64(0xFFFF)
            if n < order:
                own = np.where((count > 0) & (last != END), np.cumsum((count > 0) & (last != END)) - 1 + at, 0)
                there = np.flatnonzero(own)
                at += len(there)
                backoff.append(np.log(strength[n] / (count[there] + strength[n])))
                fail.append(state[-1][tail[there]] if n > 1 else np.zeros(len(there), np.int64))
                state.append(own)
                to = own
            else:
                to = state[-1][tail] if n > 1 else np.zeros(len(keys), np.int64)
            arcs = np.flatnonzero((count > 0) & (last != BEGIN))
            source.append(of[arcs])
            symbol.append(last[arcs].astype(np.int64))
            logp.append(np.log(p[arcs]))
            nxt.append(to[arcs])
        self.backoff, self.fail = np.concatenate(backoff), np.concatenate(fail).astype(np.int32)
        self.start = 0
        for n in range(1, order):
            keys = levels[n - 1][0]
            i = int(np.searchsorted(keys, np.uint64((1 << 16 * n) - 1)))
            if i < len(keys) and keys[i] == (1 << 16 * n) - 1 and state[n - 1][i]:
                self.start = int(state[n - 1][i])
        self._fill(np.concatenate(source) << 16 | np.concatenate(symbol), np.concatenate(logp), np.concatenate(nxt))

    def _fill(self, key: np.ndarray, logp: np.ndarray, nxt: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(max(1, len(key)) * 1.7))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.key = np.full(1 << bits, -1, np.int64)
        self.logp = np.zeros(1 << bits)
        self.next = np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            # of several for one free slot the last written stays, and the others go on
            free = self.key[slot] < 0
            self.key[slot[free]] = key[todo[free]]
            put = self.key[slot] == key[todo]
            self.logp[slot[put]] = logp[todo[put]]
            self.next[slot[put]] = nxt[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (tk.mix(key.astype(np.uint64)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the log-probabilities of the symbols."""
        key = state << 16 | symbol
        slot = self._slot(key)
        seen = self.key[slot]
        to, gain = self.next[slot].astype(np.int64), self.logp[slot]
        todo = np.flatnonzero(seen != key)
        if not len(todo):
            return to, gain
        gain[todo] = 0
        at, s, k, c = state[todo], slot[todo], key[todo], symbol[todo]
        while len(todo):
            seen = self.key[s]
            hit, gone = seen == k, seen < 0
            if hit.any():
                to[todo[hit]] = self.next[s[hit]]
                gain[todo[hit]] += self.logp[s[hit]]
            if gone.any():
                last = gone & (at == 0)
                to[todo[last]] = 0
                gain[todo[last]] += self.unknown
                up = gone & ~last
                gain[todo[up]] += self.backoff[at[up]]
                hit |= last
                at = np.where(gone, self.fail[at], at)
            s = np.where(gone, 0, (s + 1) & self.mask)
            keep = ~hit
            todo, at, c, s, gone = todo[keep], at[keep], c[keep], s[keep], gone[keep]
            k = at << 16 | c
            s = np.where(gone, self._slot(k), s)
        return to, gain

    def score(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log-probability of each marked text.

        Long texts are read by several lanes: a state depends on the last
        order - 1 symbols alone, which a lane reads first without counting them.
        """
        n, lead = len(ends) - 1, self.order - 1
        size = np.diff(ends) - lead
        lanes = -(-size // _LANE)
        doc = np.repeat(np.arange(n), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = ends[:-1][doc] + lead + nth * _LANE
        length = np.minimum(size[doc] - nth * _LANE, _LANE)
        by = np.argsort(-length, kind="stable")
        doc, begin, length, nth = doc[by], begin[by], length[by], nth[by]
        symbols = text.astype(np.int64)
        state = np.full(len(doc), self.start, np.int64)
        mid = np.flatnonzero(nth > 0)
        state[mid] = 0
        for i in range(lead):
            state[mid], _ = self.step(state[mid], symbols[begin[mid] - lead + i])
        total = np.zeros(len(doc))
        live = np.searchsorted(-length, -np.arange(1, int(length.max()) + 1 if len(length) else 1), "right")
        for i, m in enumerate(live.tolist()):
            state[:m], gain = self.step(state[:m], symbols[begin[:m] + i])
            total[:m] += gain
        return np.bincount(doc, total, n)


def lm_scores(
    docs: DataFrame,
    corpus: DataFrame | None = None,
    order: int = 3,
    strength: Sequence[float] = (1000.0, 100.0, 20.0),
    folder: str = vocab.TOKENIZERS,
    vocabulary: str = "byte_bpe_50k.tiktoken",
    block_bytes: int = 6 << 20,
    shard_symbols: int = 2_000_000,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_symbols, log_prob and perplexity (per symbol) of each document.

    The model is that of `corpus` (with the same columns), or of these documents
    themselves. n_symbols are the text's tokens and its end. strength: the weight of
    the lower order against an order's own counts, by order from 1.

    Nulls: a null text has null scores and counts for nothing; an empty one is
    scored for its end alone; a null doc_id stays null. Very long texts are read
    whole. Repeated rows score alike, each on its own, and each counts. Ties need no
    rule. An empty table gives no row, and an empty corpus the same probability to
    every token. Other columns are not read.
    """
    if not 2 <= order <= 4 or len(strength) < order or min(strength) <= 0:
        raise ValueError("order must be from 2 to 4, with a strength above 0 for each")
    spark = docs.sparkSession
    kinds = vocab.byte_bpe(folder, vocabulary).n_vocab + 1
    if kinds + 1 >= END:
        raise ValueError("the vocabulary must have fewer than 65,533 tokens")

    def picked(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))

    made = _blocks(picked(docs), SCORED if corpus is not None else SCORED | COUNTED, folder, vocabulary, block_bytes)
    if corpus is not None:
        made = made.unionByName(_blocks(picked(corpus), COUNTED, folder, vocabulary, block_bytes))
    blocks = stage(made, "blocks")
    every = blocks.agg(F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("role").bitwiseAND(COUNTED) > 0, F.col("n_symbols"))), F.lit(0)).alias("counted")).first()
    total, shards = int(every["counted"]), max(1, -(-int(every["n"]) // shard_symbols))
    told = _told(_asked(blocks, order, shards), order)
    scored = blocks.where(F.col("role").bitwiseAND(SCORED) > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("doc_id", pa.int64()), ("n_symbols", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])
        if not right.num_rows:
            return out.empty_table()
        sizes, ids, unnamed = _of(right, "sizes", 0, np.int32), _of(right, "docs", 0, np.int64), _of(right, "unnamed", 0, np.uint8) > 0
        there = sizes >= 0
        body, ends = marked(_symbols(right, 0), sizes[there], order)
        value = np.zeros(len(sizes))
        if there.any():
            grams = [k for k, _ in _grams(body, order)]
            keys = np.concatenate(grams)
            by, at = _sharded(keys, shards)
            count = np.zeros(len(keys), np.uint64)
            for shard, raw in zip(left.column("shard").to_pylist(), left.column("told")):
                raw = _loosened(raw.as_py())
                a, b = at[shard], at[shard + 1]
                count[by[a:b]] = _from_planes(raw, len(raw) // int(b - a))
            split = np.cumsum([len(g) for g in grams])[:-1]
            value[there] = Automaton(list(zip(grams, np.split(count, split))), total, kinds, strength).score(body, ends)
        size = np.where(there, sizes + 1, 1)
        columns = [pa.array(ids, mask=unnamed), pa.array(size.astype(np.int64), mask=~there), pa.array(value, mask=~there), pa.array(np.exp(-value / size), mask=~there)]
        tk._release()
        return pa.table(columns, schema=out)

    return told.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(score, SCORE_SCHEMA)
