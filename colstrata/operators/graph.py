"""A hierarchical navigable small-world graph in flat arrays.

Each layer holds a random share of the layer below, and is built from the top one
down. Neighbours lie in arrays of fixed width. A search keeps a beam for each of
many queries and moves all beams at once, so distances are batched products.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .quantile import Discoveries

_NONE = np.int32(-1)
_BEAM_BYTES = 24 << 20


class Layer:
    """Nodes of one layer (positions in the shard) and their neighbours by place in the layer."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


def _distances(vectors: np.ndarray, norms: np.ndarray, at: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances without the queries' own part, for rows of candidates."""
    return norms[at] - 2 * np.matmul(vectors[at], queries[:, :, None])[:, :, 0]


def beam_search(
    vectors: np.ndarray, norms: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, fan: int = 4, stop: Callable[[int], Discoveries] | None = None, stats: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest places found for each query, with distances; -1 and infinity beyond.

    stop: makes what tells when each of so many queries has found enough. stats: gets the number of
    distances that were computed.
    """
    n, width = links.shape
    step = max(1, _BEAM_BYTES // max(n * 3, fan * width * vectors.shape[1] * 4))
    if len(queries) > step:
        parts = [beam_search(vectors, norms, links, queries[a : a + step], entry[a : a + step], ef, fan, stop, stats) for a in range(0, len(queries), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    m = len(queries)
    out_i, out_d = np.full((m, ef), -1, np.int64), np.full((m, ef), np.inf, np.float32)
    place, dist = out_i.copy(), out_d.copy()
    place[:, 0] = entry
    dist[:, 0] = _distances(vectors, norms, entry[:, None], queries)[:, 0]
    open_ = np.zeros((m, ef), bool)
    open_[:, 0] = True
    seen, stamp = np.zeros((m, n), bool), np.zeros((m, n), np.int16)
    seen[np.arange(m), entry] = True
    live, q = np.arange(m), queries
    teller = stop(m) if stop is not None else None
    while len(live):
        # the nearest open places come first, as the beam is sorted
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :fan]
        at = np.where(np.take_along_axis(open_, pick, 1), np.take_along_axis(place, pick, 1), -1)
        np.put_along_axis(open_, pick, False, 1)
        new = np.where(at[:, :, None] >= 0, links[at], _NONE).reshape(len(live), -1).astype(np.int64)
        ok = new >= 0
        safe = np.where(ok, new, 0)
        ok &= ~seen[live[:, None], safe]
        order = np.broadcast_to(np.arange(new.shape[1], dtype=np.int16), new.shape)
        r, c = np.nonzero(ok)
        stamp[live[r], new[r, c]] = order[r, c]
        keep = stamp[live[r], new[r, c]] == order[r, c]
        ok[r[~keep], c[~keep]] = False
        seen[live[r], new[r, c]] = True
        d = np.where(ok, _distances(vectors, norms, safe, q), np.inf)
        if stats is not None:
            stats["distances"] = stats.get("distances", 0) + int(ok.sum())
        full, looked_at = np.isfinite(dist[:, -1]), ok.sum(1)
        all_d = np.concatenate([dist, d], 1)
        best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_d, best, 1), axis=1, kind="stable"), 1)
        dist = np.take_along_axis(all_d, best, 1)
        place = np.take_along_axis(np.concatenate([place, np.where(ok, new, -1)], 1), best, 1)
        open_ = np.take_along_axis(np.concatenate([open_, ok], 1), best, 1)
        if teller is not None and full.any():
            r = np.flatnonzero(full)
            open_[r[teller.done(live[r], (best[r] >= ef).sum(1), looked_at[r])]] = False
        going = open_.any(1)
        if not going.all():
            done = live[~going]
            out_i[done], out_d[done] = place[~going], dist[~going]
            live, place, dist, open_, q = live[going], place[going], dist[going], open_[going], q[going]
    return out_i, out_d


def _select(vectors: np.ndarray, cand: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Up to width neighbours of each row: first those nearer to the row than to one taken, then the nearest of the rest."""
    m, k = cand.shape
    out = np.full((m, width), -1, np.int32)
    for a in range(0, m, 128):
        c, d = cand[a : a + 128], dist[a : a + 128]
        ok = c >= 0
        x = vectors[np.where(ok, c, 0)]
        own = (x * x).sum(2)
        pair = own[:, :, None] + own[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        taken = np.zeros(c.shape, bool)
        size = np.zeros(len(c), np.int64)
        for j in range(k):
            good = ok[:, j] & (size < width)
            if j:
                good &= ~((pair[:, j, :j] <= d[:, j, None]) & taken[:, :j]).any(1)
            taken[:, j] = good
            size += good
        rank = np.where(ok, np.where(taken, 0, k) + np.arange(k), 3 * k)
        order = np.argsort(rank, axis=1, kind="stable")[:, :width]
        got = np.take_along_axis(np.where(ok, c, -1), order, 1)
        out[a : a + 128, : got.shape[1]] = got
    return out


def nearest(vectors: np.ndarray, norms: np.ndarray, end: int, first: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest others among the first `end` vectors, and squared distances, of those from `first` on, in order."""
    near = min(ef, end - 1)
    place, dist = np.full((end - first, ef), -1, np.int64), np.full((end - first, ef), np.inf, np.float32)
    if near < 1:
        return place, dist
    for a in range(first, end, 256):
        b = min(end, a + 256)
        d = norms[None, :end] - 2 * (vectors[a:b] @ vectors[:end].T)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        i = np.argpartition(d, near - 1, axis=1)[:, :near]
        d = np.take_along_axis(d, i, 1)
        order = np.argsort(d, axis=1, kind="stable")
        place[a - first : b - first, :near] = np.take_along_axis(i, order, 1)
        dist[a - first : b - first, :near] = np.take_along_axis(d, order, 1) + norms[a:b, None]
    return place, dist


def build_layer(vectors: np.ndarray, width: int, ef: int) -> np.ndarray:
    """The neighbours of all nodes, inserted in order, as many at a time as stand already.

    A node's candidates are its nearest among those that stand and those inserted
    with it, so early nodes get the long links.
    """
    n = len(vectors)
    norms = (vectors * vectors).sum(1)
    links = np.full((n, width), -1, np.int32)
    at = 0
    while at < n:
        size = min(n - at, max(256, at))
        new = np.arange(at, at + size)
        links[new] = _select(vectors, *nearest(vectors, norms, at + size, at, ef), width)
        # links back, with the lists of those that get one chosen anew
        to = links[new].astype(np.int64)
        source = np.repeat(new, width)[to.reshape(-1) >= 0]
        target = to.reshape(-1)[to.reshape(-1) >= 0]
        nodes, which = np.unique(target, return_inverse=True)
        old = links[nodes].astype(np.int64)
        x = np.concatenate([np.repeat(np.arange(len(nodes)), width), which])
        y = np.concatenate([old.reshape(-1), source])
        x, y = x[y >= 0], y[y >= 0]
        key = np.unique(x * n + y)
        x, y = key // n, key % n
        d = np.empty(len(x), np.float32)
        for p in range(0, len(x), 200_000):
            u = vectors[nodes[x[p : p + 200_000]]] - vectors[y[p : p + 200_000]]
            d[p : p + 200_000] = (u * u).sum(1)
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        count = np.bincount(x, minlength=len(nodes))
        rank = np.arange(len(x)) - (np.cumsum(count) - count)[x]
        most = 2 * width
        inside = rank < most
        cand, dist = np.full((len(nodes), most), -1, np.int64), np.full((len(nodes), most), np.inf, np.float32)
        cand[x[inside], rank[inside]], dist[x[inside], rank[inside]] = y[inside], d[inside]
        links[nodes] = _select(vectors, cand, dist, width)
        at += size
    return links


def build_graph(vectors: np.ndarray, m: int = 16, ef: int = 96, seed: int = 1) -> list[Layer]:
    """Layers from the top one down; the last holds every node, with 2 m neighbours."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(m)).astype(int)
    layers: list[Layer] = []
    for k in range(int(level.max()) if n else -1, -1, -1):
        nodes = np.flatnonzero(level >= k)
        # nodes of the layer above come first, so that they stand early
        nodes = nodes[np.argsort(-level[nodes], kind="stable")]
        layers.append(Layer(nodes, build_layer(vectors[nodes], 2 * m if k == 0 else m, ef)))
    return layers


def descend(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int) -> np.ndarray:
    """The nearest node found in the last of the layers, from the top down."""
    node = np.full(len(queries), layers[0].nodes[0])
    for layer in layers:
        x = vectors[layer.nodes]
        where = np.zeros(len(vectors), np.int64)
        where[layer.nodes] = np.arange(len(layer.nodes))
        i, _ = beam_search(x, (x * x).sum(1), layer.links, queries, where[node], max(ef, 4), 1)
        node = layer.nodes[i[:, 0]]
    return node


def search_graph(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, ef: int, stop: Callable[[int], Discoveries] | None = None, stats: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes found for each query and their squared distances; -1 and infinity beyond."""
    base = layers[-1]
    x = vectors[base.nodes]
    where = np.empty(len(vectors), np.int64)
    where[base.nodes] = np.arange(len(vectors))
    node = descend(vectors, layers[:-1], queries, 1) if len(layers) > 1 else np.full(len(queries), base.nodes[0])
    i, d = beam_search(x, (x * x).sum(1), base.links, queries, where[node], ef, stop=stop, stats=stats)
    d = d + (queries * queries).sum(1)[:, None]
    return np.where(i >= 0, base.nodes[i], -1), np.maximum(d, 0)
