"""Public vocabularies, and whole-batch encoding that looks at each distinct piece once.

The folder of the vocabulary files is a parameter of every operator; on a cluster
it is a path that each worker can read.
"""

from __future__ import annotations

import base64
import itertools
import os
from functools import lru_cache

import numpy as np

from . import textkernel as tk

TOKENIZERS = "/opt/tokenizers"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@lru_cache(maxsize=4)
def byte_bpe(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level BPE encoding, loaded once in a worker."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def piece_bpe(folder: str, name: str = "piece_bpe_32k.model"):
    """A SentencePiece processor, loaded once in a worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))


@lru_cache(maxsize=2)
def _byte_pieces(folder: str, name: str) -> frozenset[int]:
    """The ids of the pieces that are single bytes."""
    sp = piece_bpe(folder, name)
    return frozenset(i for i in range(sp.get_piece_size()) if sp.is_byte(i))


def _wide_space(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that may hold white space beyond ASCII, where pieces can depend on each other."""
    n = len(offsets) - 1
    if len(buf) < 2:
        return np.zeros(n, bool)
    a, b = buf[:-1], buf[1:]
    hit = (a == 0xC2) & ((b == 0xA0) | (b == 0x85))
    hit |= (a == 0xE1) & (b == 0x9A)
    hit |= (a == 0xE2) & ((b == 0x80) | (b == 0x81))
    hit |= (a == 0xE3) & (b == 0x80)
    # FS, GS, RS and US count as white space for the pattern, not for the pieces
    hit |= (a >= 28) & (a <= 31) | (b >= 28) & (b <= 31)
    marks = np.zeros(n, bool)
    at = np.flatnonzero(hit)
    if len(at):
        marks[np.searchsorted(offsets, at, "right") - 1] = True
        marks[np.minimum(np.searchsorted(offsets, at + 1, "right") - 1, n - 1)] = True
    return marks


class PieceMemo:
    """Codes of pieces by hash, kept by a worker from one batch to the next.

    A speed-up alone: it is emptied when it has grown past `most` pieces.
    """

    def __init__(self, most: int = 500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        known = np.zeros(len(keys), bool)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return at, known

    def codes(self, keys: np.ndarray, encode) -> np.ndarray:
        """Rows of the memo for distinct sorted `keys`; encode(positions) gives lists for those not known."""
        if len(self.keys) > self.most:
            self.clear()
        _, known = self.find(keys)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            coded = encode(fresh)
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(size.sum()))
            begin = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, flat])
            where = np.searchsorted(self.keys, keys[fresh])
            self.keys = np.insert(self.keys, where, keys[fresh])
            self.begin = np.insert(self.begin, where, begin)
            self.size = np.insert(self.size, where, size)
        return self.find(keys)[0]


@lru_cache(maxsize=4)
def _memo(folder: str, name: str) -> PieceMemo:
    return PieceMemo()


def forget() -> None:
    """Give back what the memos and encoders of this worker hold, before work that has no use for them."""
    for kept in (_memo, byte_bpe, piece_bpe, _byte_pieces):
        kept.cache_clear()


def encode_bpe(buf: np.ndarray, offsets: np.ndarray, folder: str, name: str = "byte_bpe_50k.tiktoken") -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all documents, one after the other, and n + 1 offsets into them.

    The pre-tokenising pattern always splits between a word and the white space
    after it, so a document's ids are those of its pieces put together, and each
    distinct piece is encoded once. Documents with white space outside ASCII are
    encoded whole.
    """
    enc = byte_bpe(folder, name)
    n = len(offsets) - 1
    s, e, doc = tk.chunks(buf, offsets)
    if not len(s):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    keys, first, which = np.unique(tk.hash_spans(buf, s, e), return_index=True, return_inverse=True)
    memo = _memo(folder, name)
    row = memo.codes(keys, lambda i: [enc.encode_ordinary(x) for x in tk.strings(buf, s[first[i]], e[first[i]])])[which]
    size = memo.size[row]
    ids = tk.gather(memo.pool, memo.begin[row], size)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, size, n).astype(np.int64))])
    wide = np.flatnonzero(_wide_space(buf, offsets))
    if not len(wide):
        return ids, ends
    parts = np.split(ids, ends[1:-1])
    raw = buf.tobytes()
    for i in wide.tolist():
        parts[i] = np.array(enc.encode_ordinary(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")), np.int32)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.concatenate(parts).astype(np.int32), ends


def piece_counts(buf: np.ndarray, offsets: np.ndarray, folder: str, name: str = "piece_bpe_32k.model") -> tuple[np.ndarray, np.ndarray]:
    """Pieces and byte-fallback pieces of each document, word by word."""
    sp = piece_bpe(folder, name)
    n = len(offsets) - 1
    s, e, doc = tk.words(buf, offsets)
    if not len(s):
        return np.zeros(n), np.zeros(n)
    keys, first, which = np.unique(tk.hash_spans(buf, s, e), return_index=True, return_inverse=True)
    byte_ids = _byte_pieces(folder, name)

    def encode(i):
        return [(len(c), sum(t in byte_ids for t in c)) for c in sp.encode(tk.strings(buf, s[first[i]], e[first[i]]), num_threads=1)]

    memo = _memo(folder, name)
    row = memo.codes(keys, encode)[which]
    at = memo.begin[row]
    return np.bincount(doc, memo.pool[at], n), np.bincount(doc, memo.pool[at + 1], n)
