"""Text to vectors: a deterministic encoder by feature hashing, and encoders of one's own, local or remote."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

Encoder = Callable[[list[str]], np.ndarray]


def embed_hash(table: DataFrame, key: str, text: str, dims: int = 64, limit_bytes: int | None = None) -> DataFrame:
    """key and embedding of each row: signed counts of hashed words, over their length.

    A word's hash gives its place and its sign. Rows are encoded each on its own,
    so repeated keys stay apart and nothing is shuffled. A null or empty text gives
    a zero vector.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    if limit_bytes is not None:
        source = tx.truncate_bytes(source, limit_bytes)
    hashes = F.transform(F.filter(F.split(F.lower(source), "\\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(1).value_lengths()).astype(np.int64)
            h = b.column(1).flatten().to_numpy().astype(np.int64)
            cell = np.repeat(np.arange(len(n)) * dims, n) + h % dims
            x = np.bincount(cell, np.where(h < 0, -1.0, 1.0), len(n) * dims).astype(float).reshape(-1, dims)
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
            values = pa.array(x.astype(np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dims), values)], names=[key, "embedding"])

    return table.select(key, hashes.alias("h")).mapInArrow(run, f"`{key}` {table.schema[key].dataType.simpleString()}, embedding array<float>")


def pooled(tokens: np.ndarray, mask: np.ndarray, mode: str = "mean") -> np.ndarray:
    """One vector for each text of its tokens' (texts x tokens x dims): the mean of those that the mask has, or the first."""
    if mode == "cls":
        return tokens[:, 0]
    if mode != "mean":
        raise ValueError("mode must be mean or cls")
    m = mask[:, :, None].astype(float)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


class EmbedError(Exception):
    """A failure of a given kind, with the HTTP status if there was one."""

    def __init__(self, kind: str, status: int | None = None):
        super().__init__(kind if status is None else f"{kind} ({status})")
        self.kind, self.status = kind, status

    def __reduce__(self):
        return EmbedError, (self.kind, self.status)


@dataclass(frozen=True)
class Settings:
    """What makes an encoder: any difference makes another one."""

    model: str
    cache_path: str = ""
    api_key: str = field(default="", repr=False)
    api_url: str = ""
    timeout: int = 0
    use_gpu: bool = False


#: (url, headers, body, timeout) -> (status, text)
Transport = Callable[[str, dict[str, str], bytes, int], tuple[int, str]]
URLS = {
    "openai": "https://api.openai.com/v1/embeddings",
    "voyage": "https://api.voyageai.com/v1/embeddings",
    "jina": "https://api.jina.ai/v1/embeddings",
}


def http_transport(url: str, headers: dict[str, str], body: bytes, timeout: int) -> tuple[int, str]:
    """A POST by the standard library."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout or None) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def failure(status: int, text: str) -> EmbedError:
    """The kind of a response without success, by its status and the error code in its JSON."""
    try:
        code = json.loads(text)["error"]["code"]
    except (ValueError, TypeError, KeyError):
        code = None
    if status in (401, 403) or code == "invalid_api_key":
        return EmbedError("invalid_key", status)
    if status == 404 or code == "model_not_found":
        return EmbedError("unsupported_model", status)
    if status == 429 or code in ("insufficient_quota", "rate_limit_exceeded"):
        return EmbedError("request_failed")
    return EmbedError("http_error", status)


class RemoteEncoder:
    """Vectors of a provider's model, one request for each list of texts."""

    def __init__(self, settings: Settings, transport: Transport = http_transport):
        try:
            self.provider, self.name = tx.dispatch(settings.model, settings.api_url or None)
        except ValueError:
            raise EmbedError("unsupported_model") from None
        if self.provider == "local":
            raise EmbedError("unsupported_model")
        if not tx.valid_key(settings.api_key):
            raise EmbedError("invalid_key")
        self.settings, self.transport = settings, transport
        self.dims, self.max_input = tx.limits(settings.model, settings.api_url or None)

    def __call__(self, texts: list[str]) -> np.ndarray:
        headers = {"Authorization": f"Bearer {self.settings.api_key}", "Content-Type": "application/json"}
        body = json.dumps({"input": texts, "model": self.name}).encode()
        try:
            status, text = self.transport(self.settings.api_url or URLS[self.provider], headers, body, self.settings.timeout)
        except OSError:
            raise EmbedError("request_failed") from None
        if not 200 <= status < 300:
            raise failure(status, text)
        try:
            rows = [x["embedding"] for x in json.loads(text)["data"]]
            out = np.array(rows, np.float32)
        except (ValueError, TypeError, KeyError):
            raise EmbedError("http_error", status) from None
        if out.ndim != 2 or len(out) != len(texts):
            raise EmbedError("http_error", status)
        self.dims = out.shape[1]
        return out


_ENCODERS: dict[object, Encoder] = {}
_LOCK = threading.Lock()


def cached(settings: object, load: Callable[[], Encoder]) -> Encoder:
    """The encoder of these settings, made once in a worker process."""
    with _LOCK:
        if settings not in _ENCODERS:
            _ENCODERS[settings] = load()
        return _ENCODERS[settings]


def embed_with(table: DataFrame, key: str, text: str, load: Callable[[], Encoder], batch: int = 8, settings: object = None, max_tokens: int | None = None, errors: bool = False) -> DataFrame:
    """key and embedding from an encoder; nulls are encoded as empty texts.

    load makes the encoder once in each worker for the same `settings` (which must
    hash), or once in each task without. Texts longer than any of max_tokens
    tokens are cut first. errors: a failing batch of texts gives null vectors and
    its message in a column `error`, in place of failing the job.
    """
    source = F.col(text).cast("string")
    picked = table.select(F.col(key), (tx.pre_truncate(source, max_tokens) if max_tokens else source).alias("t"))

    def vectors(encoder: Encoder, texts: Sequence[str]) -> tuple[list, list]:
        rows, failed = [], []
        for a in range(0, len(texts), batch):
            part = list(texts[a : a + batch])
            try:
                got = np.asarray(encoder(part), np.float32)
                if len(got) != len(part):
                    raise EmbedError("http_error")
                rows += got.tolist()
                failed += [None] * len(part)
            except Exception as e:  # any failure of an encoder is told with its rows
                if not errors:
                    raise
                rows += [None] * len(part)
                failed += [f"{type(e).__name__}: {e}"] * len(part)
        return rows, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load() if settings is None else cached(settings, load)
        for b in batches:
            rows, failed = vectors(encoder, [t or "" for t in b.column(1).to_pylist()])
            columns = [b.column(0), pa.array(rows, pa.list_(pa.float32())), pa.array(failed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 3 if errors else 2], names=[key, "embedding", "error"][: 3 if errors else 2])

    return picked.mapInArrow(run, f"`{key}` {table.schema[key].dataType.simpleString()}, embedding array<float>" + (", error string" if errors else ""))
