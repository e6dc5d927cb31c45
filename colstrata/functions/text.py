"""Helpers of the text embedding surface."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters of at most `limit` bytes."""
    raw = F.encode(text, "UTF-8")
    # a byte 10xxxxxx goes on with a character, so the cut goes back to one that doesn't
    back = F.coalesce(*[F.when(~F.hex(F.substring(raw, limit + 1 - k, 1)).rlike("^[89AB]"), F.lit(k)) for k in range(min(4, limit + 1))], F.lit(0))
    cut = F.call_function("substring", raw, F.lit(1), F.lit(limit) - back)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(cut, "UTF-8"))


def config_sizes(config: Column) -> tuple[Column, Column]:
    """Hidden size and longest input of a model's JSON configuration."""
    get = lambda *keys: F.coalesce(*[F.get_json_object(config, f"$.{k}") for k in keys]).cast("bigint")
    longest = F.coalesce(get("max_position_embeddings", "n_positions"), F.when(F.get_json_object(config, "$.model_type") == "t5", F.lit(512)))
    return get("hidden_size", "d_model"), longest


#: A token has no more than so many bytes in any vocabulary that matters.
BYTES_PER_TOKEN = 8


def pre_truncate(text: Column, max_tokens: int) -> Column:
    """The text cut, at a whole character, where it must have more than max_tokens tokens already."""
    return truncate_bytes(text, max_tokens * BYTES_PER_TOKEN)


def truncate_tokens(ids: Column, max_tokens: int) -> Column:
    """The first max_tokens of a list of token ids."""
    return F.slice(ids, 1, max_tokens)


@dataclass(frozen=True)
class Model:
    """A remote model: its provider, the length of its vectors and of its longest input in tokens."""

    provider: str
    name: str
    dims: int
    max_input: int = 8192


def _models() -> dict[tuple[str, str], Model]:
    sizes = {
        "openai": {"text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072},
        "voyage": dict.fromkeys(("voyage-3-large", "voyage-3.5", "voyage-3.5-lite", "voyage-code-3", "voyage-finance-2", "voyage-law-2"), 1024) | {"voyage-code-2": 1536},
        "jina": {"jina-embeddings-v4": 2048, "jina-clip-v2": 1024, "jina-embeddings-v3": 1024, "jina-clip-v1": 768, "jina-colbert-v2": 128, "jina-colbert-v1-en": 128}
        | {f"jina-embeddings-v2-base-{x}": 768 for x in ("en", "es", "de", "zh", "code")},
    }
    longer = {"jina-embeddings-v4": 32_000, "voyage-law-2": 16_000, "voyage-code-2": 16_000}

    def most(provider: str, name: str) -> int:
        return longer.get(name, 32_000 if provider == "voyage" else 8192)

    return {(p, n): Model(p, n, d, most(p, n)) for p, of in sizes.items() for n, d in of.items()}


MODELS = _models()
PROVIDERS = ("openai", "voyage", "jina")


def dispatch(model_id: str, api_url: str | None = None) -> tuple[str, str]:
    """Provider and model name of an id.

    `provider:name` passes any name on; `provider/name` must be a known model
    unless a URL of one's own is given; all else is a local model.
    """
    for p in PROVIDERS:
        for mark in ":/":
            if model_id.startswith(p + mark):
                name = model_id[len(p) + 1 :]
                if not name:
                    raise ValueError("empty model name")
                if mark == "/" and not api_url and (p, name) not in MODELS:
                    raise ValueError(f"unknown model of {p}: {name}")
                return p, name
    return "local", model_id


def limits(model_id: str, api_url: str | None = None) -> tuple[int | None, int | None]:
    """Length of vectors and longest input of a model; a remote one that isn't known takes 8,192 tokens."""
    provider, name = dispatch(model_id, api_url)
    known = MODELS.get((provider, name))
    return (None, None) if provider == "local" else (known.dims, known.max_input) if known else (None, 8192)


def valid_key(key: str) -> bool:
    """Whether a key is there and without outer white space."""
    return bool(key) and key == key.strip()
