"""Quality rules from tokeniser fertility.

Three figures of each document under public vocabularies, none of them trained here:

* characters per token under a byte-level BPE,
* share of byte-fallback pieces under a SentencePiece model, taken word by word,
* entropy of the token distribution in bits per token, over its most possible
  value for that many tokens (the evenness of the distribution).

Bands are Tukey fences around the quartiles of a language's documents of about
the same length (a power of two of tokens), taken over all documents, copies
counted once; a language without enough such documents, or none given, is judged
by its dominant script, and that by all. A length without enough documents in any
of these is judged by the nearest length that has them, and if none has, by the
documents of all lengths. Where texts of c times the tokens are the nearest, the
ranges are sqrt(c) times as wide, as means over fewer tokens scatter, and evenness,
which nears 1 in short texts, has no upper fence. So a text with a token goes unjudged only in a table of
fewer than `least` distinct documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from . import vocab
from .staging import rows_of, stage

FIGURES = ("chars_per_token", "fallback_share", "token_evenness")
_COLUMNS = (*FIGURES, "n_tokens", "words", "script")
_BATCH = 1 << 19


def _script(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The dominant script of each document, from the lead bytes of its code points."""
    n = len(offsets) - 1
    cls = np.zeros(256, np.int64)
    cls[65:91] = cls[97:123] = 1
    cls[0xC3:0xCE] = 1
    cls[0xCE:0xD0] = 2
    cls[0xD0:0xD5] = 3
    cls[0xD5:0xDC] = 4
    cls[0xE0:0xE2] = 5
    cls[0xE3:0xEE] = 6
    doc = np.repeat(np.arange(n), np.diff(offsets))
    votes = np.bincount(doc * 7 + cls[buf], minlength=7 * n).reshape(n, 7)
    votes[:, 0] = 0
    names = np.array(["none", "latin", "greek", "cyrillic", "semitic", "indic", "east_asian"])
    return names[np.where(votes.sum(1) > 0, votes.argmax(1), 0)]


def _evenness(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(ends) - 1
    size = np.diff(ends)
    out = np.ones(n)
    if not len(ids):
        return out
    key = np.repeat(np.arange(n, dtype=np.int64) << 32, size) | ids
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key))).astype(float)
    spread = np.bincount(key[edge] >> 32, count * np.log2(count), n)
    some = size > 1
    out[some] = 1 - spread[some] / (size[some] * np.log2(size[some]))
    return out


def figures(text: pa.Array, folder: str) -> dict[str, np.ndarray]:
    """The figures of each text, with its tokens and its script."""
    buf, offsets = tk.flat(text)
    found: list[dict[str, np.ndarray]] = []
    for a, b in tk.slices(offsets, _BATCH):
        part, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ids, ends = vocab.encode_bpe(part, off, folder)
        pieces, fallback = vocab.piece_counts(part, off, folder)
        tokens = np.diff(ends)
        found.append(
            {
                "chars_per_token": tk.char_counts(part, off) / np.maximum(tokens, 1),
                "fallback_share": fallback / np.maximum(pieces, 1),
                "token_evenness": _evenness(ids, ends),
                "n_tokens": tokens,
                "words": np.bincount(tk.words(part, off)[2], minlength=b - a),
                "script": _script(part, off),
            }
        )
    empty = dict.fromkeys(FIGURES, np.zeros(0)) | {"n_tokens": np.zeros(0, np.int64), "words": np.zeros(0, np.int64), "script": np.zeros(0, "U1")}
    return {k: np.concatenate([f[k] for f in found]) if found else empty[k] for k in _COLUMNS}


def _prefixed(df: DataFrame, names: tuple[str, ...]) -> str:
    """A prefix that makes the names free in a DataFrame."""
    prefix = "_f"
    taken = {c.lower() for c in df.columns}
    while any(f"{prefix}_{x}".lower() in taken for x in names):
        prefix += "_"
    return prefix


def measure(docs: DataFrame, folder: str = vocab.TOKENIZERS, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with their figures in columns `<prefix>_<figure>`, and the prefix."""
    names = _COLUMNS
    prefix = _prefixed(docs, (*names, *_LIMITS))
    kinds = {k: "double" for k in FIGURES} | {"n_tokens": "long", "words": "long", "script": "string"}
    schema = docs.schema
    for k in names:
        schema = type(schema)(list(schema.fields)).add(f"{prefix}_{k}", kinds[k])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = figures(batch.column(at), folder)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f[k].tolist() if k == "script" else f[k]) for k in names)], names=[*batch.schema.names, *(f"{prefix}_{k}" for k in names)])

    return docs.mapInArrow(lambda batches: tk.released(run(batches)), schema), prefix


#: The length class that holds the documents of all lengths.
_ANY = 0
_LIMITS = ("cls", "longer", "lang", "of_script", *(f"{side}_{k}" for k in FIGURES for side in ("low", "high")))


def _class(n_tokens: Column) -> Column:
    """The power of two of a number of tokens, from 1 up."""
    return F.length(F.bin(F.greatest(n_tokens, F.lit(1)))).cast("int")


def _groups(lang: Column, script: Column) -> list[Column]:
    """A document's groups, the one to be judged by first."""
    return [F.concat(F.lit("lang:"), lang), F.concat(F.lit("script:"), script), F.lit("all")]


def bands(measured: DataFrame, prefix: str, lang: str = "lang", least: int = 50) -> DataFrame:
    """of, band_cls and the quartiles low_<figure> and high_<figure>: by language, by script and of all, within each length class and whatever the length.

    Documents with the same figures, as copies are, count once. Groups of fewer
    than `least` get no band.
    """
    fig = [F.col(f"{prefix}_{k}").alias(k) for k in FIGURES]
    n = F.col(f"{prefix}_n_tokens")
    names = _groups(F.col(f"`{lang}`").cast("string"), F.col(f"{prefix}_script"))
    keys = [F.struct(k.alias("of"), c.alias("band_cls")) for k in names for c in (_class(n), F.lit(_ANY))]
    once = measured.where(n > 0).select(n.alias("n"), F.array(*keys).alias("bands"), *fig).distinct()
    found = once.select(F.explode("bands").alias("band"), *FIGURES).select("band.*", *FIGURES).where(F.col("of").isNotNull())
    quartiles = [F.percentile_approx(k, [0.25, 0.75], 1000).alias(k) for k in FIGURES]
    some = found.groupBy("of", "band_cls").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= least)
    return some.select("of", "band_cls", *[F.col(k)[i].alias(f"{side}_{k}") for k in FIGURES for i, side in enumerate(("low", "high"))])


def _limits(measured: DataFrame, found: DataFrame, prefix: str, lang: str) -> DataFrame:
    """For each language, script and length class the band of the nearest length class that has one, by language before script before all; and by how many classes that is longer."""
    kinds = measured.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"{prefix}_script").alias("script"), _class(F.col(f"{prefix}_n_tokens")).alias("cls")).distinct()
    each = kinds.select("*", F.posexplode(F.array(*_groups(F.col("lang"), F.col("script")))).alias("place", "of")).join(found, "of")
    # of two lengths as near, the shorter; all lengths together come last
    away = F.when(F.col("band_cls") == _ANY, F.lit(1 << 20)).otherwise(F.abs(F.col("band_cls") - F.col("cls")))
    own = [f"{side}_{k}" for k in FIGURES for side in ("low", "high")]
    best = F.min_by(F.struct("band_cls", *own), F.struct(away.alias("away"), "place", "band_cls"))
    picked = each.groupBy("lang", "script", "cls").agg(best.alias("b"))
    longer = F.when(F.col("b.band_cls") == _ANY, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("b.band_cls") - F.col("cls")))
    return picked.select("lang", F.col("script").alias("of_script"), "cls", longer.alias("longer"), *[F.col(f"b.{x}").alias(x) for x in own])


def fertility_rules(docs: DataFrame, folder: str = vocab.TOKENIZERS, text: str = "text", lang: str = "lang", width: float = 3.0, least: int = 50, floors: tuple[float, float, float] = (0.04, 0.01, 0.015), broadcast_rows: int = 50_000) -> DataFrame:
    """The documents whose figures lie within `width` interquartile ranges of their band's quartiles.

    The texts are measured once and written with their figures; quartiles come from
    the figures, and the decision is a filter of what was written. `floors` are
    the least ranges of the three figures, against bands that some copied text has
    made too narrow. The limits are a table, one row for each language, script and
    length class; up to broadcast_rows of them (200 bytes each) are broadcast, and
    more, as of a dirty language column, are joined, with the same decisions.

    Nulls: a null or empty text, or one of white space alone, has no word to
    judge by and is rejected; a null language is judged by script; other nulls
    pass through. Very long texts are read whole. Repeated rows are judged alike,
    each on its own; a figure equal to its fence is kept. An empty table gives an
    empty table. Other columns pass through, whatever their names.
    """
    measured, prefix = measure(docs, folder, text)
    measured = stage(measured, "fertility")
    limits = stage(_limits(measured, bands(measured, prefix, lang, least), prefix, lang), "limits")
    names = {c: f"{prefix}_{c}" for c in limits.columns}
    side = limits.select(*[F.col(c).alias(x) for c, x in names.items()])
    at = {k: F.col(f"{prefix}_{k}") for k in (*_COLUMNS, *limits.columns)}
    same = F.col(f"`{lang}`").cast("string").eqNullSafe(at["lang"]) & (at["script"] == at["of_script"]) & (_class(at["n_tokens"]) == at["cls"])
    keep = (at["n_tokens"] > 0) & (at["words"] > 0)
    for k, floor in zip(FIGURES, floors):
        low, high = at[f"low_{k}"], at[f"high_{k}"]
        half = F.greatest(high - low, F.lit(floor)) * width * F.pow(F.lit(2.0), at["longer"] / 2)
        above = (at["longer"] > 0) if k == "token_evenness" else F.lit(False)
        # without a band there is no limit
        keep &= low.isNull() | ((at[k] >= low - half) & ((at[k] <= high + half) | above))
    judged = measured.join(F.broadcast(side) if rows_of(limits, broadcast_rows) else side, same, "left").where(keep)
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns])
