"""Mixing sources to target weights.

Tokens (runs without white space) are summed by source over all documents; a
source of weight w then repeats each of its documents w * all tokens / own tokens
times: floor of that many copies, and one more with the fraction's probability,
drawn by a hash of the document and the seed, so any engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_words(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; 0 for a null."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, epochs: float = 1.0, text: str = "text", source: str = "source") -> DataFrame:
    """source, tokens, weight and rate of each source.

    weights: target shares by source; they are divided by their sum. Without
    them, a source's weight is its tokens to the power 1 / temperature.
    """
    tokens = docs.select(F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        raw = F.sqrt(F.col("tokens")) if temperature == 2.0 else F.pow(F.col("tokens"), F.lit(1.0 / temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(float(w))).otherwise(raw)
    rated = tokens.withColumn("raw", raw)
    total = rated.agg(F.sum("tokens").alias("all_tokens"), F.sum("raw").alias("all_raw"))
    # one row, whatever the size of the corpus
    joined = rated.crossJoin(F.broadcast(total))
    weight = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(F.lit(0.0))
    rate = F.when(F.col("tokens") > 0, F.round(weight * F.col("all_tokens") * F.lit(float(epochs)) / F.col("tokens"), 6)).otherwise(F.lit(0.0))
    return joined.select("source", "tokens", weight.alias("weight"), rate.alias("rate"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from a document's id, or from its text where it has no id."""
    key = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(key, F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, epochs: float = 1.0, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source", copy: str | None = None, most_sources: int = 10_000) -> DataFrame:
    """The documents repeated to the target weights.

    copy: the name of a column to number a document's copies from 0; it must be
    free. Up to `most_sources` sources, their rates go to the tasks as a literal
    map and no text is shuffled; beyond, they are joined.

    Nulls: documents without source are a source of their own (weight as any
    other without `weights`, and 0 with them, as for other sources that they
    don't name); a null or empty text has 0 tokens and goes with its source's
    rate; without doc_id the text is hashed. A source without any token has rate
    0. Repeated rows are drawn alike. An empty table gives an empty table. Other
    columns pass through, whatever their names.
    """
    if copy is not None and copy.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {copy} is there already")
    names = docs.columns
    n, r = "_copies", "_rate"
    while {n, r, f"{r}_source"} & {c.lower() for c in names}:
        n, r = "_" + n, "_" + r
    rates = source_rates(docs, weights, temperature, epochs, text, source)
    rows = rates.select("source", "rate").limit(most_sources + 1).collect()
    src = F.col(f"`{source}`")
    if len(rows) <= most_sources:
        of = {x["source"]: x["rate"] for x in rows}
        named = [y for k, v in of.items() if k is not None for y in (F.lit(k), F.lit(v))]
        mapped = F.try_element_at(F.create_map(*named), src) if named else F.lit(None).cast("double")
        rated = docs.withColumn(r, F.coalesce(F.when(src.isNull(), F.lit(of.get(None, 0.0))).otherwise(mapped), F.lit(0.0)))
    else:
        key = rates.select(F.col("source").alias(f"{r}_source"), F.col("rate").alias(r))
        rated = docs.join(key, src.eqNullSafe(F.col(f"{r}_source")), "left").drop(f"{r}_source")
    whole = F.floor(F.col(r))
    extra = (draw(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed) < F.col(r) - whole).cast("int")
    counted = rated.withColumn(n, (whole + extra).cast("int")).where(F.col(n) > 0)
    out = [F.col(f"`{c}`") for c in names]
    return counted.select(*out, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy or n)).select(*out, *([copy] if copy else []))


MIX_SQL = """
WITH d AS (
  SELECT *, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) = '' THEN 0
    ELSE length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'))) - length(replace(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), ' ', '')) + 1 END AS n
  FROM documents
), s AS (
  SELECT source, sum(n)::BIGINT AS tokens, sqrt(sum(n)::DOUBLE) AS raw FROM d GROUP BY source
), r AS (
  SELECT source, CASE WHEN tokens > 0 THEN round(raw / (SELECT sum(raw) FROM s) * (SELECT sum(tokens) FROM s)::DOUBLE * 1.0 / tokens, 6) ELSE 0.0 END AS rate FROM s
), c AS (
  SELECT doc_id, text, lang, d.source, n_chars,
    (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '/7'), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INT AS copy FROM c WHERE copies > 0
"""
