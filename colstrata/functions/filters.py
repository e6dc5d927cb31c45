"""Typed single-column predicates as data, turned into Column expressions.

A Filter names a column and a kind of test; `to_column` gives the boolean Column,
so Catalyst pushes it to the scan. Sets that are empty, and rows without a value,
follow one rule: a test of all elements of an empty set is false, and `exclude`
is the logical opposite of the test.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UINT_MAX = (1 << 32) - 1


@dataclass(frozen=True)
class Filter:
    """values: equal to one of them. range: between low and high. notnull: has a value.

    quantifier: for array columns, whether any or all elements must pass.
    low and high: None for no bound. fold_case: compare strings under a
    case-insensitive collation. path: a path into a column of JSON text.
    """

    column: str
    kind: str = "values"
    values: Sequence[Any] = ()
    low: Any = None
    high: Any = None
    low_closed: bool = True
    high_closed: bool = True
    exclude: bool = False
    quantifier: str = "any"
    fold_case: bool = False
    path: str | None = None

    def __post_init__(self):
        if self.kind not in ("values", "range", "notnull"):
            raise ValueError(f"unknown kind of filter: {self.kind}")
        if self.quantifier not in ("any", "all"):
            raise ValueError(f"unknown quantifier: {self.quantifier}")


def normalise(f: Filter, kind: T.DataType) -> Filter:
    """The filter with bounds that fit the column's type.

    Bounds beyond an unsigned 32-bit column are dropped; one value for a float
    column becomes a closed range; the values of a boolean one become booleans.
    """
    if isinstance(kind, T.BooleanType):
        if f.kind == "range":
            ok = [b for b in (0, 1) if _within(b, f)]
            return replace(f, kind="values", values=tuple(map(bool, ok)), low=None, high=None)
        return replace(f, values=tuple(bool(v) for v in f.values))
    if isinstance(kind, T.FloatType) and f.kind == "values" and len(f.values) == 1:
        return replace(f, kind="range", low=f.values[0], high=f.values[0], values=())
    if isinstance(kind, (T.IntegerType, T.LongType)) and f.kind == "range":
        low = None if f.low is not None and f.low < 0 and isinstance(kind, T.IntegerType) else f.low
        high = None if f.high is not None and f.high > UINT_MAX and isinstance(kind, T.IntegerType) else f.high
        return replace(f, low=low, high=high)
    return f


def _within(v: Any, f: Filter) -> bool:
    if f.low is not None and (v < f.low or (v == f.low and not f.low_closed)):
        return False
    return not (f.high is not None and (v > f.high or (v == f.high and not f.high_closed)))


def is_degenerate(f: Filter, kind: T.DataType) -> bool:
    """Whether every row passes: a boolean filter that takes both values."""
    return isinstance(kind, T.BooleanType) and not f.exclude and len(set(normalise(f, kind).values)) == 2


def prune_values(f: Filter, least: Any, most: Any) -> Filter:
    """The filter without values outside the column's own range; an excluding one stays."""
    if f.exclude or f.kind != "values":
        return f
    return replace(f, values=tuple(v for v in f.values if least <= v <= most))


def _test(x: Column, f: Filter, as_float: bool = False) -> Column:
    cast = (lambda v: F.lit(float(v)).cast("float")) if as_float else F.lit
    if f.kind == "notnull":
        return x.isNotNull()
    if f.kind == "values":
        if not f.values:
            return F.lit(False)
        return x == cast(f.values[0]) if len(f.values) == 1 else x.isin([cast(v) for v in f.values])
    parts = []
    if f.low is not None:
        parts.append(x >= cast(f.low) if f.low_closed else x > cast(f.low))
    if f.high is not None:
        parts.append(x <= cast(f.high) if f.high_closed else x < cast(f.high))
    return reduce(lambda a, b: a & b, parts) if parts else x.isNotNull()


def to_column(f: Filter, schema: T.StructType | None = None) -> Column:
    """The filter as a boolean Column."""
    x = F.col(f.column)
    kind = schema[f.column].dataType if schema is not None and f.column in schema.names else None
    if kind is not None and f.path is None and not isinstance(kind, T.ArrayType):
        f = normalise(f, kind)
    if f.path is not None:
        x = F.get_json_object(x, f.path)
        sample = next((v for v in (*f.values, f.low, f.high) if v is not None), None)
        if isinstance(sample, (int, float)) and not isinstance(sample, bool):
            x = x.cast("double" if isinstance(sample, float) else "bigint")
    if f.fold_case:
        # the binary length decides first, as a fold that changes it is no match
        same = [(F.octet_length(x) == len(str(v).encode())) & (F.lower(x) == F.lower(F.lit(v))) for v in f.values]
        hit = reduce(lambda a, b: a | b, same) if same else F.lit(False)
    elif isinstance(kind, T.ArrayType):
        if f.quantifier == "any":
            if f.kind == "values" and len(f.values) == 1:
                hit = F.array_contains(x, f.values[0])
            else:
                hit = F.exists(x, lambda e: _test(e, f))
        else:
            hit = (F.size(x) > 0) & F.forall(x, lambda e: _test(e, f))
    else:
        hit = _test(x, f, isinstance(kind, T.FloatType))
    return ~hit if f.exclude else hit


def all_of(filters: Sequence[Filter], schema: T.StructType | None = None) -> Column:
    """The conjunction of filters; of none, true."""
    return reduce(lambda a, b: a & b, [to_column(f, schema) for f in filters], F.lit(True))
