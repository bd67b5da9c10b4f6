"""Prices, penalties and dispersion measures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson import schema


def _choose(key: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def edge_weight(kind: Column, confidence: Column, weights: dict[str, float] | None = None) -> Column:
    """Kind weight times confidence."""
    return _choose(kind, weights or schema.KIND_WEIGHTS, 0.0) * confidence


def height_penalty(level: Column) -> Column:
    return _choose(level, {k: float(v) for k, v in schema.HEIGHTS.items()}, 16.0)


def rank_of(value: Column, order: Iterable[str]) -> Column:
    """Position of an enum value in its order."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int") - 1


def squared_cv(x: Column) -> Column:
    """Population variance over squared mean; 0 for fewer than two values or mean 0. An aggregate."""
    return F.when((F.count(x) < 2) | (F.avg(x) == 0), F.lit(0.0)).otherwise(F.var_pop(x) / (F.avg(x) * F.avg(x)))


def entropy_term(n: Column, total: Column) -> Column:
    p = n / total
    return -p * F.log(p)


def normalized_overage(measure: Column, cap: Column) -> Column:
    over = F.greatest(F.lit(0.0), measure.cast("double") - cap.cast("double"))
    return F.when(cap == 0, measure.cast("double")).otherwise(over / cap)


def severity(measure: Column, cap: Column) -> Column:
    """Null within the cap, Borderline up to a tenth above, Violation beyond."""
    m = measure.cast("double")
    return F.when(m <= cap, F.lit(None)).when(m <= cap * schema.BORDERLINE, "Borderline").otherwise("Violation")
