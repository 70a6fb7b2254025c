"""Column expressions that reduce a window of cells to one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.types import Element

METHODS = ("mean", "max", "min", "sum", "nearest")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")
    return method


def missing(value: Column, kind: Element, fill: float | None) -> Column:
    """True where a cell counts as missing: null, NaN, or the fill value in the cell's own type."""
    out = value.isNull()
    if kind.is_float:
        out = out | F.isnan(value)
    if fill is not None and not math.isnan(kind.coerce(fill)):
        out = out | (value == F.lit(kind.coerce(fill)).cast(kind.spark))
    return out


def narrow(value: Column, kind: Element) -> Column:
    """A double in the element type: integers truncate toward zero and saturate, floats round."""
    if kind.is_float:
        return value.cast(kind.spark)
    # The bounds are compared as doubles: the largest i64 isn't one, and a cast beyond it would raise.
    return (
        F.when(value >= F.lit(float(kind.high)), F.lit(kind.high).cast(kind.spark))
        .when(value <= F.lit(float(kind.low)), F.lit(kind.low).cast(kind.spark))
        .otherwise(value.cast(kind.spark))
    )


def absent(kind: Element, fill: float | None) -> Column:
    """What a window without a value becomes: the fill value, else NaN, else 0."""
    if fill is not None:
        return F.lit(kind.coerce(fill)).cast(kind.spark)
    return F.lit(float("nan") if kind.is_float else 0).cast(kind.spark)


def reducer(name: str, kind: Element, method: str, fill: float | None = None, skipna: bool = True, promote: bool = False) -> Column:
    """The aggregate of column ``name`` over a window.  ``promote`` leaves the mean of integers a double."""
    value = F.col(name)
    wide = value.cast("double")
    if not skipna:
        if method in ("mean", "sum"):
            return narrow(F.avg(wide) if method == "mean" else F.sum(wide), kind)
        best = F.max(value) if method == "max" else F.min(value)
        return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan")).cast(kind.spark)).otherwise(best) if kind.is_float else best
    gone = missing(value, kind, fill)
    if method == "sum":
        return narrow(F.coalesce(F.sum(F.when(~gone, wide)), F.lit(0.0)), kind)
    if method == "mean":
        if promote and not kind.is_float:
            return F.avg(wide)
        return F.coalesce(narrow(F.avg(F.when(~gone, wide)), kind), absent(kind, fill))
    present = F.when(~gone, value)
    return F.coalesce(F.max(present) if method == "max" else F.min(present), absent(kind, fill))
