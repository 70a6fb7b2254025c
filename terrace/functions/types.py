"""Element types of grids and how they map to Spark types.

Spark has no unsigned integers, so ``u8`` and ``u16`` live in the next wider type
and are clamped to their range whenever a wider number is narrowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Element:
    name: str
    spark: str
    itemsize: int
    low: int | None = None
    high: int | None = None

    @property
    def is_float(self) -> bool:
        return self.low is None

    def coerce(self, value: float) -> float | int:
        """``value`` in this type: integers truncate toward zero and saturate, NaN becomes 0."""
        if self.is_float:
            return float(value)
        if math.isnan(value):
            return 0
        if math.isinf(value):
            return self.high if value > 0 else self.low
        return min(max(int(value), self.low), self.high)


def _integer(name: str, spark: str, itemsize: int, signed: bool) -> Element:
    bits = 8 * itemsize
    return Element(name, spark, itemsize, -(1 << bits - 1) if signed else 0, (1 << bits - signed) - 1)


ELEMENTS = {
    e.name: e
    for e in (
        _integer("u8", "smallint", 1, False),
        _integer("u16", "int", 2, False),
        _integer("i16", "smallint", 2, True),
        _integer("i32", "int", 4, True),
        _integer("i64", "bigint", 8, True),
        Element("f32", "float", 4),
        Element("f64", "double", 8),
    )
}


def element(name: str) -> Element:
    try:
        return ELEMENTS[name]
    except KeyError:
        raise TypeError(f"element type {name!r} can't be reduced; use one of {', '.join(ELEMENTS)}") from None
