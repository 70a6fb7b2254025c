"""Coordinates on their way into a store and back: numbers of any type, dates and text."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

import numpy as np

from terrace.plans.raster import EPOCH, Coordinate, plain_value

#: How times are counted: the steps that give whole numbers, coarsest first.
UNITS = (("days", 86_400_000_000), ("seconds", 1_000_000), ("microseconds", 1))


def stored_values(c: Coordinate) -> tuple[str, list, dict[str, Any]]:
    """The element type of a coordinate (``i64``, ``f32``, ``f64`` or ``text``), its values, and attributes that say how to read them.

    Times become whole numbers with ``units`` and ``calendar``; None is NaN, or no time.  What
    is none of these is an error rather than left out.
    """
    raw = list(c.values) if isinstance(c.values, (list, tuple, range, np.ndarray)) or hasattr(c.values, "__iter__") and not isinstance(c.values, str) else [c.values]
    values = [plain_value(x) for x in raw]
    known = [x for x in values if x is not None]
    if known and all(isinstance(x, dt.datetime) for x in known):
        counts = [None if x is None else (x - EPOCH) // dt.timedelta(microseconds=1) for x in values]
        name, step = next((n, s) for n, s in UNITS if all(k is None or k % s == 0 for k in counts))
        attrs = {"units": f"{name} since 1970-01-01", "calendar": "proleptic_gregorian"}
        if None in counts:
            return "f64", [math.nan if k is None else float(k // step) for k in counts], attrs
        return "i64", [k // step for k in counts], attrs
    if any(isinstance(x, str) for x in known):
        if not all(isinstance(x, str) for x in values):
            raise TypeError(f"the coordinate {c.name} holds text beside other values, which can't be written")
        return "text", values, {}
    for x in known:
        if not isinstance(x, (bool, int, float)):
            raise TypeError(f"the coordinate {c.name} holds {type(x).__name__}, which can't be written; numbers, times and text can")
    if known and len(known) == len(values) and all(isinstance(x, int) for x in values):
        return "i64", [int(x) for x in values], {}
    single = bool(raw) and all(isinstance(x, np.float32) for x in raw)
    return "f32" if single else "f64", [math.nan if x is None else float(x) for x in values], {}


def restored_values(name: str, dims: tuple[str, ...], kind: str, values: list, attrs: dict[str, Any]) -> Coordinate:
    """The inverse of ``stored_values``: numbers, text, and times as ``datetime``."""
    words = str(attrs.get("units", "")).split(" since ")
    step = dict(UNITS).get(words[0]) if len(words) == 2 else None
    values = [float(x) if isinstance(x, str) and kind != "text" else x for x in values]  # NaN is text in JSON
    if step is None or kind == "text":
        return Coordinate(name, dims, values, attrs)
    start = dt.datetime.fromisoformat(words[1].strip())
    times = [None if x is None or x != x else start + dt.timedelta(microseconds=int(x) * step) for x in values]
    return Coordinate(name, dims, times, {k: v for k, v in attrs.items() if k not in ("units", "calendar")})
