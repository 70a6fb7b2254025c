"""One coarsening step: a trimmed, block-strided aggregation of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as fold
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.reduce import absent, check_method, reducer
from terrace.functions.types import element

MAX_DIMS = 4


def check_strides(dims: Sequence[str], strides: Mapping[str, int]) -> dict[str, int]:
    """A stride for each dimension, 1 where none is given."""
    if not 1 <= len(dims) <= MAX_DIMS:
        raise ValueError(f"grids have 1 to {MAX_DIMS} dimensions, not {len(dims)}")
    if unknown := set(strides) - set(dims):
        raise ValueError(f"strides for unknown dimensions: {', '.join(sorted(unknown))}")
    for d, s in strides.items():
        if isinstance(s, bool) or not isinstance(s, int) or s < 1:
            raise ValueError(f"the stride of {d} must be an integer of at least 1, not {s!r}")
    return {d: strides.get(d, 1) for d in dims}


def window_axis(size: int, stride: int) -> tuple[int, int]:
    """The stride in effect and the number of windows: an axis shorter than its stride is one window."""
    stride = min(stride, max(size, 1))
    return stride, size // stride


def trimmed(dims: Sequence[str], sizes: Mapping[str, int], strides: Mapping[str, int]) -> Column | None:
    """Cells of full windows; None where no axis has a partial window."""
    out = None
    for d in dims:
        stride, count = window_axis(sizes[d], strides[d])
        if count * stride < sizes[d]:
            inside = F.col(d) < count * stride
            out = inside if out is None else out & inside
    return out


def coarsen(
    df: DataFrame,
    dims: Sequence[str],
    sizes: Mapping[str, int],
    strides: Mapping[str, int],
    variables: Mapping[str, str],
    method: str = "mean",
    *,
    fills: Mapping[str, float | None] | None = None,
    skipna: bool = True,
    promote: bool = False,
    keys: Sequence[str] = (),
    by_mean: Sequence[str] = (),
) -> DataFrame:
    """Cells of the coarser grid: ``dims`` and one column for each of ``variables`` (name to element type).

    Window ``i`` of an axis holds the cells ``i * stride`` and on; what doesn't fill
    a window at an axis's end is dropped.  ``nearest`` keeps each window's first
    cell, which is a filter without a shuffle; all other methods aggregate every
    variable in one shuffle.  ``keys`` are further columns that windows never
    cross; a partitioning by them serves the aggregation as it is.  Variables in
    ``by_mean`` are reduced so whatever the method is; beside them ``nearest`` aggregates too.
    """
    check_method(method)
    strides = check_strides(dims, strides)
    kinds = {n: element(t) for n, t in variables.items()}
    inside = trimmed(dims, sizes, strides)
    cells = df if inside is None else df.where(inside)
    step = {d: window_axis(sizes[d], strides[d])[0] for d in dims}
    index = [(F.expr(f"`{d}` div {step[d]}").cast("int") if step[d] > 1 else F.col(d)).alias(d) for d in dims]
    by_mean = [n for n in by_mean if n in kinds]
    if method == "nearest" and not by_mean:
        for d in dims:
            if step[d] > 1:
                cells = cells.where(F.col(d) % step[d] == 0)
        return cells.select(*keys, *index, *variables)
    fills = fills or {}
    if method == "nearest":
        corner = fold(and_, [F.col(d) % step[d] == 0 for d in dims if step[d] > 1], F.lit(True))
        others = {n: F.coalesce(F.max(F.when(corner, F.col(n))), absent(k, fills.get(n))) for n, k in kinds.items() if n not in by_mean}
    else:
        others = {n: reducer(n, k, method, fills.get(n), skipna, promote) for n, k in kinds.items() if n not in by_mean}
    values = [(others[n] if n in others else reducer(n, k, "mean", fills.get(n), skipna, promote)).alias(n) for n, k in kinds.items()]
    return cells.groupBy(*keys, *index).agg(*values)


def copy_level(df: DataFrame, dims: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Level 0: the cells as they are, without other columns."""
    return df.select(*dims, *variables)

