"""The description of a gridded dataset: variables, dimensions, coordinates, and the cells they describe.

Cells are DataFrames with one INT index column per dimension and one column per
variable; variables that share their dimensions share a DataFrame.  Everything else
is small and lives on the driver, so planning runs no job.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field, replace
from functools import reduce as fold
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.reduce import absent
from terrace.functions.types import Element, element


EPOCH = dt.datetime(1970, 1, 1)


def plain_value(x: Any) -> Any:
    """A number, text or time of Python's own."""
    if isinstance(x, np.datetime64):
        if np.isnat(x):
            return None
        return EPOCH + dt.timedelta(microseconds=int(x.astype("datetime64[us]").astype(np.int64)))
    if isinstance(x, np.generic):
        return x.item()
    if hasattr(x, "to_pydatetime"):
        x = x.to_pydatetime()
    if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        return dt.datetime(x.year, x.month, x.day)
    if isinstance(x, dt.datetime) and x.tzinfo is not None:
        return x.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return x


@dataclass(frozen=True)
class Variable:
    """One array of a dataset.  ``chunks`` are those of its source, one for each dimension, if it has any.

    A ``coordinate`` has a value for each cell (of a curvilinear grid, say) and is coarsened by mean, whatever the data's method is.
    """

    name: str
    dims: tuple[str, ...]
    dtype: str
    attrs: dict[str, Any] = field(default_factory=dict)
    encoding: dict[str, Any] = field(default_factory=dict)
    chunks: tuple[int, ...] | None = None
    coordinate: bool = False

    @property
    def kind(self) -> Element:
        return element(self.dtype)

    @property
    def fill(self) -> float | None:
        """The fill value of the encoding, else of the attributes, else NaN for floats, else none."""
        for where in (self.encoding, self.attrs):
            if where.get("_FillValue") is not None:
                return float(where["_FillValue"])
        return math.nan if self.kind.is_float else None


@dataclass(frozen=True)
class Coordinate:
    """Values along one dimension, or of none for a scalar or auxiliary coordinate."""

    name: str
    dims: tuple[str, ...]
    values: list
    attrs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Raster:
    sizes: dict[str, int]
    variables: tuple[Variable, ...]
    frames: dict[tuple[str, ...], DataFrame]
    coords: dict[str, Coordinate] = field(default_factory=dict)
    crs: str | None = None
    attrs: dict[str, Any] = field(default_factory=dict)
    #: By dimensions, cells that are stored in chunks, absent ones being missing, and where: a ``sources.scan.Grid``.
    stored: dict[tuple[str, ...], Any] = field(default_factory=dict)

    def variable(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)

    def spatial(self, x_dim: str, y_dim: str) -> list[Variable]:
        """Variables over both spatial dimensions; only these are coarsened."""
        return [v for v in self.variables if {x_dim, y_dim} <= set(v.dims)]

    def require_crs(self) -> str:
        if not self.crs:
            raise ValueError('the dataset has no crs; set one, e.g. crs="EPSG:4326"')
        return str(self.crs)

    def with_frames(self, frames: dict[tuple[str, ...], DataFrame], sizes: dict[str, int], coords: dict[str, Coordinate]) -> Raster:
        return replace(self, frames=frames, sizes=sizes, coords=coords, stored={})

    def select(self, *names: str) -> Raster:
        """The dataset with the named variables alone."""
        kept = tuple(v for v in self.variables if v.name in names)
        frames = {d: df.select(*d, *[v.name for v in kept if v.dims == d]) for d, df in self.frames.items() if any(v.dims == d for v in kept)}
        return replace(self, variables=kept, frames=frames)


def raster(df: DataFrame, dims: tuple[str, ...], sizes: dict[str, int], variables: dict[str, str], *, coords: dict[str, Coordinate] | None = None, crs: str | None = None, fills: dict[str, float] | None = None, chunks: tuple[int, ...] | None = None, attrs: dict[str, Any] | None = None, auxiliary: tuple[str, ...] = ()) -> Raster:
    """A dataset of variables that share ``dims``, from cells with these columns; nulls become what a missing cell is.

    Those of ``variables`` that ``auxiliary`` names are coordinates with a value for each cell.
    """
    made = tuple(Variable(n, dims, t, encoding={"_FillValue": fills[n]} if fills and n in fills else {}, chunks=chunks, coordinate=n in auxiliary) for n, t in variables.items())
    return Raster(dict(sizes), made, {dims: normalised(df, dims, made)}, dict(coords or {}), crs, dict(attrs or {}))


def normalised(df: DataFrame, dims: tuple[str, ...], variables: tuple[Variable, ...]) -> DataFrame:
    """Index columns as INT and values in their types; a null integer without a fill value raises when it is met."""
    out = []
    for v in variables:
        value = F.col(v.name).cast(v.kind.spark)
        if v.kind.is_float or v.fill is not None:
            value = F.coalesce(value, absent(v.kind, v.fill))
        else:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in {v.name}, an integer variable without a fill value")).cast(v.kind.spark))
        out.append(value.alias(v.name))
    return df.select(*[F.col(d).cast("int").alias(d) for d in dims], *out)


def densified(df: DataFrame, dims: tuple[str, ...], sizes: dict[str, int], variables: tuple[Variable, ...]) -> DataFrame:
    """Every cell of the grid: those that ``df`` lacks are missing.

    A sparse source needs this before ``sum``, whose empty windows are 0, and before
    any reduction that doesn't skip missing cells.
    """
    spark = df.sparkSession
    index = F.col("id")
    columns = []
    for d in reversed(dims):  # row-major: the last dimension turns fastest
        columns.insert(0, (index % sizes[d]).cast("int").alias(d))
        index = F.floor(index / sizes[d])
    full = spark.range(fold(lambda a, d: a * sizes[d], dims, 1)).select(*columns)
    return normalised(full.join(df, list(dims), "left"), dims, variables)
