"""Coordinates along the axes of a level."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.coarsen import window_axis
from terrace.plans.raster import EPOCH, Coordinate, plain_value


def coarsen_values(values: list, stride: int) -> list:
    """Means of full windows, whatever the data's method is; an axis shorter than its stride is one window.

    The mean of times is a time, in whole microseconds.
    """
    stride, count = window_axis(len(values), stride)
    windows = [[plain_value(x) for x in values[i * stride : (i + 1) * stride]] for i in range(count)]
    if any(isinstance(x, dt.datetime) for w in windows for x in w):
        steps = [[(x - EPOCH) // dt.timedelta(microseconds=1) for x in w] for w in windows]
        return [EPOCH + dt.timedelta(microseconds=sum(w) // stride) for w in steps]
    return [sum(map(float, w)) / stride for w in windows]


def coarsen_coords(coords: Mapping[str, Coordinate], strides: Mapping[str, int]) -> dict[str, Coordinate]:
    """Coordinates along one coarsened axis become means; scalar ones and those of other axes stay."""
    out = {}
    for name, c in coords.items():
        stride = strides.get(c.dims[0], 1) if len(c.dims) == 1 else 1
        out[name] = replace(c, values=coarsen_values(c.values, stride)) if stride > 1 else c
    return out


def coordinate_frame(spark: SparkSession, coords: Mapping[str, Coordinate]) -> DataFrame:
    """``dim, idx, value`` of all coordinates along one axis that share its name."""
    rows = [(n, i, float(v)) for n, c in coords.items() if c.dims == (n,) for i, v in enumerate(c.values)]
    return spark.createDataFrame(rows, "dim string, idx int, value double")


def coarsen_coordinate_frame(coords: DataFrame, dim: str, size: int, stride: int) -> DataFrame:
    """The same as ``coarsen_values`` for a table ``dim, idx, value``."""
    stride, count = window_axis(size, stride)
    inside = coords.where((F.col("dim") == dim) & (F.col("idx") < count * stride))
    return inside.groupBy("dim", F.expr(f"cast(idx div {stride} as int)").alias("idx")).agg(F.avg("value").alias("value"))


def attach(cells: DataFrame, coords: DataFrame, dim: str, name: str) -> DataFrame:
    """``cells`` with the coordinate of each one's place on ``dim``; an axis is small against its cells, and Spark broadcasts it if it is small enough."""
    axis = coords.where(F.col("dim") == dim).select(F.col("idx").alias(dim), F.col("value").alias(name))
    return cells.join(axis, dim)
