"""Pyramids of grids that arrive region by region, by Structured Streaming.

Files of level-0 cells are taken as they come.  A tile, which is one cell of the coarsest
level, is final when all its cells are there: then its cells of all levels are appended.
Cells of other tiles wait below ``pending``, in a table that each batch writes anew from
the one before, so a delivery may split windows anywhere.  ``finish`` makes what is left of
tiles that never fill, at the edge of what arrived.  A batch that runs again after a
failure reads the same table and replaces its own files.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.operators.pyramid import Pyramid
from terrace.operators.tiles import tiled_levels
from terrace.sources.store import _names, _schema, cells_path, delete, exists


def _tile(pyramid: Pyramid, dims: tuple[str, ...]) -> list[Column]:
    """What names a cell's tile."""
    last = pyramid.factors[-1]
    return [(F.expr(f"`{d}` div {last}") if d in (pyramid.y_dim, pyramid.x_dim) else F.col(d)).alias(f"_{d}") for d in dims]


def _full(pyramid: Pyramid, dims: tuple[str, ...]) -> Column:
    """How many cells a tile has; those at an axis's end have fewer."""
    last, out = pyramid.factors[-1], F.lit(1)
    for d in (pyramid.y_dim, pyramid.x_dim):
        out = out * F.least(F.lit(last), F.lit(pyramid.source.sizes[d]) - F.col(f"_{d}") * last)
    return out


def _split(cells: DataFrame, pyramid: Pyramid, dims: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Cells of tiles that are all there, and the others."""
    keyed = cells.select("*", *_tile(pyramid, dims))
    names = [f"_{d}" for d in dims]
    whole = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= _full(pyramid, dims)).drop("_n")
    same = lambda: reduce(and_, [keyed[n] == whole[n] for n in names])
    return keyed.join(whole, same(), "left_semi").drop(*names), keyed.join(whole, same(), "left_anti").drop(*names)


def _pending(root: str, dims: tuple[str, ...]) -> str:
    return f"{root}/pending/{'_'.join(dims)}"


def _batches(spark: SparkSession, root: str, dims: tuple[str, ...]) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, _pending(root, dims)) if n.startswith("batch="))


def stream_levels(arrivals: DataFrame, pyramid: Pyramid, root: str, checkpoint: str, dims: tuple[str, ...] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start a query that writes the levels of each tile, when it is whole, below ``root``, as ``batch=<id>/level=<n>``.

    A cell must arrive once.
    """
    dims = dims or next(iter(pyramid._dims_groups()))

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = _schema(pyramid, dims)
        cells = batch.select(*dims, *(v.name for v in pyramid._dims_groups()[dims]))
        before = [n for n in _batches(spark, root, dims) if n < number]
        if before:
            cells = cells.unionByName(spark.read.schema(schema).parquet(f"{_pending(root, dims)}/batch={before[-1]}"))
        whole, rest = _split(cells.persist(), pyramid, dims)
        try:
            _append(pyramid, dims, whole, root, number)
            rest.write.mode("overwrite").parquet(f"{_pending(root, dims)}/batch={number}")
        finally:
            cells.unpersist()
        for n in before[:-1]:  # the last one is what this batch would read again
            delete(spark, f"{_pending(root, dims)}/batch={n}")

    writer = arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _append(pyramid: Pyramid, dims: tuple[str, ...], cells: DataFrame, root: str, number: int) -> None:
    levels = tiled_levels(pyramid, dims, list(range(pyramid.levels)), cells)
    levels.sortWithinPartitions("level", *dims).write.mode("overwrite").partitionBy("level").parquet(f"{cells_path(root, dims)}/batch={number}")


def finish(spark: SparkSession, pyramid: Pyramid, root: str, dims: tuple[str, ...] | None = None) -> None:
    """Write the levels of tiles that aren't whole, when no more cells will come."""
    dims = dims or next(iter(pyramid._dims_groups()))
    batches = _batches(spark, root, dims)
    if batches:
        rest = spark.read.schema(_schema(pyramid, dims)).parquet(f"{_pending(root, dims)}/batch={batches[-1]}")
        _append(pyramid, dims, rest, root, batches[-1] + 1)
        delete(spark, _pending(root, dims))


def read_stream_level(spark: SparkSession, root: str, dims: tuple[str, ...], level: int) -> DataFrame:
    """A level's cells of all tiles that are whole (or finished) so far; an error before the first."""
    if not exists(spark, cells_path(root, dims)):
        raise FileNotFoundError(f"{root} has no tiles yet")
    return spark.read.parquet(cells_path(root, dims)).where(F.col("level") == level).drop("batch", "level")
