"""All levels of a pyramid in one pass: tiles of cells, reduced by numpy in the task that holds them.

A tile is a rectangle of level-0 cells whose sides are multiples of the last level's
factor, so every window of every level lies in one tile and all levels of a tile come
from its own cells.  Cells travel as blocks, one row for the cells that a task has of a
tile, not as rows of their own; there is one exchange, by tile.  A grid that is stored
in chunks is read by tile instead, without an exchange: tiles are then whole numbers of
source chunks, so that each chunk is read by one task, unless that makes them too large.

What a task holds is one tile with its levels.  The rows of a level are those of the
column expressions in ``functions.reduce``: windows without a row give none.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terrace.functions.types import Element, element
from terrace.plans.layout import REGION_BYTES, copy_region

#: The side of a tile, about, and the greatest factor that one pass spans.
SIDE, SPAN = 512, 2048
#: Cells that a task gathers before it sends their blocks, and bytes of blocks that a task is handed at once, about.
GATHER, HANDED = 1 << 18, 4 << 20
WIDE = {"smallint": np.dtype("<i2"), "int": np.dtype("<i4"), "bigint": np.dtype("<i8"), "float": np.dtype("<f4"), "double": np.dtype("<f8")}
#: Copies of a tile that a task has in hand at once, about: its cells, their mask and what a reduction makes of them.
COPIES = 5


@dataclass(frozen=True)
class Field:
    """A variable as the kernel sees it; cells have the type that Spark holds them in."""

    name: str
    dtype: str
    fill: float | None
    by_mean: bool = False

    @property
    def kind(self) -> Element:
        return element(self.dtype)

    @property
    def wide(self) -> np.dtype:
        return WIDE[self.kind.spark]

    @property
    def absent(self) -> float | int:
        return self.kind.coerce(self.fill) if self.fill is not None else math.nan if self.kind.is_float else 0


def missing_cells(values: np.ndarray, f: Field) -> np.ndarray:
    out = np.isnan(values) if f.kind.is_float else np.zeros(values.shape, bool)
    if f.fill is not None and not math.isnan(f.absent):
        out |= values == f.absent
    return out


def _narrow(wide: np.ndarray, f: Field) -> np.ndarray:
    if f.kind.is_float:
        return wide.astype(f.wide)
    # The bounds are compared as doubles; the largest i64 isn't one.
    inside = np.clip(np.trunc(wide), float(f.kind.low), np.nextafter(float(f.kind.high), 0) if f.dtype == "i64" else float(f.kind.high))
    return np.where(wide >= float(f.kind.high), f.kind.high, np.where(wide <= float(f.kind.low), f.kind.low, inside.astype(f.wide))).astype(f.wide)


def reduced(values: np.ndarray, there: np.ndarray, step: int, method: str, f: Field) -> np.ndarray:
    """One value for each window of ``step`` by ``step`` cells; what doesn't fill a window is dropped."""
    ny, nx = values.shape[0] // step, values.shape[1] // step

    def windows(a: np.ndarray) -> np.ndarray:
        return a[: ny * step, : nx * step].reshape(ny, step, nx, step)

    v = windows(values)
    if method == "nearest":
        return np.where(windows(there)[:, 0, :, 0], v[:, 0, :, 0], np.array(f.absent, f.wide))
    gone = ~windows(there) | windows(missing_cells(values, f))
    present = (~gone).sum((1, 3))
    if method in ("sum", "mean"):
        total = np.where(gone, 0.0, v.astype(np.float64)).sum((1, 3))
        if method == "sum":
            return _narrow(total, f)
        out = _narrow(total / np.maximum(present, 1), f)
    elif f.kind.is_float:
        out = np.where(gone, -np.inf if method == "max" else np.inf, v).max((1, 3)) if method == "max" else np.where(gone, np.inf, v).min((1, 3))
    else:
        info = np.iinfo(f.wide)
        out = np.where(gone, info.min, v).max((1, 3)) if method == "max" else np.where(gone, info.max, v).min((1, 3))
    return np.where(present > 0, out, np.array(f.absent, f.wide)).astype(f.wide)


def present(there: np.ndarray, step: int, method: str) -> np.ndarray:
    """Which windows give a row."""
    ny, nx = there.shape[0] // step, there.shape[1] // step
    t = there[: ny * step, : nx * step].reshape(ny, step, nx, step)
    return np.ascontiguousarray(t[:, 0, :, 0]) if method == "nearest" else t.any((1, 3))


@dataclass(frozen=True)
class Tiling:
    """What tasks need to know of a pyramid: ``levels`` are written, the first of them is what the tiles hold."""

    dims: tuple[str, ...]
    y: str
    x: str
    fields: tuple[Field, ...]
    method: str
    levels: tuple[int, ...]
    steps: tuple[int, ...]
    sizes: tuple[dict[str, int], ...]
    sides: tuple[int, int]

    @property
    def others(self) -> list[str]:
        return [d for d in self.dims if d not in (self.y, self.x)]

    @property
    def row_bytes(self) -> int:
        return 1 + sum(f.wide.itemsize for f in self.fields)

    @property
    def tile_bytes(self) -> int:
        return self.row_bytes * math.prod(self.sides)

    @property
    def counts(self) -> list[int]:
        """Tiles along each of ``others``, and along ``y`` and ``x``."""
        top = self.sizes[0]
        return [*(top[d] for d in self.others), *(-(-top[d] // s) for d, s in zip((self.y, self.x), self.sides))]

    def shape(self, level: int, key: Sequence[int]) -> tuple[int, int]:
        """The cells of a level (by its place in ``levels``) in a tile."""
        factor, out = math.prod(self.steps[: level + 1]), []
        for d, side, k in zip((self.y, self.x), self.sides, key[-2:]):
            out.append(max(0, min(side // factor, self.sizes[level][d] - k * side // factor)))
        return tuple(out)


def tiling(pyramid: Any, dims: tuple[str, ...], levels: Sequence[int], *, max_region_bytes: int = REGION_BYTES) -> Tiling:
    """The tiles of consecutive levels."""
    of = pyramid._dims_groups()[dims]
    first = levels[0]
    fields = tuple(Field(v.name, v.dtype, v.fill, v.coordinate) for v in of)
    span = pyramid.factors[levels[-1]] // pyramid.factors[first]
    sizes = tuple(pyramid.templates[n].sizes for n in levels)
    v = of[0]
    shard = dict(zip(dims, pyramid.region_shape(first, v.name)))
    sides = []
    source = v.chunks if first == 0 else None
    aligned = dict(zip(dims, copy_region(tuple(math.lcm(shard[d], span) if d in (pyramid.y_dim, pyramid.x_dim) else 1 for d in dims), tuple(sizes[0][d] for d in dims), 8 * len(of), source, max_region_bytes)))
    for d in (pyramid.y_dim, pyramid.x_dim):
        side = -(-aligned[d] // span) * span  # a region that ends with the grid may not be whole windows
        if side * side * 8 * len(of) > max_region_bytes or source is None and side > 4 * SIDE:
            side = span * max(1, SIDE // span)
        sides.append(min(side, -(-sizes[0][d] // span) * span))
    steps = (1, *(pyramid.factors[b] // pyramid.factors[a] for a, b in zip(levels, levels[1:])))
    return Tiling(dims, pyramid.y_dim, pyramid.x_dim, fields, pyramid.method, tuple(levels), steps, sizes, tuple(sides))


def passes(pyramid: Any, levels: Sequence[int]) -> list[list[int]]:
    """Consecutive levels that one pass makes; the next pass begins with the last level of the one before, of which little is left."""
    out = [[levels[0]]]
    for n in levels[1:]:
        if pyramid.factors[n] // pyramid.factors[out[-1][0]] > SPAN:
            out.append([out[-1][-1]])
        out[-1].append(n)
    return out


@dataclass
class Block:
    """Cells of one level in a tile: the index of the first along ``others``, ``y`` and ``x``, values and which there are."""

    level: int
    start: tuple[int, ...]
    values: list[np.ndarray]
    there: np.ndarray
    reduce_s: float = 0.0


def levels_of(t: Tiling, key: Sequence[int], values: list[np.ndarray], there: np.ndarray) -> Iterator[Block]:
    """The blocks of a tile, finest first."""
    for i, (level, step) in enumerate(zip(t.levels, t.steps)):
        began = time.perf_counter()
        if i:
            values = [reduced(v, there, step, "mean" if f.by_mean else t.method, f) for v, f in zip(values, t.fields)]
            there = present(there, step, "mean" if any(f.by_mean for f in t.fields) else t.method)
        ny, nx = t.shape(i, key)
        values, there = [v[:ny, :nx] for v in values], there[:ny, :nx]
        factor = math.prod(t.steps[: i + 1])
        start = (*key[:-2], *(k * s // factor for k, s in zip(key[-2:], t.sides)))
        yield Block(level, start, values, there, time.perf_counter() - began if i else 0.0)


def pieces(b: Block, sides: Sequence[int]) -> Iterator[Block]:
    """A block cut along the edges of regions of these sides in ``y`` and ``x``."""
    (y, x), (ny, nx) = b.start[-2:], b.there.shape
    for y0 in range(y // sides[0] * sides[0], y + ny, sides[0]):
        for x0 in range(x // sides[1] * sides[1], x + nx, sides[1]):
            cut = (slice(max(y0 - y, 0), min(y0 + sides[0] - y, ny)), slice(max(x0 - x, 0), min(x0 + sides[1] - x, nx)))
            yield Block(b.level, (*b.start[:-2], y + cut[0].start, x + cut[1].start), [v[cut] for v in b.values], b.there[cut])


# Tiles from cells


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand about ``HANDED`` bytes at once to Python, not all blocks of a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _gatherer(t: Tiling) -> tuple[Callable, str]:
    """Cells to one row for each tile and ``GATHER`` cells: the tile's number, places in it, and values."""
    counts, (sy, sx), names = t.counts, t.sides, [*t.others, t.y, t.x]
    kinds = [("tile", pa.int64()), ("at", pa.binary()), *((f.name, pa.binary()) for f in t.fields)]

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        index = [np.concatenate([b.column(b.schema.get_field_index(d)).to_numpy() for b in held]).astype(np.int64) for d in names]
        values = [np.concatenate([b.column(b.schema.get_field_index(f.name)).to_numpy(zero_copy_only=False) for b in held]).astype(f.wide, copy=False) for f in t.fields]
        y, x = index[-2:]
        tile = np.ravel_multi_index((*index[:-2], y // sy, x // sx), counts)
        at = (y % sy * sx + x % sx).astype("<i4")
        order = np.argsort(tile, kind="stable")
        tile, at, values = tile[order], at[order], [v[order] for v in values]
        edges = [*np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist(), len(tile)]
        parts = [[tile[a] for a in edges[:-1]], *([x[a:b].tobytes() for a, b in zip(edges, edges[1:])] for x in (at, *values))]
        return pa.RecordBatch.from_arrays([pa.array(p, kind) for p, (_, kind) in zip(parts, kinds)], names=[n for n, _ in kinds])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= GATHER:
                yield blocks(held)
                held = []
        if held:
            yield blocks(held)

    return gather, ", ".join(["tile long", "at binary", *(f"`{f.name}` binary" for f in t.fields)])


def _tiles(t: Tiling, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], list[np.ndarray], np.ndarray]]:
    """Whole tiles from rows of ``_gatherer`` in the order of tiles."""
    now, values, there = None, [], np.zeros(0, bool)

    def shaped():
        key = tuple(int(k) for k in np.unravel_index(now, t.counts))
        shape = t.shape(0, key)
        cut = tuple(slice(0, n) for n in shape)
        return key, [v.reshape(t.sides)[cut] for v in values], there.reshape(t.sides)[cut]

    for b in batches:
        numbers, *blocks = b.columns
        for i, tile in enumerate(numbers.to_pylist()):
            at, *parts = (c[i].as_buffer() for c in blocks)
            if tile != now:
                if now is not None:
                    yield shaped()
                now, there = tile, np.zeros(math.prod(t.sides), bool)
                values = [np.full(math.prod(t.sides), f.absent, f.wide) for f in t.fields]
            where = np.frombuffer(at, "<i4")
            if there[where].any():
                raise ValueError(f"tile {np.unravel_index(now, t.counts)} has a cell twice")
            there[where] = True
            for v, raw, f in zip(values, parts, t.fields):
                v[where] = np.frombuffer(raw, f.wide)
    if now is not None:
        yield shaped()


def from_cells(cells: DataFrame, t: Tiling, emit: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], shape: str, parts: int | None = None) -> DataFrame:
    """What ``emit`` makes of tiles ``(key, values, there)``, gathered from cells by one exchange.

    ``parts`` bounds the tasks that work at the same time.
    """
    gather, sent = _gatherer(t)
    inside = cells.where(" and ".join(f"`{d}` between 0 and {n - 1}" for d, n in t.sizes[0].items() if d in t.dims))
    blocks = inside.select(*t.others, t.y, t.x, *(f.name for f in t.fields)).mapInArrow(gather, sent)
    dealt = (blocks.repartition(parts, "tile") if parts else blocks.repartition("tile")).sortWithinPartitions("tile")
    return dealt.mapInArrow(lambda batches: emit(_tiles(t, batches)), shape)


# Tiles from chunks


def from_chunks(spark, grid: Any, t: Tiling, emit: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], shape: str, parts: int | None = None) -> DataFrame:
    """The same for a grid stored in chunks, whose tiles are read by the tasks that reduce them."""
    from terrace.sources.scan import read_block

    arrays = [next(a for a in grid.arrays if a.name == f.name) for f in t.fields]
    axis = [t.others.index(d) if d in t.others else len(t.others) + (d == t.x) for d in grid.dims]
    order = [grid.dims.index(d) for d in (t.y, t.x)]
    count = math.prod(t.counts)

    def tile(key: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray] | None:
        sy, sx = t.shape(0, key)
        low = [*key[:-2], key[-2] * t.sides[0], key[-1] * t.sides[1]]
        high = [*(k + 1 for k in key[:-2]), low[-2] + sy, low[-1] + sx]
        bounds = [(low[a], high[a]) for a in axis]
        cells, there, any_there = [], np.zeros((sy, sx), bool), False
        for f, array in zip(t.fields, arrays):
            # A window of the array, whatever the order of its dimensions.
            window = np.full([b - a for a, b in bounds], f.absent, f.wide)
            stored = np.zeros(window.shape, bool)
            for at in np.ndindex(*(-(-b // n) - a // n for (a, b), n in zip(bounds, grid.block))):
                chunk = [a // n + i for (a, _), n, i in zip(bounds, grid.block, at)]
                found = read_block(array, grid.block, chunk, bounds)
                if found is None:
                    continue
                start = [c * n for c, n in zip(chunk, grid.block)]
                both = [(max(a, s), min(b, s + n)) for (a, b), s, n in zip(bounds, start, grid.block)]
                into = tuple(slice(p - a, q - a) for (p, q), (a, _) in zip(both, bounds))
                out = tuple(slice(p - s, q - s) for (p, q), s in zip(both, start))
                window[into] = np.where(found[1][out], found[0][out], window[into])
                stored[into] |= found[1][out]
            any_there |= bool(stored.any())
            cells.append(window.transpose([*(i for i in range(len(bounds)) if i not in order), *order]).reshape(sy, sx))
            there |= stored.transpose([*(i for i in range(len(bounds)) if i not in order), *order]).reshape(sy, sx)
        return (cells, there) if any_there else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for number in b.column(0).to_pylist():
                key = tuple(int(k) for k in np.unravel_index(number, t.counts))
                found = tile(key)
                if found is not None:
                    yield key, *found

    tasks = min(count, parts or max(spark.sparkContext.defaultParallelism, -(-count * t.tile_bytes // (128 << 20))))
    return spark.range(0, count, 1, max(1, tasks)).mapInArrow(lambda batches: emit(read(batches)), shape)


# Blocks as cells again


def cell_batches(t: Tiling, blocks: Iterator[Block], keep: Callable[[Block], bool] = lambda b: True) -> Iterator[pa.RecordBatch]:
    """``level``, the index and the values of each cell that there is."""
    from terrace.sources.scan import columns

    kinds = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    for b in blocks:
        if not b.there.any() or not keep(b):
            continue
        whole = None if b.there.all() else b.there
        y, x = columns(b.start[-2:], b.there.shape, whole)
        index = {t.y: y, t.x: x, **{d: np.full(len(y), k, np.int32) for d, k in zip(t.others, b.start)}}
        values = [pa.array(np.ascontiguousarray(v if whole is None else v[whole]).ravel(), kinds[f.kind.spark]) for v, f in zip(b.values, t.fields)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), b.level, np.int32)), *(pa.array(index[d]) for d in t.dims), *values], names=["level", *t.dims, *(f.name for f in t.fields)])


def cell_shape(t: Tiling) -> str:
    return ", ".join(["level int", *(f"`{d}` int" for d in t.dims), *(f"`{f.name}` {f.kind.spark}" for f in t.fields)])


def tiled_levels(pyramid: Any, dims: tuple[str, ...], levels: Sequence[int], source: DataFrame | None = None, emit=None, shape: str | None = None, *, max_region_bytes: int = REGION_BYTES, parts: int | None = None) -> DataFrame:
    """Cells of consecutive levels with their ``level``, or what ``emit(tiling, tiles)`` makes of the tiles.

    Tiles come from ``source``, or else from the source's own chunks or cells if the first level is 0.
    """
    t = tiling(pyramid, dims, levels, max_region_bytes=max_region_bytes)

    def plain(tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for tile in tiles:
            yield from cell_batches(t, levels_of(t, *tile))

    work, shape = (lambda tiles: emit(t, tiles)) if emit else plain, shape or cell_shape(t)
    of, grid = pyramid.source.stored.get(dims, (None, None))
    # Only while the cells are still those that were opened.
    if source is None and levels[0] == 0 and grid is not None and of is pyramid.source.frames[dims]:
        spark = next(iter(pyramid.source.frames.values())).sparkSession
        return from_chunks(spark, grid, t, work, shape, parts)
    cells = pyramid.source.frames[dims] if source is None else source
    return from_cells(cells, t, work, shape, parts)


def fits(pyramid: Any, levels: Sequence[int], max_region_bytes: int = REGION_BYTES) -> tuple[bool, int, int]:
    """Whether the tiles that all tasks have in hand fit into three quarters of the executors' storage memory; both in bytes."""
    spark = next(iter(pyramid.source.frames.values())).sparkSession
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    entries = status.values().iterator()
    total = 0
    while entries.hasNext():
        total += entries.next()._1()
    tasks = spark.sparkContext.defaultParallelism
    need = max(COPIES * tasks * tiling(pyramid, dims, p, max_region_bytes=max_region_bytes).tile_bytes for dims in pyramid._dims_groups() for p in passes(pyramid, levels))
    return need <= total * 3 // 4, need, total * 3 // 4
