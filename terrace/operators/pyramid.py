"""Pyramids: a grid and its coarser levels, planned on the driver and computed as one chain.

Level ``n`` reduces level ``n - 1``.  Cells are dealt to tasks once, by the tile of
the coarsest level that they fall into (and by the other dimensions, of which each
index is a grid of its own), and each level's aggregation keeps the tile in its keys: every level then finds its cells already together, so that a chain of
aggregations has one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.reduce import check_method
from terrace.operators.coarsen import MAX_DIMS, coarsen, copy_level
from terrace.operators.coords import coarsen_coords
from terrace.plans.layout import CHUNKS_PER_SHARD, TARGET_BYTES, Layout, check_shards, recommend_encoding, region_count
from terrace.plans.metadata import LayerHint, multiscale_attrs
from terrace.plans.raster import Raster

#: The largest side of a tile: levels beyond this factor are dealt out again, when little is left of the cells.
TILE = 64


def resolve_factors(levels: int | None = None, factors: Sequence[int] | None = None) -> list[int]:
    """Cumulative factors from one of a number of levels (powers of two) or a list of factors."""
    if (levels is None) == (factors is None):
        raise ValueError("give either levels or factors")
    if factors is None:
        if not isinstance(levels, int) or levels < 1:
            raise ValueError(f"levels must be an integer of at least 1, not {levels!r}")
        return [1 << i for i in range(levels)]
    out = list(factors)
    if not out or any(isinstance(f, bool) or not isinstance(f, int) for f in out):
        raise ValueError(f"factors must be integers, not {factors!r}")
    if out[0] != 1:
        raise ValueError("factors start at 1")
    for a, b in zip(out, out[1:]):
        if b <= a or b % a:
            raise ValueError(f"each factor must be a larger multiple of the one before: {a}, {b}")
    return out


def level_sizes(sizes: Mapping[str, int], factors: Sequence[int], x_dim: str, y_dim: str) -> list[dict[str, int]]:
    """The sizes of each level; an axis must hold a window at every step."""
    out = [dict(sizes)]
    for i, (a, b) in enumerate(zip(factors, factors[1:]), 1):
        step, now = b // a, dict(out[-1])
        for d in (x_dim, y_dim):
            if now[d] < step:
                raise ValueError(f"level {i} would be empty: {d} has {now[d]} cells and the step is {step}")
            now[d] //= step
        out.append(now)
    return out


@dataclass(frozen=True)
class Pyramid:
    """A plan: nothing is read before a level's cells are asked for."""

    source: Raster
    x_dim: str
    y_dim: str
    method: str
    factors: list[int]
    templates: list[Raster]
    encoding: dict[str, dict[str, Layout]]
    attrs: dict[str, Any]
    promote: bool = False

    @property
    def levels(self) -> int:
        return len(self.factors)

    def step(self, level: int) -> int:
        return self.factors[level] // self.factors[level - 1] if level else 1

    def _dims_groups(self) -> dict[tuple[str, ...], list]:
        groups: dict[tuple[str, ...], list] = {}
        for v in self.source.spatial(self.x_dim, self.y_dim):
            groups.setdefault(v.dims, []).append(v)
        return groups

    def reduce_step(self, df: DataFrame, dims: tuple[str, ...], level: int, keys: Sequence[str] = ()) -> DataFrame:
        """Level ``level`` from the cells of the level before it."""
        of = self._dims_groups()[dims]
        step = self.step(level)
        return coarsen(
            df, dims, self.templates[level - 1].sizes, {self.x_dim: step, self.y_dim: step}, {v.name: v.dtype for v in of}, self.method,
            fills={v.name: v.fill for v in of}, promote=self.promote, keys=keys, by_mean=[v.name for v in of if v.coordinate],
        )

    def chain(self, dims: tuple[str, ...] | None = None, upto: int | None = None, base: DataFrame | None = None) -> list[DataFrame]:
        """The cells of levels 0 to ``upto``, each derived from the one before."""
        groups = self._dims_groups()
        dims = dims or next(iter(groups))
        last = self.levels - 1 if upto is None else upto
        names = [v.name for v in groups[dims]]
        df = copy_level(self.source.frames[dims] if base is None else base, dims, names)
        out = [df]
        if self.method == "nearest" and not any(v.coordinate for v in groups[dims]):
            for level in range(1, last + 1):
                out.append(self.reduce_step(out[-1], dims, level))
            return out
        tile, done, others = 0, 0, [d for d in dims if d not in (self.y_dim, self.x_dim)]
        for level in range(1, last + 1):
            if level > done:  # deal the cells out for as many levels as a tile spans
                tile = next((i for i in range(last, level - 1, -1) if self.factors[i] // self.factors[level - 1] <= TILE), level)
                side, done = self.factors[tile] // self.factors[level - 1], tile
                keys = [F.expr(f"cast(`{d}` div {side} as int)").alias(f"tile_{d}") for d in (self.y_dim, self.x_dim)]
                df = df.select(*dims, *names, *keys)
                if done > level:
                    df = df.repartition("tile_" + self.y_dim, "tile_" + self.x_dim, *others)
            df = self.reduce_step(df, dims, level, ["tile_" + self.y_dim, "tile_" + self.x_dim])
            out.append(df.select(*dims, *names))
        return out

    def level(self, n: int, dims: tuple[str, ...] | None = None) -> DataFrame:
        return self.chain(dims, n)[n]

    def union(self, dims: tuple[str, ...] | None = None) -> DataFrame:
        """All levels in one DataFrame, with a column ``level``."""
        frames = [df.withColumn("level", F.lit(i)) for i, df in enumerate(self.chain(dims))]
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def as_levels(self) -> dict[int, Raster]:
        """The levels as datasets that haven't been computed, for a writer of one's own.

        The mean of integers is then a double and fill values count as values, as
        lazy array libraries have it.
        """
        plain = replace(self, promote=True, source=replace(self.source, variables=tuple(replace(v, encoding={}, attrs={k: x for k, x in v.attrs.items() if k != "_FillValue"}) for v in self.source.variables)))
        frames = {dims: plain.chain(dims) for dims in plain._dims_groups()}
        others = {d: df for d, df in self.source.frames.items() if d not in frames}
        return {i: self.templates[i].with_frames({**{d: f[i] for d, f in frames.items()}, **others}, self.templates[i].sizes, self.templates[i].coords) for i in range(self.levels)}

    def window(self, level: int, y0: int, y1: int, x0: int, x1: int, dims: tuple[str, ...] | None = None) -> DataFrame:
        """Cells of a level with ``y0 <= y < y1`` and ``x0 <= x < x1``.

        The bounds are multiplied up to the source's own index, where the Parquet
        reader can use them: Spark itself pushes them no further than the division
        that makes the level's index.
        """
        dims = dims or next(iter(self._dims_groups()))
        factor, base = self.factors[level], self.source.frames[dims]
        for d, a, b in ((self.y_dim, y0, y1), (self.x_dim, x0, x1)):
            base = base.where((F.col(d) >= a * factor) & (F.col(d) < b * factor))
        cells = self.chain(dims, level, base)[level]
        return cells.where((F.col(self.y_dim) >= y0) & (F.col(self.y_dim) < y1) & (F.col(self.x_dim) >= x0) & (F.col(self.x_dim) < x1))

    def auxiliary(self, level: int) -> str:
        """The names of coordinates that aren't an axis of their own, as the ``coordinates`` attribute has them."""
        t = self.templates[level]
        return " ".join([*(c.name for c in t.coords.values() if c.dims != (c.name,)), *(v.name for v in t.variables if v.coordinate)])

    def region_shape(self, level: int, name: str) -> tuple[int, ...]:
        """What is written at once: a shard, or a chunk where there are no shards."""
        e = self.encoding[f"/{level}"][name]
        return e.get("shards", e["chunks"])

    def region_count(self, level: int, name: str) -> int:
        v = self.source.variable(name)
        return region_count(tuple(self.templates[level].sizes[d] for d in v.dims), self.region_shape(level, name))


def create_pyramid(
    ds: Raster,
    levels: int | None = None,
    *,
    factors: Sequence[int] | None = None,
    x_dim: str = "x",
    y_dim: str = "y",
    method: str = "mean",
    target_chunk_bytes: int = TARGET_BYTES,
    chunks_per_shard: int | None = CHUNKS_PER_SHARD,
    layer_hints: Mapping[str, LayerHint] | None = None,
) -> Pyramid:
    """Plan a pyramid: factors, level sizes and coordinates, storage layout and metadata.  Runs no job."""
    steps = resolve_factors(levels, factors)
    check_method(method)
    check_shards(chunks_per_shard)
    if absent := {x_dim, y_dim} - set(ds.sizes):
        raise ValueError(f"the dataset has no dimension {', '.join(sorted(absent))}")
    spatial = ds.spatial(x_dim, y_dim)
    if not spatial:
        raise ValueError(f"no variable has both {y_dim} and {x_dim}")
    for v in spatial:
        if len(v.dims) > MAX_DIMS:
            raise ValueError(f"{v.name} has {len(v.dims)} dimensions; pyramids have at most {MAX_DIMS}")
        v.kind  # noqa: B018  an element type that can't be reduced raises now rather than halfway through a write
    for v in ds.variables:
        if len({x_dim, y_dim} & set(v.dims)) == 1:
            raise ValueError(f"{v.name} has only one of the dimensions {y_dim} and {x_dim}")
    for c in ds.coords.values():
        if len(c.dims) > 1 and {x_dim, y_dim} & set(c.dims):
            raise ValueError(f"the coordinate {c.name} has more than one dimension: give it as a variable that is a coordinate, with a value for each cell")
    ds.require_crs()
    templates = [replace(ds, frames={}, sizes=s) for s in level_sizes(ds.sizes, steps, x_dim, y_dim)]
    for i in range(1, len(steps)):
        step = steps[i] // steps[i - 1]
        unchunked = tuple(replace(v, chunks=None) for v in ds.variables)
        templates[i] = replace(templates[i], variables=unchunked, coords=coarsen_coords(templates[i - 1].coords, {x_dim: step, y_dim: step}))
    encoding = {f"/{i}": recommend_encoding(t, x_dim=x_dim, y_dim=y_dim, target_chunk_bytes=target_chunk_bytes, chunks_per_shard=chunks_per_shard) for i, t in enumerate(templates)}
    attrs = multiscale_attrs(ds, templates, steps, method, x_dim, y_dim, layer_hints)
    return Pyramid(ds, x_dim, y_dim, method, steps, templates, encoding, attrs)
