"""Pyramids in a store: level-partitioned Parquet, committed rewrites, and chunk blocks.

A store is a folder of any Hadoop file system::

    <root>/versions/<n>.json                       what the store holds since its n-th commit
    <root>/data/<id>/cells/<dims>/level=<n>/       cells of the variables with these dimensions
    <root>/data/<id>/side/level=<n>/               coordinates, variables' names and attributes of a level

A write puts everything below a new ``<id>`` and then adds a version that names it, which is
one small file that must not be there yet.  So a write that fails leaves all levels as
they were, readers see either all of a write or nothing, and of two writers that begin
with the same version one is refused.  What no version names any more is deleted.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.reduce import missing
from terrace.operators.pyramid import Pyramid
from terrace.operators.tiles import Block, Tiling, cell_batches, fits, levels_of, missing_cells, passes, pieces, small_batches, tiled_levels, tiling
from terrace.plans.layout import REGION_BYTES
from terrace.plans.metadata import to_json
from terrace.plans.raster import Coordinate, Variable
from terrace.sources.axes import restored_values, stored_values
from terrace.sources.stats import Progress, Stats, sums

SIDE = "kind string, name string, dims array<string>, dtype string, values string, attrs string"
DTYPES = {"u8": "<u1", "u16": "<u2", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cells_path(root: str, dims: Sequence[str], level: int | None = None) -> str:
    return f"{root}/cells/{'_'.join(dims)}" + (f"/level={level}" if level is not None else "")


def chosen_levels(pyramid: Pyramid, levels: Sequence[int] | None) -> list[int]:
    if levels is None:
        return list(range(pyramid.levels))
    if bad := [n for n in levels if isinstance(n, bool) or n not in range(pyramid.levels)]:
        raise ValueError(f"the pyramid has no level {bad[0]}")
    return sorted(set(levels))


def nonempty(df: DataFrame, dims: Sequence[str], region: Sequence[int], variables: Sequence[Variable]) -> DataFrame:
    """``<dim>_block`` of each region with a cell that isn't missing, and how many there are."""
    keys = [F.expr(f"cast(`{d}` div {r} as int)").alias(f"{d}_block") for d, r in zip(dims, region)]
    present = F.lit(False)
    for v in variables:
        present = present | ~missing(F.col(v.name), v.kind, v.fill)
    return df.groupBy(*keys).agg(F.count_if(present).alias("present")).where("present > 0")


def by_region(df: DataFrame, dims: Sequence[str], region: Sequence[int], variables: Sequence[Variable] = ()) -> DataFrame:
    """Cells dealt out by region and in its order, so that statistics of row groups let a window skip the others'.

    If variables are named, regions in which all of them are missing are left out, in the same exchange and sort.
    """
    blocks = {f"_{d}_block": F.expr(f"cast(`{d}` div {r} as int)") for d, r in zip(dims, region)}
    dealt = df.withColumns(blocks).repartition(*blocks).sortWithinPartitions(*blocks, *dims)
    if variables:
        present = [~missing(F.col(v.name), v.kind, v.fill) for v in variables]
        dealt = dealt.withColumn("_present", F.bool_or(reduce(or_, present)).over(Window.partitionBy(*blocks))).where("_present")
    return dealt.select(*df.columns)


def without_empty(df: DataFrame, dims: Sequence[str], region: Sequence[int], variables: Sequence[Variable]) -> DataFrame:
    """Cells of regions that aren't wholly missing; a reader takes absent cells as missing."""
    return by_region(df, dims, region, variables)


# Versions


def _put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small object that isn't there; ``FileExistsError`` if it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(f"{path} was written meanwhile; this write is left out") from e
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{root}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any]:
    """What a version, the last if none is named, says: ``attrs``, ``schemas``, and by level the ids below which cells and the rest lie."""
    there = versions(spark, root)
    if not there or version is not None and version not in there:
        raise FileNotFoundError(f"{root} has no version {version}" if there else f"{root} is no store")
    found = there[-1] if version is None else version
    return {**json.loads(read_text(spark, f"{root}/versions/{found:08d}.json")), "version": found}


def _commit(spark: SparkSession, root: str, made: dict[str, Any], history: int) -> None:
    _put_new(spark, f"{root}/versions/{made['version']:08d}.json", to_json({k: v for k, v in made.items() if k != "version"}))
    there = versions(spark, root)
    old, kept = there[: -1 - history], there[-1 - history :]
    ids = {n: set(manifest(spark, root, n)["levels"].values()) for n in there}
    for n in old:
        delete(spark, f"{root}/versions/{n:08d}.json")
    # A write that is still under way has an id that no version names yet: it is left alone.
    for i in set().union(*(ids[n] for n in old)) - set().union(*(ids[n] for n in kept)):
        delete(spark, f"{root}/data/{i}")


# Writing


def runs_of(levels: Sequence[int]) -> list[list[int]]:
    """Consecutive levels."""
    out: list[list[int]] = []
    for n in levels:
        if out and out[-1][-1] == n - 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def parts_of(pyramid: Pyramid, run: list[int], fused: bool) -> list[tuple[list[int], list[int]]]:
    """The levels that one job handles, the first of them being its source, and those that it writes."""
    if not fused:
        return [([n - 1, n] if n else [0], [n]) for n in run]
    first = run if run[0] == 0 else [run[0] - 1, *run]
    return [(p, p if i == 0 and run[0] == 0 else p[1:]) for i, p in enumerate(passes(pyramid, first)) if p != [run[0] - 1]]


def write(pyramid: Pyramid, root: str, *, mode: str = "w", levels: Sequence[int] | None = None, keep_levels_in_memory: bool | None = None, skip_empty: bool = True, stats: bool = False, on_level: Any = None, progress: Any = None, max_region_bytes: int = REGION_BYTES, max_workers: int | None = None, history: int = 0) -> dict[int, dict] | None:
    """Write levels.  ``w`` starts the store anew, ``w-`` refuses one that exists, ``a`` replaces only what it writes.

    All levels come from one pass over tiles of the source (``operators.tiles``) whose cells
    and levels a task has in memory, if the tiles of all tasks fit into the executors' memory;
    else, or if ``keep_levels_in_memory`` is false, each level is aggregated from the stored one
    before it, by Spark, which spills.  If it is true, not fitting is a ``MemoryError``.

    Nothing is replaced before all is written: see the module.  ``history`` older versions stay
    readable.  ``progress`` is True for a bar (tqdm), or gets the regions done and how many there
    are; ``on_level`` gets each level and its numbers.  ``max_workers`` bounds the tasks that
    reduce tiles at the same time, and ``max_region_bytes`` what a tile may take.
    """
    spark = next(iter(pyramid.source.frames.values())).sparkSession
    wanted = chosen_levels(pyramid, levels)
    if mode not in ("w", "w-", "a"):
        raise ValueError(f"mode must be w, w- or a, not {mode!r}")
    there = exists(spark, root)
    if there and mode == "w-":
        raise FileExistsError(f"{root} exists")
    if there and mode == "w" and wanted != list(range(pyramid.levels)):
        raise ValueError('mode "w" would delete the levels that are not written; use mode "a"')
    known = versions(spark, root) if there else []
    if there and not known and (mode == "w" or _names(spark, root)):
        raise FileExistsError(f"{root} holds something else than a pyramid and is left as it is")
    before = manifest(spark, root) if known else {"version": 0, "levels": {}, "schemas": {}}
    groups = pyramid._dims_groups()
    for n in wanted:
        if n and n - 1 not in wanted and (mode != "a" or str(n - 1) not in before["levels"]):
            raise FileNotFoundError(f"level {n} needs level {n - 1}, which is neither written now nor in the store")
    fused = keep_levels_in_memory
    if fused is not False:
        fit, need, room = fits(pyramid, wanted, max_region_bytes)
        if fused and not fit:
            raise MemoryError(f"keep_levels_in_memory=True: tiles need {need / 1e9:.2f} GB, the executors have room for {room / 1e9:.2f} GB")
        fused = fit
    made = uuid.uuid4().hex
    base = f"{root}/data/{made}"
    counts = {n: sum(pyramid.region_count(n, v.name) for of in groups.values() for v in of) for n in wanted}
    shown, out = Progress(progress, sum(counts.values())), {}
    try:
        _write_sides(pyramid, spark, base, wanted)
        for n in wanted:
            out[n] = dict.fromkeys(("rows", "skipped"), 0) | dict.fromkeys(("wall_s", "read_s", "reduce_s", "write_s"), 0.0)
            out[n] |= {"regions": counts[n], "workers": max_workers or spark.sparkContext.defaultParallelism, "region_shapes": {v.name: pyramid.region_shape(n, v.name) for of in groups.values() for v in of}}
        for dims in groups:
            for run in runs_of(wanted):
                for part, write_now in parts_of(pyramid, run, fused):
                    source = None
                    if part[0] not in write_now:
                        where = base if part[0] in run else f"{root}/data/{before['levels'][str(part[0])]}"
                        source = _cells(spark, f"{cells_path(where, dims)}/level={part[0]}", _schema(pyramid, dims))
                    share = sum(counts[n] for n in write_now) // len(groups)
                    put = _write_tiles if fused else _write_level
                    put(pyramid, dims, part, write_now, source, base, skip_empty and pyramid.method != "sum", out, shown, share, max_region_bytes, max_workers)
        ids = {n: i for n, i in before["levels"].items() if mode == "a"} | {str(n): made for n in wanted}
        manifested = {
            "version": before["version"] + 1, "attrs": pyramid.attrs, "levels": ids,
            "schemas": {"_".join(d): _schema(pyramid, d) for d in groups},
        }
        _commit(spark, root, manifested, history)
    except BaseException:
        delete(spark, base)
        raise
    shown.to(shown.total)
    result = Stats(out)
    for n in wanted:
        if on_level:
            on_level(n, result[n])
    return result if stats else None


def _schema(pyramid: Pyramid, dims: Sequence[str]) -> str:
    return ", ".join([*(f"`{d}` int" for d in dims), *(f"`{v.name}` {v.kind.spark}" for v in pyramid._dims_groups()[tuple(dims)])])


def _cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cells below a path; a level whose cells are all missing has none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _write_tiles(pyramid: Pyramid, dims: tuple[str, ...], part: list[int], wanted: list[int], source: DataFrame | None, base: str, sparse: bool, out: dict, shown: Progress, share: int, max_region_bytes: int, max_workers: int | None) -> None:
    """Levels from one pass over tiles, in one job."""
    if not wanted:
        return
    spark, began = next(iter(pyramid.source.frames.values())).sparkSession, time.time()
    counted = sums(spark)
    sides = {n: pyramid.region_shape(n, pyramid._dims_groups()[dims][0].name) for n in wanted}

    def emit(t: Tiling, tiles: Any) -> Any:
        axes = [dims.index(t.y), dims.index(t.x)]
        began = time.perf_counter()
        for key, values, there in tiles:
            read = time.perf_counter() - began
            seen = {"tiles": 1, ("read_s", wanted[0]): read}
            for b in levels_of(t, key, values, there):
                seen["reduce_s", max(b.level, wanted[0])] = seen.get(("reduce_s", max(b.level, wanted[0])), 0) + b.reduce_s
                if b.level not in wanted:
                    continue
                for piece in pieces(b, [sides[b.level][a] for a in axes]):
                    began = time.perf_counter()
                    if sparse and all_missing(t, piece):
                        seen["skipped", b.level] = seen.get(("skipped", b.level), 0) + 1
                    else:
                        yield from cell_batches(t, [piece])
                    seen["write_s", b.level] = seen.get(("write_s", b.level), 0) + time.perf_counter() - began
            counted.add(seen)
            began = time.perf_counter()

    t = tiling(pyramid, dims, part, max_region_bytes=max_region_bytes)
    df = tiled_levels(pyramid, dims, part, source, emit, max_region_bytes=max_region_bytes, parts=max_workers)
    at = F.col("level") - wanted[0]
    blocks = [F.floor(F.col(d) / F.element_at(F.array(*[F.lit(sides[n][i]) for n in wanted]), at + 1)) for i, d in enumerate(dims)]
    seen = Observation(f"levels-{time.time_ns()}")
    ordered = df.sortWithinPartitions("level").observe(seen, *[F.count_if(F.col("level") == n).alias(f"rows_{n}") for n in wanted])
    with small_batches(spark), shown.watched(counted, share, math.prod(t.counts)):
        ordered.write.partitionBy("level").parquet(f"{cells_path(base, dims)}/pass={part[0]}")
        _gathered(spark, cells_path(base, dims), part[0])
    wall, rows = time.time() - began, seen.get
    for n in wanted:
        out[n]["rows"] += rows[f"rows_{n}"]
        out[n]["wall_s"] += wall / len(wanted)
    for (name, n), v in ((k, v) for k, v in counted.value.items() if k != "tiles"):
        out[n][name] += v


def _gathered(spark: SparkSession, path: str, number: int) -> None:
    """The levels of a pass beside those of others; nothing reads them before the commit."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in _names(spark, f"{path}/pass={number}"):
        if name.startswith("level="):
            fs.rename(hadoop(f"{path}/pass={number}/{name}"), hadoop(f"{path}/{name}"))
    delete(spark, f"{path}/pass={number}")


def _write_level(pyramid: Pyramid, dims: tuple[str, ...], part: list[int], wanted: list[int], source: DataFrame | None, base: str, sparse: bool, out: dict, shown: Progress, share: int, max_region_bytes: int, max_workers: int | None) -> None:
    """One level, aggregated from the stored one before it."""
    (n,), began = wanted, time.time()
    df = pyramid.chain(dims, 0)[0] if source is None else pyramid.reduce_step(source, dims, n)
    variables = pyramid._dims_groups()[dims]
    put = by_region(df, dims, pyramid.region_shape(n, variables[0].name), variables if sparse else ())
    if max_workers:
        put = put.coalesce(max_workers)
    seen = Observation(f"level-{n}-{time.time_ns()}")
    put.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{cells_path(base, dims)}/level={n}")
    out[n]["rows"] += seen.get["rows"]
    out[n]["wall_s"] += time.time() - began
    out[n]["write_s"] += time.time() - began  # Spark reads, reduces and writes at once
    shown.to(shown.done + share)


def all_missing(t: Tiling, b: Block) -> bool:
    return all(bool((missing_cells(v, f) | ~b.there).all()) for v, f in zip(b.values, t.fields))


def _write_sides(pyramid: Pyramid, spark: SparkSession, base: str, levels: Sequence[int]) -> None:
    """Coordinates and variables of levels with their attributes, and cells of variables that aren't coarsened."""
    rows = []
    for level in levels:
        t = pyramid.templates[level]
        others = pyramid.auxiliary(level)
        for c in t.coords.values():
            kind, values, attrs = stored_values(c)
            rows.append((level, "coordinate", c.name, list(c.dims), kind, to_json(values), to_json({**attrs, **c.attrs})))
        for v in t.variables:
            attrs = {**v.attrs, **({"coordinates": others} if others and v.name not in others.split() else {}), "_FillValue": None if v.fill is None else str(v.fill)}
            rows.append((level, "variable", v.name, list(v.dims), v.dtype, None, to_json({**attrs, **pyramid.encoding[f"/{level}"].get(v.name, {})})))
        for dims, df in pyramid.source.frames.items():
            if dims not in pyramid._dims_groups():
                df.write.parquet(f"{cells_path(base, dims)}/level={level}")
    spark.createDataFrame(rows, f"level int, {SIDE}").coalesce(1).write.partitionBy("level").parquet(f"{base}/side")


# Reading


def read(spark: SparkSession, root: str, dims: Sequence[str], level: int, version: int | None = None) -> DataFrame:
    """The cells of one level."""
    made = manifest(spark, root, version)
    if str(level) not in made["levels"]:
        raise FileNotFoundError(f"{root} has no level {level}")
    path, schema = cells_path(f"{root}/data/{made['levels'][str(level)]}", dims, level), made["schemas"].get("_".join(dims))
    return _cells(spark, path, schema) if schema else spark.read.parquet(path)


def read_levels(spark: SparkSession, root: str, dims: Sequence[str], version: int | None = None) -> DataFrame:
    """All levels with their number in ``level``; a filter on it reads only that level's files."""
    made = manifest(spark, root, version)
    parts = [read(spark, root, dims, int(n), made["version"]).withColumn("level", F.lit(int(n))) for n in sorted(made["levels"], key=int)]
    return reduce(DataFrame.unionByName, parts)


def read_attrs(spark: SparkSession, root: str, version: int | None = None) -> str:
    return to_json(manifest(spark, root, version)["attrs"])


def read_side(spark: SparkSession, root: str, level: int, version: int | None = None) -> DataFrame:
    """Coordinates and variables of a level: ``kind, name, dims, dtype, values`` (JSON) and ``attrs`` (JSON)."""
    made = manifest(spark, root, version)
    return spark.read.schema(SIDE).parquet(f"{root}/data/{made['levels'][str(level)]}/side/level={level}")


def read_coords(spark: SparkSession, root: str, level: int, version: int | None = None) -> dict[str, Coordinate]:
    """The coordinates of a level, with values of the kinds they had."""
    rows = read_side(spark, root, level, version).where("kind = 'coordinate'").collect()  # as long as the axes
    return {r.name: restored_values(r.name, tuple(r.dims), r.dtype, json.loads(r["values"]), json.loads(r.attrs)) for r in rows}


def blocks(df: DataFrame, dims: Sequence[str], sizes: dict[str, int], v: Variable, block: Sequence[int]) -> DataFrame:
    """A variable's cells as chunks: ``block array<int>, shape array<int>, data binary``, row-major little-endian; absent cells are missing."""
    fill = v.fill if v.fill is not None else 0
    dtype, names, sides = np.dtype(DTYPES[v.dtype]), list(dims), list(block)
    whole = [sizes[d] for d in dims]
    kind_fill = v.kind.coerce(fill)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[names].to_numpy()
        which = at[0] // sides
        shape = np.minimum(sides, np.array(whole) - which * sides)
        data = np.full(shape, kind_fill, dtype)
        data[tuple((at - which * sides).T)] = pdf[v.name].to_numpy()
        return pd.DataFrame({"block": [which.tolist()], "shape": [shape.tolist()], "data": [data.tobytes()]})

    keys: list[Column] = [F.expr(f"`{d}` div {b}") for d, b in zip(dims, block)]
    return df.select(*dims, v.name).groupBy(*keys).applyInPandas(gather, "block array<int>, shape array<int>, data binary")


def cells(chunks: DataFrame, dims: Sequence[str], v: Variable, block: Sequence[int]) -> DataFrame:
    """The inverse of ``blocks``."""
    dtype, names, sides = np.dtype(DTYPES[v.dtype]), list(dims), np.array(block)

    def scatter(batches):
        for pdf in batches:
            for which, shape, data in zip(pdf["block"], pdf["shape"], pdf["data"]):
                values = np.frombuffer(data, dtype).reshape(shape)
                at = np.indices(values.shape).reshape(len(names), -1).T + np.asarray(which) * sides
                yield pd.DataFrame({**{d: at[:, i].astype(np.int32) for i, d in enumerate(names)}, v.name: values.ravel()})

    return chunks.select("block", "shape", "data").mapInPandas(scatter, ", ".join(f"`{d}` int" for d in dims) + f", `{v.name}` {v.kind.spark}")
