"""Zarr version 3 stores: a pyramid as groups of sharded arrays, and arrays as cells again.

A shard is one object, written by the task that holds its cells: the chunks one
after the other, then an index with each chunk's place and a check sum.  Chunks and shards
that are wholly missing are not written.  Tasks write whole objects, so one that runs again
leaves the same object; a task needs a file system that pyarrow knows (local, S3, GCS, HDFS).

A write goes to a folder beside the store.  When all of it is there, what it replaces is
renamed away and it is renamed to its place; if that fails, names are put back.  On object
stores a rename copies, and readers in those moments may see parts of both.

Reading opens only the chunks that a query asks for (``scan``), where pyarrow knows the file
system; elsewhere all of an array's objects go through Spark's own reader.  Arrays of version
2 and those of other writers are read too (``codecs``), and consolidated metadata is used and
written, so that a store is opened without listing it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.pyramid import Pyramid, create_pyramid
from terrace.operators.tiles import Tiling, fits, levels_of, pieces, small_batches, tiled_levels, tiling
from terrace.plans.layout import REGION_BYTES, Layout
from terrace.plans.metadata import attach_metadata, to_json
from terrace.plans.raster import Coordinate, Raster, Variable, densified, normalised
from terrace.sources.axes import restored_values, stored_values
from terrace.sources.checks import signed
from terrace.sources.codecs import NOWHERE, decode, pack, packed_text, require_known, unpacked_text, written_index
from terrace.sources.scan import Grid, Stored, file_system, referenced, scan
from terrace.sources.stats import Progress, Stats, sums
from terrace.sources.store import DTYPES, cells, chosen_levels, delete, exists, parts_of, runs_of

NAMES = {"u8": "uint8", "u16": "uint16", "i16": "int16", "i32": "int32", "i64": "int64", "f32": "float32", "f64": "float64"}
#: What a writer can add to the plain bytes.
PACKED: dict[str | None, list] = {None: [], "gzip": [{"name": "gzip", "configuration": {"level": 5}}], "zstd": [{"name": "zstd", "configuration": {"level": 3, "checksum": False}}]}
LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}
SUM = {"name": "crc32c"}
#: The folder of a group's places, and the attribute of arrays that says so.
PLACES = "references"
ITEM = {"u8": 1, "u16": 2, "i16": 2, "i32": 4, "i64": 8, "f32": 4, "f64": 8}


def packers(compressor: str | None, dtype: str, checked: bool = False) -> list[dict[str, Any]]:
    """The codecs of a chunk behind ``bytes``."""
    blosc = [{"name": "blosc", "configuration": {"cname": "lz4", "clevel": 5, "shuffle": "shuffle", "typesize": ITEM[dtype], "blocksize": 0}}]
    return [*(blosc if compressor == "blosc" else PACKED[compressor]), *([SUM] if checked else [])]


def _fill(v: Variable) -> Any:
    fill = v.kind.coerce(v.fill) if v.fill is not None else 0
    return "NaN" if isinstance(fill, float) and math.isnan(fill) else fill


def array_document(shape: Sequence[int], dtype: str, dims: Sequence[str], chunks: Sequence[int], shards: Sequence[int] | None, fill: Any, attrs: dict[str, Any], compressor: str | None = None, checked: bool = False) -> dict[str, Any]:
    codecs: list[dict[str, Any]] = [LITTLE, *packers(compressor, dtype, checked)]
    if shards is not None:
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [*chunks], "codecs": codecs, "index_codecs": [LITTLE, SUM], "index_location": "end"}}]
    return {
        "zarr_format": 3, "node_type": "array", "shape": [*shape], "data_type": NAMES[dtype],
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [*(shards or chunks)]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": fill, "codecs": codecs, "dimension_names": [*dims], "attributes": attrs,
    }


def _put(uri: str, data: bytes) -> None:
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def _uri(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + root.rstrip("/")


def pack_chunk(piece: np.ndarray, compressor: str | None = None, checked: bool = False) -> bytes:
    raw = pack(np.ascontiguousarray(piece).tobytes(), compressor, piece.dtype.itemsize)
    return signed(raw) if checked else raw


def _all(piece: np.ndarray, fill: Any) -> bool:
    return bool(np.isnan(piece).all() if fill != fill else (piece == fill).all())


def pack_shard(data: np.ndarray, chunks: Sequence[int], fill: Any, compressor: str | None = None, checked: bool = False) -> bytes | None:
    """The bytes of a shard, ``data`` having its full shape; None if all is missing."""
    counts = [s // c for s, c in zip(data.shape, chunks)]
    parts, index, at = [], [], 0
    for where in np.ndindex(*counts):
        piece = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(where, chunks))]
        if _all(piece, fill):
            index += [NOWHERE, NOWHERE]
            continue
        raw = pack_chunk(piece, compressor, checked)
        parts.append(raw)
        index += [at, len(raw)]
        at += len(raw)
    return b"".join(parts) + written_index(index) if parts else None


def unpack_shard(raw: bytes, shard: Sequence[int], chunks: Sequence[int], dtype: str, fill: Any) -> np.ndarray:
    """The inverse of ``pack_shard`` without a compressor."""
    return decode(raw, [{"name": "sharding_indexed", "configuration": {"chunk_shape": [*chunks], "codecs": [LITTLE], "index_codecs": [LITTLE, SUM]}}], shard, DTYPES[dtype], fill)


@dataclass(frozen=True)
class Target:
    """Where a variable's objects go and what they look like."""

    name: str
    base: str
    dtype: str
    block: list[int]
    chunks: list[int] | None
    fill: Any
    compressor: str | None
    checked: bool

    def put(self, at: Sequence[int], data: np.ndarray) -> bool:
        """Write one shard, or chunk where there are no shards; False if all is missing."""
        if self.chunks is None:
            raw = None if _all(data, self.fill) else pack_chunk(data, self.compressor, self.checked)
        else:
            raw = pack_shard(data, self.chunks, self.fill, self.compressor, self.checked)
        if raw is not None:
            _put(f"{self.base}/c/{'/'.join(map(str, at))}", raw)
        return raw is not None


def _target(uri: str, path: str, v: Variable, e: Layout, compressor: str | None, checked: bool) -> Target:
    fill = v.kind.coerce(v.fill) if v.fill is not None else 0
    shards = e.get("shards")
    return Target(v.name, f"{uri}/{path}", v.dtype, [*(shards or e["chunks"])], [*e["chunks"]] if shards else None, fill, compressor, checked)


def write_array(df: DataFrame, root: str, path: str, dims: Sequence[str], sizes: dict[str, int], v: Variable, chunks: Sequence[int], shards: Sequence[int] | None = None, attrs: dict[str, Any] | None = None, compressor: str | None = None) -> int:
    """Write a variable's cells as an array, plain or by ``gzip``, ``zstd`` or ``blosc``; the number of objects written."""
    base = f"{_uri(root)}/{path}"
    block = list(shards or chunks)
    fill = v.kind.coerce(v.fill) if v.fill is not None else 0
    _put(f"{base}/zarr.json", to_json(array_document([sizes[d] for d in dims], v.dtype, dims, chunks, shards, _fill(v), attrs or {}, compressor)).encode())
    names, dtype = list(dims), np.dtype(DTYPES[v.dtype])
    target = Target(v.name, base, v.dtype, block, [*chunks] if shards is not None else None, fill, compressor, False)

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[names].to_numpy()
        which = at[0] // block
        data = np.full(block, fill, dtype)
        data[tuple((at - which * block).T)] = pdf[v.name].to_numpy()
        return pd.DataFrame({"written": [int(target.put(which, data))]})

    keys = [F.expr(f"`{d}` div {b}") for d, b in zip(dims, block)]
    return df.select(*dims, v.name).groupBy(*keys).applyInPandas(store, "written int").agg(F.sum("written")).first()[0] or 0


# Pyramids


def _axis(c: Coordinate) -> tuple[dict[str, Any], bytes]:
    """The document of a coordinate's array and its one chunk."""
    kind, values, found = stored_values(c)
    attrs, shape = {**found, **c.attrs}, [len(values)] if c.dims else []
    if not c.dims and len(values) != 1:
        raise ValueError(f"the coordinate {c.name} has no dimension and {len(values)} values")
    if kind != "text":
        return array_document(shape, kind, c.dims, [max(n, 1) for n in shape], None, "NaN" if kind != "i64" else 0, attrs), np.array(values, DTYPES[kind]).tobytes()
    doc = array_document(shape, "f64", c.dims, [max(n, 1) for n in shape], None, "", attrs)
    return {**doc, "data_type": "string", "codecs": [{"name": "vlen-utf8"}]}, packed_text(values)


def write_pyramid(
    pyramid: Pyramid, root: str, *, mode: str = "w", levels: Sequence[int] | None = None, compressor: str | None = None, checked: bool = False, keep_levels_in_memory: bool | None = None,
    stats: bool = False, progress: Any = None, max_region_bytes: int = REGION_BYTES, max_workers: int | None = None, from_source: bool = False,
) -> dict[int, Any]:
    """Write levels as groups ``/0``, ``/1`` and so on below a root with the pyramid's attributes.

    ``compressor`` is ``gzip``, ``zstd`` or ``blosc``; with ``checked`` each chunk ends with its check
    sum.  Levels come from one pass over tiles, as in ``store.write``, where the other arguments are told; a level
    whose predecessor isn't written needs it in the store, but for level 1 with ``from_source``, when level 0 stays
    where it is (see ``write_references``).  The number of objects written by level,
    or with ``stats`` all numbers.
    """
    return _write(pyramid, root, lambda n: f"{n}/", pyramid.attrs, mode, levels, compressor, checked, keep_levels_in_memory, stats, progress, max_region_bytes, max_workers, from_source)


def write_flat(ds: Raster, root: str, *, mode: str = "w", encoding: dict[str, Layout] | None = None, x_dim: str = "x", y_dim: str = "y", compressor: str | None = None, checked: bool = False, **more: Any) -> Any:
    """Write a dataset without coarser levels as one group, with its metadata and the ``encoding`` given (that of ``recommend_encoding`` if None)."""
    p = create_pyramid(ds, 1, x_dim=x_dim, y_dim=y_dim)
    if encoding:
        p = replace(p, encoding={"/0": {**p.encoding["/0"], **encoding}})
    out = _write(p, root, lambda n: "", attach_metadata(ds, x_dim=x_dim, y_dim=y_dim).attrs, mode, None, compressor, checked, None, more.pop("stats", False), more.pop("progress", None), REGION_BYTES, None)
    return out[0]


def _write(pyramid: Pyramid, root: str, place: Callable[[int], str], attrs: dict[str, Any], mode: str, levels: Sequence[int] | None, compressor: str | None, checked: bool, fused: bool | None, stats: bool, progress: Any, max_region_bytes: int, max_workers: int | None, from_source: bool = False) -> dict[int, Any]:
    if compressor not in (*PACKED, "blosc"):
        raise ValueError(f"compressor must be gzip, zstd, blosc or None, not {compressor!r}")
    if mode not in ("w", "w-", "a"):
        raise ValueError(f"mode must be w, w- or a, not {mode!r}")
    spark = next(iter(pyramid.source.frames.values())).sparkSession
    wanted, uri, groups = chosen_levels(pyramid, levels), _uri(root), pyramid._dims_groups()
    there = exists(spark, uri)
    if there and mode == "w-":
        raise FileExistsError(f"{root} exists")
    if there and mode == "w":
        if not exists(spark, f"{uri}/zarr.json"):
            raise FileExistsError(f"{root} holds something else than a Zarr store and is left as it is")
        if wanted != list(range(pyramid.levels)):
            raise ValueError('mode "w" would delete the levels that are not written; use mode "a"')
    for n in wanted:
        if n and n - 1 not in wanted and not (n == 1 and from_source) and not (mode == "a" and all(exists(spark, f"{uri}/{place(n - 1)}{v.name}/zarr.json") for of in groups.values() for v in of)):
            raise FileNotFoundError(f"level {n} needs level {n - 1}, which is neither written now nor in the store")
    fit, need, room = fits(pyramid, wanted, max_region_bytes)
    if fused and not fit:
        raise MemoryError(f"keep_levels_in_memory=True: tiles need {need / 1e9:.2f} GB, the executors have room for {room / 1e9:.2f} GB")
    fused = fit if fused is None else fused
    staged = f"{uri}.staging-{uuid.uuid4().hex}"
    counts = {n: sum(pyramid.region_count(n, v.name) for of in groups.values() for v in of) for n in wanted}
    shown, docs = Progress(progress, sum(counts.values())), {}
    out: dict[int, dict[str, Any]] = {}
    try:
        for n in wanted:
            out[n] = {"objects": 0, "regions": counts[n], "skipped": 0, "workers": max_workers or spark.sparkContext.defaultParallelism, "wall_s": 0.0, "read_s": 0.0, "reduce_s": 0.0, "write_s": 0.0}
            out[n]["region_shapes"] = {v.name: pyramid.region_shape(n, v.name) for of in groups.values() for v in of}
            docs |= _write_level_documents(pyramid, staged, place(n), n, compressor, checked)
            for dims, df in pyramid.source.frames.items():
                if dims and dims not in groups:
                    for v in pyramid.source.variables:
                        if v.dims == dims:
                            out[n]["objects"] += write_array(df, staged, f"{place(n)}{v.name}", dims, pyramid.source.sizes, v, [pyramid.source.sizes[d] for d in dims], None, v.attrs)
                            docs[f"{place(n)}{v.name}"] = _json(spark, f"{staged}/{place(n)}{v.name}/zarr.json")
        for dims in groups:
            for run in runs_of(wanted):
                for part, now in parts_of(pyramid, run, fused):
                    base = staged if part[0] in run else uri
                    grid = _grid_of_level(spark, f"{base}/{place(part[0])}", groups[dims]) if part[0] not in now and not (part[0] == 0 and from_source) else None
                    share = sum(counts[n] for n in now) // len(groups)
                    _write_pass(pyramid, dims, part, now, grid, staged, place, compressor, checked, out, shown, share, max_region_bytes, max_workers)
        _swap(spark, uri, staged, docs, attrs, mode == "a" and there)
    except BaseException:
        delete(spark, staged)
        raise
    shown.to(shown.total)
    return Stats(out if stats else {n: o["objects"] for n, o in out.items()})


def _write_level_documents(pyramid: Pyramid, staged: str, prefix: str, n: int, compressor: str | None, checked: bool) -> dict[str, dict[str, Any]]:
    """The documents of a level's group and arrays, and its coordinates; the documents by path."""
    t, docs = pyramid.templates[n], {}
    if prefix:
        docs[prefix.rstrip("/")] = {"zarr_format": 3, "node_type": "group", "attributes": t.attrs}
    others = pyramid.auxiliary(n)
    for c in t.coords.values():
        docs[f"{prefix}{c.name}"], raw = _axis(c)
        _put(f"{staged}/{prefix}{c.name}/c{'/0' * len(c.dims)}", raw)
    for dims, of in pyramid._dims_groups().items():
        for v in of:
            e = pyramid.encoding[f"/{n}"][v.name]
            attrs = {**v.attrs, **({"coordinates": others} if others and v.name not in others.split() else {})}
            docs[f"{prefix}{v.name}"] = array_document([t.sizes[d] for d in dims], v.dtype, dims, e["chunks"], e.get("shards"), _fill(v), attrs, compressor, checked)
    for path, doc in docs.items():
        _put(f"{staged}/{path}/zarr.json", to_json(doc).encode())
    return docs


METRICS = "level int, variable int, shard array<int>, start array<int>, shape array<int>, data binary, objects long, skipped long, read_s double, reduce_s double, write_s double"
_KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=[c.split()[0] for c in METRICS.split(", ")])


def _measured(level: int, objects: int = 0, skipped: int = 0, read_s: float = 0.0, reduce_s: float = 0.0, write_s: float = 0.0) -> tuple:
    return (level, -1, [], [], [], None, objects, skipped, read_s, reduce_s, write_s)


def _write_pass(pyramid: Pyramid, dims: tuple[str, ...], part: list[int], wanted: list[int], grid: Grid | None, staged: str, place: Callable[[int], str], compressor: str | None, checked: bool, out: dict, shown: Progress, share: int, max_region_bytes: int, max_workers: int | None) -> None:
    """Levels from one pass over tiles.

    A shard that lies in one tile is written by the task that reduced it; parts of others
    travel once more, as blocks, to the task that puts them together.
    """
    spark, began = next(iter(pyramid.source.frames.values())).sparkSession, time.time()
    of = pyramid._dims_groups()[dims]
    targets = {n: [_target(staged, f"{place(n)}{v.name}", v, pyramid.encoding[f"/{n}"][v.name], compressor, checked) for v in of] for n in wanted}
    sizes = {n: [pyramid.templates[n].sizes[d] for d in dims] for n in wanted}
    counted = sums(spark)

    def emit(t: Tiling, tiles: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        y, x = dims.index(t.y), dims.index(t.x)
        rest = [i for i in range(len(dims)) if i not in (y, x)]
        began = time.perf_counter()
        for key, values, there in tiles:
            rows = [_measured(wanted[0], read_s=time.perf_counter() - began)]
            for b in levels_of(t, key, values, there):
                rows.append(_measured(max(b.level, wanted[0]), reduce_s=b.reduce_s))
                if b.level not in wanted:
                    continue
                for i, target in enumerate(targets[b.level]):
                    for piece in pieces(b, [target.block[y], target.block[x]]):
                        began = time.perf_counter()
                        start, shape = [0] * len(dims), [1] * len(dims)
                        for axis, k in zip(rest, piece.start):
                            start[axis] = k
                        start[y], start[x] = piece.start[-2:]
                        shape[y], shape[x] = piece.there.shape
                        plane = np.where(piece.there, piece.values[i], target.fill).astype(DTYPES[target.dtype])
                        data = plane.reshape(shape) if y < x else plane.T.reshape(shape)
                        shard = [s // n for s, n in zip(start, target.block)]
                        whole = [min(n, z - k * n) for n, z, k in zip(target.block, sizes[b.level], shard)]
                        if shape == whole:
                            full = np.full(target.block, target.fill, data.dtype)
                            full[tuple(slice(0, n) for n in shape)] = data
                            put = target.put(shard, full)
                            rows.append(_measured(b.level, int(put), int(not put), write_s=time.perf_counter() - began))
                        else:
                            rows.append((b.level, i, shard, start, shape, None if _all(data, target.fill) else data.tobytes(), 0, 0, 0.0, 0.0, time.perf_counter() - began))
            counted.add({"tiles": 1})
            yield _batch(rows)
            began = time.perf_counter()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        full: np.ndarray | None = None
        for batch in batches:
            rows = []
            places, parts, measured = batch.columns[:5], batch.column(5), batch.columns[6:]
            for at, (level, variable, shard, start, shape, *numbers) in enumerate(zip(*(c.to_pylist() for c in (*places, *measured)))):
                rows.append((level, -1, [], [], [], None, *numbers))
                if variable < 0:
                    continue
                key = (level, variable, tuple(shard))
                if key != now:
                    if now is not None:
                        rows.append(finished(now, full))
                    now = key
                    full = np.full(targets[level][variable].block, targets[level][variable].fill, DTYPES[targets[level][variable].dtype])
                if (data := parts[at].as_buffer()) is not None:
                    inside = tuple(slice(s - k * n, s - k * n + m) for s, k, n, m in zip(start, shard, targets[level][variable].block, shape))
                    full[inside] = np.frombuffer(data, full.dtype).reshape(shape)
            yield _batch(rows)
        if now is not None:
            yield _batch([finished(now, full)])

    def finished(key: tuple, full: np.ndarray) -> tuple:
        began = time.perf_counter()
        put = targets[key[0]][key[1]].put(key[2], full)
        return _measured(key[0], int(put), int(not put), write_s=time.perf_counter() - began)

    cells = None
    if grid is not None:
        pyramid = replace(pyramid, source=replace(pyramid.source, stored={}))
        cells = scan(spark, grid)
    t = tiling(pyramid, dims, part, max_region_bytes=max_region_bytes)
    made = tiled_levels(pyramid, dims, part, cells, emit, METRICS, max_region_bytes=max_region_bytes, parts=max_workers)
    met = made.repartition("level", "variable", "shard").sortWithinPartitions("level", "variable", "shard").mapInArrow(join, METRICS)
    names = ("objects", "skipped", "read_s", "reduce_s", "write_s")
    with small_batches(spark), shown.watched(counted, share, math.prod(t.counts)):
        found = met.groupBy("level").agg(*[F.sum(n).alias(n) for n in names]).collect()
    for r in found:
        for n in names:
            out[r.level][n] += r[n]
    for n in wanted:
        out[n]["wall_s"] += (time.time() - began) / len(wanted)


def _swap(spark: SparkSession, uri: str, staged: str, docs: dict[str, dict[str, Any]], attrs: dict[str, Any], append: bool) -> None:
    """Put what was staged in its place, whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(uri).getFileSystem(spark._jsc.hadoopConfiguration())
    known = _consolidated(spark, uri, "") if append else {}
    if known is None:  # what other writers left is listed once
        tops = {p: d for p, d in _children(spark, uri, "").items() if d["node_type"] != "unknown"}
        known = tops | {f"{p}/{q}": x for p, d in tops.items() if d["node_type"] == "group" for q, x in _children(spark, uri, p).items() if x["node_type"] != "unknown"}
    known = {p: d for p, d in known.items() if d.get("zarr_format") == 3} | docs
    root = {"zarr_format": 3, "node_type": "group", "attributes": attrs, "consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": dict(sorted(known.items()))}}
    _put(f"{staged}/zarr.json", to_json(root).encode())
    gone = f"{uri}.replaced-{uuid.uuid4().hex}"
    moved: list[tuple[str, str]] = []

    def move(a: str, b: str) -> None:
        fs.mkdirs(hadoop(b).getParent())
        if not fs.rename(hadoop(a), hadoop(b)):
            raise OSError(f"{a} could not be renamed to {b}")
        moved.append((a, b))

    # Beside what is there: array by array, and the documents of groups; other arrays of a group stay.
    parts = [p if docs[p]["node_type"] == "array" else f"{p}/zarr.json" for p in sorted(docs)] if append else [""]
    try:
        for p in [*parts, *(["zarr.json"] if append else [])]:
            here = f"{uri}/{p}".rstrip("/")
            if exists(spark, here):
                move(here, f"{gone}/{p}".rstrip("/"))
            move(f"{staged}/{p}".rstrip("/"), here)
    except BaseException:
        for a, b in reversed(moved):
            fs.rename(hadoop(b), hadoop(a))
        delete(spark, gone)
        raise
    delete(spark, gone)
    delete(spark, staged)


# Documents


def _json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A small object, which may have a name that Spark's readers skip."""
    raw = _object(spark, path)
    return None if raw is None else json.loads(raw)


def _object(spark: SparkSession, path: str) -> bytes | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _at(root: str, path: str) -> str:
    return f"{_uri(root)}/{path.strip('/')}".rstrip("/")


def _from_version_2(base: str, old: dict[str, Any] | None, attrs: dict[str, Any]) -> dict[str, Any]:
    """What stands for a ``zarr.json`` in version 2."""
    if old is None:
        return {"zarr_format": 2, "node_type": "group", "attributes": attrs}
    if old.get("filters"):
        raise ValueError(f"{base} has filters, which aren't known")
    if not isinstance(old["dtype"], str):
        raise ValueError(f"{base} has cells of several fields")
    kind, rank, attrs = np.dtype(old["dtype"]), len(old["shape"]), dict(attrs)
    codecs: list[dict[str, Any]] = [{"name": "transpose", "configuration": {"order": [*range(rank)][::-1]}}] if old.get("order") == "F" and rank > 1 else []
    codecs.append({"name": "bytes", "configuration": {"endian": "big" if kind.byteorder == ">" else "little"}})
    codecs += [{"name": old["compressor"]["id"], "configuration": old["compressor"]}] if old.get("compressor") else []
    return {
        "zarr_format": 2, "node_type": "array", "shape": old["shape"], "data_type": kind.name,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": old["chunks"]}},
        "chunk_key_encoding": {"name": "v2", "configuration": {"separator": old.get("dimension_separator") or "."}},
        "fill_value": old["fill_value"], "codecs": codecs, "dimension_names": attrs.pop("_ARRAY_DIMENSIONS", None), "attributes": attrs,
    }


def read_document(spark: SparkSession, root: str, path: str = "") -> dict[str, Any]:
    """A group's or array's ``zarr.json``; what stands for it in version 2 is given in the same form."""
    base = _at(root, path)
    if (doc := _json(spark, f"{base}/zarr.json")) is not None:
        return doc
    attrs = _json(spark, f"{base}/.zattrs") or {}
    if (old := _json(spark, f"{base}/.zarray")) is None and _json(spark, f"{base}/.zgroup") is None:
        raise FileNotFoundError(f"{base} is no Zarr group or array")
    return _from_version_2(base, old, attrs)


def _consolidated(spark: SparkSession, root: str, path: str) -> dict[str, dict[str, Any]] | None:
    """The documents below a group by their path from it, if it or the root has them all in one object."""
    for base, inside in ((_at(root, path), ""), (_at(root, ""), path.strip("/"))):
        if (doc := _json(spark, f"{base}/zarr.json")) is not None:
            found = (doc.get("consolidated_metadata") or {}).get("metadata")
            if found is None:
                continue
            docs = found
        elif (doc := _json(spark, f"{base}/.zmetadata")) is not None:
            metadata, docs = doc["metadata"], {}
            for key in metadata:
                name, _, kind = key.rpartition("/")
                if kind in (".zarray", ".zgroup") and name:
                    try:
                        docs[name] = _from_version_2(f"{base}/{name}", metadata[key] if kind == ".zarray" else None, metadata.get(f"{name}/.zattrs", {}))
                    except ValueError as e:
                        docs[name] = {"node_type": "unknown", "why": str(e)}
        else:
            continue
        prefix = f"{inside}/" if inside else ""
        if not inside or inside in docs or any(p.startswith(prefix) for p in docs):
            return {p[len(prefix) :]: d for p, d in docs.items() if p.startswith(prefix) and p != inside}
    return None


def _children(spark: SparkSession, root: str, path: str) -> dict[str, dict[str, Any]]:
    """The documents of what a group holds by name; a document that can't be read says why."""
    found = _consolidated(spark, root, path)
    if found is not None:
        return {p: d for p, d in sorted(found.items()) if "/" not in p}
    base = _at(root, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    out = {}
    for name in sorted(s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if s.isDirectory()):
        try:
            out[name] = read_document(spark, base, name)
        except FileNotFoundError:
            continue
        except ValueError as e:
            out[name] = {"node_type": "unknown", "why": str(e)}
    return out


def _described(doc: dict[str, Any], path: str) -> tuple[Variable, Any]:
    """The variable that an array holds and what cells without a chunk are, None if that isn't said."""
    dtype = {n: t for t, n in NAMES.items()}.get(doc["data_type"])
    if dtype is None:
        raise ValueError(f"{path} has cells of type {doc['data_type']}; known are {', '.join(NAMES.values())}")
    dims = tuple(n or f"dim_{i}" for i, n in enumerate(doc.get("dimension_names") or [None] * len(doc["shape"])))
    fill = float(doc["fill_value"]) if isinstance(doc["fill_value"], str) else doc["fill_value"]
    name, chunks, attrs = path.rstrip("/").rsplit("/", 1)[-1], tuple(doc["chunk_grid"]["configuration"]["chunk_shape"]), {k: x for k, x in (doc.get("attributes") or {}).items() if k != PLACES}
    # In version 2 the fill value is what stands for a missing cell; in version 3 an attribute tells it.
    missing = {"_FillValue": fill} if doc["zarr_format"] == 2 and fill is not None and "_FillValue" not in attrs else {}
    return Variable(name, dims, dtype, attrs, missing, chunks), fill


# Reading


def stored_array(doc: dict[str, Any], base: str, name: str) -> tuple[Variable, Stored]:
    """An array's variable and where its chunks are; raises if they can't be read."""
    v, fill = _described(doc, name)
    require_known(doc["codecs"])
    keys = doc.get("chunk_key_encoding") or {"name": "default"}
    separator = (keys.get("configuration") or {}).get("separator", "/" if keys["name"] == "default" else ".")
    prefix = f"c{separator}" if keys["name"] == "default" else ""
    return v, Stored("value" if v.name in v.dims else v.name, v.dtype, base, prefix, separator, doc["codecs"], fill)


def _places(doc: dict[str, Any], base: str) -> str:
    """Where an array's table of places is, if it has one."""
    return f"{base.rsplit('/', 1)[0]}/{PLACES}" if (doc.get("attributes") or {}).get(PLACES) == f"../{PLACES}" else ""


def array_grid(spark: SparkSession, root: str, path: str) -> tuple[Variable, Grid]:
    """An array's variable and its chunks."""
    doc = read_document(spark, root, path)
    v, stored = stored_array(doc, _at(root, path), path)
    if not v.dims:
        raise ValueError(f"{path} has no dimensions")
    return v, Grid([*v.dims], doc["shape"], [*v.chunks], [stored], _places(doc, _at(root, path)))


def _grid_of_level(spark: SparkSession, base: str, of: Sequence[Variable]) -> Grid:
    """Arrays with the same dimensions; their chunks are the greatest that all share, or those of one if they differ."""
    made = [array_grid(spark, base, v.name) for v in of]
    if any(g.block != made[0][1].block for _, g in made):
        raise ValueError(f"{', '.join(v.name for v in of)} have different chunks and can't be read at once")
    return Grid(made[0][1].dims, made[0][1].shape, made[0][1].block, [g.arrays[0] for _, g in made])


def read_array(spark: SparkSession, root: str, path: str) -> DataFrame:
    """An array's cells: an INT column for each dimension and one with the array's name, or ``value`` for a dimension's own coordinate; cells that aren't stored are absent, which readers take as missing."""
    v, grid = array_grid(spark, root, path)
    return _grid_cells(spark, grid)


def read_references(references: DataFrame, grid: Grid) -> DataFrame:
    """The cells of arrays whose chunks lie in other files, at the places that ``references`` (``scan.REFERENCES``) names."""
    return referenced(references, grid)


def write_references(references: DataFrame, grid: Grid, root: str, path: str, attrs: dict[str, Any] | None = None) -> None:
    """Arrays at ``path`` whose chunks stay where ``references`` says; the table is kept beside them, and ``read_array`` and ``open_group`` follow it."""
    base = _at(root, path)
    _put(f"{base}/zarr.json", to_json({"zarr_format": 3, "node_type": "group", "attributes": attrs or {}}).encode())
    references.select("name", "chunk", "path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length")).write.mode("overwrite").parquet(f"{base}/{PLACES}")
    for a in grid.arrays:
        fill = "NaN" if isinstance(a.fill, float) and math.isnan(a.fill) else a.fill
        doc = array_document(grid.shape, a.dtype, grid.dims, grid.block, None, fill, {PLACES: f"../{PLACES}", "_FillValue": fill})
        _put(f"{base}/{a.name}/zarr.json", to_json({**doc, "codecs": a.codecs}).encode())


def _grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    if grid.references:
        return referenced(spark.read.parquet(grid.references), grid)
    if file_system(grid.arrays[0].base) is not None:
        return scan(spark, grid)
    (array,) = grid.arrays
    return _listed_cells(spark, grid, array)


def _listed_cells(spark: SparkSession, grid: Grid, array: Stored) -> DataFrame:
    """The same through Spark's reader of whole objects, for file systems that only Spark opens."""
    dims, shape, block, codecs, dtype = grid.dims, grid.shape, grid.block, array.codecs, DTYPES[array.dtype]
    separator, fill = array.separator, array.fill
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*[0-9]").load(array.base).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, raw in zip(pdf["path"], pdf["content"]):
                key = where.rsplit("/", 1)[1].split(".") if separator == "." else where.split("/")
                at = [int(x) for x in key[-len(dims) :]]
                data = decode(raw, codecs, block, dtype, 0 if fill is None else fill)
                inside = data[tuple(slice(0, n - i * b) for n, i, b in zip(shape, at, block))]
                yield pd.DataFrame({"block": [at], "shape": [[*inside.shape]], "data": [np.ascontiguousarray(inside).tobytes()]})

    made = objects.mapInPandas(parse, "block array<int>, shape array<int>, data binary")
    return cells(made, dims, Variable(array.name, tuple(dims), array.dtype), block)


def read_axis(spark: SparkSession, root: str, name: str, doc: dict[str, Any] | None = None) -> Coordinate:
    """A coordinate along one dimension, of none, or text; an axis is small and read by the driver."""
    doc = doc or read_document(spark, root, name)
    base, rank = _at(root, name), len(doc["shape"])
    dims = tuple(n or f"dim_{i}" for i, n in enumerate(doc.get("dimension_names") or [None] * rank))
    keys = doc.get("chunk_key_encoding") or {"name": "default"}
    default = keys["name"] == "default"
    separator = (keys.get("configuration") or {}).get("separator", "/" if default else ".")
    size = math.prod(doc["shape"])
    step = doc["chunk_grid"]["configuration"]["chunk_shape"][0] if rank else 1
    text = doc["data_type"] == "string"
    fill = doc["fill_value"] if text else float(doc["fill_value"]) if isinstance(doc["fill_value"], str) else doc["fill_value"] or 0
    values: list[Any] = []
    for i in range(-(-size // step)):
        raw = _object(spark, f"{base}/c{separator}{i}" if default and rank else f"{base}/{i if rank else 'c' if default else '0'}")
        if text:
            values += [fill] * step if raw is None else unpacked_text(raw)
        else:
            dtype = np.dtype(doc["data_type"])
            values += ([fill] * step if raw is None else decode(raw, doc["codecs"], [step], dtype.str, fill).tolist())
    return restored_values(name, dims, "text" if text else "", values[:size], doc.get("attributes") or {})


def open_group(spark: SparkSession, root: str, path: str = "", *, crs: str | None = None) -> Raster:
    """The arrays of a group as a dataset: one-dimensional ones named as their dimension are coordinates, scalars are left out.

    Variables that share their dimensions and chunks come by one scan, others by one union and one
    exchange.  Where cells without a chunk have a value that isn't missing, the whole grid is made.
    An array that can't be read is left out, with a warning.
    """
    base = _at(root, path)
    group = read_document(spark, root, path)
    sizes: dict[str, int] = {}
    coords: dict[str, Coordinate] = {}
    stored: dict[tuple[str, ...], list[tuple[Variable, Any, Grid]]] = {}
    for name, doc in _children(spark, root, path).items():
        if name == PLACES:
            continue
        try:
            if doc["node_type"] == "unknown":
                raise ValueError(doc["why"])
            if doc["node_type"] != "array" or not doc["shape"]:
                continue
            if doc.get("dimension_names") == [name]:
                coords[name] = read_axis(spark, base, name, doc)
                found = {name: doc["shape"][0]}
            else:
                v, place = stored_array(doc, f"{base}/{name}", name)
                found = dict(zip(v.dims, doc["shape"]))
                stored.setdefault(v.dims, []).append((v, place.fill, Grid([*v.dims], doc["shape"], [*v.chunks], [place], _places(doc, f"{base}/{name}"))))
        except (ValueError, TypeError) as e:
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
            continue
        for d, n in found.items():
            if sizes.setdefault(d, n) != n:
                raise ValueError(f"{name} has {n} cells along {d}, others have {sizes[d]}")
    # Arrays that others name as their coordinates, over both dimensions of a grid, are carried by mean.
    named = {n for arrays in stored.values() for v, *_ in arrays for n in str(v.attrs.get("coordinates", "")).split()}
    stored = {dims: [(replace(v, coordinate=v.name in named and len(dims) > 1 and v.kind.is_float), *more) for v, *more in arrays] for dims, arrays in stored.items()}
    frames, grids = {}, {}
    for dims, arrays in stored.items():
        frames[dims], grid = _together(spark, dims, sizes, arrays)
        if grid is not None:
            grids[dims] = (frames[dims], grid)
    attrs = group.get("attributes") or {}
    return Raster(sizes, tuple(v for arrays in stored.values() for v, *_ in arrays), frames, coords, crs or attrs.get("proj:code"), attrs, grids)


def _together(spark: SparkSession, dims: tuple[str, ...], sizes: dict[str, int], arrays: list[tuple[Variable, Any, Grid]]) -> tuple[DataFrame, Grid | None]:
    """The cells of arrays that share their dimensions, and their one grid if they share chunks and absent cells are missing."""
    whole, variables = False, []
    for v, fill, _ in arrays:
        same = fill is None or (v.fill is not None and (fill == v.fill or (fill != fill and v.fill != v.fill)))
        whole |= not same
        variables.append(v if fill is None else replace(v, encoding={"_FillValue": fill}))
    grids = [g for *_, g in arrays]
    one = all((g.block, g.references) == (grids[0].block, grids[0].references) for g in grids) and (bool(grids[0].references) or file_system(grids[0].arrays[0].base) is not None)
    if one:
        grids = [replace(grids[0], arrays=[g.arrays[0] for g in grids])]
    df = _grid_cells(spark, grids[0])
    for grid in grids[1:]:
        df = df.unionByName(_grid_cells(spark, grid), allowMissingColumns=True)
    if len(grids) > 1:
        df = df.groupBy(*dims).agg(*[F.first(v.name, ignorenulls=True).alias(v.name) for v in variables])
    if whole:
        return densified(df, dims, sizes, tuple(variables)), None
    return normalised(df, dims, tuple(variables)), grids[0] if one and not grids[0].references else None
