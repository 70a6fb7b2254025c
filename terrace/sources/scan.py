"""A scan of Zarr arrays that opens only what a query asks for: a Spark data source.

Which chunks there may be follows from an array's shape, so nothing is listed.  Bounds
on the dimensions are pushed into the scan: chunks beyond them are not opened, and of a
shard only its index and the chunks within the bounds are read, by ranged reads.
Arrays that share shape and chunks come by one scan with a column each.

Tasks read what pyarrow's file systems open (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from terrace.functions.types import element
from terrace.sources.codecs import decode, index_bytes, read_index

NAME = "terrace_zarr"
#: Cells in bytes that one task reads, about, where there are enough chunks, and tasks at most, whose list the driver holds.
PART, PARTS = 32 << 20, 100_000
ARROW = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
STORED = {"u8": "<u1", "u16": "<u2", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}


@dataclass(frozen=True)
class Stored:
    """Where an array's chunks are and what they hold; ``prefix`` stands before the numbers of a chunk's key."""

    name: str
    dtype: str
    base: str
    prefix: str
    separator: str
    codecs: list[dict[str, Any]]
    fill: Any

    def path(self, at: Sequence[int]) -> str:
        return f"{self.base}/{self.prefix}{self.separator.join(map(str, at)) or '0'}"


@dataclass(frozen=True)
class Grid:
    """Arrays with the same dimensions, shape and chunks (or shards)."""

    dims: list[str]
    shape: list[int]
    block: list[int]
    arrays: list[Stored]
    #: A table of the places of the chunks, if they aren't under their keys.
    references: str = ""

    @property
    def ddl(self) -> str:
        return ", ".join([*(f"`{d}` int" for d in self.dims), *(f"`{a.name}` {element(a.dtype).spark}" for a in self.arrays)])

    def text(self) -> str:
        return json.dumps(asdict(self))


def grid_of(text: str) -> Grid:
    made = json.loads(text)
    return Grid(made["dims"], made["shape"], made["block"], [Stored(**a) for a in made["arrays"]], made.get("references", ""))


def file_system(uri: str):
    """The file system and the path of a URI; None where pyarrow knows no such scheme."""
    from pyarrow.fs import FileSystem

    try:
        return FileSystem.from_uri(uri)
    except (ValueError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


def open_object(uri: str):
    """An object for ranged reads, None if there is none."""
    fs, path = file_system(uri)
    try:
        return fs.open_input_file(path)
    except FileNotFoundError:
        return None


Bounds = list[tuple[int, int]]


def _overlap(start: Sequence[int], shape: Sequence[int], bounds: Bounds) -> tuple[slice, ...] | None:
    """The part of a block within the bounds, counted from the block's start."""
    cut = tuple(slice(max(a - s, 0), min(b - s, n)) for s, n, (a, b) in zip(start, shape, bounds))
    return cut if all(c.start < c.stop for c in cut) else None


def read_block(array: Stored, block: Sequence[int], at: Sequence[int], bounds: Bounds, opened=open_object, uri: str | None = None, offset: int = 0, length: int | None = None, whole: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of chunk ``at`` and which of them are stored; what lies beyond the bounds may be left unread.

    None if the chunk has no object.  ``uri``, ``offset`` and ``length`` say where its bytes are, if not under its
    key; then the last chunk of an axis may end with the array, whose shape is ``whole``.
    """
    uri = uri or array.path(at)
    source = opened(uri)
    if source is None:
        return None
    with source:
        size = source.size() - offset if length is None else length
        fill = 0 if array.fill is None else array.fill
        dtype = STORED[array.dtype]
        try:
            if [c["name"] for c in array.codecs] != ["sharding_indexed"]:
                raw = source.read_at(size, offset)
                if whole is not None and [c["name"] for c in array.codecs] == ["bytes"] and len(raw) < math.prod(block) * np.dtype(dtype).itemsize:
                    # Another file's last rows: what is there of the chunk.
                    shape = [min(b, n - i * b) for i, b, n in zip(at, block, whole)]
                    values, there = np.full(block, fill, dtype), np.zeros(block, bool)
                    cut = tuple(slice(0, n) for n in shape)
                    values[cut], there[cut] = decode(raw, array.codecs, shape, dtype, fill), True
                    return values, there
                return decode(raw, array.codecs, block, dtype, fill), np.ones(block, bool)
            conf = array.codecs[0]["configuration"]
            many, at_end = index_bytes(conf, block)
            index = read_index(source.read_at(many, offset + size - many if at_end else offset), conf, block)
            values, there, inner = np.full(block, fill, dtype), np.zeros(block, bool), conf["chunk_shape"]
            start = [i * b for i, b in zip(at, block)]
            for where, (place, n) in index.items():
                first = [i * c for i, c in zip(where, inner)]
                if _overlap([s + f for s, f in zip(start, first)], inner, bounds) is None:
                    continue
                cut = tuple(slice(f, f + c) for f, c in zip(first, inner))
                values[cut] = decode(source.read_at(n, offset + place), conf["codecs"], inner, dtype, fill)
                there[cut] = True
            return values, there
        except Exception as e:
            raise ValueError(f"{uri} can't be read: {e}") from e


def columns(start: Sequence[int], shape: Sequence[int], keep: np.ndarray | None = None) -> list[np.ndarray]:
    """The index of each cell along each axis, row-major."""
    out = []
    for i, (s, n) in enumerate(zip(start, shape)):
        axis = np.arange(s, s + n, dtype=np.int32).reshape([-1 if j == i else 1 for j in range(len(shape))])
        whole = np.broadcast_to(axis, shape)
        out.append(whole.ravel() if keep is None else whole[keep])
    return out


def batch_of(grid: Grid, at: Sequence[int], found: list[tuple[np.ndarray, np.ndarray] | None], bounds: Bounds) -> pa.RecordBatch | None:
    """The cells of a chunk that are stored in any array; others' are null there."""
    start = [i * b for i, b in zip(at, grid.block)]
    inside = [(max(a, 0), min(b, n)) for (a, b), n in zip(bounds, grid.shape)]
    cut = _overlap(start, grid.block, inside)
    if cut is None or all(f is None for f in found):
        return None
    any_there = np.any([f[1][cut] for f in found if f is not None], axis=0)
    if not any_there.any():
        return None
    keep = None if any_there.all() else any_there
    arrays = [pa.array(c) for c in columns([s + c.start for s, c in zip(start, cut)], any_there.shape, keep)]
    for a, f in zip(grid.arrays, found):
        kind = ARROW[element(a.dtype).spark]
        if f is None:
            arrays.append(pa.nulls(len(arrays[0]), kind))
            continue
        values, there = (x[cut].ravel() if keep is None else x[cut][keep] for x in f)
        arrays.append(pa.array(np.ascontiguousarray(values), mask=None if there.all() else ~there).cast(kind))
    return pa.RecordBatch.from_arrays(arrays, names=[*grid.dims, *(a.name for a in grid.arrays)])


@dataclass
class Range(ds.InputPartition):
    """Chunks by number within the bounds."""

    first: int
    end: int


class Reader(ds.DataSourceReader):
    def __init__(self, grid: Grid, parallelism: int):
        self.grid, self.parallelism = grid, parallelism
        self.bounds: Bounds = [(0, n) for n in grid.shape]
        self.opened = open_object

    def pushFilters(self, filters: list[ds.Filter]):
        """Comparisons of a dimension with a number are done here; others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, ds.IsNotNull) and name in self.grid.dims:
                continue
            value = getattr(f, "value", None)
            if name not in self.grid.dims or isinstance(value, bool) or not isinstance(value, int if not isinstance(f, ds.In) else tuple):
                yield f
                continue
            i = self.grid.dims.index(name)
            low, high = self.bounds[i]
            if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
                low, high = max(low, value), min(high, value + 1)
            elif isinstance(f, ds.GreaterThan):
                low = max(low, value + 1)
            elif isinstance(f, ds.GreaterThanOrEqual):
                low = max(low, value)
            elif isinstance(f, ds.LessThan):
                high = min(high, value)
            elif isinstance(f, ds.LessThanOrEqual):
                high = min(high, value + 1)
            elif isinstance(f, ds.In) and value and all(isinstance(v, int) for v in value):
                low, high = max(low, min(value)), min(high, max(value) + 1)
                yield f
            else:
                yield f
            self.bounds[i] = (low, high)

    def _chunks(self) -> list[range]:
        return [range(a // b, max(-(-z // b), a // b)) if a < z else range(0) for (a, z), b in zip(self.bounds, self.grid.block)]

    def partitions(self) -> list[Range]:
        count = math.prod(len(r) for r in self._chunks())
        cells = sum(element(a.dtype).itemsize for a in self.grid.arrays) * math.prod(self.grid.block)
        each = max(1, min(PART // max(cells, 1), -(-count // self.parallelism)), -(-count // PARTS))
        return [Range(i, min(i + each, count)) for i in range(0, count, each)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        ranges = self._chunks()
        sizes = [len(r) for r in ranges]
        for number in range(partition.first, partition.end):
            at = [r[i] for r, i in zip(ranges, np.unravel_index(number, sizes))]
            found = [read_block(a, self.grid.block, at, self.bounds, self.opened) for a in self.grid.arrays]
            batch = batch_of(self.grid, at, found, self.bounds)
            if batch is not None:
                yield batch


class ZarrSource(ds.DataSource):
    """Options: ``grid``, a ``Grid`` as text, and ``parallelism``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return grid_of(self.options["grid"]).ddl

    def reader(self, schema) -> Reader:
        return Reader(grid_of(self.options["grid"]), int(self.options.get("parallelism", "1")))


def scan(spark: SparkSession, grid: Grid) -> DataFrame:
    """The stored cells of a grid.  Turns on the session's pushdown into Python sources, without which Spark refuses a source that takes filters."""
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("grid", grid.text()).option("parallelism", spark.sparkContext.defaultParallelism).load()


REFERENCES = "chunk array<int>, path string, offset long, length long"


def referenced(references: DataFrame, grid: Grid) -> DataFrame:
    """The cells of arrays whose chunks lie anywhere: ``name, chunk, path, offset, length`` for each.

    Such a table lists the chunks of other files (of HDF5 or NetCDF ones, say), which stay
    where they are; it may be large and is dealt out as any table.  ``name`` is the array's.
    Rows of a chunk that several arrays have are put together by it.
    """
    from pyspark.sql import functions as F

    bounds = [(0, n) for n in grid.shape]
    names = {a.name: i for i, a in enumerate(grid.arrays)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(grid.arrays)
                for p in parts:
                    i = names[p["name"]]
                    found[i] = read_block(grid.arrays[i], grid.block, at, bounds, uri=p["path"], offset=p["offset"], length=p["length"], whole=grid.shape)
                    if found[i] is None:
                        raise FileNotFoundError(f"{p['path']}, which holds a chunk of {p['name']}, is not there")
                batch = batch_of(grid, at, found, bounds)
                if batch is not None:
                    yield batch

    place = F.struct("name", "path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    wanted = references.where(F.col("name").isin(*names))
    if len(names) == 1:
        return wanted.select(F.col("chunk").cast("array<int>").alias("chunk"), F.array(place).alias("parts")).mapInArrow(read, grid.ddl)
    return wanted.groupBy(F.col("chunk").cast("array<int>").alias("chunk")).agg(F.collect_list(place).alias("parts")).mapInArrow(read, grid.ddl)
