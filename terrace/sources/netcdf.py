"""NetCDF classic files (CDF-1, -2 and -5) as arrays of places: nothing is copied.

The header says where each variable's bytes begin.  A variable over the record dimension has
a stretch in every record, others have one stretch, which is cut along its first dimension.
Each stretch, or part of one, is a chunk; a table of all of them is made by Spark and read by
``scan.referenced``.  Only the header passes through the driver.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.raster import Coordinate, Raster, Variable, normalised
from terrace.sources.scan import Grid, Stored, referenced

# Fixed values of the format: the size and NumPy name of each external type by its number.
TYPES = {1: ("i1", 1), 2: ("c", 1), 3: ("i2", 2), 4: ("i4", 4), 5: ("f4", 4), 6: ("f8", 8), 7: ("u1", 1), 8: ("u2", 2), 9: ("u4", 4), 10: ("i8", 8), 11: ("u8", 8)}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
ELEMENTS = {"i2": "i16", "i4": "i32", "f4": "f32", "f8": "f64", "u1": "u8", "u2": "u16", "i8": "i64"}
#: Bytes of a chunk, about, and of the header that are asked for first.
CHUNK, HEAD = 4 << 20, 1 << 16


class _Short(Exception):
    """The header goes on beyond the bytes at hand."""


@dataclass(frozen=True)
class Array:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    record: bool
    attrs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    attrs: dict[str, Any]
    arrays: dict[str, Array]
    record_bytes: int


class _Bytes:
    def __init__(self, raw: bytes, wide_counts: bool, wide_offsets: bool):
        self.raw, self.at = raw, 4
        self.count_form, self.offset_form = ">q" if wide_counts else ">i", ">q" if wide_offsets else ">i"

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise _Short
        out = self.raw[self.at : self.at + n]
        self.at += n
        return out

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def count(self) -> int:
        return self.number(self.count_form)

    def padded(self, n: int) -> bytes:
        out = self.take(n)
        self.take(-n % 4)
        return out

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def listed(self, tag: int) -> range:
        found, n = self.number(">i"), self.count()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError(f"a NetCDF header has the tag {found} where {tag} or 0 should be")
        return range(n)

    def attributes(self) -> dict[str, Any]:
        out = {}
        for _ in self.listed(ATTRIBUTES):
            name, kind, n = self.name(), self.number(">i"), 0
            form, size = TYPES[kind]
            n = self.count()
            raw = self.padded(n * size)
            if form == "c":
                out[name] = raw.decode(errors="replace")
                continue
            values = list(struct.unpack(f">{n}{ {'i1': 'b', 'i2': 'h', 'i4': 'i', 'f4': 'f', 'f8': 'd', 'u1': 'B', 'u2': 'H', 'u4': 'I', 'i8': 'q', 'u8': 'Q'}[form]}", raw))
            out[name] = values[0] if n == 1 else values
        return out


def parsed(raw: bytes, file_bytes: int | None = None) -> Header:
    """What a header says; ``_Short`` if it isn't all there."""
    if raw[:3] != b"CDF" or len(raw) < 4 or raw[3] not in (1, 2, 5):
        raise ValueError("this is no NetCDF classic file (those of version 4 are HDF5)")
    b = _Bytes(raw, raw[3] == 5, raw[3] != 1)
    records = b.count()
    sizes = [(b.name(), b.count()) for _ in b.listed(DIMENSIONS)]
    attrs, made = b.attributes(), []
    for _ in b.listed(VARIABLES):
        name = b.name()
        dims = [b.count() for _ in range(b.count())]
        own, kind = b.attributes(), b.number(">i")
        b.count()  # the size in bytes, which follows from the shape
        made.append((name, dims, own, kind, b.number(b.offset_form)))
    record = {i for i, (_, n) in enumerate(sizes) if n == 0}
    one = [math.prod(sizes[d][1] for d in dims[1:]) * TYPES[kind][1] for _, dims, _, kind, _ in made if dims and dims[0] in record]
    # Each variable's part of a record is padded, unless it is the only one.
    record_bytes = one[0] if len(one) == 1 else sum(-(-n // 4) * 4 for n in one)
    if records < 0:  # a file that was streamed tells by its length
        first = min((begin for _, dims, _, _, begin in made if dims and dims[0] in record), default=0)
        records = (file_bytes - first) // record_bytes if record_bytes and file_bytes else 0
    whole = {n: s or records for n, s in sizes}
    arrays = {}
    for name, dims, own, kind, begin in made:
        names = tuple(sizes[d][0] for d in dims)
        arrays[name] = Array(name, names, tuple(whole[d] for d in names), TYPES[kind][0], begin, bool(dims) and dims[0] in record, own)
    return Header(whole, attrs, arrays, record_bytes)


def header(spark: SparkSession, path: str) -> Header:
    """The header of a file, of which no more is read than it takes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size, n = fs.getFileStatus(p).getLen(), HEAD
    while True:
        stream = fs.open(p)
        try:
            raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, min(n, size))))
        finally:
            stream.close()
        try:
            return parsed(raw, size)
        except _Short:
            if n >= size:
                raise ValueError(f"{path} ends within its header") from None
            n *= 8


def chunk_shape(a: Array) -> list[int]:
    """Whole rows of the first dimension: one of the record dimension, else as many as ``CHUNK`` holds; the rest of the axes whole."""
    if not a.shape:
        return []
    row = math.prod(a.shape[1:]) * TYPES[next(k for k, v in TYPES.items() if v[0] == a.kind)][1]
    return [1 if a.record else max(1, min(a.shape[0], CHUNK // max(row, 1))), *a.shape[1:]]


def references(spark: SparkSession, path: str, head: Header, names: list[str]) -> DataFrame:
    """``name, chunk, path, offset, length`` of the variables named; the last chunk of an axis may be shorter."""
    out = []
    for a in (head.arrays[n] for n in names):
        chunk, item = chunk_shape(a), int(a.kind[1])
        row = math.prod(a.shape[1:]) * item
        step = head.record_bytes if a.record else chunk[0] * row
        i = F.col("id").cast("int")
        length = F.least(F.lit(chunk[0]), F.lit(a.shape[0]) - i * chunk[0]).cast("long") * row
        out.append(spark.range(-(-a.shape[0] // chunk[0])).select(F.lit(a.name).alias("name"), F.concat(F.array(i), F.array_repeat(F.lit(0), len(a.shape) - 1)).alias("chunk"), F.lit(path).alias("path"), (F.lit(a.begin).cast("long") + F.col("id") * step).alias("offset"), length.alias("length")))
    made = out[0]
    for df in out[1:]:
        made = made.unionByName(df)
    return made


def grid(head: Header, names: list[str]) -> Grid:
    """The variables named, which share dimensions and chunks."""
    of = [head.arrays[n] for n in names]
    if any(a.kind not in ELEMENTS for a in of):
        raise ValueError(f"{', '.join(a.name for a in of if a.kind not in ELEMENTS)} can't be read as numbers of a known type")
    chunks = [chunk_shape(a) for a in of]
    if any((a.dims, c) != (of[0].dims, chunks[0]) for a, c in zip(of, chunks)):
        raise ValueError(f"{', '.join(names)} have different dimensions or chunks")
    codecs = [{"name": "bytes", "configuration": {"endian": "big"}}]
    return Grid([*of[0].dims], [*of[0].shape], chunks[0], [Stored(a.name, ELEMENTS[a.kind], "", "", ".", codecs, a.attrs.get("_FillValue", 0)) for a in of])


def open_file(spark: SparkSession, path: str, *, crs: str | None = None) -> Raster:
    """A file as a dataset: one-dimensional variables named as their dimension are coordinates, others' cells stay in the file.

    Variables of a type or shape that isn't known are left out.
    """
    from terrace.sources.scan import open_object

    uri = path if "://" in path else f"file://{path}"
    head = header(spark, uri)
    coords, variables, groups = {}, [], {}
    for a in head.arrays.values():
        if a.dims == (a.name,) and a.kind != "c":
            form = {"i1": "b", "i2": "h", "i4": "i", "f4": "f", "f8": "d", "u1": "B", "u2": "H", "u4": "I", "i8": "q", "u8": "Q"}[a.kind]
            size, step = struct.calcsize(form), head.record_bytes if a.record else struct.calcsize(form)
            with open_object(uri) as source:  # as long as an axis
                raw = source.read_at(step * max(a.shape[0] - 1, 0) + size, a.begin) if a.shape[0] else b""
            coords[a.name] = Coordinate(a.name, a.dims, [struct.unpack_from(f">{form}", raw, i * step)[0] for i in range(a.shape[0])], a.attrs)
        elif a.dims and a.kind in ELEMENTS:
            missing = {"_FillValue": a.attrs["_FillValue"]} if "_FillValue" in a.attrs else {}
            variables.append(Variable(a.name, a.dims, ELEMENTS[a.kind], a.attrs, missing, tuple(chunk_shape(a))))
            groups.setdefault((a.dims, tuple(chunk_shape(a))), []).append(a.name)
    frames: dict[tuple[str, ...], DataFrame] = {}
    for (dims, _), names in groups.items():
        df = referenced(references(spark, uri, head, names), grid(head, names))
        frames[dims] = frames[dims].join(df, list(dims), "full") if dims in frames else df
    frames = {d: normalised(df, d, tuple(v for v in variables if v.dims == d)) for d, df in frames.items()}
    return Raster(head.dims, tuple(variables), frames, coords, crs, head.attrs)
