"""Committed rewrites, one-pass writes, statistics, progress, coordinates, pruned scans and check sums."""

import datetime as dt
import json
import math
import struct
import tracemalloc
import warnings
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from terrace import Coordinate, create_pyramid
from terrace.operators import tiles
from terrace.plans.raster import Variable, raster
from terrace.sources import blosc, checks, codecs, scan, store, zarr
from tests.test_pyramid import YX, coords, make, rows


def plain(df):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


def holes(spark, ny=23, nx=18, dtype="f64", fill=None, dims=YX):
    """A grid with missing and absent cells."""
    rng = np.random.default_rng(ny * nx)
    cells = [(y, x, float(rng.integers(0, 90))) for y in range(ny) for x in range(nx) if rng.random() < 0.8 and not (y < 8 and x < 8)]
    df = spark.createDataFrame([(y, x, None if v < 20 else v) for y, x, v in cells], "y int, x int, v double")
    return raster(df, dims, {"y": ny, "x": nx}, {"v": dtype}, coords=coords(ny, nx), crs="EPSG:4326", fills=None if fill is None else {"v": fill})


# One pass


@pytest.mark.parametrize("method", ["mean", "max", "min", "sum", "nearest"])
@pytest.mark.parametrize("dtype, fill", [("f64", None), ("f32", None), ("u8", 7), ("i16", -5), ("i64", 0)])
def test_tiles_equal_the_chain(spark, monkeypatch, method, dtype, fill):
    """Kernels against column expressions: missing, absent and narrow cells, partial windows, many small tiles."""
    monkeypatch.setattr(tiles, "SIDE", 8)
    p = create_pyramid(holes(spark, dtype=dtype, fill=fill), factors=[1, 2, 4, 8], method=method)
    monkeypatch.setattr(type(p), "region_shape", lambda self, n, name: (8, 8))
    t = tiles.tiling(p, YX, [0, 1, 2, 3])
    assert t.sides == (8, 8) and t.counts == [3, 3]
    near = lambda df: plain(df.select("level", *YX, F.round("v", 4).alias("v")))
    assert near(tiles.tiled_levels(p, YX, [0, 1, 2, 3])) == near(p.union())


def test_integers_saturate_in_tiles():
    f = tiles.Field("v", "i64", None)
    v, there = np.full((2, 2), 2**62, np.int64), np.ones((2, 2), bool)
    assert tiles.reduced(v, there, 2, "sum", f).tolist() == [[2**63 - 1]] and tiles.reduced(-v, there, 2, "sum", f).tolist() == [[-(2**63)]]
    u = tiles.Field("v", "u8", None)
    assert tiles.reduced(np.array([[250, 251], [3, 0]], np.int16), there, 2, "sum", u).tolist() == [[255]]
    assert tiles.reduced(np.array([[-7, -8], [0, 0]], np.int16), there, 2, "mean", tiles.Field("v", "i16", None)).tolist() == [[-3]]


def test_one_exchange_and_no_join(spark):
    p = create_pyramid(make(spark, 40, 40), 4)
    plan = tiles.tiled_levels(p, YX, [0, 1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_other_dimensions_and_a_transposed_grid(spark, tmp_path):
    cells = [(x, t, y, float((t * 7 + y * 3 + x) % 11)) for t in range(3) for y in range(9) for x in range(12)]
    dims = ("x", "t", "y")
    ds_ = raster(spark.createDataFrame(cells, "x int, t int, y int, v double"), dims, {"x": 12, "t": 3, "y": 9}, {"v": "f32"}, coords=coords(9, 12), crs="EPSG:4326")
    p, root = create_pyramid(ds_, 3, method="max"), f"{tmp_path}/z"
    assert plain(tiles.tiled_levels(p, dims, [0, 1, 2]).select("level", *dims, "v")) == plain(p.union(dims).select("level", *dims, "v"))
    zarr.write_pyramid(p, root)
    for n in range(3):
        assert plain(zarr.read_array(spark, root, f"{n}/v").select(*dims, "v")) == plain(p.level(n))


def test_a_cell_twice_is_an_error(spark):
    ds_ = make(spark, 4, 4)
    p = create_pyramid(ds_.with_frames({YX: ds_.frames[YX].union(ds_.frames[YX].limit(1))}, ds_.sizes, ds_.coords), 2)
    with pytest.raises(Exception, match="has a cell twice"):
        tiles.tiled_levels(p, YX, [0, 1]).count()


def test_passes_and_memory(spark, tmp_path, monkeypatch):
    """Levels beyond the span of a pass begin with the last one; what doesn't fit is re-read level by level, or refused."""
    p = create_pyramid(make(spark, 40, 40), 4)
    monkeypatch.setattr(tiles, "SPAN", 2)
    assert tiles.passes(p, [0, 1, 2, 3]) == [[0, 1], [1, 2], [2, 3]] and tiles.passes(p, [2, 3]) == [[2, 3]]
    store.write(p, f"{tmp_path}/a")
    zarr.write_pyramid(p, f"{tmp_path}/z")
    for n in range(4):
        assert rows(store.read(spark, f"{tmp_path}/a", YX, n)) == rows(zarr.read_array(spark, f"{tmp_path}/z", f"{n}/v")) == rows(p.level(n))
    fit, need, room = tiles.fits(p, [0, 1, 2, 3])
    assert fit and 0 < need < room
    monkeypatch.setattr(store, "fits", lambda *a: (False, 2 * 10**9, 10**9))
    used = []
    monkeypatch.setattr(store, "_write_level", lambda *a, f=store._write_level: used.append(a[3]) or f(*a))
    store.write(p, f"{tmp_path}/b")
    assert used == [[0], [1], [2], [3]] and rows(store.read(spark, f"{tmp_path}/b", YX, 3)) == rows(p.level(3))
    with pytest.raises(MemoryError, match="2.00 GB"):
        store.write(p, f"{tmp_path}/c", keep_levels_in_memory=True)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# Versions


def broken(monkeypatch, module, name, n=1):
    """The ``n``-th call of a function and those after it fail."""
    calls = []

    def fail(*a, f=getattr(module, name), **b):
        calls.append(1)
        if len(calls) >= n:
            raise RuntimeError("the executor is gone")
        return f(*a, **b)

    monkeypatch.setattr(module, name, fail)


def other(spark):
    ds_ = make(spark, 40, 40)
    return create_pyramid(ds_.with_frames({YX: ds_.frames[YX].withColumn("v", F.col("v") + 100)}, ds_.sizes, ds_.coords), 3)


@pytest.mark.parametrize("mode", ["a", "w"])
@pytest.mark.parametrize("kind", ["parquet", "zarr"])
def test_a_failed_rewrite_leaves_all_levels(spark, tmp_path, monkeypatch, mode, kind):
    """Level 1 fails after level 0 was written: every level reads as before, and nothing is left behind; then it succeeds."""
    p, q, root = create_pyramid(make(spark, 40, 40), 3), other(spark), f"{tmp_path}/s"
    write, read = (store.write, lambda n: store.read(spark, root, YX, n)) if kind == "parquet" else (zarr.write_pyramid, lambda n: zarr.read_array(spark, root, f"{n}/v"))
    write(p, root)
    monkeypatch.setattr(tiles, "SPAN", 1)  # a pass for each level
    with monkeypatch.context() as m:
        broken(m, *((store, "_write_tiles", 2) if kind == "parquet" else (zarr, "_write_pass", 2)))
        with pytest.raises(RuntimeError, match="gone"):
            write(q, root, mode=mode)
    for n in range(3):
        assert rows(read(n)) == rows(p.level(n))
    assert len(list((tmp_path / "s/data").iterdir())) == 1 if kind == "parquet" else [f.name for f in tmp_path.iterdir()] == ["s"]
    write(q, root, mode=mode)
    for n in range(3):
        assert rows(read(n)) == rows(q.level(n))
    assert [f.name for f in tmp_path.iterdir()] == ["s"]


def test_a_failed_swap_puts_names_back(spark, tmp_path, monkeypatch):
    p, q, root = create_pyramid(make(spark, 40, 40), 3), other(spark), f"{tmp_path}/z"
    zarr.write_pyramid(p, root)
    moves = []
    exists = zarr.exists
    monkeypatch.setattr(zarr, "exists", lambda s, path: moves.append(path) or exists(s, path))
    monkeypatch.setattr(zarr, "_put", lambda uri, data, f=zarr._put: f(uri, data))
    real = zarr._swap

    def swap(spark, uri, staged, docs, attrs, append):
        import shutil

        shutil.rmtree(f"{staged[7:]}/2/v")  # an array of the last level can't be renamed
        return real(spark, uri, staged, docs, attrs, append)

    monkeypatch.setattr(zarr, "_swap", swap)
    with pytest.raises(Exception):
        zarr.write_pyramid(q, root, mode="a")
    monkeypatch.undo()
    for n in range(3):
        assert rows(zarr.read_array(spark, root, f"{n}/v")) == rows(p.level(n))
    assert [f.name for f in tmp_path.iterdir()] == ["z"]


def test_versions(spark, tmp_path):
    """Older versions can be kept and read; of two writers that begin with the same version one is refused."""
    p, q, root = create_pyramid(make(spark, 40, 40), 3), other(spark), f"{tmp_path}/s"
    store.write(p, root)
    store.write(q, root, levels=[0], mode="a", history=1)
    assert store.versions(spark, root) == [1, 2]
    assert rows(store.read(spark, root, YX, 0)) == rows(q.level(0)) and rows(store.read(spark, root, YX, 0, version=1)) == rows(p.level(0))
    assert rows(store.read(spark, root, YX, 1)) == rows(p.level(1))
    made = store.manifest(spark, root)
    with pytest.raises(FileExistsError, match="meanwhile"):
        store._commit(spark, root, {**made, "version": 2}, 0)
    store.write(q, root, levels=[1], mode="a")
    assert store.versions(spark, root) == [3] and rows(store.read(spark, root, YX, 1)) == rows(q.level(1))
    assert {f.name for f in (tmp_path / "s/data").iterdir()} == set(store.manifest(spark, root)["levels"].values())
    with pytest.raises(FileNotFoundError, match="version 1"):
        store.read(spark, root, YX, 0, version=1)
    with pytest.raises(FileNotFoundError, match="no store"):
        store.read(spark, f"{tmp_path}/none", YX, 0)


def test_modes_and_predecessors(spark, tmp_path):
    p, q, root = create_pyramid(make(spark, 40, 40), 3), other(spark), f"{tmp_path}/z"
    for bad in ("r", "append"):
        with pytest.raises(ValueError, match="mode"):
            zarr.write_pyramid(p, root, mode=bad)
    with pytest.raises(FileNotFoundError, match="level 1"):
        zarr.write_pyramid(p, root, levels=[0, 2], mode="a")
    zarr.write_pyramid(p, root, levels=[0, 1])
    zarr.write_pyramid(q, root, levels=[2], mode="a")  # from stored level 1, not from its own source
    assert rows(zarr.read_array(spark, root, "2/v")) == rows(p.level(2))
    parquet = f"{tmp_path}/s"
    store.write(p, parquet, levels=[0, 1])
    store.write(q, parquet, levels=[2], mode="a")
    assert rows(store.read(spark, parquet, YX, 2)) == rows(p.level(2))


# Statistics and progress


@pytest.mark.parametrize("kept", [True, False])
@pytest.mark.parametrize("kind", ["parquet", "zarr"])
def test_statistics_and_progress(spark, tmp_path, kept, kind):
    p, seen = create_pyramid(holes(spark, 300, 200), 3, target_chunk_bytes=8192), []
    write = store.write if kind == "parquet" else zarr.write_pyramid
    out = write(p, f"{tmp_path}/s", stats=True, keep_levels_in_memory=kept, progress=lambda done, total: seen.append((done, total)), max_workers=2)
    total = sum(p.region_count(n, "v") for n in range(3))
    assert sorted(out) == [0, 1, 2] and seen[-1] == (total, total) and seen == sorted(set(seen)) and seen[0][0] > 0
    for n in range(3):
        of = out[str(n)]
        assert of is out[n] and of["regions"] == p.region_count(n, "v") > 0 and of["workers"] == 2 and of["region_shapes"] == {"v": p.region_shape(n, "v")}
        assert all(of[k] >= 0 for k in ("wall_s", "read_s", "reduce_s", "write_s", "skipped"))
    assert out[0]["reduce_s"] == 0 and (not kept or out[1]["reduce_s"] > 0)


def test_skipped_regions_are_counted(spark, tmp_path):
    ds_ = make(spark, 300, 150)
    gone = raster(ds_.frames[YX].withColumn("v", F.when(F.col("y") < 100, F.col("v"))), YX, ds_.sizes, {"v": "f64"}, coords=ds_.coords, crs="EPSG:4326")
    p = create_pyramid(gone, 2, target_chunk_bytes=8192)
    regions = p.region_count(0, "v")
    out = zarr.write_pyramid(p, f"{tmp_path}/z", stats=True)
    assert out[0]["objects"] + out[0]["skipped"] == regions and out[0]["skipped"] > 0
    made = store.write(p, f"{tmp_path}/s", stats=True)
    assert made[0]["skipped"] > 0 and made[0]["rows"] < 300 * 150
    assert rows(store.read(spark, f"{tmp_path}/s", YX, 0).where("not isnan(v)")) == rows(p.level(0).where("not isnan(v)"))


def test_a_bar_needs_tqdm(spark, monkeypatch):
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a: (_ for _ in ()).throw(ImportError(name)) if name.startswith("tqdm") else real(name, *a))
    from terrace.sources.stats import progress_bar

    with pytest.raises(ImportError, match="tqdm"):
        progress_bar(3)


# Coordinates

AXES = {
    "f32": [np.float32(i / 8) for i in range(4)], "numpy ints": np.arange(4) * 2**53 + 1, "ints": [1, 2, 3, 2**60 + 1], "floats": [0.5, 1.5, math.inf, -2.0],
    "days": [dt.date(2020, 1, 1 + i) for i in range(4)], "times": [dt.datetime(2020, 1, 1, i, 0, 0, 7) for i in range(4)], "numpy times": np.array(["2020-01-01", "2020-01-02", "1960-05-05T12:00", "NaT"], "datetime64[ns]"), "text": ["a", "", "ü漢", "d"],
}


@pytest.mark.parametrize("kind", AXES)
def test_coordinates_of_any_type(spark, tmp_path, kind):
    """They come back from both stores with their values, and the store opens."""
    values = AXES[kind]
    cells = spark.createDataFrame([(t, y, x, float(t + y + x)) for t in range(4) for y in range(4) for x in range(4)], "t int, y int, x int, v double")
    coords = {"t": Coordinate("t", ("t",), values, {"long_name": "steps"}), "x": Coordinate("x", ("x",), np.arange(4, dtype=np.float32)), "y": Coordinate("y", ("y",), range(4)), "run": Coordinate("run", (), [values[1]])}
    p = create_pyramid(raster(cells, ("t", *YX), {"t": 4, "y": 4, "x": 4}, {"v": "f64"}, coords=coords, crs="EPSG:4326"), 2)
    zarr.write_pyramid(p, f"{tmp_path}/z")
    store.write(p, f"{tmp_path}/s")
    want = [dt.datetime(v.year, v.month, v.day) if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else v for v in (values.astype("datetime64[us]").tolist() if kind == "numpy times" else values.tolist() if isinstance(values, np.ndarray) else [getattr(v, "item", lambda v=v: v)() for v in values])]
    for n in range(2):
        ds_ = zarr.open_group(spark, f"{tmp_path}/z", str(n), crs="EPSG:4326")
        for got in (ds_.coords["t"], store.read_coords(spark, f"{tmp_path}/s", n)["t"]):
            assert list(got.values) == want and got.attrs["long_name"] == "steps" and got.dims == ("t",)
        assert len(ds_.coords["x"].values) == 4 >> n and ds_.sizes == {"t": 4, "y": 4 >> n, "x": 4 >> n}
        run = zarr.read_axis(spark, f"{tmp_path}/z", f"{n}/run")
        assert run.dims == () and list(run.values) == [want[1]]
        assert ds_.frames["t", "y", "x"].count() == 64 >> 2 * n
    assert zarr.open_group(spark, f"{tmp_path}/z", "0").coords["x"].values == [0, 1, 2, 3]


def test_coordinates_that_cannot_be_written(spark, tmp_path):
    ds_ = make(spark, 4, 4)
    for bad in ([1, "a", 2, 3], [{}, 1, 2, 3], [b"a"] * 4):
        p = create_pyramid(replace(ds_, coords={**ds_.coords, "z": Coordinate("z", ("z",), bad)}), 2)
        for write in (store.write, zarr.write_pyramid):
            with pytest.raises(TypeError, match="can't be written"):
                write(p, f"{tmp_path}/bad")
    assert not list(tmp_path.iterdir()) or not store.versions(spark, f"{tmp_path}/bad")


# Pruned scans


class Counted:
    def __init__(self):
        self.opened = []

    def __call__(self, uri):
        source = scan.open_object(uri)
        if source is None:
            return None
        owner = self

        class Wrapped:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                source.close()

            def size(self):
                return source.size()

            def read_at(self, n, offset):
                owner.opened.append((uri.rsplit("/c/", 1)[1], n))
                return source.read_at(n, offset)

        return Wrapped()


def test_only_chunks_within_the_bounds_are_read(spark, tmp_path):
    """Of a shard its index and the chunks asked for; of the array no chunk beyond the bounds; nothing is listed."""
    p, root = create_pyramid(make(spark, 64, 64), 1), f"{tmp_path}/z"
    p = replace(p, encoding={"/0": {"v": {"chunks": (8, 8), "shards": (32, 32)}}})
    zarr.write_pyramid(p, root)
    _, grid = zarr.array_grid(spark, root, "0/v")
    reader = scan.Reader(grid, 4)
    reader.opened = Counted()
    left = list(reader.pushFilters([ds.GreaterThanOrEqual(("y",), 33), ds.LessThan(("y",), 39), ds.EqualTo(("x",), 5), ds.IsNotNull(("x",)), ds.GreaterThan(("v",), 3), ds.In(("y",), (34, 35, 36))]))
    assert [type(f) for f in left] == [ds.GreaterThan, ds.In]
    found = [b for part in reader.partitions() for b in reader.read(part)]
    got = sorted((r["y"], r["x"], r["v"]) for b in found for r in b.to_pylist())
    assert got == rows(p.level(0).where("y between 34 and 36 and x = 5"))
    assert len(reader.opened.opened) == 2 and {k for k, _ in reader.opened.opened} == {"1/0"} and reader.opened.opened[1][1] == 8 * 8 * 8
    # Nothing is within the bounds: no object is opened.
    none = scan.Reader(grid, 4)
    none.opened = Counted()
    list(none.pushFilters([ds.LessThan(("y",), 0)]))
    assert [b for part in none.partitions() for b in none.read(part)] == [] and none.opened.opened == []


def test_filters_reach_the_scan(spark, tmp_path):
    p, root = create_pyramid(make(spark, 64, 64), 2), f"{tmp_path}/z"
    zarr.write_pyramid(p, root)
    df = zarr.read_array(spark, root, "1/v").where("y >= 3 and y < 9 and x in (1, 2, 30) and v > 2")
    assert rows(df) == rows(p.level(1).where("y >= 3 and y < 9 and x in (1, 2, 30) and v > 2"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert scan.NAME in plan and "Filter" in plan and "y#" not in plan.split("Filter")[1].split("\n")[0].replace("isnotnull(y#", "")


def test_variables_with_the_same_chunks_come_by_one_scan(spark, tmp_path):
    """And a pyramid of an opened store reads each chunk by one task, without an exchange; cells of one variable alone have nulls made missing."""
    base = make(spark, 64, 64)
    df = base.frames[YX].withColumn("w", F.when(F.col("y") < 20, F.col("v") * 2))
    ds_ = raster(df, YX, base.sizes, {"v": "f64", "w": "f64"}, coords=base.coords, crs="EPSG:4326")
    root = f"{tmp_path}/z"
    zarr.write_pyramid(replace(create_pyramid(ds_, 1), encoding={"/0": {n: {"chunks": (8, 8), "shards": (16, 16)} for n in "vw"}}), root)
    opened = zarr.open_group(spark, root, "0", crs="EPSG:4326")
    plan = opened.frames[YX]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count(scan.NAME) == 1
    assert plain(opened.frames[YX].select(*YX, "v", "w")) == plain(ds_.frames[YX])
    p = create_pyramid(opened, 3)
    t = tiles.tiling(p, YX, [0, 1, 2])
    assert all(s % 16 == 0 for s in t.sides)  # whole source chunks
    made = tiles.tiled_levels(p, YX, [0, 1, 2])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert plain(made.select("level", *YX, "v", "w")) == plain(p.union().select("level", *YX, "v", "w"))
    # Cells that were put in place of the opened ones are what counts.
    changed = replace(opened, frames={YX: opened.frames[YX].withColumn("v", F.col("v") + 1)})
    assert plain(tiles.tiled_levels(create_pyramid(changed, 2), YX, [0, 1]).where("level = 0").select(*YX, "v")) == plain(changed.frames[YX].select(*YX, "v"))


@pytest.mark.parametrize("chunk, limit, aligned", [(12, 1 << 28, True), (12, 100, False)])
def test_tiles_follow_source_chunks(spark, chunk, limit, aligned):
    ds_ = raster(make(spark, 96, 96).frames[YX], YX, {"y": 96, "x": 96}, {"v": "f64"}, coords=coords(96, 96), crs="EPSG:4326", chunks=(chunk, chunk))
    p = create_pyramid(ds_, 3)
    t = tiles.tiling(replace(p, encoding={**p.encoding, "/0": {"v": {"chunks": (16, 16)}}}), YX, [0, 1, 2], max_region_bytes=limit)
    assert t.sides == (48, 48) if aligned else all(s % 4 == 0 for s in t.sides)


def test_references_to_other_files(spark, tmp_path):
    """A table of places stands for an array: its cells, and a pyramid above them."""
    data = np.arange(6 * 8, dtype="<i4").reshape(6, 8)
    refs = []
    for i in range(2):
        body = b"header" * (i + 1)
        for j in range(2):
            raw = data[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].tobytes()
            refs.append(("v", [i, j], f"file://{tmp_path}/part{i}.bin", len(body), len(raw)))
            body += raw + b"gap"
        (tmp_path / f"part{i}.bin").write_bytes(body)
    grid = scan.Grid(["y", "x"], [6, 8], [3, 4], [scan.Stored("v", "i32", "", "", ".", [{"name": "bytes"}], -1)])
    table = spark.createDataFrame(refs, "name string, chunk array<int>, path string, offset long, length long")
    cells = zarr.read_references(table, grid)
    assert rows(cells) == [(y, x, int(data[y, x])) for y in range(6) for x in range(8)]
    two = scan.Grid(["y", "x"], [6, 8], [3, 4], [grid.arrays[0], replace(grid.arrays[0], name="w")])
    both = zarr.read_references(table.union(table.where("chunk[0] = 0").withColumn("name", F.lit("w"))), two)
    assert rows(both.where("y < 3")) == [(y, x, int(data[y, x]), int(data[y, x])) for y in range(3) for x in range(8)] and both.where("y >= 3 and w is null").count() == 24
    p = create_pyramid(raster(cells, YX, {"y": 6, "x": 8}, {"v": "i32"}, coords=coords(6, 8), crs="EPSG:4326"), 2, method="max")
    zarr.write_pyramid(p, f"{tmp_path}/z", levels=[0, 1])
    assert rows(zarr.read_array(spark, f"{tmp_path}/z", "1/v")) == [(y, x, int(data[2 * y + 1, 2 * x + 1])) for y in range(3) for x in range(4)]
    with pytest.raises(Exception, match="not there"):
        zarr.read_references(spark.createDataFrame([("v", [0, 0], f"file://{tmp_path}/gone.bin", 0, 48)], table.schema), grid).count()


# Check sums, Blosc and metadata


def test_crc32c_known_values():
    assert checks.crc32c(b"123456789") == 0xE3069283 and checks.crc32c(b"") == 0
    assert checks.crc32c(bytes(32)) == 0x8A9136AA and checks.crc32c(b"\xff" * 32) == 0x62A8AB43 and checks.crc32c(bytes(range(32))) == 0x46DD794E
    data, slow = np.random.default_rng(0).bytes(10_007), 0xFFFFFFFF
    for b in data:
        slow ^= b
        for _ in range(8):
            slow = slow >> 1 ^ (checks.POLYNOMIAL if slow & 1 else 0)
    assert checks.crc32c(data) == slow ^ 0xFFFFFFFF and checks.verified(checks.signed(data)) == data


@pytest.mark.parametrize("where", ["index", "chunk"])
def test_a_flipped_byte_is_told(spark, tmp_path, where):
    p, root = create_pyramid(make(spark, 32, 32), 1), f"{tmp_path}/z"
    zarr.write_pyramid(p, root, checked=True)
    path = tmp_path / "z/0/v/c/0/0"
    raw = bytearray(path.read_bytes())
    raw[-10 if where == "index" else 40] ^= 16
    path.write_bytes(raw)
    with pytest.raises(Exception, match="v/c/0/0 can't be read: the check sum is wrong"):
        zarr.read_array(spark, root, "0/v").count()


@pytest.mark.parametrize("width, dtype", [(1, "u1"), (2, "<i2"), (4, "<f4"), (8, "<f8"), (17, "V17")])
@pytest.mark.parametrize("shuffle", ["noshuffle", "shuffle", "bitshuffle"])
def test_blosc_frames(width, dtype, shuffle):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 1000, 4096, 30_001):
        for raw in (bytes(rng.integers(0, 5, n * width, dtype=np.uint8)), rng.bytes(n * width + width // 2)):
            for name in ("lz4", "snappy", "zlib", "zstd"):
                for block in (1 << 18, 5000):
                    assert blosc.decompress(blosc.compress(raw, width, name, shuffle, block)) == raw


def frame(flags, width, size, block, *blocks):
    at, offsets, body = 16 + 4 * len(blocks), [], b""
    for b in blocks:
        offsets.append(at + len(body))
        body += b
    return struct.pack(f"<BBBBIII{len(offsets)}i", 2, 1, flags, width, size, block, at + len(body), *offsets) + body


def test_literal_blosc_frames():
    """By the format's rules: stored and packed streams, streams by byte, both shuffles, and BloscLZ matches near, long, overlapping and far."""
    assert blosc.decompress(struct.pack("<BBBBIII", 2, 1, 2, 4, 5, 5, 21) + b"hello") == b"hello"
    stream = lambda raw: len(raw).to_bytes(4, "little") + raw
    # One stream, stored: bytes of two-byte elements were brought together.
    assert blosc.decompress(frame(1 | 16, 2, 6, 6, stream(b"ace" + b"bdf"))) == b"abcdef"
    # A stream for each byte of the elements of a full block, one for the last, shorter block.
    full = bytes(range(128)) + b"\x07" * 128
    assert blosc.decompress(frame(1, 2, 260, 256, stream(full[:128]) + stream(full[128:]), stream(b"ab\x00\x00"))) == b"".join(bytes([i, 7]) for i in range(128)) + b"a\x00b\x00"
    # Eight elements of one byte, a bit plane each.
    assert blosc.decompress(frame(4 | 16, 1, 8, 8, stream(bytes([1, 2, 0, 0, 0, 0, 0, 128])))) == bytes([1, 2, 0, 0, 0, 0, 0, 128])
    # BloscLZ: "abc", then a match of 6 at distance 3; then one byte repeated 20 times.
    packed = bytes([2]) + b"abc" + bytes([(4 << 5) | 0, 2]) + bytes([0]) + b"z" + bytes([(7 << 5) | 0, 10, 0])
    want = b"abcabcabc" + b"z" * 20
    assert blosc.decompress(frame(16, 1, len(want), len(want), stream(packed))) == want
    long = bytes(np.random.default_rng(1).integers(0, 256, 9000, dtype=np.uint8))
    literal = b"".join(bytes([len(long[i : i + 32]) - 1]) + long[i : i + 32] for i in range(0, 9000, 32))
    far = literal + bytes([(1 << 5) | 31, 255]) + (9000 - 8191 - 1).to_bytes(2, "big")
    assert blosc.decompress(frame(16, 1, 9003, 9003, stream(far))) == long + long[:3]


@pytest.mark.parametrize("bad, why", [(struct.pack("<BBBBIII", 9, 1, 2, 4, 5, 5, 21) + b"hello", "version"), (struct.pack("<BBBBIII", 2, 1, 8, 4, 5, 5, 21) + b"hello", "flags"), (struct.pack("<BBBBIII", 2, 1, 2, 4, 5, 5, 99) + b"hello", "bytes"), (b"short", "header"), (frame(7 << 5, 1, 4, 4, b"\0\0\0\0"), "compressor"), (frame(16, 1, 8, 8, b"\x40\0\0\0ab"), "cut off")])
def test_bad_blosc_frames(bad, why):
    with pytest.raises(ValueError, match=why):
        blosc.decompress(bad)


def test_blosc_stores_and_plans(spark, tmp_path):
    """Our own, and those of version 2 writers; what isn't known raises when planning."""
    from tests.test_zarr import old_array

    p, root = create_pyramid(make(spark, 300, 150, "f32"), 2), f"{tmp_path}/z"
    zarr.write_pyramid(p, root, compressor="blosc", checked=True)
    assert rows(zarr.read_array(spark, root, "1/v")) == rows(p.level(1))
    data = np.arange(42.0).reshape(6, 7)
    meta = {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 2, "blocksize": 0}
    old_array(tmp_path, "old", data, (4, 4), meta, lambda raw: blosc.compress(raw, 8, "zstd", "bitshuffle"))
    assert rows(zarr.read_array(spark, str(tmp_path), "old")) == [(y, x, data[y, x]) for y in range(6) for x in range(7)]
    for name, bad in (("a", {**meta, "cname": "lzo"}), ("b", {**meta, "shuffle": 7})):
        old_array(tmp_path, name, data, (4, 4), bad, bytes)
        with pytest.raises(ValueError, match="Blosc"):
            zarr.read_array(spark, str(tmp_path), name)


def test_consolidated_metadata(spark, tmp_path, monkeypatch):
    """Stores are opened from one object, in version 2 and 3, without being listed; ours stay right when levels are added."""
    from tests.test_zarr import old_array

    p, root = create_pyramid(make(spark, 32, 32), 3), f"{tmp_path}/z"
    zarr.write_pyramid(p, root, levels=[0, 1])
    zarr.write_pyramid(p, root, levels=[2], mode="a")
    doc = json.loads((tmp_path / "z/zarr.json").read_text())["consolidated_metadata"]["metadata"]
    assert {"0", "0/v", "0/x", "2/v"} <= doc.keys() and doc["2/v"] == json.loads((tmp_path / "z/2/v/zarr.json").read_text())
    for name in ("0", "2"):
        (tmp_path / f"z/{name}/y/zarr.json").unlink()
        ds_ = zarr.open_group(spark, root, name, crs="EPSG:4326")
        assert set(ds_.coords) == {"x", "y"} and [v.name for v in ds_.variables] == ["v"]
    old = tmp_path / "old"
    old.mkdir()
    old_array(old, "v", np.arange(16.0).reshape(4, 4), (2, 2), None, bytes)
    (old / ".zgroup").write_text('{"zarr_format": 2}')
    found = {f"v/{n}": json.loads((old / f"v/{n}").read_text()) for n in (".zarray", ".zattrs")}
    (old / ".zmetadata").write_text(json.dumps({"zarr_consolidated_format": 1, "metadata": {".zgroup": {"zarr_format": 2}, **found}}))
    (old / "v/.zarray").unlink()
    assert zarr.open_group(spark, str(old), crs="EPSG:4326").frames[YX].count() == 16


def test_other_arrays_of_a_group_stay(spark, tmp_path):
    """Mode "a" replaces the arrays that it writes, and the metadata in one object tells of all."""
    p, root = create_pyramid(make(spark, 32, 32), 2), f"{tmp_path}/z"
    zarr.write_pyramid(p, root)
    ds_ = make(spark, 32, 32)
    more = create_pyramid(raster(ds_.frames[YX].withColumnRenamed("v", "w"), YX, ds_.sizes, {"w": "f64"}, coords=ds_.coords, crs="EPSG:4326"), 2, method="max")
    zarr.write_pyramid(more, root, mode="a")
    assert rows(zarr.read_array(spark, root, "1/v")) == rows(p.level(1)) and rows(zarr.read_array(spark, root, "1/w")) == rows(more.level(1))
    opened = zarr.open_group(spark, root, "1", crs="EPSG:4326")
    assert {v.name for v in opened.variables} == {"v", "w"}
    doc = json.loads((tmp_path / "z/zarr.json").read_text())
    del doc["consolidated_metadata"]
    (tmp_path / "z/zarr.json").write_text(json.dumps(doc))
    zarr.write_pyramid(more, root, levels=[1], mode="a")
    found = json.loads((tmp_path / "z/zarr.json").read_text())["consolidated_metadata"]["metadata"]
    assert {"0", "0/v", "0/w", "0/x", "1", "1/v", "1/w"} <= found.keys()
    assert [f.name for f in tmp_path.iterdir()] == ["z"]


def test_unknown_arrays_are_left_out(spark, tmp_path):
    from tests.test_zarr import old_array

    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    old_array(tmp_path, "v", np.arange(16.0).reshape(4, 4), (2, 2), None, bytes)
    old_array(tmp_path, "flag", np.ones((4, 4), bool), (2, 2), None, bytes)
    old_array(tmp_path, "y", np.arange(4, dtype="u4"), (3,), None, bytes, dims=("y",))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        ds_ = zarr.open_group(spark, str(tmp_path), crs="EPSG:4326")
    assert [v.name for v in ds_.variables] == ["v"] and ds_.coords["y"].values == [0, 1, 2, 3] and any("flag" in str(w.message) for w in told)


def test_flat_datasets(spark, tmp_path):
    """One group with the dataset's metadata and a storage layout of one's own."""
    from terrace import recommend_encoding

    ds_, root = make(spark, 300, 150, "f32"), f"{tmp_path}/z"
    assert zarr.write_flat(ds_, root, encoding=recommend_encoding(ds_, target_chunk_bytes=65536)) >= 1
    attrs = zarr.read_document(spark, root)["attributes"]
    assert attrs["spatial:shape"] == [300, 150] and "multiscales" not in attrs and attrs["proj:code"] == "EPSG:4326"
    again = zarr.open_group(spark, root)
    assert again.crs == "EPSG:4326" and again.variables[0].chunks == recommend_encoding(ds_, target_chunk_bytes=65536)["v"]["shards"]
    assert rows(again.frames[YX]) == rows(ds_.frames[YX]) and again.coords["y"].values == [10.0 - 2 * i for i in range(300)]


def test_text_chunks():
    for values in ([], [""], ["a", "ü漢字", "x" * 300]):
        assert codecs.unpacked_text(codecs.packed_text(values)) == values
    assert Variable("v", YX, "f32").fill != 0


# Coordinates for each cell


@pytest.mark.parametrize("method", ["max", "nearest"])
def test_curvilinear_coordinates(spark, tmp_path, method):
    """They are coarsened by mean beside data of another method, by column expressions and in tiles, and come back from a store as what they are."""
    base = make(spark, 24, 16)
    df = base.frames[YX].withColumns({"lat": F.col("y") * 2.0 + F.col("x") / 8, "lon": F.col("x") - F.col("y") / 4})
    ds_ = raster(df, YX, base.sizes, {"v": "f64", "lat": "f64", "lon": "f64"}, coords=base.coords, crs="EPSG:4326", auxiliary=("lat", "lon"))
    p, root = create_pyramid(ds_, 3, method=method), f"{tmp_path}/z"
    want = {(n, y, x): (2 * f * y + (f - 1) + (f * x + (f - 1) / 2) / 8, f * x + (f - 1) / 2 - (f * y + (f - 1) / 2) / 4) for n, f in enumerate(p.factors) for y in range(24 // f) for x in range(16 // f)}
    chain = p.union().select("level", *YX, "v", "lat", "lon")
    assert {tuple(r)[:3]: tuple(r)[4:] for r in chain.collect()} == want
    assert plain(chain) == plain(tiles.tiled_levels(p, YX, [0, 1, 2]).select(*chain.columns))
    plainly = create_pyramid(base, 3, method=method)
    assert plain(chain.select("level", *YX, "v")) == plain(plainly.union().select("level", *YX, "v"))
    zarr.write_pyramid(p, root)
    opened = zarr.open_group(spark, root, "1", crs="EPSG:4326")
    assert {v.name: v.coordinate for v in opened.variables} == {"v": False, "lat": True, "lon": True}
    assert opened.variable("v").attrs["coordinates"] == "lat lon" and "coordinates" not in opened.variable("lat").attrs
    assert plain(create_pyramid(opened, 2, method=method).level(1).select(*YX, "v", "lat", "lon")) == plain(p.level(2).select(*YX, "v", "lat", "lon"))


def test_times_are_coarsened(spark):
    from terrace.operators.coords import coarsen_values

    days = [dt.datetime(2020, 1, 1 + i) for i in range(5)]
    assert coarsen_values(days, 2) == [dt.datetime(2020, 1, 1, 12), dt.datetime(2020, 1, 3, 12)]
    assert coarsen_values(np.array(days, "datetime64[ns]"), 2) == coarsen_values([d.date() for d in days], 2) == coarsen_values(days, 2)


# Streams


def test_split_deliveries(spark, tmp_path):
    """Rows that come one by one, in any order: the levels are those of the whole grid, and only whole tiles are there before the end."""
    from terrace.streaming.regions import finish, read_stream_level, stream_levels

    p = create_pyramid(make(spark, 14, 16), 3)
    df = p.source.frames[YX]
    for i in (3, 0, 9, 1, 2, 13, 4, 5, 6, 7, 8, 10, 11, 12):
        df.where(f"y = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    given = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in")
    q = stream_levels(given, p, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert q.exception() is None
    for n in range(3):  # the last rows fill no window of level 2, but tiles that end with the grid
        assert rows(read_stream_level(spark, f"{tmp_path}/out", YX, n).select(*YX, "v")) == rows(p.level(n))
    finish(spark, p, f"{tmp_path}/out")
    assert rows(read_stream_level(spark, f"{tmp_path}/out", YX, 1).select(*YX, "v")) == rows(p.level(1))


def test_tiles_that_never_fill(spark, tmp_path):
    from terrace.streaming.regions import finish, read_stream_level, stream_levels

    p = create_pyramid(make(spark, 16, 16), 3)
    df = p.source.frames[YX].where("y <> 5 or x <> 5")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_levels(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), p, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert read_stream_level(spark, f"{tmp_path}/out", YX, 2).count() == 15
    finish(spark, p, f"{tmp_path}/out")
    want = create_pyramid(p.source.with_frames({YX: df}, p.source.sizes, p.source.coords), 3)
    assert rows(read_stream_level(spark, f"{tmp_path}/out", YX, 2).select(*YX, "v")) == rows(want.level(2))


def test_a_task_is_not_handed_all_its_blocks(spark, tmp_path):
    """Tiles are made from blocks where they lie, and jobs hand few bytes at once to Python; the session's own bound comes back."""
    t = tiles.Tiling(("y", "x"), "y", "x", (tiles.Field("v", "f64", None),), "max", (0,), (1,), ({"y": 64 * 256, "x": 64},), (256, 64))
    at, v = np.arange(256 * 64, dtype="<i4").tobytes(), np.ones(256 * 64).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(64), pa.int64()), pa.array([at] * 64, pa.binary()), pa.array([v] * 64, pa.binary())], names=["tile", "at", "v"])
    tracemalloc.start()
    assert sum(int(values[0].sum()) for _, values, _ in tiles._tiles(t, iter([batch]))) == 64 * 256 * 64
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 8
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    with tiles.small_batches(spark):
        big = spark.range(0, 32, 1, 1).select(F.expr("cast(repeat('x', 1000000) as binary)").alias("b"))
        rows = [r.n for r in big.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()]
    assert sum(rows) == 32 and max(rows) <= 6
    p = create_pyramid(holes(spark), 2, method="max")
    for module in (store, zarr):
        real = module.small_batches
        module.small_batches = lambda s: seen.append(module) or real(s)
        try:
            (module.write if module is store else module.write_pyramid)(p, f"file://{tmp_path}/{module.__name__}")
        finally:
            module.small_batches = real
    assert {store, zarr} == set(seen) and spark.conf.get(key) == before
