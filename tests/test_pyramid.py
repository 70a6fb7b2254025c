import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace import Coordinate, LayerHint, attach_metadata, create_pyramid, recommend_encoding
from terrace.operators.pyramid import resolve_factors
from terrace.plans.layout import copy_region, even_chunk, ideal_side, nested_chunk, region_bytes, region_count, region_grid, workers
from terrace.plans.metadata import affine, bbox, spacing, to_json
from terrace.plans.raster import Raster, Variable, raster
from terrace.sources import store
from terrace.streaming.regions import read_stream_level, stream_levels

YX = ("y", "x")


def coords(ny, nx):
    return {"x": Coordinate("x", ("x",), [float(i) for i in range(nx)]), "y": Coordinate("y", ("y",), [10.0 - 2 * i for i in range(ny)])}


def make(spark, ny=13, nx=15, dtype="f64", **more):
    rows = [(y, x, float((y * 31 + x * 7) % 23)) for y in range(ny) for x in range(nx)]
    df = spark.createDataFrame(rows, "y int, x int, v double")
    return raster(df, YX, {"y": ny, "x": nx}, {"v": dtype}, coords=coords(ny, nx), crs="EPSG:4326", **more)


def planned(dims, sizes, dtype="f32", chunks=None):
    return Raster(sizes, (Variable("v", dims, dtype, chunks=chunks),), {}, {d: Coordinate(d, (d,), list(map(float, range(sizes[d])))) for d in YX}, "EPSG:4326")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_factors():
    assert resolve_factors(3) == [1, 2, 4] and resolve_factors(factors=[1, 2, 8]) == [1, 2, 8]
    for bad in ({}, {"levels": 2, "factors": [1, 2]}, {"levels": 0}, {"factors": []}, {"factors": [2, 4]}, {"factors": [1, 1]}, {"factors": [1, 2, 3]}, {"factors": [1, True]}, {"factors": [1, 2.0]}):
        with pytest.raises(ValueError):
            resolve_factors(**bad)


def test_plan_checks():
    ok = planned(YX, {"y": 8, "x": 8})
    with pytest.raises(ValueError, match="empty"):
        create_pyramid(ok, 5)
    with pytest.raises(ValueError, match="method"):
        create_pyramid(ok, 2, method="mode")
    with pytest.raises(ValueError, match="dimension"):
        create_pyramid(ok, 2, x_dim="lon")
    with pytest.raises(ValueError, match="crs"):
        create_pyramid(Raster(ok.sizes, ok.variables, {}, ok.coords), 2)
    with pytest.raises(TypeError):
        create_pyramid(planned(YX, {"y": 8, "x": 8}, "bool"), 2)
    with pytest.raises(ValueError, match="4"):
        create_pyramid(planned(("a", "b", "c", *YX), {"a": 1, "b": 1, "c": 1, "y": 8, "x": 8}), 2)
    with pytest.raises(ValueError, match="one value|evenly"):
        spacing([0, 1, 3], "x")


def test_a_deep_stack_is_dealt_out(spark):
    """Many small grids: the chain has one exchange, and a grid's own index deals it out."""
    cells = spark.range(64 * 8 * 8).selectExpr("cast(id div 64 as int) t", "cast(id % 64 div 8 as int) y", "cast(id % 8 as int) x", "cast(id as double) v")
    ds = raster(cells, ("t", *YX), {"t": 64, "y": 8, "x": 8}, {"v": "f64"}, coords=coords(8, 8), crs="EPSG:4326")
    df = create_pyramid(ds, 3).level(2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from pyspark.sql import functions as F

        assert df.groupBy(F.spark_partition_id()).count().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_one_shuffle_for_a_chain(spark):
    p = create_pyramid(make(spark, 64, 64), 4)
    assert p.level(3)._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    plan = p.level(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in create_pyramid(make(spark, 64, 64), 4, method="nearest").level(3)._jdf.queryExecution().executedPlan().toString()


def test_window_reaches_the_scan(spark, tmp_path):
    ds = make(spark, 64, 64)
    ds.frames[YX].write.parquet(f"{tmp_path}/cells")
    p = create_pyramid(ds.with_frames({YX: spark.read.parquet(f"{tmp_path}/cells")}, ds.sizes, ds.coords), 3)
    got = p.window(2, 3, 5, 1, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y,12)" in plan and "LessThan(y,20)" in plan
    assert rows(got) == rows(p.level(2).where("y between 3 and 4 and x between 1 and 3"))


@pytest.mark.parametrize("method", ["mean", "max", "min", "sum", "nearest"])
def test_store(spark, tmp_path, method):
    p, root = create_pyramid(make(spark), 3, method=method), f"{tmp_path}/s"
    stats = store.write(p, root, stats=True, keep_levels_in_memory=method != "max")
    assert sorted(stats) == [0, 1, 2] and stats[0]["rows"] == 13 * 15
    for n in range(3):
        assert rows(store.read(spark, root, YX, n)) == rows(p.level(n))
    assert json.loads(store.read_attrs(spark, root))["multiscales"]["resampling_method"] == method
    assert store.read_side(spark, root, 1).where("kind = 'coordinate'").count() == 2


def test_store_guards(spark, tmp_path):
    p, root = create_pyramid(make(spark), 3), f"{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        store.write(p, root, levels=[2], mode="a")
    with pytest.raises(ValueError):
        store.write(p, root, levels=[3])
    assert store.write(p, root, levels=[0, 1, 1]) is None
    with pytest.raises(ValueError, match="delete"):
        store.write(p, root, levels=[2])
    with pytest.raises(FileExistsError):
        store.write(p, root, mode="w-")
    store.write(p, root, levels=[2], mode="a")
    assert rows(store.read(spark, root, YX, 2)) == rows(p.level(2))
    (tmp_path / "other").mkdir()
    with pytest.raises(FileExistsError):
        store.write(p, f"{tmp_path}/other")


@pytest.mark.parametrize("variables", [False, True])
def test_regions_stay_together(spark, variables):
    ds = make(spark, 13, 15)
    df = store.by_region(ds.frames[YX].repartition(5), YX, (4, 4), ds.variables if variables else ())
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    placed = df.select(F.spark_partition_id().alias("p"), F.expr("y div 4"), F.expr("x div 4"), "y", "x").collect()
    assert len(placed) == 13 * 15
    order = [tuple(r) for r in placed]
    assert order == sorted(order)
    assert len({r[:3] for r in order}) == len({r[1:3] for r in order}) == 16


def test_blocks(spark):
    ds = make(spark, 13, 15, "f32")
    v = ds.variables[0]
    made = store.blocks(ds.frames[YX], YX, ds.sizes, v, (4, 8))
    assert made.count() == 8
    assert {tuple(r.shape) for r in made.collect()} == {(4, 8), (4, 7), (1, 8), (1, 7)}
    assert rows(store.cells(made, YX, v, (4, 8))) == rows(ds.frames[YX])


def test_stream(spark, tmp_path):
    p = create_pyramid(make(spark, 16, 16), 3)
    df = p.source.frames[YX]
    for i in range(2):  # two deliveries of whole tiles
        df.where(f"y div 8 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = stream_levels(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), p, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert q.exception() is None
    assert rows(read_stream_level(spark, f"{tmp_path}/out", YX, 2).select(*YX, "v")) == rows(p.level(2))


def test_coordinates_and_metadata():
    p = create_pyramid(planned(YX, {"y": 8, "x": 8}), factors=[1, 2, 8], layer_hints={"v": LayerHint([0, 1], "blues")})
    assert p.templates[1].coords["x"].values == [0.5, 2.5, 4.5, 6.5]
    layout = p.attrs["multiscales"]["layout"]
    assert layout[0] == {"asset": "0", "spatial:transform": [1.0, 0.0, -0.5, 0.0, 1.0, -0.5], "spatial:shape": [8, 8]}
    assert layout[2]["transform"] == {"scale": [4.0, 4.0], "translation": [1.5, 1.5]} and layout[2]["derived_from"] == "1"
    assert layout[2]["spatial:transform"] == [8.0, 0.0, -0.5, 0.0, 8.0, -0.5]
    assert p.attrs["zarr-layer"] == {"v": {"clim": [0, 1], "colormap": "blues"}}
    assert [c["name"] for c in p.attrs["zarr_conventions"]] == ["multiscales", "proj", "spatial"]
    assert affine(coords(4, 4), "x", "y") == [1.0, 0.0, -0.5, 0.0, -2.0, 11.0] and bbox([1.0, 0, -0.5, 0, -2.0, 11.0], 4, 4) == [-0.5, 3.0, 3.5, 11.0]
    flat = attach_metadata(planned(YX, {"y": 8, "x": 8}))
    assert "multiscales" not in flat.attrs and flat.attrs["spatial:shape"] == [8, 8]
    assert json.loads(to_json({"a": np.float32(1), "b": np.arange(2)})) == {"a": 1, "b": [0, 1]}


def test_layout():
    assert [ideal_side(n) for n in (1, 2, 4, 8)] == [724, 512, 362, 256]
    assert [even_chunk(n, 362) for n in (250, 500, 1000, 2000, 7200)] == [250, 250, 334, 334, 360]
    assert nested_chunk(2000, 362, 1000, 4) == 250 and nested_chunk(100, 362, 50, 4) is None and nested_chunk(2000, 362, 0, 4) is None
    assert recommend_encoding(planned(YX, {"y": 2000, "x": 500}))["v"] == {"chunks": (334, 250), "shards": (1336, 500)}
    assert recommend_encoding(planned(("time", *YX), {"time": 4, "y": 500, "x": 500}))["v"] == {"chunks": (1, 250, 250), "shards": (4, 500, 500)}
    assert recommend_encoding(planned(YX, {"y": 2000, "x": 2000}, chunks=(1000, 1000)))["v"] == {"chunks": (250, 250), "shards": (1000, 1000)}
    assert recommend_encoding(planned(YX, {"y": 500, "x": 500}), chunks_per_shard=None)["v"] == {"chunks": (250, 250)}
    deep = recommend_encoding(planned(("time", *YX), {"time": 512, "y": 64, "x": 64}))["v"]
    assert deep["shards"][0] == 128
    with pytest.raises(ValueError):
        recommend_encoding(planned(YX, {"y": 9, "x": 9}), chunks_per_shard=3)


def test_regions(spark):
    assert copy_region((4, 4), (100, 100), 4, (6, 8)) == (12, 8) and copy_region((4, 4), (100, 100), 4, None) == (4, 4)
    assert copy_region((4, 4), (100, 100), 4, (6, 8), 100) == (4, 4)
    assert region_count((5, 4), (2, 2)) == 6 and region_bytes((2, 2), 4, 2) == 64
    got = rows(region_grid(spark, YX, (5, 4), (2, 2)))
    assert len(got) == 6 and (4, 5, 2, 4) in got
    assert workers(1 << 30, cpus=8, available=4 << 30) == 1 and workers(1, cpus=8, available=4 << 30) == 16


def test_sparse_sources_and_selection(spark):
    ds = make(spark, 8, 8)
    assert ds.select("v").variables == ds.variables and not ds.select("w").frames
    with pytest.raises(ValueError, match="more than one"):
        create_pyramid(Raster(ds.sizes, ds.variables, ds.frames, {**ds.coords, "lat": Coordinate("lat", YX, [])}, "EPSG:4326"), 2)
