"""Registered queries of the raster engine, each with DuckDB SQL that gives the same rows.

Grids are made of the tables: event ids in rows of 40 cells, embeddings as rows of
components, customers in rows of 30.  Sizes always come from the data.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.coarsen import coarsen, copy_level
from terrace.operators.coords import attach, coarsen_coordinate_frame, coordinate_frame
from terrace.operators.pyramid import create_pyramid
from terrace.operators.tiles import tiled_levels
from terrace.plans.layout import encoding_frame, recommend_encoding, region_grid
from terrace.plans.metadata import LayerHint, attach_metadata, coordinate_spacing, layout_frame
from terrace.plans.raster import EPOCH, Coordinate, Raster, densified, raster
from terrace.sources import store, zarr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

YX = ("y", "x")
CODES = {"click": 10, "view": 20, "signup": 30, "error": 80, "purchase": 200}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Grids

G1 = "SELECT CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, round(value * 100) AS v FROM events"
G2 = "SELECT CAST(vec_id AS INT) AS y, CAST(u.i AS INT) AS x, embedding[u.i + 1] AS v FROM embeddings, (SELECT unnest(range(64)) AS i) u"
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in CODES.items()) + " END"
G3 = f"SELECT CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, CAST({CODE_SQL} AS SMALLINT) AS v FROM events"
G4 = "SELECT CAST((c_custkey - o.low) // 30 AS INT) AS y, CAST((c_custkey - o.low) % 30 AS INT) AS x, CAST(trunc(c_acctbal) - 4500 AS SMALLINT) AS v FROM customer, (SELECT min(c_custkey) AS low FROM customer) o"
G5 = "SELECT y, x, CASE WHEN event_type = 'error' OR (y % 16 < 4 AND x % 16 < 4) THEN 'NaN'::DOUBLE ELSE v END AS v FROM (SELECT CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, round(value * 100) AS v, event_type FROM events)"
G6 = "SELECT CAST(event_id // 1000 AS INT) AS t, CAST((event_id % 1000) // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, round(value * 100) AS v FROM events"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(df: DataFrame, column: str) -> int:
    return int(df.agg(F.max(column)).first()[0]) + 1


def _coords(ny: int, nx: int) -> dict[str, Coordinate]:
    return {"x": Coordinate("x", ("x",), [-180 + 0.5 * i for i in range(nx)]), "y": Coordinate("y", ("y",), [90 - 0.25 * i for i in range(ny)])}


def _grid(df: DataFrame, ny: int, nx: int, dtype: str = "f64", fill: float | None = None, names: tuple[str, ...] = ("v",), **more) -> Raster:
    return raster(df, YX, {"y": ny, "x": nx}, dict.fromkeys(names, dtype), coords=_coords(ny, nx), crs="EPSG:4326", fills={n: fill for n in names} if fill is not None else None, **more)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    events = _table(spark, sf_dir, "events")
    cells = events.select(F.expr("cast(event_id div 40 as int)").alias("y"), F.expr("cast(event_id % 40 as int)").alias("x"), F.round(F.col("value") * 100).alias("v"), "event_type")
    return cells, -(-_count(events, "event_id") // 40)


def g1(spark: SparkSession, sf_dir: str) -> Raster:
    cells, ny = _events(spark, sf_dir)
    return _grid(cells, ny, 40)


def g2(spark: SparkSession, sf_dir: str) -> Raster:
    vectors = _table(spark, sf_dir, "embeddings")
    return _grid(vectors.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")), _count(vectors, "vec_id"), 64, "f32")


def g3(spark: SparkSession, sf_dir: str, fill: float | None = None) -> Raster:
    cells, ny = _events(spark, sf_dir)
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("event_type")]
    return _grid(cells.withColumn("v", code), ny, 40, "u8", fill)


def g4(spark: SparkSession, sf_dir: str) -> Raster:
    customers = _table(spark, sf_dir, "customer")
    low, high = customers.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    key = F.col("c_custkey") - low
    value = F.when(F.col("c_acctbal") < 0, F.ceil("c_acctbal")).otherwise(F.floor("c_acctbal")) - 4500
    return _grid(customers.select(F.floor(key / 30).alias("y"), (key % 30).alias("x"), value.alias("v")), -(-(high - low + 1) // 30), 30, "i16")


def g5(spark: SparkSession, sf_dir: str) -> Raster:
    cells, ny = _events(spark, sf_dir)
    hole = (F.col("event_type") == "error") | ((F.col("y") % 16 < 4) & (F.col("x") % 16 < 4))
    return _grid(cells.withColumn("v", F.when(hole, F.lit(float("nan"))).otherwise(F.col("v"))), ny, 40)


def _one(ds: Raster, method: str, strides: dict[str, int] | None = None, **more) -> DataFrame:
    """One step over the only frame of a dataset."""
    (dims, df), v = next(iter(ds.frames.items())), ds.variables
    return coarsen(df, dims, ds.sizes, strides or {"y": 2, "x": 2}, {a.name: a.dtype for a in v}, method, fills={a.name: a.fill for a in v}, **more)


# SQL of one step and of chains

AGG = {"mean": "avg(v)", "max": "max(v)", "min": "min(v)", "sum": "sum(v)"}
HOLES = "coalesce({} FILTER (WHERE NOT isnan(v)), 'NaN'::DOUBLE)"
SATURATED = "CAST(least(greatest(trunc({}), {}), {}) AS SMALLINT)"


def _step(prev: str, aggregate: str, sy: int = 2, sx: int = 2, keys: str = "") -> str:
    """A level from the relation ``prev``, whose sizes are one more than its largest indices."""
    lead = f"{keys}, " if keys else ""
    return (
        f"SELECT {lead}CAST(y // {sy} AS INT) AS y, CAST(x // {sx} AS INT) AS x, {aggregate} AS v FROM {prev} "
        f"WHERE y < ((SELECT max(y) + 1 FROM {prev}) // {sy}) * {sy} AND x < ((SELECT max(x) + 1 FROM {prev}) // {sx}) * {sx} GROUP BY {lead}y // {sy}, x // {sx}"
    )


def _corner(prev: str, s: int = 2) -> str:
    return f"SELECT CAST(y // {s} AS INT) AS y, CAST(x // {s} AS INT) AS x, v FROM {prev} WHERE y % {s} = 0 AND x % {s} = 0 AND y < ((SELECT max(y) + 1 FROM {prev}) // {s}) * {s} AND x < ((SELECT max(x) + 1 FROM {prev}) // {s}) * {s}"


def _chain(grid: str, method: str, steps: list[int], aggregate: str | None = None, value: str = "v") -> str:
    parts = [f"l0 AS ({grid})"]
    for i, s in enumerate(steps, 1):
        parts.append(f"l{i} AS ({_corner(f'l{i - 1}', s) if method == 'nearest' else _step(f'l{i - 1}', aggregate or AGG[method], s, s)})")
    union = " UNION ALL ".join(f"SELECT {i} AS level, y, x, {value} AS v FROM l{i}" for i in range(len(steps) + 1))
    return f"WITH {', '.join(parts)} {union}"


# One step

query("level0_copy", G1)(lambda s, d: (lambda g: copy_level(g.frames[YX], YX, ["v"]))(g1(s, d)))
for _m in ("mean", "max", "min", "sum"):
    query(f"coarsen_{_m}", f"WITH g AS ({G1}) {_step('g', AGG[_m])}")(lambda s, d, m=_m: _one(g1(s, d), m))
query("coarsen_nearest", f"WITH g AS ({G1}) {_corner('g')}")(lambda s, d: _one(g1(s, d), "nearest"))
query("coarsen_mean_f32", f"WITH g AS ({G2}) {_step('g', 'CAST(avg(CAST(v AS DOUBLE)) AS REAL)')}")(lambda s, d: _one(g2(s, d), "mean"))
query("int_mean_trunc", f"WITH g AS ({G4}) {_step('g', 'CAST(trunc(avg(v)) AS SMALLINT)')}")(lambda s, d: _one(g4(s, d), "mean"))
query("int_sum_saturate", f"WITH g AS ({G3}) {_step('g', SATURATED.format('sum(v)', 0, 255))}")(lambda s, d: _one(g3(s, d), "sum"))
query("nearest_categorical", f"WITH g AS ({G3}) {_corner('g')}")(lambda s, d: _one(g3(s, d), "nearest"))
query("fill_mean", f"WITH g AS ({G3}) {_step('g', 'coalesce(CAST(trunc(avg(v) FILTER (WHERE v <> 200)) AS SMALLINT), 200::SMALLINT)')}")(lambda s, d: _one(g3(s, d, 200), "mean"))
query("fill_max", f"WITH g AS ({G3}) {_step('g', 'coalesce(max(v) FILTER (WHERE v <> 200), 200::SMALLINT)')}")(lambda s, d: _one(g3(s, d, 200), "max"))
query("all_missing", f"WITH g AS ({G5}), c AS ({_step('g', HOLES.format('max(v)'))}) SELECT y, x FROM c WHERE isnan(v)")(lambda s, d: _one(g5(s, d), "max").where(F.isnan("v")).select("y", "x"))
query("skipna_true", f"WITH g AS ({G5}), c AS ({_step('g', HOLES.format('avg(v)'))}) SELECT y, x, round(v, 4) AS v FROM c")(lambda s, d: _one(g5(s, d), "mean").withColumn("v", F.round("v", 4)))
query("skipna_sum", f"WITH g AS ({G5}) {_step('g', 'coalesce(sum(v) FILTER (WHERE NOT isnan(v)), 0)')}")(lambda s, d: _one(g5(s, d), "sum"))
query("skipna_false", f"WITH g AS ({G5}) {_step('g', 'avg(v)')}")(lambda s, d: _one(g5(s, d), "mean", skipna=False))
for _m in ("min", "max"):
    query(f"skipna_false_{_m}", f"WITH g AS ({G5}) {_step('g', f'''CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE {_m}(v) END''')}")(lambda s, d, m=_m: _one(g5(s, d), m, skipna=False))
query("short_axis", f"WITH g AS ({G2}) SELECT CAST(y // 2 AS INT) AS y, CAST(0 AS INT) AS x, max(v) AS v FROM g WHERE y < ((SELECT max(y) + 1 FROM g) // 2) * 2 GROUP BY y // 2")(lambda s, d: _one(g2(s, d), "max", {"y": 2, "x": 100}))
query("anisotropic_stride", f"WITH g AS ({G1}) {_step('g', 'sum(v)', 3, 5)}")(lambda s, d: _one(g1(s, d), "sum", {"y": 3, "x": 5}))
query("pyramid_step_int", f"WITH g AS ({G4}) {_step('g', SATURATED.format('sum(v)', -32768, 32767))}")(lambda s, d: _one(g4(s, d), "sum"))


@query("extra_dim", f"WITH g AS ({G6}) {_step('g', 'avg(v)', keys='t')}")
def extra_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    cells = events.select(F.expr("event_id div 1000").alias("t"), F.expr("(event_id % 1000) div 40").alias("y"), (F.col("event_id") % 40).alias("x"), F.round(F.col("value") * 100).alias("v"))
    n = _count(events, "event_id")
    return _one(raster(cells, ("t", "y", "x"), {"t": -(-n // 1000), "y": 25, "x": 40}, {"v": "f64"}), "mean")


# Chains


def _levels(ds: Raster, method: str, **more) -> DataFrame:
    return create_pyramid(ds, method=method, **more).union().select("level", *YX, "v")


for _m in ("mean", "max", "min", "sum", "nearest"):
    query(f"pyramid_{_m}_chain", _chain(G1, _m, [2, 2, 2]))(lambda s, d, m=_m: _levels(g1(s, d), m, levels=4))
query("sparse_factors", _chain(G1, "mean", [4, 4]))(lambda s, d: _levels(g1(s, d), "mean", factors=[1, 4, 16]))
query("nonuniform_factors", _chain(G1, "mean", [2, 4]))(lambda s, d: _levels(g1(s, d), "mean", factors=[1, 2, 8]))
query("pyramid_holes_chain", _chain(G5, "mean", [2, 2], HOLES.format("avg(v)"), "round(v, 4)"))(lambda s, d: _levels(g5(s, d), "mean", levels=3).withColumn("v", F.round("v", 4)))
query("pyramid_int_chain", _chain(G4, "mean", [2, 2], "CAST(trunc(avg(v)) AS SMALLINT)"))(lambda s, d: _levels(g4(s, d), "mean", levels=3))


@query("datatree_int_mean", f"WITH g AS ({G4}), a AS ({_step('g', 'avg(v)')}), b AS ({_step('a', 'avg(v)')}) SELECT y, x, round(v, 6) AS v FROM b")
def datatree_int_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_pyramid(g4(spark, sf_dir), 3).as_levels()[2].frames[YX].withColumn("v", F.round("v", 6))


@query("multi_var", f"WITH g AS ({G1}) " + _step("g", "avg(v)").replace(" AS v FROM", " AS v, avg(2 * v) AS slope FROM"))
def multi_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, ny = _events(spark, sf_dir)
    return create_pyramid(_grid(cells.withColumn("slope", F.col("v") * 2), ny, 40, names=("v", "slope")), 2).level(1)


@query("window_query", f"WITH l0 AS ({G1}), l1 AS ({_step('l0', 'avg(v)')}), l2 AS ({_step('l1', 'avg(v)')}) SELECT * FROM l2 WHERE y BETWEEN 3 AND 4 AND x BETWEEN 1 AND 5")
def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_pyramid(g1(spark, sf_dir), 3).window(2, 3, 5, 1, 6)


@query("densified_sum", f"WITH g AS (SELECT y, x, CASE WHEN event_type = 'view' THEN 0 ELSE v END AS v FROM (SELECT CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, round(value * 100) AS v, event_type FROM events)) {_step('g', 'sum(v)')}")
def densified_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse source: absent cells add nothing, and windows without cells are 0."""
    cells, ny = _events(spark, sf_dir)
    ds = _grid(cells, ny, 40)
    sparse = densified(cells.where("event_type <> 'view'").select(*YX, "v"), YX, ds.sizes, ds.variables)
    return coarsen(sparse, YX, ds.sizes, {"y": 2, "x": 2}, {"v": "f64"}, "sum")


# Coordinates and metadata

AXES = "SELECT 'x' AS dim, CAST(i AS INT) AS idx, -180 + 0.5 * i AS value FROM range(40) r(i) UNION ALL SELECT 'y', CAST(i AS INT), 90 - 0.25 * i FROM range((SELECT (max(event_id) + 40) // 40 FROM events)) r(i)"


def _axes(spark: SparkSession, sf_dir: str) -> tuple[Raster, DataFrame]:
    ds = g1(spark, sf_dir)
    return ds, coordinate_frame(spark, ds.coords)


@query("coords_mean", f"WITH a AS ({AXES}) SELECT dim, CAST(idx // 4 AS INT) AS idx, CAST(avg(value) AS DOUBLE) AS value FROM a WHERE idx < ((SELECT max(idx) + 1 FROM a b WHERE b.dim = a.dim) // 4) * 4 GROUP BY dim, idx // 4")
def coords_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, axes = _axes(spark, sf_dir)
    return coarsen_coordinate_frame(axes, "x", ds.sizes["x"], 4).unionByName(coarsen_coordinate_frame(axes, "y", ds.sizes["y"], 4))


@query("cells_with_coords", f"WITH g AS ({G1}) SELECT y, x, v, CAST(90 - 0.25 * y AS DOUBLE) AS lat, CAST(-180 + 0.5 * x AS DOUBLE) AS lon FROM g")
def cells_with_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, axes = _axes(spark, sf_dir)
    return attach(attach(ds.frames[YX], axes, "y", "lat"), axes, "x", "lon").select(*YX, "v", "lat", "lon")


@query("coord_spacing", f"WITH a AS ({AXES}) SELECT dim, count(*) AS n, CAST((arg_max(value, idx) - arg_min(value, idx)) / (count(*) - 1) AS DOUBLE) AS resolution, CAST(arg_min(value, idx) AS DOUBLE) AS origin, true AS uniform FROM a GROUP BY dim")
def coord_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, axes = _axes(spark, sf_dir)
    return coordinate_spacing(axes, "x").unionByName(coordinate_spacing(axes, "y"))


def _numbers(spark: SparkSession, names: list[str], values: list[float]) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{n} double" for n in names))


NY = "(SELECT (max(event_id) + 40) // 40 FROM events)"


#: An axis whose place and step come from the events: west of 0 by the kinds of events, steps by the greatest day.
DRIFT = "SELECT -0.5 * count(DISTINCT event_type) AS ox, 0.25 * count(DISTINCT event_type) AS dx, 0.5 * (max(event_id) % 128 + 1) AS oy, -0.125 * (max(user_id) % 64 + 1) AS dy FROM events"


def _drifted(spark: SparkSession, sf_dir: str) -> Raster:
    kinds, last, users = _table(spark, sf_dir, "events").agg(F.count_distinct("event_type"), F.max("event_id"), F.max("user_id")).first()
    ds = g1(spark, sf_dir)
    x, y = [-0.5 * kinds + 0.25 * kinds * i for i in range(40)], [0.5 * (last % 128 + 1) - 0.125 * (users % 64 + 1) * i for i in range(ds.sizes["y"])]
    return replace(ds, coords={"x": Coordinate("x", ("x",), x), "y": Coordinate("y", ("y",), y)})


@query("affine_transform", f"SELECT CAST(dx AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(ox - dx / 2 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d, CAST(dy AS DOUBLE) AS e, CAST(oy - dy / 2 AS DOUBLE) AS f FROM ({DRIFT})")
def affine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, list("abcdef"), attach_metadata(_drifted(spark, sf_dir)).attrs["spatial:transform"])


@query("bbox", f"SELECT CAST(-180.25 AS DOUBLE) AS xmin, CAST(90.125 - 0.25 * {NY} AS DOUBLE) AS ymin, CAST(-160.25 AS DOUBLE) AS xmax, CAST(90.125 AS DOUBLE) AS ymax")
def bbox_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, ["xmin", "ymin", "xmax", "ymax"], attach_metadata(g1(spark, sf_dir)).attrs["spatial:bbox"])


@query("level_plan", f"WITH n AS (SELECT CAST(floor(log2(least({NY}, 40))) AS BIGINT) AS last, {NY} AS ny) SELECT CAST(i AS INT) AS level, CAST(2 ** i AS INT) AS factor, CAST(CASE WHEN i = 0 THEN 1 ELSE 2 END AS INT) AS step, CAST((ny // CAST(2 ** i AS BIGINT)) * (40 // CAST(2 ** i AS BIGINT)) AS BIGINT) AS cells FROM n, range(20) r(i) WHERE i <= last")
def level_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many levels as the shorter axis has halves."""
    ds = g1(spark, sf_dir)
    p = create_pyramid(ds, min(ds.sizes["y"], ds.sizes["x"]).bit_length())
    return spark.createDataFrame([(i, f, p.step(i), t.sizes["y"] * t.sizes["x"]) for i, (f, t) in enumerate(zip(p.factors, p.templates))], "level int, factor int, step int, cells long")


@query("level_shapes", f"SELECT CAST(i AS INT) AS level, CAST({NY} // CAST(2 ** i AS BIGINT) AS INT) AS ny, CAST(40 // CAST(2 ** i AS BIGINT) AS INT) AS nx FROM range(4) r(i)")
def level_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = create_pyramid(g1(spark, sf_dir), 4)
    return spark.createDataFrame([(i, t.sizes["y"], t.sizes["x"]) for i, t in enumerate(p.templates)], "level int, ny int, nx int")


@query(
    "multiscale_layout",
    "SELECT CAST(i AS VARCHAR) AS asset, CASE WHEN i > 0 THEN CAST(i - 1 AS VARCHAR) END AS derived_from, CASE WHEN i > 0 THEN CAST(2 AS DOUBLE) END AS scale_y, CASE WHEN i > 0 THEN CAST(0.5 AS DOUBLE) END AS translation_x, CASE WHEN i > 0 THEN 'mean' END AS resampling_method, "
    f"CAST(0.5 * 2 ** i AS DOUBLE) AS dx, CAST(-180.25 AS DOUBLE) AS left_edge, CAST(-0.25 * 2 ** i AS DOUBLE) AS dy, CAST(90.125 AS DOUBLE) AS top_edge, CAST({NY} // CAST(2 ** i AS BIGINT) AS INT) AS ny, CAST(40 // CAST(2 ** i AS BIGINT) AS INT) AS nx FROM range(4) r(i)",
)
def multiscale_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout_frame(spark, create_pyramid(g1(spark, sf_dir), 4).attrs)
    t, s = F.col("transform"), F.col("shape")
    return rows.select("asset", "derived_from", F.col("scale")[0].alias("scale_y"), F.col("translation")[1].alias("translation_x"), "resampling_method", t[0].alias("dx"), t[2].alias("left_edge"), t[4].alias("dy"), t[5].alias("top_edge"), s[0].alias("ny"), s[1].alias("nx"))


@query("layer_hints", """SELECT 'v' AS variable, concat('{"clim":[', CAST(min(v) AS VARCHAR), ',', CAST(max(v) AS VARCHAR), '],"colormap":"blues"}') AS hint FROM (SELECT round(value * 100) AS v FROM events)""")
def layer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of the data's values is what a viewer is told to show."""
    ds = g1(spark, sf_dir)
    low, high = ds.frames[YX].agg(F.min("v"), F.max("v")).first()
    p = create_pyramid(ds, 2, layer_hints={"v": LayerHint([low, high], "blues")})
    rows = [(k, h["clim"], h["colormap"]) for k, h in p.attrs["zarr-layer"].items()]
    return spark.createDataFrame(rows, "variable string, clim array<double>, colormap string").select("variable", F.to_json(F.struct("clim", "colormap")).alias("hint"))


# Storage layout

_SIZES = f"SELECT CAST(i AS INT) AS level, {NY} // CAST(2 ** i AS BIGINT) AS ny, 40 // CAST(2 ** i AS BIGINT) AS nx FROM range(3) r(i)"
_CHUNK = "CASE WHEN {0} <= 256 THEN {0} ELSE greatest(128, CAST(ceil({0} / ceil({0} / 256.0)) AS BIGINT)) END"


@query(
    "encoding_plan",
    f"WITH s AS ({_SIZES}), c AS (SELECT *, {_CHUNK.format('ny')} AS cy, {_CHUNK.format('nx')} AS cx FROM s) SELECT level, 'v' AS variable, CAST(cy AS INT) AS chunk_y, CAST(cx AS INT) AS chunk_x, CAST(cy * greatest(1, least(4, ny // cy)) AS INT) AS shard_y, CAST(cx * greatest(1, least(4, nx // cx)) AS INT) AS shard_x FROM c",
)
def encoding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encoding_frame(spark, create_pyramid(g1(spark, sf_dir), 3).encoding)
    return e.select("level", "variable", *[F.col(f"{k}s")[i].alias(f"{k}_{d}") for k in ("chunk", "shard") for i, d in enumerate(YX)])


@query(
    "region_grid",
    f"WITH c AS (SELECT {_CHUNK.format('ny')} AS cy, ny FROM ({_SIZES}) WHERE level = 0), s AS (SELECT cy * greatest(1, least(4, ny // cy)) AS sy, ny FROM c) SELECT CAST(i * sy AS INT) AS y_start, CAST(least((i + 1) * sy, ny) AS INT) AS y_stop, CAST(0 AS INT) AS x_start, CAST(40 AS INT) AS x_stop FROM s, range(100000) r(i) WHERE i * sy < ny",
)
def region_grid_(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = g1(spark, sf_dir)
    return region_grid(spark, YX, (ds.sizes["y"], ds.sizes["x"]), recommend_encoding(ds)["v"]["shards"])


@query("nonempty_blocks", f"WITH g AS ({G5}) SELECT CAST(y // 4 AS INT) AS y_block, CAST(x // 4 AS INT) AS x_block, count(*) FILTER (WHERE NOT isnan(v)) AS present FROM g GROUP BY y // 4, x // 4 HAVING count(*) FILTER (WHERE NOT isnan(v)) > 0")
def nonempty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = g5(spark, sf_dir)
    return store.nonempty(ds.frames[YX], YX, (4, 4), ds.variables)


# Stores


def _root(spark: SparkSession) -> str:
    """A new store in the folder that driver and executors share; a session on one machine may name none and gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="terrace-")
    return f"{shared.rstrip('/')}/pyramid-{uuid.uuid4().hex}"


@query("store_round_trip", _chain(G1, "mean", [2, 2]))
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _root(spark)
    store.write(create_pyramid(g1(spark, sf_dir), 3), root)
    return store.read_levels(spark, root, YX).select("level", *YX, "v")


@query("store_append_level", f"WITH g AS ({G1}), a AS ({_step('g', 'max(v)')}) SELECT 2 AS level, y, x, v FROM ({_step('a', 'max(v)')})")
def store_append_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 2 is added to a store that holds levels 0 and 1, and read without touching them."""
    root, p = _root(spark), create_pyramid(g1(spark, sf_dir), 3, method="max")
    store.write(p, root, levels=[0, 1])
    store.write(p, root, levels=[2], mode="a")
    return store.read_levels(spark, root, YX).where("level = 2").select("level", *YX, "v")


@query("store_skip_empty", f"WITH g AS ({G5}) SELECT y, x, v FROM g WHERE (y // 4, x // 4) IN (SELECT (y // 4, x // 4) FROM g WHERE NOT isnan(v))")
def store_skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = g5(spark, sf_dir)
    return store.without_empty(ds.frames[YX], YX, (4, 4), ds.variables)


@query("chunk_round_trip", f"WITH g AS ({G1}) {_step('g', 'avg(v)')}")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 1 as row-major chunks and back."""
    p = create_pyramid(g1(spark, sf_dir), 2)
    v, sizes = p.source.variables[0], p.templates[1].sizes
    return store.cells(store.blocks(p.level(1), YX, sizes, v, (16, 16)), YX, v, (16, 16))


@query("zarr_round_trip", _chain(G1, "mean", [2, 2]))
def zarr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels through sharded arrays."""
    root, p = _root(spark), create_pyramid(g1(spark, sf_dir), 3)
    zarr.write_pyramid(p, root)
    levels = [zarr.read_array(spark, root, f"{n}/v").select(F.lit(n).alias("level"), *YX, "v") for n in range(3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


@query("zarr_append", f"WITH g AS ({G1}), a AS ({_step('g', 'max(v)')}) SELECT y, x, v FROM ({_step('a', 'max(v)')})")
def zarr_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 2 is added to a store that holds levels 0 and 1."""
    root, p = _root(spark), create_pyramid(g1(spark, sf_dir), 3, method="max")
    zarr.write_pyramid(p, root, levels=[0, 1])
    zarr.write_pyramid(p, root, levels=[2], mode="a")
    return zarr.read_array(spark, root, "2/v").select(*YX, "v")


@query("zarr_opened", f"WITH g AS ({G1}), a AS ({_step('g', 'max(v)')}) SELECT y, x, v FROM ({_step('a', 'max(v)')})")
def zarr_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's level 1, packed by zstd, is opened as a dataset and coarsened once more."""
    root, p = _root(spark), create_pyramid(g1(spark, sf_dir), 2, method="max")
    zarr.write_pyramid(p, root, compressor="zstd")
    return create_pyramid(zarr.open_group(spark, root, "1", crs="EPSG:4326"), 2, method="max").level(1).select(*YX, "v")


query("tiled_levels", _chain(G1, "mean", [2, 2, 2]))(lambda s, d: tiled_levels(create_pyramid(g1(s, d), 4), YX, [0, 1, 2, 3]).select("level", *YX, "v"))
query("tiled_int_levels", _chain(G4, "mean", [2, 2], "CAST(trunc(avg(v)) AS SMALLINT)"))(lambda s, d: tiled_levels(create_pyramid(g4(s, d), 3), YX, [0, 1, 2]).select("level", *YX, "v"))
query("tiled_holes", _chain(G5, "max", [2, 2], HOLES.format("max(v)")))(lambda s, d: tiled_levels(create_pyramid(g5(s, d), 3, method="max"), YX, [0, 1, 2]).select("level", *YX, "v"))


@query("tiled_f32_chunks", f"WITH l0 AS ({G2}), l1 AS ({_step('l0', 'max(v)')}), l2 AS ({_step('l1', 'max(v)')}) SELECT * FROM l2")
def tiled_f32_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels above a stored array, whose chunks are read by the tasks that reduce them, without an exchange."""
    root = _root(spark)
    zarr.write_pyramid(create_pyramid(g2(spark, sf_dir), 1, target_chunk_bytes=16384), root)
    p = create_pyramid(zarr.open_group(spark, root, "0", crs="EPSG:4326"), 3, method="max")
    return tiled_levels(p, YX, [0, 1, 2]).where("level = 2").select(*YX, "v")


@query("zarr_blosc", _chain(G2, "max", [2, 2]))
def zarr_blosc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels through chunks that Blosc packed, with check sums."""
    root, p = _root(spark), create_pyramid(g2(spark, sf_dir), 3, method="max")
    zarr.write_pyramid(p, root, compressor="blosc", checked=True)
    levels = [zarr.read_array(spark, root, f"{n}/v").select(F.lit(n).alias("level"), *YX, "v") for n in range(3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


@query("zarr_window", f"WITH l0 AS ({G1}), l1 AS ({_step('l0', 'avg(v)')}) SELECT * FROM l1 WHERE y >= (SELECT max(y) FROM l1) // 2 AND y < (SELECT max(y) FROM l1) // 2 + 20 AND x IN (2, 3, 11)")
def zarr_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window on a stored level, whose bounds reach the scan: only chunks within them are opened."""
    root, p = _root(spark), create_pyramid(g1(spark, sf_dir), 2, target_chunk_bytes=16384)
    zarr.write_pyramid(p, root, compressor="zstd")
    low = (p.templates[1].sizes["y"] - 1) // 2
    return zarr.read_array(spark, root, "1/v").where((F.col("y") >= low) & (F.col("y") < low + 20) & F.col("x").isin(2, 3, 11)).select(*YX, "v")


@query("zarr_coords", "WITH a AS (SELECT event_id // 40 AS y, epoch_us(date_trunc('second', min(ts))) AS us FROM events GROUP BY event_id // 40), l AS (SELECT 0 AS level, y, us FROM a UNION ALL SELECT 1, y // 2, CAST(sum(us) AS HUGEINT) // 2 FROM a WHERE y < ((SELECT max(y) + 1 FROM a) // 2) * 2 GROUP BY y // 2) SELECT CAST(level AS INT) AS level, CAST(y AS INT) AS y, CAST(us AS BIGINT) AS us FROM l")
def zarr_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis of times and one of 32-bit numbers through a store, at both levels."""
    ds = g1(spark, sf_dir)
    first = _table(spark, sf_dir, "events").groupBy(F.expr("cast(event_id div 40 as int)").alias("y")).agg(F.date_trunc("second", F.min("ts")).alias("t"))
    times = [EPOCH + dt.timedelta(microseconds=r.us) for r in first.orderBy("y").select(F.unix_micros("t").alias("us")).collect()]  # as long as the axis
    p = create_pyramid(replace(ds, coords={**ds.coords, "when": Coordinate("when", ("y",), times)}), 2)
    root = _root(spark)
    zarr.write_pyramid(p, root)
    rows = [(n, i, (x - EPOCH) // dt.timedelta(microseconds=1)) for n in range(2) for i, x in enumerate(zarr.read_axis(spark, root, f"{n}/when").values)]
    return spark.createDataFrame(rows, "level int, y int, us long")


@query("zarr_references", G2)
def zarr_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 by a table of the places of its chunks in other objects, as a virtual array has it."""
    root = _root(spark)
    p = create_pyramid(g2(spark, sf_dir), 1, target_chunk_bytes=16384, chunks_per_shard=None)
    zarr.write_pyramid(p, root)
    _, grid = zarr.array_grid(spark, root, "0/v")
    return zarr.read_references(_places(spark, f"{root}/0/v"), grid).select(*YX, "v")


def _places(spark: SparkSession, path: str) -> DataFrame:
    """Where the chunks of a stored array are, as a table of references has it."""
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*[0-9]").load(f"{path}/c")
    key = F.split(F.regexp_extract("path", r"/c/(\d+/\d+)$", 1), "/").cast("array<int>")
    return objects.select(F.lit("v").alias("name"), key.alias("chunk"), "path", F.lit(0).alias("offset"), "length")


@query("virtual_levels", _chain(G2, "max", [2, 2]))
def virtual_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose level 0 stays in another's objects, with coarser levels appended to it."""
    root, store_root = _root(spark), _root(spark)
    zarr.write_pyramid(create_pyramid(g2(spark, sf_dir), 1, target_chunk_bytes=16384, chunks_per_shard=None), root)
    _, grid = zarr.array_grid(spark, root, "0/v")
    zarr.write_references(_places(spark, f"{root}/0/v"), grid, store_root, "0")
    p = create_pyramid(replace(zarr.open_group(spark, store_root, "0", crs="EPSG:4326"), coords=_coords(grid.shape[0], grid.shape[1])), 3, method="max")
    zarr.write_pyramid(p, store_root, levels=[1, 2], mode="a", from_source=True)
    levels = [zarr.read_array(spark, store_root, f"{n}/v").select(F.lit(n).alias("level"), *YX, "v") for n in range(3)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


@query("zarr_flat", G1)
def zarr_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset without coarser levels, written with a layout of its own and opened."""
    ds, root = g1(spark, sf_dir), _root(spark)
    zarr.write_flat(ds, root, encoding=recommend_encoding(ds, target_chunk_bytes=32768), compressor="gzip")
    return zarr.open_group(spark, root).frames[YX].select(*YX, "v")


@query("store_versions", f"WITH g AS ({G1}), a AS ({_step('g', 'max(v)')}), b AS ({_step('g', 'min(v)')}) SELECT CAST(1 AS INT) AS version, y, x, v FROM a UNION ALL SELECT 2, y, x, v FROM b")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 1 before and after it was rewritten by another method; the version before was kept."""
    ds, root = g1(spark, sf_dir), _root(spark)
    store.write(create_pyramid(ds, 2, method="max"), root)
    store.write(create_pyramid(ds, 2, method="min"), root, levels=[1], mode="a", history=1)
    parts = [store.read(spark, root, YX, 1, version=n).select(F.lit(n).alias("version"), *YX, "v") for n in (1, 2)]
    return parts[0].unionByName(parts[1])


@query("coords_2d", "WITH g AS (SELECT CAST(event_id // 40 AS INT) AS y, CAST(event_id % 40 AS INT) AS x, round(value * 100) AS v, 0.5 * user_id AS lat FROM events), a AS (" + _step("g", "max(v)").replace(" AS v FROM", " AS v, avg(lat) AS lat FROM") + ") " + _step("a", "max(v)").replace(" AS v FROM", " AS v, CAST(avg(lat) AS DOUBLE) AS lat FROM"))
def coords_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate with a value for each cell goes by mean beside data that go by max."""
    events = _table(spark, sf_dir, "events")
    cells = events.select(F.expr("cast(event_id div 40 as int)").alias("y"), F.expr("cast(event_id % 40 as int)").alias("x"), F.round(F.col("value") * 100).alias("v"), (F.col("user_id") * 0.5).alias("lat"))
    ds = _grid(cells, -(-_count(events, "event_id") // 40), 40, names=("v", "lat"), auxiliary=("lat",))
    return create_pyramid(ds, 3, method="max").level(2).select(*YX, "v", "lat")


@query("deep_stack", f"WITH l0 AS ({G6}), l1 AS ({_step('l0', 'max(v)', keys='t')}), l2 AS ({_step('l1', 'max(v)', keys='t')}) SELECT * FROM l2")
def deep_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over many small grids, which are dealt out by their own index too."""
    events = _table(spark, sf_dir, "events")
    cells = events.select(F.expr("event_id div 1000").alias("t"), F.expr("(event_id % 1000) div 40").alias("y"), (F.col("event_id") % 40).alias("x"), F.round(F.col("value") * 100).alias("v"))
    n = _count(events, "event_id")
    ds = raster(cells, ("t", "y", "x"), {"t": -(-n // 1000), "y": 25, "x": 40}, {"v": "f64"}, coords=_coords(25, 40), crs="EPSG:4326")
    return create_pyramid(ds, 3, method="max").level(2)
