"""Geospatial metadata: affine transform, bounding box, conventions and the multiscale layout."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.plans.raster import Coordinate, Raster
from terrace.plans.reference_systems import by_rule

# Fixed values of the published conventions.
CONVENTIONS = {
    "multiscales": ("multiscales", "d35379db-88df-4056-af3a-620245f8e347", "Multiscale layout of zarr datasets"),
    "proj": ("geo-proj", "f17cb550-5864-4468-aeb7-f3180cfb622f", "Coordinate reference system information for geospatial data"),
    "spatial": ("spatial", "689b58e2-cf7b-45e0-9fff-9cfc0883d6b4", "Spatial coordinate information"),
}
SCHEMA_URL = "https://raw.githubusercontent.com/zarr-conventions/{}/refs/tags/v1/schema.json"
SPEC_URL = "https://github.com/zarr-conventions/{}/blob/v1/README.md"
#: Spacings within this part of the first one count as equal.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def convention(name: str) -> dict[str, str]:
    folder, uuid, description = CONVENTIONS[name]
    return {"schema_url": SCHEMA_URL.format(folder), "spec_url": SPEC_URL.format(folder), "uuid": uuid, "name": name, "description": description}


@dataclass(frozen=True)
class LayerHint:
    """How to show a variable: its colour range ``[min, max]`` and a colour map's name."""

    clim: list[float] | None = None
    colormap: str | None = None


def spacing(values: Sequence[float], dim: str, fallback: float | None = None) -> float:
    """The uniform spacing of a coordinate; a single value needs ``fallback``."""
    if len(values) < 2:
        if fallback is None:
            raise ValueError(f"{dim} has one value, so its resolution is unknown")
        return fallback
    steps = [float(b) - float(a) for a, b in zip(values, values[1:])]
    if not all(abs(s - steps[0]) <= ABSOLUTE + RELATIVE * abs(steps[0]) for s in steps):
        raise ValueError(f"{dim} is not evenly spaced")
    return steps[0]


def affine(coords: Mapping[str, Coordinate], x_dim: str, y_dim: str, fallback: tuple[float, float] | None = None) -> list[float]:
    """``[x step, 0, left, 0, y step, top]``, the corner half a cell before the first centre."""
    x, y = coords[x_dim].values, coords[y_dim].values
    dx, dy = spacing(x, x_dim, fallback and fallback[0]), spacing(y, y_dim, fallback and fallback[1])
    return [dx, 0.0, float(x[0]) - dx / 2, 0.0, dy, float(y[0]) - dy / 2]


def bbox(transform: Sequence[float], nx: int, ny: int) -> list[float]:
    """``[xmin, ymin, xmax, ymax]`` for either direction of the axes."""
    dx, _, left, _, dy, top = transform
    xs, ys = sorted((left, left + dx * nx)), sorted((top, top + dy * ny))
    return [xs[0], ys[0], xs[1], ys[1]]


def wkt2(crs: str) -> str | None:
    """The reference system as WKT2: by pyproj where it is installed, else by rule for common codes."""
    try:
        from pyproj import CRS
    except ImportError:
        return by_rule(crs)
    return CRS.from_user_input(crs).to_wkt()


def spatial_attrs(ds: Raster, x_dim: str, y_dim: str, crs: str, names: Sequence[str], hints: Mapping[str, LayerHint] | None) -> dict[str, Any]:
    transform, (nx, ny) = affine(ds.coords, x_dim, y_dim), (ds.sizes[x_dim], ds.sizes[y_dim])
    out: dict[str, Any] = {"zarr_conventions": [convention(n) for n in names], "proj:code": crs}
    if (text := wkt2(crs)) is not None:
        out["proj:wkt2"] = text
    out |= {"spatial:dimensions": [y_dim, x_dim], "spatial:registration": "pixel", "spatial:transform": transform, "spatial:bbox": bbox(transform, nx, ny), "spatial:shape": [ny, nx]}
    if hints is not None:
        out["zarr-layer"] = {k: asdict(h) for k, h in hints.items()}
    return out


def attach_metadata(ds: Raster, *, x_dim: str = "x", y_dim: str = "y", crs: str | None = None, layer_hints: Mapping[str, LayerHint] | None = None) -> Raster:
    """A copy of a single-level dataset whose attributes describe its place; new keys win over old."""
    return replace(ds, attrs={**ds.attrs, **spatial_attrs(ds, x_dim, y_dim, crs or ds.require_crs(), ("proj", "spatial"), layer_hints)})


def multiscale_attrs(ds: Raster, levels: Sequence[Raster], factors: Sequence[int], method: str, x_dim: str, y_dim: str, hints: Mapping[str, LayerHint] | None = None) -> dict[str, Any]:
    """Attributes of a pyramid's root, with how each level derives from the one before."""
    root = affine(ds.coords, x_dim, y_dim)
    layout = []
    for i, (level, factor) in enumerate(zip(levels, factors)):
        entry: dict[str, Any] = {"asset": str(i)}
        if i:
            step = factor // factors[i - 1]
            inside = [d in (x_dim, y_dim) for d in ds.sizes]
            entry |= {
                "derived_from": str(i - 1),
                "transform": {"scale": [float(step) if s else 1.0 for s in inside], "translation": [(step - 1) / 2 if s else 0.0 for s in inside]},
                "resampling_method": method,
            }
        entry["spatial:transform"] = affine(level.coords, x_dim, y_dim, (root[0] * factor, root[4] * factor))
        entry["spatial:shape"] = [level.sizes[y_dim], level.sizes[x_dim]]
        layout.append(entry)
    out = spatial_attrs(ds, x_dim, y_dim, ds.require_crs(), ("multiscales", "proj", "spatial"), hints)
    return out | {"multiscales": {"layout": layout, "resampling_method": method}}


def layout_frame(spark: SparkSession, attrs: Mapping[str, Any]) -> DataFrame:
    """One row for each level of the multiscale layout."""
    rows = []
    for e in attrs["multiscales"]["layout"]:
        t = e.get("transform", {})
        rows.append((e["asset"], e.get("derived_from"), t.get("scale"), t.get("translation"), e.get("resampling_method"), e["spatial:transform"], e["spatial:shape"]))
    return spark.createDataFrame(rows, "asset string, derived_from string, scale array<double>, translation array<double>, resampling_method string, transform array<double>, shape array<int>")


def to_json(attrs: Mapping[str, Any]) -> str:
    """JSON of nested attributes; numpy numbers and arrays become plain ones, and what JSON has no number for its name."""

    def plain(x: Any) -> Any:
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if hasattr(x, "tolist"):
            return plain(x.tolist())
        if isinstance(x, float) and not math.isfinite(x):
            return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
        return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)

    return json.dumps(plain(attrs))


def coordinate_spacing(coords: DataFrame, dim: str) -> DataFrame:
    """``dim, n, resolution, origin, uniform`` of the values ``idx, value`` of one dimension.

    Each value meets the one before by a join on the index, so that a long axis stays
    distributed; what is gathered are its least, greatest and first step.
    """
    axis = coords.where(F.col("dim") == dim).select("idx", "value")
    before = axis.select((F.col("idx") + 1).alias("idx"), F.col("value").alias("before"))
    steps = axis.join(before, "idx", "left").withColumn("step", F.col("value") - F.col("before"))
    found = steps.agg(F.count("*").alias("n"), F.min_by("step", F.when(F.col("step").isNotNull(), F.col("idx"))).alias("resolution"), F.min("step").alias("least"), F.max("step").alias("most"), F.min_by("value", "idx").alias("origin"))
    near = F.greatest(F.col("most") - F.col("resolution"), F.col("resolution") - F.col("least")) <= ABSOLUTE + RELATIVE * F.abs(F.col("resolution"))
    return found.select(F.lit(dim).alias("dim"), "n", "resolution", "origin", F.coalesce(near, F.lit(True)).alias("uniform"))
