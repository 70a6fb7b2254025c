import json

import numpy as np
import pytest

from terrace import create_pyramid
from terrace.plans.raster import raster
from terrace.sources import zarr
from terrace.sources.codecs import written_index
from tests.test_pyramid import YX, make, rows


@pytest.mark.parametrize("per_shard, compressor", [(4, None), (4, "zstd"), (None, None), (None, "gzip")])
def test_round_trip(spark, tmp_path, per_shard, compressor):
    p, root = create_pyramid(make(spark, 300, 150), 3, chunks_per_shard=per_shard, target_chunk_bytes=8192), f"{tmp_path}/z"
    written = zarr.write_pyramid(p, root, compressor=compressor)
    assert written[0] >= 1 and sorted(written) == [0, 1, 2]
    for n in range(3):
        assert rows(zarr.read_array(spark, root, f"{n}/v").select(*YX, "v")) == rows(p.level(n))
    assert zarr.read_document(spark, root)["attributes"]["multiscales"]["layout"][1]["derived_from"] == "0"
    doc = json.loads((tmp_path / "z/1/v/zarr.json").read_text())
    assert doc["shape"] == [150, 75] and doc["dimension_names"] == ["y", "x"] and doc["fill_value"] == "NaN"
    assert [r.value for r in zarr.read_array(spark, root, "1/x").orderBy("x").collect()][:2] == [0.5, 2.5]


def test_shards_skip_what_is_missing():
    data = np.full((4, 6), np.nan)
    data[0, 0] = 1
    raw = zarr.pack_shard(data, (2, 3), float("nan"))
    assert len(raw) == 6 * 8 + 4 * 16 + 4
    np.testing.assert_array_equal(zarr.unpack_shard(raw, (4, 6), (2, 3), "f64", float("nan")), data)
    assert zarr.pack_shard(np.full((2, 2), -9), (2, 2), -9) is None


def test_rewriting_leaves_no_stale_cells(spark, tmp_path):
    """Shards that are wholly missing now are gone, at level 0 too; an array without cells reads as none."""
    from pyspark.sql import functions as F

    root, ds = f"{tmp_path}/z", make(spark, 300, 150)
    zarr.write_pyramid(create_pyramid(ds, 2, target_chunk_bytes=8192), root)
    gone = raster(ds.frames[YX].where("y > 500"), YX, ds.sizes, {"v": "f64"}, coords=ds.coords, crs="EPSG:4326")
    zarr.write_pyramid(create_pyramid(gone, 2, target_chunk_bytes=8192), root, levels=[0], mode="a")
    assert zarr.read_array(spark, root, "0/v").count() == 0 and zarr.read_array(spark, root, "0/v").columns == ["y", "x", "v"]
    some = raster(ds.frames[YX].withColumn("v", F.when(F.col("y") < 20, F.col("v"))), YX, ds.sizes, {"v": "f64"}, coords=ds.coords, crs="EPSG:4326", attrs={"scale": np.float32(1.5), "odd": float("nan")})
    zarr.write_pyramid(create_pyramid(some, 2, target_chunk_bytes=8192), root, levels=[0], mode="a")
    assert zarr.read_array(spark, root, "0/v").where("v = v and not isnan(v)").count() == 20 * 150
    assert json.loads((tmp_path / "z/0/zarr.json").read_text())["attributes"] == {"scale": 1.5, "odd": "NaN"}


def test_variables_off_the_grid(spark, tmp_path):
    """A variable without spatial dimensions is an array in every level."""
    from dataclasses import replace

    from terrace.plans.raster import Variable

    ds, root = make(spark, 16, 16), f"{tmp_path}/z"
    extra = spark.createDataFrame([(i, i * 1.5) for i in range(4)], "band int, weight double")
    ds = replace(ds, sizes={**ds.sizes, "band": 4}, variables=(*ds.variables, Variable("weight", ("band",), "f64")), frames={**ds.frames, ("band",): extra})
    zarr.write_pyramid(create_pyramid(ds, 2), root)
    for n in range(2):
        assert rows(zarr.read_array(spark, root, f"{n}/weight")) == [(i, i * 1.5) for i in range(4)]


def test_guards(spark, tmp_path):
    p, root = create_pyramid(make(spark), 2), f"{tmp_path}/z"
    zarr.write_pyramid(p, root, levels=[0])
    with pytest.raises(ValueError):
        zarr.write_pyramid(p, root, levels=[1])
    with pytest.raises(FileExistsError):
        zarr.write_pyramid(p, root, mode="w-")
    zarr.write_pyramid(p, root, levels=[1], mode="a")
    assert rows(zarr.read_array(spark, root, "1/v")) == rows(p.level(1))


def old_array(folder, name, data, chunks, compressor, pack, *, order="C", fill=None, separator=".", dims=("y", "x")):
    """A version 2 array, as other writers leave it; chunks that are all ``fill`` have no object."""
    base = folder / name
    base.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "compressor": compressor, "fill_value": fill, "order": order, "filters": None, "dimension_separator": separator}
    (base / ".zarray").write_text(json.dumps(meta))
    (base / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, "units": "m"}))
    counts = [-(-n // c) for n, c in zip(data.shape, chunks)]
    padded = np.pad(data, [(0, c * k - n) for n, c, k in zip(data.shape, chunks, counts)])
    for at in np.ndindex(*counts):
        piece = padded[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        if fill is not None and (piece == fill).all():
            continue
        target = base / separator.join(map(str, at))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(pack(piece.tobytes(order)))


def packers():
    import bz2
    import gzip
    import zlib

    import pyarrow as pa
    import zstandard

    lz4 = lambda raw: len(raw).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(raw, asbytes=True)
    return {None: bytes, "gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "lz4": lz4, "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("packed", [None, "gzip", "zlib", "bz2", "lz4", "zstd"])
def test_version_2_arrays(spark, tmp_path, packed):
    data = np.arange(7 * 5).reshape(7, 5)
    for dtype, order, separator in (("<f4", "C", "."), (">i4", "F", "/"), (">f8", "C", "/")):
        name = f"v{np.dtype(dtype).name}"
        old_array(tmp_path, name, data.astype(dtype), (3, 2), packed and {"id": packed}, packers()[packed], order=order, separator=separator)
        got = zarr.read_array(spark, str(tmp_path), name)
        assert got.columns == ["y", "x", name] and rows(got) == [(y, x, data[y, x]) for y in range(7) for x in range(5)]


def test_opened_group(spark, tmp_path):
    """Coordinates, source chunks and missing cells come from the store, and a pyramid can be made of it."""
    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    (tmp_path / ".zattrs").write_text('{"title": "heights"}')
    a, b = np.arange(64.0).reshape(8, 8), np.zeros((8, 8), "<i4")
    a[:4, :4], b[0, 0] = -1, 7
    zstd = packers()["zstd"]
    old_array(tmp_path, "a", a, (4, 4), {"id": "zstd"}, zstd, fill=-1)
    old_array(tmp_path, "b", b, (2, 8), {"id": "zstd"}, zstd, fill=0)
    for d in ("y", "x"):
        old_array(tmp_path, d, np.arange(8.0) / 2, (3,), None, bytes, dims=(d,))
    ds = zarr.open_group(spark, str(tmp_path), crs="EPSG:4326")
    assert ds.sizes == {"y": 8, "x": 8} and ds.attrs == {"title": "heights"} and ds.coords["x"].values == [i / 2 for i in range(8)]
    assert {v.name: (v.dtype, v.chunks, v.fill, v.attrs) for v in ds.variables} == {"a": ("f64", (4, 4), -1, {"units": "m"}), "b": ("i32", (2, 8), 0, {"units": "m"})}
    got = {(r.y, r.x): (r.a, r.b) for r in create_pyramid(ds, 2, method="max").level(1).collect()}
    assert got[3, 3] == (63, 0) and got[0, 0] == (-1, 7) and got[0, 2] == (13, 0)


def test_other_writers_version_3(spark, tmp_path):
    """Shards with a checked index at their start and packed chunks; absent cells whose value isn't missing are in the grid."""
    import zstandard

    data = np.arange(16, dtype="<i2").reshape(4, 4)
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]
    index_codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]  # whose sum has to be right
    parts, index, at = [], [], 4 * 16 + 4
    for i, j in np.ndindex(2, 2):
        parts.append(zstandard.ZstdCompressor().compress(data[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].tobytes()))
        index += [at, len(parts[-1])]
        at += len(parts[-1])
    doc = zarr.array_document([4, 8], "i16", ["y", "x"], [2, 2], [4, 4], 5, {})
    doc["codecs"][0]["configuration"] = {"chunk_shape": [2, 2], "codecs": inner, "index_codecs": index_codecs, "index_location": "start"}
    doc["chunk_key_encoding"] = {"name": "default", "configuration": {"separator": "."}}
    (tmp_path / "v").mkdir()
    (tmp_path / "zarr.json").write_text('{"zarr_format": 3, "node_type": "group", "attributes": {}}')
    (tmp_path / "v/zarr.json").write_text(json.dumps(doc))
    (tmp_path / "v/c.0.0").write_bytes(written_index(index) + b"".join(parts))
    cells = [(y, x, int(data[y, x])) for y in range(4) for x in range(4)]
    assert rows(zarr.read_array(spark, str(tmp_path), "v")) == cells
    assert rows(zarr.open_group(spark, str(tmp_path)).frames[YX]) == sorted(cells + [(y, x, 5) for y in range(4) for x in range(4, 8)])
    doc["codecs"] = [inner[0], {"name": "pcodec"}]
    (tmp_path / "v/zarr.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="pcodec"):
        zarr.read_array(spark, str(tmp_path), "v")
