"""NetCDF classic files and stores whose level 0 stays in other files."""

import struct

import numpy as np
import pytest

from terrace import create_pyramid
from terrace.sources import netcdf, zarr
from tests.test_pyramid import YX, rows

FORMS = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}


def text(s):
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def attributes(attrs):
    out = struct.pack(">ii", 12, len(attrs)) if attrs else struct.pack(">ii", 0, 0)
    for name, value in attrs.items():
        if isinstance(value, str):
            out += text(name) + struct.pack(">i", 2) + text(value)
        else:
            out += text(name) + struct.pack(">iid", 6, 1, value)
    return out


def classic(dims, variables, records=None, version=1, streamed=False):
    """A file by the format's rules: ``dims`` by size (0 is the record dimension), ``variables`` by dimensions, data and attributes."""
    names, place = list(dims), ">i" if version == 1 else ">q"
    record = [n for n in names if dims[n] == 0]

    def build(begins):
        head = b"CDF" + bytes([version]) + struct.pack(">i", -1 if streamed else records or 0) + struct.pack(">ii", 10, len(dims))
        for n in names:
            head += text(n) + struct.pack(">i", dims[n])
        head += attributes({"title": "heights"}) + struct.pack(">ii", 11, len(variables))
        for (n, (of, data, attrs)), begin in zip(variables.items(), begins):
            size = data[0].nbytes if of and of[0] in record else data.nbytes
            head += text(n) + struct.pack(f">i{len(of)}i", len(of), *(names.index(d) for d in of)) + attributes(attrs) + struct.pack(">ii", FORMS[data.dtype.str[1:]], -(-size // 4) * 4) + struct.pack(place, begin)
        return head

    fixed = [n for n, (of, *_) in variables.items() if not (of and of[0] in record)]
    moving = [n for n in variables if n not in fixed]
    at, begins, body = len(build([0] * len(variables))), {}, b""
    for n in fixed:
        begins[n] = at + len(body)
        body += variables[n][1].astype(variables[n][1].dtype.newbyteorder(">")).tobytes()
        body += b"\0" * (-len(body) % 4)
    start = at + len(body)
    for n in moving:
        begins[n] = start
        size = variables[n][1][0].nbytes
        start += size if len(moving) == 1 else -(-size // 4) * 4
    for i in range(records or 0):
        for n in moving:
            raw = np.array(variables[n][1][i], variables[n][1].dtype.newbyteorder(">")).tobytes()
            body += raw + (b"" if len(moving) == 1 else b"\0" * (-len(raw) % 4))
    return build([begins[n] for n in variables]) + body


def grid(ny=9, nx=6):
    rng = np.random.default_rng(0)
    return {"y": (("y",), np.arange(ny, dtype="f8") * 2, {}), "x": (("x",), np.arange(nx, dtype="f4"), {"units": "m"}), "v": (YX, rng.integers(0, 99, (ny, nx)).astype("f4"), {"_FillValue": -1.0, "long_name": "v"}), "w": (YX, rng.integers(0, 99, (ny, nx)).astype("i2"), {})}


@pytest.mark.parametrize("version", [1, 2])
def test_fixed_variables(spark, tmp_path, monkeypatch, version):
    """Cut along the first axis, the last part being shorter; variables with other chunks meet by a join."""
    monkeypatch.setattr(netcdf, "CHUNK", 6 * 4 * 4)
    made = grid()
    (tmp_path / "a.nc").write_bytes(classic({"y": 9, "x": 6}, made, version=version))
    ds = netcdf.open_file(spark, f"{tmp_path}/a.nc", crs="EPSG:4326")
    assert ds.sizes == {"y": 9, "x": 6} and ds.attrs == {"title": "heights"} and ds.coords["y"].values == [2.0 * i for i in range(9)] and ds.coords["x"].attrs == {"units": "m"}
    assert {v.name: (v.dtype, v.chunks) for v in ds.variables} == {"v": ("f32", (4, 6)), "w": ("i16", (8, 6))} and ds.variable("v").fill == -1
    want = [(y, x, float(made["v"][1][y, x]), int(made["w"][1][y, x])) for y in range(9) for x in range(6)]
    assert rows(ds.frames[YX].select(*YX, "v", "w")) == want
    one = ds.select("v")
    top = create_pyramid(one, 2, method="max").level(1)
    assert rows(top) == [(y, x, float(made["v"][1][2 * y : 2 * y + 2, 2 * x : 2 * x + 2].max())) for y in range(4) for x in range(3)]


@pytest.mark.parametrize("count, streamed", [(1, False), (2, False), (2, True)])
def test_record_variables(spark, tmp_path, count, streamed):
    """A stretch in every record, padded where there are several variables."""
    data = {"t": (("t",), np.arange(5, dtype="f8"), {})} if count == 2 else {}
    values = np.arange(5 * 3 * 3, dtype="i2").reshape(5, 3, 3)
    data["v"] = (("t", *YX), values, {})
    (tmp_path / "r.nc").write_bytes(classic({"t": 0, "y": 3, "x": 3}, data, records=5, streamed=streamed))
    ds = netcdf.open_file(spark, f"{tmp_path}/r.nc")
    assert ds.sizes["t"] == 5 and ds.variable("v").chunks == (1, 3, 3) and (count == 1 or ds.coords["t"].values == [0, 1, 2, 3, 4])
    assert rows(ds.frames["t", "y", "x"]) == [(t, y, x, int(values[t, y, x])) for t in range(5) for y in range(3) for x in range(3)]


def test_other_files_are_told(spark, tmp_path):
    for raw in (b"\x89HDF\r\n\x1a\n" + bytes(99), b"CDF\x07" + bytes(99), b"CDF\x01" + bytes(3)):
        (tmp_path / "x.nc").write_bytes(raw)
        with pytest.raises(ValueError, match="classic|ends within"):
            netcdf.open_file(spark, f"{tmp_path}/x.nc")
    (tmp_path / "short.nc").write_bytes(classic({"y": 9, "x": 6}, grid())[:60])
    with pytest.raises(ValueError, match="ends within"):
        netcdf.open_file(spark, f"{tmp_path}/short.nc")


def test_long_headers_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf, "HEAD", 16)
    (tmp_path / "a.nc").write_bytes(classic({"y": 9, "x": 6}, grid()))
    assert set(netcdf.header(spark, f"{tmp_path}/a.nc").arrays) == {"y", "x", "v", "w"}


@pytest.mark.parametrize("fused", [True, False])
def test_a_store_above_a_file(spark, tmp_path, monkeypatch, fused):
    """Level 0 stays in the file; coarser levels are appended, and all are read from one store."""
    monkeypatch.setattr(netcdf, "CHUNK", 6 * 4 * 4)
    made, root, path = grid(), f"{tmp_path}/z", f"file://{tmp_path}/a.nc"
    (tmp_path / "a.nc").write_bytes(classic({"y": 9, "x": 6}, made))
    ds = netcdf.open_file(spark, path, crs="EPSG:4326").select("v")
    p = create_pyramid(ds, 3, method="max")
    with pytest.raises(FileNotFoundError, match="level 0"):
        zarr.write_pyramid(p, root, levels=[1, 2], mode="a")
    head = netcdf.header(spark, path)
    zarr.write_references(netcdf.references(spark, path, head, ["v"]), netcdf.grid(head, ["v"]), root, "0")
    zarr.write_pyramid(p, root, levels=[1, 2], mode="a", from_source=True, keep_levels_in_memory=fused)
    for n in range(3):
        assert rows(zarr.read_array(spark, root, f"{n}/v").select(*YX, "v")) == rows(p.level(n))
    assert rows(zarr.open_group(spark, root, "0", crs="EPSG:4326").frames[YX]) == rows(p.level(0))
    assert not (tmp_path / "z/0/v/c").exists()
