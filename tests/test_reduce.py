"""Single windows and small grids with known results, and random grids against numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrace import coarsen
from terrace.functions.types import element

NAN = float("nan")


def grid(spark, a, dtype="f64"):
    a = np.asarray(a)
    dims = ["z", "t", "y", "x"][-a.ndim :]
    rows = [(*map(int, i), a[i].item()) for i in np.ndindex(*a.shape)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} int" for d in dims) + f", v {element(dtype).spark}")
    return df, dims, dict(zip(dims, a.shape))


def step(spark, a, strides, method, dtype="f64", fill=None, skipna=True):
    df, dims, sizes = grid(spark, a, dtype)
    fills = {"v": fill if fill is not None else (NAN if element(dtype).is_float else None)}
    out = coarsen(df, dims, sizes, strides, {"v": dtype}, method, fills=fills, skipna=skipna)
    found = {tuple(r[d] for d in dims): r["v"] for r in out.collect()}
    shape = [max(i) + 1 for i in zip(*found)] if found else [0] * len(dims)
    return np.array([found[i] for i in np.ndindex(*shape)]).reshape(shape)


S2 = {"y": 2, "x": 2}


@pytest.mark.parametrize("method, value", [("mean", 2.5), ("max", 4), ("min", 1), ("sum", 10), ("nearest", 1)])
def test_methods(spark, method, value):
    assert step(spark, [[1.0, 2.0], [3.0, 4.0]], S2, method).tolist() == [[value]]


def test_trim_and_short_axis(spark):
    assert step(spark, np.arange(9.0).reshape(3, 3), S2, "sum").tolist() == [[8]]
    assert step(spark, np.arange(3.0), {"x": 8}, "sum").tolist() == [3]


@pytest.mark.parametrize("skipna, value", [(True, 2), (False, NAN)])
@pytest.mark.parametrize("method", ["mean", "max", "min", "sum"])
def test_nan(spark, method, skipna, value):
    got = step(spark, [[NAN, 2.0]], {"x": 2}, method, skipna=skipna)[0, 0]
    assert got == value or math.isnan(value) and math.isnan(got)


def test_fill(spark):
    a = [[1, 3, -9, -9], [5, 7, -9, -9]]
    assert step(spark, a, S2, "mean", "i16", -9).tolist() == [[4, -9]]
    assert step(spark, a, S2, "sum", "i16", -9).tolist() == [[16, 0]]
    assert step(spark, a, S2, "nearest", "i16", -9).tolist() == [[1, -9]]
    assert step(spark, a, S2, "max", "i16", -9, skipna=False).tolist() == [[7, -9]]


def test_all_missing(spark):
    for method in ("mean", "max", "min"):
        assert math.isnan(step(spark, [[NAN, NAN]], {"x": 2}, method)[0, 0])
        assert step(spark, [[NAN, 5.0]], {"x": 2}, method, fill=5.0).tolist() == [[5]]
    assert step(spark, [[NAN, NAN]], {"x": 2}, "sum").tolist() == [[0]]


def test_narrowing(spark):
    assert step(spark, [[-1, -2, 5, 2]], {"x": 2}, "mean", "i16").tolist() == [[-1, 3]]
    assert step(spark, [[200, 100]], {"x": 2}, "sum", "u8").tolist() == [[255]]
    assert step(spark, [[-30000, -30000]], {"x": 2}, "sum", "i16").tolist() == [[-32768]]
    top = 2**63 - 1
    assert step(spark, [[top, top, -top, -top]], {"x": 2}, "sum", "i64").tolist() == [[top, -(2**63)]]
    assert step(spark, [[3e38, 3e38]], {"x": 2}, "sum", "f32").tolist() == [[math.inf]]


def test_leading_axis(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    assert step(spark, a, S2, "max").tolist() == a[:, :2].reshape(2, 1, 2, 2, 2).max((2, 4)).tolist()


def test_checks(spark):
    df, dims, sizes = grid(spark, [[1.0]])
    for bad in ({"y": 0}, {"y": True}, {"q": 2}):
        with pytest.raises(ValueError):
            coarsen(df, dims, sizes, bad, {"v": "f64"})
    with pytest.raises(ValueError):
        coarsen(df, dims, sizes, {}, {"v": "f64"}, "median")
    with pytest.raises(TypeError):
        coarsen(df, dims, sizes, {}, {"v": "c16"})
    with pytest.raises(ValueError):
        coarsen(df, ["a", "b", "c", "d", "e"], sizes, {}, {"v": "f64"})


def test_coercion():
    assert [element("u8").coerce(x) for x in (-9999, 300, NAN, 7.9, math.inf)] == [0, 255, 0, 7, 255]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 7), st.integers(1, 7), st.integers(1, 3), st.integers(1, 3), st.sampled_from(["mean", "max", "min", "sum"]), st.integers(0, 2**31))
def test_random(spark, ny, nx, sy, sx, method, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-50, 50, (ny, nx)).astype(float)
    a[rng.random((ny, nx)) < 0.3] = NAN
    ey, ex = min(sy, ny), min(sx, nx)
    w = a[: ny // ey * ey, : nx // ex * ex].reshape(ny // ey, ey, nx // ex, ex).transpose(0, 2, 1, 3).reshape(ny // ey, nx // ex, -1)
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore")
        want = {"mean": np.nanmean, "max": np.nanmax, "min": np.nanmin, "sum": np.nansum}[method](w, axis=2)
    np.testing.assert_allclose(step(spark, a, {"y": sy, "x": sx}, method), want)
