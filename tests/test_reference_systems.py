import re

import pytest

from terrace import attach_metadata
from terrace.plans.metadata import wkt2
from terrace.plans.reference_systems import by_rule
from tests.test_pyramid import planned


def parts(text):
    """WKT as nested lists; an error if brackets don't match."""
    tokens, stack = re.findall(r'"(?:[^"]|"")*"|[A-Za-z]\w*|-?[\d.]+|[\[\],]', text), [[]]
    for t in tokens:
        if t == "[":
            stack.append([])
        elif t == "]":
            inner = stack.pop()
            stack[-1].append(inner)
        elif t != ",":
            stack[-1].append(t)
    assert len(stack) == 1
    return stack[0]


def parameter(text, name):
    return float(re.search(rf'PARAMETER\["{name}",(-?[\d.]+),', text)[1])


@pytest.mark.parametrize("code, name", [(4326, "WGS 84"), (4258, "ETRS89"), (4269, "NAD83")])
def test_geographic(code, name):
    text = by_rule(f"EPSG:{code}")
    assert parts(text)[0] == "GEOGCRS" and parts(text)[1][0] == f'"{name}"' and text.endswith(f'ID["EPSG",{code}]]') and "6378137" in text
    assert by_rule(f" epsg:{code}") == by_rule(str(code)) == text


@pytest.mark.parametrize("code, name, meridian, north", [(32633, "WGS 84 / UTM zone 33N", 15, 0), (32701, "WGS 84 / UTM zone 1S", -177, 10_000_000), (32660, "WGS 84 / UTM zone 60N", 177, 0), (25832, "ETRS89 / UTM zone 32N", 9, 0), (26910, "NAD83 / UTM zone 10N", -123, 0)])
def test_utm(code, name, meridian, north):
    text = by_rule(f"EPSG:{code}")
    assert parts(text)[0] == "PROJCRS" and parts(text)[1][0] == f'"{name}"' and text.endswith(f'ID["EPSG",{code}]]')
    assert parameter(text, "Longitude of natural origin") == meridian and parameter(text, "False northing") == north and parameter(text, "False easting") == 500_000 and parameter(text, "Scale factor at natural origin") == 0.9996


def test_web_mercator_and_unknown_codes():
    assert 'METHOD["Popular Visualisation Pseudo Mercator",ID["EPSG",1024]]' in by_rule("EPSG:3857") and parts(by_rule("EPSG:3857"))[0] == "PROJCRS"
    for unknown in ("EPSG:32661", "EPSG:25827", "EPSG:2154", "OGC:CRS84", "+proj=longlat", ""):
        assert by_rule(unknown) is None


def test_metadata_has_the_text():
    ds = planned(("y", "x"), {"y": 4, "x": 4})
    attrs = attach_metadata(ds, crs="EPSG:32633").attrs
    assert attrs["proj:code"] == "EPSG:32633" and attrs["proj:wkt2"] == wkt2("EPSG:32633")
    try:
        import pyproj  # noqa: F401
    except ImportError:
        assert "proj:wkt2" not in attach_metadata(ds, crs="EPSG:2154").attrs
