"""WKT2 of common coordinate reference systems, by rule: geographic ones, Web Mercator and UTM zones.

Where pyproj is installed its text is used (``metadata.wkt2``), which knows all codes.
"""

from __future__ import annotations

import re

# Fixed values of the EPSG registry: code, name, datum, ellipsoid, semi-major axis and inverse flattening of geographic systems.
GEOGRAPHIC = {
    4326: ("WGS 84", "World Geodetic System 1984", "WGS 84", 6378137, 298.257223563),
    4258: ("ETRS89", "European Terrestrial Reference System 1989", "GRS 1980", 6378137, 298.257222101),
    4269: ("NAD83", "North American Datum 1983", "GRS 1980", 6378137, 298.257222101),
}
# UTM codes are a base and the zone; first and last zone, hemisphere and geographic system.
UTM = {32600: (1, 60, "N", 4326), 32700: (1, 60, "S", 4326), 25800: (28, 38, "N", 4258), 26900: (1, 23, "N", 4269)}
DEGREE = 'ANGLEUNIT["degree",0.0174532925199433]'
METRE = 'LENGTHUNIT["metre",1]'


def _datum(code: int) -> str:
    _, datum, ellipsoid, a, flattening = GEOGRAPHIC[code]
    return f'DATUM["{datum}",ELLIPSOID["{ellipsoid}",{a},{flattening},{METRE}]],PRIMEM["Greenwich",0,{DEGREE}]'


def _geographic(code: int) -> str:
    axes = f'AXIS["geodetic latitude (Lat)",north,ORDER[1],{DEGREE}],AXIS["geodetic longitude (Lon)",east,ORDER[2],{DEGREE}]'
    return f'GEOGCRS["{GEOGRAPHIC[code][0]}",{_datum(code)},CS[ellipsoidal,2],{axes},ID["EPSG",{code}]]'


def _projected(name: str, base: int, conversion: str, method: tuple[str, int], parameters: list[tuple[str, float, str, int]], code: int, axes: tuple[str, str] = ("(E)", "(N)")) -> str:
    given = ",".join(f'PARAMETER["{n}",{v},{unit},ID["EPSG",{i}]]' for n, v, unit, i in parameters)
    first, second = (f'AXIS["{a}",{d},ORDER[{i}],{METRE}]' for i, (a, d) in enumerate(zip(axes, ("east", "north")), 1))
    base_text = f'BASEGEOGCRS["{GEOGRAPHIC[base][0]}",{_datum(base)},ID["EPSG",{base}]]'
    return f'PROJCRS["{name}",{base_text},CONVERSION["{conversion}",METHOD["{method[0]}",ID["EPSG",{method[1]}]],{given}],CS[Cartesian,2],{first},{second},ID["EPSG",{code}]]'


def by_rule(crs: str) -> str | None:
    """The text of ``EPSG:<code>``, None for a code that no rule covers."""
    found = re.fullmatch(r"\s*(?:epsg:)?(\d+)\s*", str(crs), re.IGNORECASE)
    if not found:
        return None
    code = int(found[1])
    if code in GEOGRAPHIC:
        return _geographic(code)
    scale = 'SCALEUNIT["unity",1]'
    if code == 3857:
        zero = [("Latitude of natural origin", 0, DEGREE, 8801), ("Longitude of natural origin", 0, DEGREE, 8802), ("False easting", 0, METRE, 8806), ("False northing", 0, METRE, 8807)]
        return _projected("WGS 84 / Pseudo-Mercator", 4326, "Popular Visualisation Pseudo-Mercator", ("Popular Visualisation Pseudo Mercator", 1024), zero, code, ("easting (X)", "northing (Y)"))
    base, zone = code // 100 * 100, code % 100
    if base not in UTM or not UTM[base][0] <= zone <= UTM[base][1]:
        return None
    _, _, half, of = UTM[base]
    parameters = [
        ("Latitude of natural origin", 0, DEGREE, 8801), ("Longitude of natural origin", 6 * zone - 183, DEGREE, 8802), ("Scale factor at natural origin", 0.9996, scale, 8805),
        ("False easting", 500_000, METRE, 8806), ("False northing", 10_000_000 if half == "S" else 0, METRE, 8807),
    ]
    return _projected(f"{GEOGRAPHIC[of][0]} / UTM zone {zone}{half}", of, f"UTM zone {zone}{half}", ("Transverse Mercator", 9807), parameters, code)
