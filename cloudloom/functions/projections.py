"""Map projections and shifts of datums as column expressions: conformal ones, forward and back, to well under a millimetre.

Latitudes go over the conformal latitude, by series in the third flattening, so no expression iterates. Angles are degrees outside, radians inside.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the series in powers of the third flattening, by multiple of the angle: transverse Mercator from conformal
# latitude and back, and latitude from conformal latitude.
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,),
)
BACK = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,),
)
LATITUDE = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,),
)


@dataclass(frozen=True)
class Ellipsoid:
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def series(self, table: tuple) -> list[float]:
        n = self.f / (2 - self.f)
        return [sum(c * n ** (j + 1 + i) for i, c in enumerate(row)) for j, row in enumerate(table)]


@dataclass(frozen=True)
class Crs:
    """A reference system. kind: geographic, transverse, conic, mercator or polar; unit: metres in one unit of length.

    shift: to the common datum: metres along the axes, seconds of arc about them (position vectors turn), parts per million.
    """

    kind: str = "geographic"
    ellipsoid: Ellipsoid = field(default_factory=Ellipsoid)
    latitude: float = 0.0
    longitude: float = 0.0
    scale: float = 1.0
    parallels: tuple[float, ...] = ()
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0
    shift: tuple[float, ...] = ()

    def __post_init__(self):
        if self.kind not in ("geographic", "transverse", "conic", "mercator", "polar"):
            raise ValueError(f"unknown projection {self.kind!r}")


def _psi(lat: float, e: float) -> float:
    """Isometric latitude of a number."""
    return math.asinh(math.tan(lat)) - e * math.atanh(e * math.sin(lat))


def _isometric(lat: Column, e: float) -> Column:
    s = F.sin(lat)
    return F.atanh(s) - e * F.atanh(e * s)


def _from_isometric(psi: Column, ellipsoid: Ellipsoid) -> Column:
    conformal = F.asin(F.tanh(psi))
    return sum((c * F.sin(2 * (j + 1) * conformal) for j, c in enumerate(ellipsoid.series(LATITUDE))), conformal)


def _radius(lat: float, el: Ellipsoid) -> float:
    """Of the parallel, over the semi-axis."""
    return math.cos(lat) / math.sqrt(1 - (el.e * math.sin(lat)) ** 2)


def _conic(c: Crs) -> tuple[float, float, float]:
    """(n, F, rho of the origin) of a cone through one parallel or two."""
    e, one = c.ellipsoid.e, [math.radians(p) for p in c.parallels] or [math.radians(c.latitude)]
    if len(one) == 1 or abs(one[0] - one[1]) < 1e-12:
        n = math.sin(one[0])
    else:
        n = (math.log(_radius(one[0], c.ellipsoid)) - math.log(_radius(one[1], c.ellipsoid))) / (_psi(one[1], e) - _psi(one[0], e))
    size = _radius(one[0], c.ellipsoid) / n * math.exp(n * _psi(one[0], e)) * c.scale * c.ellipsoid.a
    return n, size, size * math.exp(-n * _psi(math.radians(c.latitude), e))


def _polar(c: Crs) -> tuple[float, float]:
    """(1 for the north pole or -1, size): distance from the pole is the size times exp(-isometric latitude)."""
    el, e = c.ellipsoid, c.ellipsoid.e
    if c.parallels:
        p = abs(math.radians(c.parallels[0]))
        return math.copysign(1.0, c.parallels[0]), el.a * _radius(p, el) * math.exp(_psi(p, e))
    return math.copysign(1.0, c.latitude), 2 * el.a * c.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _meridian(c: Crs) -> tuple[float, float]:
    """(length of a radian on the mean meridian, that angle at the origin) of a transverse projection."""
    n = c.ellipsoid.f / (2 - c.ellipsoid.f)
    size = c.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * c.scale
    chi = math.atan(math.sinh(_psi(math.radians(c.latitude), c.ellipsoid.e)))
    return size, chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(c.ellipsoid.series(FORWARD)))


def forward(c: Crs, lon: Column, lat: Column) -> tuple[Column, Column]:
    """x, y from degrees."""
    el, e = c.ellipsoid, c.ellipsoid.e
    if c.kind == "geographic":
        return lon, lat
    phi, lam = F.radians(lat), F.radians(F.pmod(lon - c.longitude + 180, F.lit(360.0)) - 180)
    if c.kind == "transverse":
        size, origin = _meridian(c)
        t = F.sinh(_isometric(phi, e))
        xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
        terms = [(2 * (j + 1), a) for j, a in enumerate(el.series(FORWARD))]
        x = size * sum((a * F.cos(k * xi) * F.sinh(k * eta) for k, a in terms), eta)
        y = size * (sum((a * F.sin(k * xi) * F.cosh(k * eta) for k, a in terms), xi) - origin)
    elif c.kind == "conic":
        n, size, base = _conic(c)
        rho = size * F.exp(-n * _isometric(phi, e))
        x, y = rho * F.sin(n * lam), base - rho * F.cos(n * lam)
    elif c.kind == "mercator":
        size = el.a * (_radius(abs(math.radians(c.parallels[0])), el) if c.parallels else c.scale)
        x, y = size * lam, size * _isometric(phi, e)
    else:
        sign, size = _polar(c)
        rho = size * F.exp(-_isometric(sign * phi, e))
        x, y = rho * F.sin(lam), -sign * rho * F.cos(lam)
    return x / c.unit + c.east, y / c.unit + c.north


def inverse(c: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    el = c.ellipsoid
    if c.kind == "geographic":
        return x, y
    x, y = (x - c.east) * c.unit, (y - c.north) * c.unit
    if c.kind == "transverse":
        size, origin = _meridian(c)
        xi, eta = y / size + origin, x / size
        terms = [(2 * (j + 1), b) for j, b in enumerate(el.series(BACK))]
        xi, eta = xi - sum(b * F.sin(k * xi) * F.cosh(k * eta) for k, b in terms), eta - sum(b * F.cos(k * xi) * F.sinh(k * eta) for k, b in terms)
        psi, lam = F.atanh(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi))
    elif c.kind == "conic":
        n, size, base = _conic(c)
        s = math.copysign(1.0, n)
        rho = s * F.sqrt(x * x + (base - y) * (base - y))
        psi, lam = -F.ln(rho / size) / n, F.atan2(s * x, s * (base - y)) / n
    elif c.kind == "mercator":
        size = el.a * (_radius(abs(math.radians(c.parallels[0])), el) if c.parallels else c.scale)
        psi, lam = y / size, x / size
    else:
        sign, size = _polar(c)
        psi, lam = -sign * F.ln(F.sqrt(x * x + y * y) / size), F.atan2(x, -sign * y)
    lon = F.degrees(lam) + c.longitude
    return F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(_from_isometric(psi, el))


def geocentric(el: Ellipsoid, lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    phi, lam, e2 = F.radians(lat), F.radians(lon), el.e**2
    n = el.a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + h) * F.sin(phi)


def shifted(shift: tuple[float, ...], x: Column, y: Column, z: Column, back: bool = False) -> tuple[Column, Column, Column]:
    """Three or seven parameters on geocentric coordinates; back: the other way, exactly."""
    tx, ty, tz, rx, ry, rz, ppm = [*shift, 0, 0, 0, 0][:7]
    a, b, g = (math.radians(v / 3600) for v in (rx, ry, rz))
    m, turn = 1 + ppm * 1e-6, [[1.0, -g, b], [g, 1.0, -a], [-b, a, 1.0]]
    if back:
        import numpy as np

        r = np.linalg.inv(np.array(turn)) / m
        u, v, w = x - tx, y - ty, z - tz
        return tuple(u * float(k[0]) + v * float(k[1]) + w * float(k[2]) for k in r)
    return tuple((x * k[0] + y * k[1] + z * k[2]) * m + t for k, t in zip(turn, (tx, ty, tz)))


def geodetic(df: DataFrame, el: Ellipsoid, xyz: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """df with degrees and height from geocentric columns: the reduced latitude is corrected three times, a column each."""
    x, y, z = map(F.col, xyz)
    e2, b = el.e**2, el.a * (1 - el.f)
    second = e2 / (1 - e2)
    df = df.withColumn("_p", F.sqrt(x * x + y * y)).withColumn("_u", F.atan2(z * el.a, F.col("_p") * b))
    for _ in range(3):
        phi = F.atan2(z + second * b * F.pow(F.sin("_u"), F.lit(3)), F.col("_p") - e2 * el.a * F.pow(F.cos("_u"), F.lit(3)))
        df = df.withColumn("_f", phi).withColumn("_u", F.atan2((1 - el.f) * F.sin("_f"), F.cos("_f")))
    n = el.a / F.sqrt(1 - e2 * F.sin("_f") * F.sin("_f"))
    # Along the normal: good at the poles as well.
    h = F.col("_p") * F.cos("_f") + z * F.sin("_f") - el.a * el.a / n
    return df.withColumns({out[0]: F.degrees(F.atan2(y, x)), out[1]: F.degrees("_f"), out[2]: h}).drop("_p", "_u", "_f")


def transform(points: DataFrame, source: Crs, target: Crs) -> DataFrame:
    """points with x, y taken over, and z where a datum is shifted: a system without a shift is taken to be on the common datum. Points without z lie on the ellipsoid."""
    lon, lat = inverse(source, F.col("x"), F.col("y"))
    own = points.withColumns({"_lon": lon, "_lat": lat})
    if source.shift != target.shift:
        own = own if "z" in points.columns else own.withColumn("z", F.lit(0.0))
        x, y, z = geocentric(source.ellipsoid, F.col("_lon"), F.col("_lat"), F.col("z"))
        if source.shift:
            x, y, z = shifted(source.shift, x, y, z)
        if target.shift:
            x, y, z = shifted(target.shift, x, y, z, back=True)
        own = geodetic(own.withColumns({"_x": x, "_y": y, "_z": z}), target.ellipsoid, ("_x", "_y", "_z"), ("_lon", "_lat", "z")).drop("_x", "_y", "_z")
    x, y = forward(target, F.col("_lon"), F.col("_lat"))
    return own.withColumns({"x": x, "y": y}).select(*points.columns)


# Names of projections and of their parameters in well-known text.
_KINDS = {
    "transverse_mercator": "transverse", "gauss_kruger": "transverse", "lambert_conformal_conic_1sp": "conic", "lambert_conformal_conic_2sp": "conic", "lambert_conformal_conic": "conic",
    "mercator_1sp": "mercator", "mercator_2sp": "mercator", "mercator": "mercator", "polar_stereographic": "polar", "stereographic_north_pole": "polar", "stereographic_south_pole": "polar",
}


def _nodes(text: str) -> list:
    """[name, *values] of bracketed text, values being strings, numbers or such lists."""
    tokens = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_][A-Za-z_0-9]*|[-+]?\d[-+.\deE]*|[\[\](),]', text)
    stack: list[list] = [[]]
    for i, t in enumerate(tokens):
        if t in "[(":
            stack.append([stack[-1].pop()])
        elif t in "])":
            done = stack.pop()
            if not stack:
                raise ValueError("well-known text closes more than it opens")
            stack[-1].append(done)
        elif t != ",":
            stack[-1].append(t[1:-1] if t[0] == '"' else float(t) if t[0] in "+-.0123456789" else t)
    if len(stack) != 1 or not stack[0] or not isinstance(stack[0][0], list):
        raise ValueError("not well-known text")
    return stack[0][0]


def from_wkt(text: str) -> Crs:
    """The system of a PROJCS or GEOGCS text."""
    root = _nodes(text)
    under = lambda node, name: next((n for n in node if isinstance(n, list) and str(n[0]).upper() == name), None)
    if str(root[0]).upper() == "COMPD_CS":
        root = under(root, "PROJCS") or under(root, "GEOGCS") or root
    geographic = root if str(root[0]).upper() == "GEOGCS" else under(root, "GEOGCS")
    datum = under(geographic or [], "DATUM")
    spheroid = under(datum or [], "SPHEROID")
    if spheroid is None:
        raise ValueError("well-known text without a spheroid")
    el, moved = Ellipsoid(float(spheroid[2]), float(spheroid[3])), under(datum, "TOWGS84")
    shift = tuple(float(v) for v in moved[1:]) if moved and any(moved[1:]) else ()
    if root is geographic:
        return Crs("geographic", el, shift=shift)
    projection = under(root, "PROJECTION")
    kind = _KINDS.get(str(projection[1]).lower() if projection else "")
    if kind is None:
        raise ValueError(f"unknown projection {projection[1] if projection else None!r}")
    p = {str(n[1]).lower(): float(n[2]) for n in root if isinstance(n, list) and str(n[0]).upper() == "PARAMETER"}
    unit = float((under(root, "UNIT") or [0, 0, 1.0])[2])
    latitude, parallels = p.get("latitude_of_origin", p.get("latitude_of_center", 0.0)), tuple(p[k] for k in ("standard_parallel_1", "standard_parallel_2") if k in p)
    if kind == "polar" and not parallels and abs(latitude) < 89.999:
        parallels, latitude = (latitude,), math.copysign(90.0, latitude)  # the text names the true parallel as the origin
    longitude = p.get("central_meridian", p.get("longitude_of_center", 0.0))
    return Crs(kind, el, latitude, longitude, p.get("scale_factor", 1.0), parallels, p.get("false_easting", 0.0), p.get("false_northing", 0.0), unit, shift)


def from_epsg(code: int) -> Crs:
    """Longitude and latitude, universal transverse Mercator and polar stereographic zones on the common datum, and web Mercator's ellipsoidal kin."""
    if code in (4326, 4258, 4979):
        return Crs()
    grs = Ellipsoid(6378137.0, 298.257222101)
    if 32601 <= code <= 32660 or 32701 <= code <= 32760 or 25828 <= code <= 25838:
        zone, south = code % 100, 32701 <= code <= 32760
        return Crs("transverse", grs if code < 26000 else Ellipsoid(), 0.0, zone * 6 - 183.0, 0.9996, (), 500000.0, 10_000_000.0 if south else 0.0)
    known = {5041: (90.0, 0.0, 0.994, (), 2e6, 2e6), 5042: (-90.0, 0.0, 0.994, (), 2e6, 2e6), 3031: (-90.0, 0.0, 1.0, (-71.0,), 0.0, 0.0), 3995: (90.0, 0.0, 1.0, (71.0,), 0.0, 0.0), 3413: (90.0, -45.0, 1.0, (70.0,), 0.0, 0.0)}
    if code in known:
        lat, lon, k, parallels, x, y = known[code]
        return Crs("polar", Ellipsoid(), lat, lon, k, parallels, x, y)
    conic = {2154: (46.5, 3.0, (49.0, 44.0), 700000.0, 6600000.0), 3034: (52.0, 10.0, (35.0, 65.0), 4000000.0, 2800000.0)}
    if code in conic:
        lat, lon, parallels, x, y = conic[code]
        return Crs("conic", grs, lat, lon, 1.0, parallels, x, y)
    if code == 3395:
        return Crs("mercator")
    raise ValueError(f"unknown code {code}")
