"""Published control values of projections and datum shifts, round trips and well-known text."""

import random

import pytest
from pyspark.sql import functions as F

from cloudloom.functions.projections import Crs, Ellipsoid, forward, from_epsg, from_wkt, geocentric, geodetic, inverse, shifted, transform
from cloudloom.operators import register

dms = lambda d, m=0, s=0.0: d + m / 60 + s / 3600
CLARKE, FOOT = Ellipsoid(6378206.4, 294.97870), 0.3048006096012192
# Worked examples of the registry's guidance on coordinate conversions.
EXAMPLES = {
    "grid of Great Britain": (Crs("transverse", Ellipsoid(6377563.396, 299.32496), 49.0, -2.0, 0.9996012717, (), 400000.0, -100000.0), dms(0, 30), dms(50, 30), 577274.99, 69740.50),
    "Texas South Central": (Crs("conic", CLARKE, dms(27, 50), -99.0, 1.0, (dms(28, 23), dms(30, 17)), 2e6, 0.0, FOOT), -96.0, dms(28, 30), 2963503.91, 254759.80),
    "Jamaica": (Crs("conic", CLARKE, 18.0, -77.0, 1.0, (), 250000.0, 150000.0), -dms(76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51),
    "NEIEZ": (Crs("mercator", Ellipsoid(6377397.155, 299.15281), 0.0, 110.0, 0.997, (), 3900000.0, 900000.0), 120.0, -3.0, 5009726.58, 569150.82),
    "Caspian Sea": (Crs("mercator", Ellipsoid(6378245.0, 298.3), 0.0, 51.0, 1.0, (42.0,)), 53.0, 53.0, 165704.29, 5171848.07),
    "UPS North": (Crs("polar", Ellipsoid(), 90.0, 0.0, 0.994, (), 2e6, 2e6), 44.0, 73.0, 3320416.75, 632668.43),
    "Australian Antarctic": (Crs("polar", Ellipsoid(), -90.0, 70.0, 1.0, (-71.0,), 6e6, 6e6), 120.0, -75.0, 7255380.79, 7053389.56),
}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_control_values(spark, name):
    crs, lon, lat, x, y = EXAMPLES[name]
    got = spark.range(1).select(*[c.alias(n) for c, n in zip(forward(crs, F.lit(lon), F.lit(lat)), "xy")]).first()
    assert abs(got.x - x) < 0.011 and abs(got.y - y) < 0.011
    back = spark.range(1).select(*[c.alias(n) for c, n in zip(inverse(crs, F.lit(got.x), F.lit(got.y)), ("lon", "lat"))]).first()
    assert abs(back.lon - lon) < 1e-10 and abs(back.lat - lat) < 1e-10


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_there_and_back(spark, name):
    crs = EXAMPLES[name][0]
    r, south = random.Random(4), crs.latitude < 0
    pts = [(i, crs.longitude + r.uniform(-8, 8), (-1 if south else 1) * r.uniform(3 if crs.kind != "polar" else 60, 84)) for i in range(200)]
    df = spark.createDataFrame(pts, "pid long, x double, y double").withColumn("z", F.lit(0.0))
    back = transform(transform(df, Crs("geographic", crs.ellipsoid), crs), crs, Crs("geographic", crs.ellipsoid)).collect()
    assert all(abs(b.x - x) < 1e-9 and abs(b.y - y) < 1e-9 for b, (_, x, y) in zip(sorted(back), pts))


def test_seven_parameters(spark):
    """From WGS 72 to WGS 84, as published."""
    here = [F.lit(v) for v in (3657660.66, 255768.55, 5201382.11)]
    moved = shifted((0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219), *here)
    got = spark.range(1).select(*[c.alias(n) for c, n in zip(moved, "xyz")]).first()
    assert all(abs(a - b) < 0.011 for a, b in zip(got, (3657660.78, 255778.43, 5201387.75)))
    again = spark.range(1).select(*[c.alias(n) for c, n in zip(shifted((0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219), *moved, back=True), "xyz")]).first()
    assert all(abs(a - b) < 1e-6 for a, b in zip(again, (3657660.66, 255768.55, 5201382.11)))


def test_geocentric_round_trip(spark):
    el = Ellipsoid()
    df = spark.createDataFrame([(lon, lat, h) for lon in (-170.0, 0.0, 33.3) for lat in (-90.0, -45.0, 0.0, 0.001, 89.0, 90.0) for h in (-400.0, 0.0, 8000.0)], "lon double, lat double, h double")
    own = df.withColumns(dict(zip("xyz", geocentric(el, F.col("lon"), F.col("lat"), F.col("h")))))
    for r in geodetic(own, el, ("x", "y", "z"), ("lon2", "lat2", "h2")).collect():
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.h - r.h2) < 1e-5 and (abs(r.lat) == 90.0 or abs(r.lon - r.lon2) < 1e-9)


WKT = """PROJCS["OSGB 1936 / British National Grid",GEOGCS["OSGB 1936",DATUM["OSGB_1936",SPHEROID["Airy 1830",6377563.396,299.3249646,AUTHORITY["EPSG","7001"]],
TOWGS84[446.448,-125.157,542.06,0.15,0.247,0.842,-20.489]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",49],
PARAMETER["central_meridian",-2],PARAMETER["scale_factor",0.9996012717],PARAMETER["false_easting",400000],PARAMETER["false_northing",-100000],UNIT["metre",1],AUTHORITY["EPSG","27700"]]"""


def test_well_known_text(spark):
    crs = from_wkt(WKT)
    assert (crs.kind, crs.latitude, crs.longitude, crs.scale, crs.east, crs.north, crs.shift[0], crs.ellipsoid.a) == ("transverse", 49.0, -2.0, 0.9996012717, 400000.0, -100000.0, 446.448, 6377563.396)
    assert from_wkt(f'COMPD_CS["both",{WKT},VERT_CS["height",UNIT["metre",1]]]') == crs
    assert from_wkt('GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174]]') == Crs()
    for bad in ("", "PROJCS[", 'PROJCS["x"]', 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["s",6378137,298]]],PROJECTION["Robinson"]]', "EPSG:4326"):
        with pytest.raises(ValueError):
            from_wkt(bad)


def test_between_datums(spark):
    """A point of the British grid in longitude and latitude of the common datum and back, its height included."""
    df = spark.createDataFrame([(1, 530000.0, 180000.0, 20.0)], "pid long, x double, y double, z double")
    there = register.transform(df, WKT, 4326)
    got = there.first()
    assert abs(got.x - -0.1270) < 0.002 and abs(got.y - 51.5045) < 0.002  # the middle of London
    back = register.transform(there, 4326, WKT).first()
    assert abs(back.x - 530000) < 1e-4 and abs(back.y - 180000) < 1e-4 and abs(back.z - 20) < 1e-4


def test_codes(spark):
    far = spark.createDataFrame([(1, 500000.0, 5300000.0, 0.0)], "pid long, x double, y double, z double")
    there = register.transform(far, 32632, 32633)  # six degrees off the mean meridian
    back = register.transform(there, 32633, 32632).first()
    assert abs(back.x - 500000) < 1e-5 and abs(back.y - 5300000) < 1e-5
    assert from_epsg(32733).north == 1e7 and from_epsg(3031).parallels == (-71.0,)
    same, warned = register.transform_or_keep(far, 32632, 999)
    assert same is far and "999" in warned
    with pytest.raises(ValueError):
        Crs("robinson")
