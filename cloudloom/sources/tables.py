"""Text tables: trajectories, control points, roofs, and logs as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that columns of control points and trajectories go by, lower case.
SYNONYMS = {
    "name": ("name", "id", "label", "point", "point_name"),
    "x": ("x", "easting", "east", "lon", "longitude"),
    "y": ("y", "northing", "north", "lat", "latitude"),
    "z": ("z", "elev", "elevation", "height", "alt", "altitude"),
    "time": ("time", "gps_time", "gpstime", "t", "timestamp", "seconds"),
}


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a text file, for a look at its form."""
    rows = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("i")).orderBy("i").limit(n).collect()
    return [r["value"].removeprefix("﻿") for r in rows]


def guess_columns(fields: list[str], wanted: tuple[str, ...] = ("name", "x", "y", "z")) -> dict[str, int]:
    """Places of known names in a header."""
    low = [f.strip().strip("\"'").lower() for f in fields]
    return {w: i for w in wanted for i, f in enumerate(low) if f in SYNONYMS[w]}


def _fields(line: str, separator: str, most: int = 64) -> Column:
    """The first fields of a line of text, an empty one being empty text, without what is missing at the end."""
    if separator in (" ", r"\s+"):
        return F.slice(F.split(F.trim(line), r"\s+"), 1, most)
    parsed = F.from_csv(line, ", ".join(f"c{i} string" for i in range(most)), {"sep": separator, "mode": "PERMISSIVE"})
    found = F.array(*[parsed[f"c{i}"] for i in range(most)])
    width = F.coalesce(F.array_max(F.transform(found, lambda f, i: F.when(f.isNotNull(), i + 1))), F.lit(0))
    return F.transform(F.slice(found, F.lit(1), width), lambda f: F.coalesce(f, F.lit("")))


def _mostly_numbers(fields: Column) -> Column:
    """Whether two fields at least, and three of four, are numbers, a decimal comma being one too: such a line is no header."""
    numbers = F.size(F.filter(fields, lambda f: F.translate(F.trim(f), ",", ".").try_cast("double").isNotNull()))
    return (numbers >= 2) & (numbers * 4 >= F.size(fields) * 3)


def read_trajectory(spark: SparkSession, path: str, columns: tuple[int, int, int, int] = (0, 1, 2, 3), separator: str | None = None, skip_rows: int = 0, has_header: bool = False) -> DataFrame:
    """(t, x, y, z) of a text file in order of time. Blank lines, lines that begin with # and rows that don't parse are left out.

    Without a separator the first of comma, semicolon, tab and blanks that gives four fields in the first line is taken.
    """
    skip = skip_rows + has_header
    first = _first_lines(spark, path, skip + 1)[skip:]
    if not first:
        raise ValueError(f"{path} is empty")
    if separator is None:
        fits = [s for s in (",", ";", "\t") if len(first[0].strip().split(s)) >= 4]
        separator = fits[0] if fits else r"\s+" if len(first[0].split()) >= 4 else ","
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("line"), F.monotonically_increasing_id().alias("i"))
    if skip:
        head = lines.orderBy("i").limit(skip).select(F.col("i").alias("h"))
        lines = lines.join(F.broadcast(head), F.col("i") == F.col("h"), "left_anti")
    fields = F.split("line", r"\s+" if separator in (" ", r"\s+") else F.lit("\\Q" + separator + "\\E"))
    own = lines.where("line <> '' and not line like '#%'").select(fields.alias("f"))
    out = own.select(*[F.try_element_at("f", F.lit(k + 1)).try_cast("double").alias(n) for n, k in zip(("t", "x", "y", "z"), columns)]).dropna()
    if out.isEmpty():
        raise ValueError(f"no usable records in {path}")
    return out.orderBy("t")


def read_control_points(spark: SparkSession, path: str, separator: str = ",", has_header: bool = True, columns: dict[str, int] | None = None) -> DataFrame:
    """(name, x, y, z). A first line that looks like data is data; columns by known names, else name, x, y, z or x, y, z by place; rows without a
    number in any of the three are left out; without names rows are numbered in their order."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.monotonically_increasing_id().alias("i")).where("trim(line) <> ''")
    fields = _fields("line", separator)
    first = lines.orderBy("i").limit(1).select("i", fields.alias("f"), _mostly_numbers(fields).alias("data")).first()
    if first is None:
        return spark.createDataFrame([], "name string, x double, y double, z double")
    header = has_header and not first["data"]
    at = columns or (guess_columns(first["f"]) if header else {})
    if not {"x", "y", "z"} <= set(at):
        at = {"name": 0, "x": 1, "y": 2, "z": 3} if len(first["f"]) >= 4 else {"x": 0, "y": 1, "z": 2}
    if header:
        lines = lines.where(F.col("i") != first["i"])
    f = _fields("line", separator, max(at.values()) + 1)
    own = lines.select("i", f.alias("f"))
    number = lambda c: F.trim(F.try_element_at("f", F.lit(at[c] + 1))).try_cast("double").alias(c)
    own = own.select("i", *[number(c) for c in "xyz"], (F.trim(F.try_element_at("f", F.lit(at["name"] + 1))) if "name" in at else F.lit(None).cast("string")).alias("name")).dropna(subset=["x", "y", "z"])
    if "name" in at:
        return own.select("name", "x", "y", "z")
    from pyspark.sql.window import Window

    return own.select(F.row_number().over(Window.orderBy("i")).cast("string").alias("name"), "x", "y", "z")  # as many rows as a survey crew measures


def read_roofs(spark: SparkSession, path: str, separator: str = ",", has_header: bool = True) -> DataFrame:
    """(surface, x, y, z) corners of the surfaces that have at least three."""
    from pyspark.sql.window import Window

    rows = read_control_points(spark, path, separator, has_header).withColumnRenamed("name", "surface")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("surface"))).where(F.col("_n") >= 3).drop("_n")


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header, in as many files as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
