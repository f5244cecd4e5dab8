"""Array columns as vectors, and scalar helpers of views."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, e: s + e))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, e: s + F.exp(e - top))
    return F.transform(logits, lambda v: v - top - F.ln(total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)


def argmax(values: Column) -> Column:
    """Place of the largest, the first at ties, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top(values: Column, k: int) -> Column:
    """Places of the k largest, the smaller place at ties."""
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["i"])


def height_above_ground(z: Column, ground: Column, most: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), z - ground))


def normalized(intensity: Column, scale: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), intensity / scale))


def blend_weight(dx: Column, dy: Column, half: float) -> Column:
    """Weight of a point in a block by its distance from the centre, 1 there and at least 0.01."""
    off = F.lit(1.0) - F.greatest(F.abs(dx), F.abs(dy)) / half
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), off * off))


def gaussian(distance: Column, sigma: float) -> Column:
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def project(eye: tuple, center: tuple, up: tuple, fov: float, width: int, height: int) -> tuple[Column, Column, Column]:
    """screen_x, screen_y and whether it is in front, of points x, y, z seen along the axis from centre to eye."""
    import numpy as np

    axis = np.subtract(eye, center) / np.linalg.norm(np.subtract(eye, center))
    right = np.cross(axis, np.asarray(up) / np.linalg.norm(up))
    right = right / (np.linalg.norm(right) + 1e-12)
    above = np.cross(right, axis)
    above = above / (np.linalg.norm(above) + 1e-12)
    along = lambda v: sum((F.col(c) - float(e)) * float(w) for c, e, w in zip("xyz", eye, v))
    depth = along(axis)
    front = depth > 0.01
    half_h = math.tan(math.radians(fov / 2))
    half_w = half_h * width / height
    flat = lambda v: F.when(front, along(v) / depth).otherwise(0.0)
    return (flat(right) / half_w * 0.5 + 0.5) * width, (F.lit(0.5) - flat(above) / half_h * 0.5) * height, front


def ramp(value: Column, low: Column, high: Column, stops: list[tuple[float, float, float]]) -> Column:
    """Colour between equally spaced stops by a value's place between low and high, as (r, g, b) from 0 to 1."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(high > low, (value - low) / (high - low)).otherwise(0.0))) * (len(stops) - 1)
    first = F.least(F.floor(place), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in stops])
    a, b = F.element_at(table, first + 1), F.element_at(table, first + 2)
    return F.zip_with(a, b, lambda p, q: p + (q - p) * (place - first))


def class_color(code: Column, colors: dict[int, tuple[float, float, float]], other: tuple = (0.0, 0.0, 0.0)) -> Column:
    rgb = lambda t: F.array(*[F.lit(float(v)) for v in t])
    table = F.create_map(*[v for k, c in colors.items() for v in (F.lit(k), rgb(c))])
    return F.coalesce(F.try_element_at(table, code), rgb(other))
