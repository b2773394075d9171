"""Boxes in space as column expressions; a box is x, y, z (centre), length, width, height and yaw about z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def volume(length: Column, width: Column, height: Column) -> Column:
    return length * width * height


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def corners(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """The eight corners as an array of (x, y, z): the lower four first, each four in turn about the centre."""
    out = []
    for up in (-0.5, 0.5):
        for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)):
            dx, dy = length * a, width * b
            out.append(F.struct((x + dx * F.cos(yaw) - dy * F.sin(yaw)).alias("x"), (y + dx * F.sin(yaw) + dy * F.cos(yaw)).alias("y"), (z + height * up).alias("z")))
    return F.array(*out)
