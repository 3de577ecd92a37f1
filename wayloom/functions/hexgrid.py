"""Hexagonal binning on the mercator plane.

Cells are pointy-top hexagons addressed by axial coordinates. The edge length per
resolution follows the usual 1 : √7 ladder of global hexagon grids, so counts are
comparable in size, but ids are this library's own: ``resolution:q:r``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions.geo import mercator_lat, mercator_lon, mercator_x, mercator_y, point

FINEST_EDGE_M = 65.907807
FINEST_RESOLUTION = 10


def hex_edge_m(resolution: int) -> float:
    if not 6 <= resolution <= 10:
        raise ValueError("resolution must lie in 6..10")
    return FINEST_EDGE_M * math.sqrt(7.0) ** (FINEST_RESOLUTION - resolution)


def _axial(lon: Column, lat: Column, resolution: int) -> tuple[Column, Column]:
    edge = hex_edge_m(resolution)
    x, y = mercator_x(lon), mercator_y(lat)
    return (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / edge, y * (2.0 / 3.0) / edge


def hex_cell(lon: Column, lat: Column, resolution: int) -> Column:
    """Struct {q, r} of the hexagon holding a point (cube rounding)."""
    q, r = _axial(lon, lat, resolution)
    near_q, near_r, near_s = (F.floor(v + 0.5) for v in (q, r, -q - r))
    off_q, off_r, off_s = F.abs(near_q - q), F.abs(near_r - r), F.abs(near_s + q + r)
    fix_q = (off_q > off_r) & (off_q > off_s)
    fix_r = ~fix_q & (off_r > off_s)
    return F.struct(
        F.when(fix_q, -near_r - near_s).otherwise(near_q).cast("long").alias("q"),
        F.when(fix_r, -near_q - near_s).otherwise(near_r).cast("long").alias("r"),
    )


def hex_id(cell: Column, resolution: int) -> Column:
    return F.concat_ws(":", F.lit(str(resolution)), cell["q"].cast("string"), cell["r"].cast("string"))


def _plane_centre(cell: Column, resolution: int) -> tuple[Column, Column]:
    edge = hex_edge_m(resolution)
    return (
        (cell["q"] + cell["r"] / 2.0) * (math.sqrt(3.0) * edge),
        cell["r"] * (1.5 * edge),
    )


def hex_centre(cell: Column, resolution: int) -> Column:
    x, y = _plane_centre(cell, resolution)
    return point(mercator_lon(x), mercator_lat(y))


def hex_boundary(cell: Column, resolution: int) -> Column:
    """Six corners, anticlockwise from the lower right."""
    edge = hex_edge_m(resolution)
    x, y = _plane_centre(cell, resolution)
    corners = []
    for k in range(6):
        angle = math.radians(60.0 * k - 30.0)
        corners.append(point(mercator_lon(x + edge * math.cos(angle)), mercator_lat(y + edge * math.sin(angle))))
    return F.array(*corners)
