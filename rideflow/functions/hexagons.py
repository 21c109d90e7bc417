"""Hexagon cells of a fixed radius around a map centre."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, functions as F

# The map centre and the hexagon radius in metres.
CENTRE_LAT = 38.888
CENTRE_LNG = -77.021
RADIUS_M = 200.0
METRES_PER_DEGREE = 111320.0

EAST_M = METRES_PER_DEGREE * math.cos(math.radians(CENTRE_LAT))
NORTH_M = METRES_PER_DEGREE


class HexCell(NamedTuple):
    q: Column
    r: Column


def hex_cell(lat: Column, lng: Column, radius_m: float = RADIUS_M) -> HexCell:
    """Axial (q, r) of the pointy-top hexagon a point falls into.

    Metres come from a local flat projection. Fractional axial coordinates are rounded as cube
    coordinates, whose sum is zero: the one with the largest rounding error is replaced by what
    the other two imply.
    """
    east = (lng - F.lit(CENTRE_LNG)) * F.lit(EAST_M)
    north = (lat - F.lit(CENTRE_LAT)) * F.lit(NORTH_M)
    q = (F.lit(math.sqrt(3.0) / 3.0) * east - F.lit(1.0 / 3.0) * north) / F.lit(radius_m)
    r = (F.lit(2.0 / 3.0) * north) / F.lit(radius_m)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_worst = (dq > dr) & (dq > ds)
    r_worst = dr > ds
    return HexCell(
        F.when(q_worst, -rr - rs).otherwise(rq).cast("long"),
        F.when(~q_worst & r_worst, -rq - rs).otherwise(rr).cast("long"),
    )
