"""Box arithmetic over x0, y0, x1, y1 columns of a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def area(b: tuple[Column, ...]) -> Column:
    return F.abs(b[2] - b[0]) * F.abs(b[3] - b[1])


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def covered_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the first box that the second covers."""
    return F.when(area(a) > 0, overlap(a, b) / area(a)).otherwise(0.0)


def overlap_of_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def vertical_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of the first box's height that the second has too."""
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return F.when(a[3] > a[1], h / (a[3] - a[1])).otherwise(0.0)


def fills_page(b: tuple[Column, ...], width: Column, height: Column) -> Column:
    return ((b[2] - b[0]) >= 0.9 * width) & ((b[3] - b[1]) >= 0.9 * height)


def angle(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def pixels(points: Column) -> Column:
    return points * 96 / 72
