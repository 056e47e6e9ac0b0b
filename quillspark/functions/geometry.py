"""Boxes on a page as column expressions: gaps, alignment, overlap, order and proximity; y grows downwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Left, top, width and height."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, row: Column) -> Box:
        """The box of a struct with fields x, y, w and h."""
        return cls(row["x"], row["y"], row["w"], row["h"])

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def middle(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    def along(self, axis: str) -> tuple[Column, Column, Column]:
        """Start, end and middle on the axis x or y."""
        return (self.x, self.right, self.middle[0]) if axis == "x" else (self.y, self.bottom, self.middle[1])


def gap(a: Box, b: Box, axis: str) -> Column:
    """Distance from the end of ``a`` to the start of ``b``; null where ``b`` starts earlier."""
    d = b.along(axis)[0] - a.along(axis)[1]
    return F.when(d >= 0, d)


def middle_distance(a: Box, b: Box, axis: str) -> Column:
    """Distance of the middles; boxes in one row are near on y, boxes in one column on x."""
    return F.abs(a.along(axis)[2] - b.along(axis)[2])


def same_line(a: Box, b: Box, tolerance: float = 0.0) -> Column:
    """Middles within half the taller height and the tolerance."""
    return middle_distance(a, b, "y") <= F.greatest(a.h, b.h) / 2 + tolerance


def overlaps(a: Box, b: Box, axis: str, tolerance: float = 0.0) -> Column:
    """Extents meet on the axis; touching counts."""
    (a0, a1, _), (b0, b1, _) = a.along(axis), b.along(axis)
    return (a1 >= b0 - tolerance) & (a0 <= b1 + tolerance)


def before(a: Box, b: Box, axis: str) -> Column:
    """``a`` ends where ``b`` starts, or earlier: left of it on x, above it on y."""
    return a.along(axis)[1] <= b.along(axis)[0]


def before_within(a: Box, b: Box, axis: str, most: float, tolerance: float) -> Column:
    """The gap from ``a`` to ``b`` where it is at most ``most`` and the two stand in one row (x) or column (y), else null.

    An overlap up to the tolerance is a gap of zero where the middle of ``a`` comes first.
    """
    (_, end, first), (start, _, second) = a.along(axis), b.along(axis)
    d = start - end
    reach = F.when(d >= 0, d).when((-d <= tolerance) & (first < second), F.lit(0.0))
    in_line = same_line(a, b, tolerance) if axis == "x" else overlaps(a, b, "x", tolerance)
    return F.when((reach <= most) & in_line, reach)


def beside(field: Box, label: Box, side: str, most: float, tolerance: float) -> Column:
    """The gap between a field and a label above, below, left or right of it, null where it is not there."""
    axis = "y" if side in ("above", "below") else "x"
    first, second = (label, field) if side in ("above", "left") else (field, label)
    return before_within(first, second, axis, most, tolerance)


def share_inside(a: Box, b: Box) -> Column:
    """The share of the area of ``b`` that lies in ``a``; 0 for a box without area."""
    wide = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    high = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.when((b.w * b.h > 0) & (wide > 0) & (high > 0), wide * high / (b.w * b.h)).otherwise(0.0)


def union(a: Box, b: Box) -> Box:
    """The smallest box around both."""
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.right, b.right) - x, F.greatest(a.bottom, b.bottom) - y)


def is_square(a: Box, tolerance: float) -> Column:
    """Sides whose ratio is 1 within the tolerance, without a division; not for a box without extent."""
    return (a.w != 0) & (a.h != 0) & (F.greatest(a.w, a.h) <= F.least(a.w, a.h) * (1 + tolerance))


def fits(a: Box, most: float) -> Column:
    """Neither side is longer than ``most``."""
    return (a.w <= most) & (a.h <= most)


def rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Red, green and blue of a colour in four inks, all from 0 to 1."""
    return [(1 - ink) * (1 - k) for ink in (c, m, y)]
