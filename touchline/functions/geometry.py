"""Boxes, crops, homographies and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def iou(a: list[Column], b: list[Column]) -> Column:
    shared = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, with 1e-8 added to the product of norms."""

    def dot(p: Column, q: Column) -> Column:
        products = F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def project(h: Column, x: Column, y: Column) -> Column:
    """Struct x, y of a point through a row-major 3x3 matrix of nine doubles."""
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(
        ((h[0] * x + h[1] * y + h[2]) / w).alias("x"), ((h[3] * x + h[4] * y + h[5]) / w).alias("y")
    )


def inverse(h: Column) -> Column:
    """Inverse of a 3x3 matrix by cofactors; null when singular."""
    a, b, c, d, e, f, g, i, j = (h[n] for n in range(9))
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    cof = [
        e * j - f * i, c * i - b * j, b * f - c * e,
        f * g - d * j, a * j - c * g, c * d - a * f,
        d * i - e * g, b * g - a * i, a * e - b * d,
    ]
    return F.when(det != 0, F.array(*[x / det for x in cof]))


def img_to_world(h: Column, px: Column, py: Column) -> Column:
    return project(h, px, py)


def world_to_img(h: Column, wx: Column, wy: Column) -> Column:
    return project(inverse(h), wx, wy)


def blend(before: Column, after: Column, weight: Column) -> Column:
    """Linear blend of two matrices, scaled so that the last entry is 1."""
    mixed = F.zip_with(before, after, lambda p, q: (F.lit(1.0) - weight) * p + weight * q)
    return F.transform(mixed, lambda v: v / mixed[8])


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return F.floor((x1 + x2) / 2).cast("long"), y2


def torso_bottom(y1: Column, y2: Column, ratio: Column | float) -> Column:
    """Last row of the jersey part of a box."""
    return y1 + ((y2 - y1) * F.lit(ratio)).cast("long")


def torso_clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, ratio: float = 0.55,
                  min_px: int = 4) -> Column:
    """Jersey part kept inside the image; null when smaller than ``min_px``."""
    left, right = F.greatest(F.lit(0), x1), F.least(F.lit(width), x2)
    top = F.greatest(F.lit(0), y1)
    bottom = F.least(F.lit(height), top + ((y2 - top) * F.lit(ratio)).cast("long"))
    fits = (right - left >= min_px) & (bottom - top >= min_px)
    return F.when(fits, F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


def torso_band(w: Column, h: Column, top: float = 0.25, bottom: float = 0.65, side: float = 0.15) -> Column:
    """Middle band of a crop; the whole crop when the band is empty."""
    y1, y2 = (h * F.lit(top)).cast("long"), (h * F.lit(bottom)).cast("long")
    x1 = (w * F.lit(side)).cast("long")
    x2 = w - x1
    ok = (y2 > y1) & (x2 > x1)
    zero = F.lit(0).cast("long")

    def pick(v: Column, whole: Column) -> Column:
        return F.when(ok, v).otherwise(whole).cast("long")

    return F.struct(
        pick(x1, zero).alias("x1"), pick(y1, zero).alias("y1"), pick(x2, w).alias("x2"), pick(y2, h).alias("y2")
    )


def centre_margin(size: Column, ratio: Column | float) -> Column:
    """Pixels cut from each side so that the middle ``ratio`` of a crop remains."""
    return (size * (F.lit(1.0) - F.lit(ratio)) / 2.0).cast("long")
