"""Box and ground-plane expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two xyxy boxes; the union is at least 1e-6."""
    wide = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    high = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    both = wide * high
    return both / F.greatest((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both, F.lit(1e-6))


def iou_xywh(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    return iou(ax, ay, ax + aw, ay + ah, bx, by, bx + bw, by + bh)


def to_ground(u: Column, v: Column, inverse: list[list[float]], centre: list[float]) -> tuple[Column, Column]:
    """Ground point (z = 0) of a pixel. inverse: R^T K^-1; centre: the camera's place. Null where the
    ray is parallel to the ground or meets it behind the camera."""
    ray = [u * row[0] + v * row[1] + row[2] for row in inverse]
    scale = F.when(F.abs(ray[2]) > 1e-9, -F.lit(float(centre[2])) / ray[2])
    scale = F.when(scale > 0, scale)
    return F.lit(float(centre[0])) + scale * ray[0], F.lit(float(centre[1])) + scale * ray[1]


def to_image(x: Column, y: Column, z: Column, projection: list[list[float]]) -> tuple[Column, Column]:
    """Pixel of a world point by a 3x4 projection; null behind the camera."""
    u, v, w = [x * p[0] + y * p[1] + z * p[2] + p[3] for p in projection]
    return F.when(w > 1e-9, u / w), F.when(w > 1e-9, v / w)


def in_convex_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Whether a point is inside or on a convex polygon given counter-clockwise."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        out = out & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return out


def grid_to_cm(position: Column, columns: int = 480, step: float = 2.5, origin: tuple[float, float] = (-300.0, -900.0)) -> tuple[Column, Column]:
    """Centimetres of a cell number of the ground grid."""
    return F.lit(origin[0]) + (position % columns) * step, F.lit(origin[1]) + F.floor(position / columns) * step


def padded_crop(x1, y1, x2, y2, width: int, height: int, pad: float = 0.1) -> tuple[Column, Column, Column, Column]:
    """A box with a margin of a share of its size, inside the image."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    zero = F.lit(0.0)
    return F.greatest(zero, x1 - px), F.greatest(zero, y1 - py), F.least(F.lit(float(width)), x2 + px), F.least(F.lit(float(height)), y2 + py)
