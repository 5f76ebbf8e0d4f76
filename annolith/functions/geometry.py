"""Box expressions.  A box is four corner columns with a common prefix: ``{p}x1, {p}y1, {p}x2, {p}y2``.

All are plain SQL expressions, so they stay inside generated code.  The order of the arithmetic is fixed, as results are compared bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(p: str = "") -> str:
    """Clamped at 0 in either direction."""
    return f"greatest(0D, {p}x2 - {p}x1) * greatest(0D, {p}y2 - {p}y1)"


def intersection(a: str, b: str) -> str:
    return f"greatest(0D, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0D, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"


def iou(a: str, b: str) -> str:
    """Intersection over union, 0 where the union is 0."""
    inter = intersection(a, b)
    return f"coalesce(try_divide({inter}, ({area(a)}) + ({area(b)}) - ({inter})), 0D)"


def iou_floored(a: str, b: str) -> str:
    """The tracking variant: areas are not clamped, the denominator is at least 1e-9."""
    inter = intersection(a, b)
    raw = lambda p: f"({p}x2 - {p}x1) * ({p}y2 - {p}y1)"
    return f"({inter}) / greatest({raw(a)} + {raw(b)} - ({inter}), 1e-9D)"


def corners(x: str, y: str, w: str, h: str, width: str, height: str) -> list[Column]:
    """Normalised centre form to pixel corners x1, y1, x2, y2."""
    return [F.expr(f"({x} - {w} / 2) * {width}").alias("x1"), F.expr(f"({y} - {h} / 2) * {height}").alias("y1"), F.expr(f"({x} + {w} / 2) * {width}").alias("x2"), F.expr(f"({y} + {h} / 2) * {height}").alias("y2")]


def size_bucket(normalised_area: str) -> str:
    return f"case when {normalised_area} < 0.001D then 'tiny' when {normalised_area} < 0.01D then 'small' when {normalised_area} < 0.1D then 'medium' else 'large' end"


def letterbox(width: str, height: str, to_width: int, to_height: int) -> dict[str, str]:
    """Where an image lies on a canvas it is scaled into: left, top, width, height; rounding is half to even."""
    scale = f"least(cast({to_width} as double) / {width}, cast({to_height} as double) / {height})"
    w, h = f"greatest(1, cast(bround({width} * {scale}) as int))", f"greatest(1, cast(bround({height} * {scale}) as int))"
    return {"left": f"cast(floor(({to_width} - {w}) / 2) as int)", "top": f"cast(floor(({to_height} - {h}) / 2) as int)", "width": w, "height": h}


def zoom(index: str, frames: str, most: float) -> str:
    return f"1D + ({most}D - 1D) * ({index} / cast(greatest({frames} - 1, 1) as double))"


def crop_window(size: str, factor: str) -> tuple[str, str]:
    """(start, length) of the central part of one dimension that a zoom shows; all of it up to a factor of 1."""
    length = f"(case when {factor} <= 1D then {size} else cast(bround({size} / {factor}) as int) end)"
    return f"cast(floor(({size} - {length}) / 2) as int)", length


def projected(placement: str, width: str, height: str, factor: str, box: tuple[str, str, str, str] = ("x", "y", "w", "h")) -> str:
    """struct<x1, y1, x2, y2> of a normalised box on a zoomed frame, clipped to it; null where less than a pixel is left.

    placement: a struct of left, top, width, height where the image lies on the canvas before the zoom.
    """
    cx, cy, w, h = box

    def edges(centre: str, side: str, start: str, extent: str, size: str) -> tuple[str, str]:
        first, length = crop_window(size, factor)
        at = lambda sign: f"(({placement}.{start} + ({centre} {sign} {side} / 2) * {placement}.{extent}) - {first}) * (cast({size} as double) / {length})"
        return f"greatest(0D, {at('-')})", f"least(cast({size} as double), {at('+')})"

    x1, x2 = edges(cx, w, "left", "width", width)
    y1, y2 = edges(cy, h, "top", "height", height)
    return f"case when ({x2}) - ({x1}) >= 1 and ({y2}) - ({y1}) >= 1 then named_struct('x1', {x1}, 'y1', {y1}, 'x2', {x2}, 'y2', {y2}) end"
