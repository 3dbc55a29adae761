"""Boxes as structs (left, top, right, bottom) and the expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<left:int,top:int,width:int,height:int,right:int,bottom:int>"


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box of whole pixels, or null where it is empty."""
    edges = [F.bround(x.cast("double"), 0).cast("int") for x in (left, top, right, bottom)]
    a, b, c, d = edges
    made = F.struct(a.alias("left"), b.alias("top"), (c - a).alias("width"), (d - b).alias("height"), c.alias("right"), d.alias("bottom"))
    return F.when((c > a) & (d > b), made)


def clipped(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    within = lambda x, most: F.greatest(F.lit(0), F.least(x, most))
    return box(within(left, width), within(top, height), within(right, width), within(bottom, height))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["right"] - b["left"]) * F.greatest(F.lit(0), b["bottom"] - b["top"])


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where they are apart or empty."""
    both = overlap(a["left"], a["right"], b["left"], b["right"]) * overlap(a["top"], a["bottom"], b["top"], b["bottom"])
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def expanded(b: Column, x: int, y: int, width: Column, height: Column) -> Column:
    return clipped(b["left"] - x, b["top"] - y, b["right"] + x, b["bottom"] + y, width, height)


def rotated(x: Column, y: Column, degrees: float, cx: Column, cy: Column, to_x: Column, to_y: Column) -> list[Column]:
    """A point of a page turned by `degrees` about (cx, cy), turned back about (to_x, to_y)."""
    r = F.radians(F.lit(float(degrees)))
    dx, dy = x - cx, y - cy
    return [to_x + dx * F.cos(r) - dy * F.sin(r), to_y + dx * F.sin(r) + dy * F.cos(r)]


def of_points(points: Column, width: Column, height: Column) -> Column:
    """The box around array<struct(x, y)>, clipped to the page; null where it is empty."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return clipped(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width, height)


def whole_points(points: Column, width: Column, height: Column) -> Column:
    """The points as whole pixels of the page."""
    on = lambda x, most: F.greatest(F.lit(0), F.least(most, F.bround(x.cast("double"), 0).cast("int")))
    return F.transform(points, lambda p: F.struct(on(p["x"], width).alias("x"), on(p["y"], height).alias("y")))


def padded(width: Column, height: Column, padding: int) -> list[Column]:
    """Width and height of a page with a white margin."""
    return [width + 2 * padding, height + 2 * padding]


def unpadded(left: Column, top: Column, width: Column, height: Column, padding: int, page_width: Column, page_height: Column) -> Column:
    """A box of a page with a margin on the page without it."""
    return clipped(left - padding, top - padding, left + width - padding, top + height - padding, page_width, page_height)


def turned_back(left: Column, top: Column, width: Column, height: Column, padding: int, degrees: float, turned: tuple[Column, Column], page: tuple[Column, Column]) -> Column:
    """A box of a page that was padded and turned by `degrees`, on the page as it was: the box around its four corners."""
    x0, y0 = left - padding, top - padding
    corners = [(x0, y0), (x0 + width, y0), (x0 + width, y0 + height), (x0, y0 + height)]
    half = [c / 2 for c in (*turned, *page)]
    points = [rotated(x, y, degrees, half[0], half[1], half[2], half[3]) for x, y in corners]
    return of_points(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points]), *page)
