"""Page and box geometry in points, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import text_width

#: Paper sizes in points, in the order in which they are tried.
PAPER = (
    ("A3", 841.89, 1190.55), ("A4", 595.28, 841.89), ("A5", 419.53, 595.28), ("B4", 708.66, 1000.63), ("B5", 498.9, 708.66),
    ("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0), ("Ledger", 1224.0, 792.0), ("Tabloid", 792.0, 1224.0),
)
DEFAULT_WIDTH, DEFAULT_HEIGHT = 595.0, 842.0


def normal_rotation(r: Column) -> Column:
    return F.pmod(r, F.lit(360))


def viewport(w: Column, h: Column, rotation: Column) -> Column:
    """What a viewer sees of a page: its rotation from 0 to 359, and width and height, swapped where it lies on its side."""
    r = normal_rotation(rotation)
    turned = r.isin(90, 270)
    return F.struct(r.alias("rotation"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def crop_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A crop as left, bottom, right, top."""
    return F.array(x, y, x + w, y + h)


def paper_name(w: Column, h: Column, within: float = 3.0) -> Column:
    """The first paper size that both sides are ``within`` points of, upright or turned; null if there is none."""
    fits = lambda a, b: (F.abs(w - a) < within) & (F.abs(h - b) < within)
    return F.coalesce(*(F.when(fits(a, b) | fits(b, a), name) for name, a, b in PAPER))


def paper_label(w: Column, h: Column) -> Column:
    """``A4 (210 x 297 mm)``, or the size alone; a dash where a side is missing or zero."""
    mm = lambda c: F.floor(c * 25.4 / 72 + 0.5).cast("string")
    size = F.concat(mm(w), F.lit(" x "), mm(h), F.lit(" mm"))
    name = paper_name(w, h)
    return F.when((F.coalesce(w, F.lit(0)) == 0) | (F.coalesce(h, F.lit(0)) == 0), "—").when(name.isNull(), size).otherwise(F.concat(name, F.lit(" ("), size, F.lit(")")))


def box_to_visual(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, rotation: Column) -> Column:
    """A box of the unrotated page, from its lower left, as a box of the page as shown, from its upper left."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))
    r = normal_rotation(rotation)
    return (
        F.when(r == 90, box(y, x, h, w))
        .when(r == 180, box(page_w - x - w, y, w, h))
        .when(r == 270, box(page_h - y - h, page_w - x - w, h, w))
        .otherwise(box(x, page_h - y - h, w, h))
    )


def box_from_visual(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, rotation: Column) -> Column:
    """The inverse of ``box_to_visual``; the page's sides are those of the unrotated page."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))
    r = normal_rotation(rotation)
    return (
        F.when(r == 90, box(y, x, h, w))
        .when(r == 180, box(page_w - x - w, y, w, h))
        .when(r == 270, box(page_w - y - h, page_h - x - w, h, w))
        .otherwise(box(x, page_h - y - h, w, h))
    )


def point_from_visual(x: Column, y: Column, page_w: Column, page_h: Column, rotation: Column) -> Column:
    """A point of the page as shown, from its lower left, as a point of the unrotated page."""
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    r = normal_rotation(rotation)
    return F.when(r == 90, at(page_w - y, x)).when(r == 180, at(page_w - x, page_h - y)).when(r == 270, at(y, page_h - x)).otherwise(at(x, y))


def anchor(text: Column, size: float, page_w: Column, page_h: Column, position: str) -> Column:
    """Where a line of text starts at one of six places of the page; any other name means bottom-center."""
    edge, _, side = position.partition("-")
    if edge not in ("top", "bottom") or side not in ("left", "center", "right"):
        edge, side = "bottom", "center"
    width = text_width(text, size)
    x = {"left": F.lit(50.0), "center": F.greatest((page_w - width) / 2, F.lit(10.0)), "right": F.greatest(page_w - 50 - width, F.lit(10.0))}[side]
    return F.struct(x.alias("x"), (page_h - 30 if edge == "top" else F.lit(30.0)).alias("y"))


def quad(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The corners of a markup rectangle: upper left, upper right, lower left, lower right."""
    return F.array(x, y + h, x + w, y + h, x, y, x + w, y)


def pixels_to_points(left: Column, top: Column, w: Column, h: Column, px_w: Column, px_h: Column, page_w: Column, page_h: Column, pad: float = 0.0) -> Column:
    """A pixel box from the upper left as a page box from the lower left, scaled axis by axis, ``pad`` points wider on all sides but not beyond 0."""
    sx, sy = page_w / px_w, page_h / px_h
    x, y = left * sx - pad, page_h - (top + h) * sy - pad
    return F.struct(F.greatest(x, F.lit(0.0)).alias("x"), F.greatest(y, F.lit(0.0)).alias("y"), (w * sx + 2 * pad).alias("width"), (h * sy + 2 * pad).alias("height"))
