"""Colours, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_color(c: Column, default: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """``#RRGGBB`` as parts from 0 to 1; anything else is the default."""
    part = lambda i: F.conv(F.substring(c, i, 2), 16, 10).cast("double") / 255
    ok = F.coalesce(c.rlike(r"^#[0-9A-Fa-f]{6}$"), F.lit(False))
    return F.struct(*(F.when(ok, part(2 + 2 * i)).otherwise(default[i]).alias(n) for i, n in enumerate("rgb")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """Parts from 0 to 1 as ``#rrggbb``, each truncated to 255ths."""
    whole = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), (x * 255).cast("int")))
    return F.format_string("#%02x%02x%02x", whole(r), whole(g), whole(b))


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    """Whole percentages, truncated; black has K = 100 alone."""
    k = 1 - F.greatest(r, g, b)
    part = lambda x: F.when(k >= 1, 0).otherwise(((1 - x - k) / F.nullif(1 - k, F.lit(0.0)) * 100).cast("int"))
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), F.when(k >= 1, 100).otherwise((k * 100).cast("int")).alias("k"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """From percentages to 255ths, truncated."""
    part = lambda x: (255 * (1 - x / 100) * (1 - k / 100)).cast("int")
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))
