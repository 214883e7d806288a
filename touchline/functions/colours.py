"""Colour texts, 8-bit HSV and the cylindrical colour space, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.binding import let

# fixed values: colour names callers may send
NAMED_COLOURS = {
    "white": "#FFFFFF",
    "black": "#000000",
    "grey": "#808080",
    "gray": "#808080",
    "silver": "#C0C0C0",
    "red": "#FF0000",
    "maroon": "#800000",
    "orange": "#FFA500",
    "gold": "#FFD700",
    "yellow": "#FFFF00",
    "lime": "#00FF00",
    "green": "#008000",
    "teal": "#008080",
    "cyan": "#00FFFF",
    "aqua": "#00FFFF",
    "blue": "#0000FF",
    "navy": "#000080",
    "sky": "#87CEEB",
    "skyblue": "#87CEEB",
    "purple": "#800080",
    "magenta": "#FF00FF",
    "pink": "#FFC0CB",
    "brown": "#A52A2A",
}


def normalise_colour(colour: Column) -> Column:
    """Form used to tell whether a colour changed; null when empty."""
    bare = F.regexp_replace(colour, r"^\s*#*\s*|\s+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def parse_colour(colour: Column, strict: bool = False) -> Column:
    """Struct r, g, b of a colour name or hex text; bad text gives null or an error."""
    names = F.create_map(*[F.lit(x) for pair in NAMED_COLOURS.items() for x in pair])
    bad = F.lit(None)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unrecognised colour: "), F.coalesce(colour, F.lit("null"))))

    def digits(text: Column) -> Column:
        return F.lower(F.regexp_replace(F.coalesce(F.try_element_at(names, text), text), "^#+", ""))

    def doubled(hexa: Column) -> Column:
        return F.when(F.length(hexa) == 3, F.regexp_replace(hexa, "(.)", "$1$1")).otherwise(hexa)

    def channels(hexa: Column) -> Column:
        parts = {c: F.conv(F.substring(hexa, at, 2), 16, 10).cast("int") for c, at in (("r", 1), ("g", 3), ("b", 5))}
        rgb = F.struct(*[v.alias(c) for c, v in parts.items()])
        return F.when(hexa.rlike("^[0-9a-f]{6}$"), rgb).otherwise(bad)

    text = F.lower(F.regexp_replace(colour, r"^\s+|\s+$", ""))
    return let(let(let(text, digits), doubled), channels)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct h (0-179), s, v (0-255), in the fixed-point arithmetic of 8-bit images."""
    top = F.greatest(r, g, b)
    spread = top - F.least(r, g, b)
    one, half = 12, 1 << 11
    s_unit = F.when(top == 0, 0).otherwise(F.rint(F.lit(float(255 << one)) / top)).cast("int")
    h_unit = F.when(spread == 0, 0).otherwise(F.rint(F.lit(float(180 << one)) / (6 * spread))).cast("int")
    sector = F.when(top == r, g - b).when(top == g, b - r + 2 * spread).otherwise(r - g + 4 * spread)
    h = F.shiftright(sector * h_unit + half, one)
    return F.struct(
        F.when(h < 0, h + 180).otherwise(h).cast("int").alias("h"),
        F.shiftright(spread * s_unit + half, one).cast("int").alias("s"),
        top.cast("int").alias("v"),
    )


def hue_angle(hue: Column) -> Column:
    return hue * F.lit(math.pi / 90.0)


def colour_vector(h: Column, s: Column, v: Column) -> Column:
    """Struct a, b, v: saturation along the hue angle, and brightness."""
    return F.struct(
        (s * F.cos(hue_angle(h))).alias("a"), (s * F.sin(hue_angle(h))).alias("b"), v.cast("double").alias("v")
    )


def text_vector(colour: Column) -> Column:
    """Cylindrical vector of a colour text, null for bad text."""

    def vector(rgb: Column) -> Column:
        hsv = let(rgb_to_hsv(rgb["r"], rgb["g"], rgb["b"]), lambda c: colour_vector(c["h"], c["s"], c["v"]))
        return F.when(rgb.isNotNull(), hsv)

    return let(parse_colour(colour), vector)


def colour_distance(p: Column, q: Column) -> Column:
    da, db, dv = p["a"] - q["a"], p["b"] - q["b"], p["v"] - q["v"]
    return F.sqrt(da * da + db * db + dv * dv)
