"""Column functions over colours, durations and curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Three decimals, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def rgb(text: Column) -> Column:
    """rgb() or rgba() as a struct, alpha 1 where it isn't given; null for other text."""
    inner = F.regexp_extract(text, r"(?i)^\s*rgba?\(([^)]*)\)", 1)
    p = F.transform(F.filter(F.split(F.trim(inner), r"[,\s/]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    made = F.struct(F.get(p, 0).alias("r"), F.get(p, 1).alias("g"), F.get(p, 2).alias("b"), F.coalesce(F.get(p, 3), F.lit(1.0)).alias("a"))
    return F.when((inner != "") & (F.size(p) >= 3), made)


def over(front: Column, back: Column) -> Column:
    """front composited over back, opaque."""
    a = front["a"]
    return F.struct(*[(front[c] * a + back[c] * (1 - a)).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels from 0 to 255."""

    def linear(c: Column) -> Column:
        s = c / 255
        return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and lightness, and chroma in channel units."""
    r, g, b = r / 255, g / 255, b / 255
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d, light = most - least, (most + least) / 2
    hue = F.when(d == 0, 0.0).when(most == r, ((g - b) / F.nullif(d, F.lit(0.0))) % 6).when(most == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4) * 60
    hue = F.when(hue < 0, hue + 360).otherwise(hue)
    sat = F.when(d == 0, 0.0).otherwise(d / F.nullif(1 - F.abs(2 * light - 1), F.lit(0.0)))
    return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"), (d * 255).alias("c"))


def hue_bucket(hue: Column) -> Column:
    """Hue to the nearest 30 degrees, halves up."""
    return (F.floor(hue / 30 + 0.5) * 30 % 360).cast("int")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of rounded channels; null beyond 255."""
    two = [F.lpad(F.lower(F.hex(F.floor(c + 0.5).cast("long"))), 2, "0") for c in (r, g, b)]
    return F.when(F.greatest(r, g, b) <= 255, F.concat(F.lit("#"), *two))


def hex_normal(text: Column) -> Column:
    """Lower case with three digits doubled; eight digits stay."""
    low = F.lower(text)
    return F.when(F.length(low) == 4, F.concat(F.lit("#"), F.regexp_replace(F.substring(low, 2, 3), "(.)", "$1$1"))).otherwise(low)


def hex_channels(text: Column) -> Column:
    return F.struct(*[F.conv(F.substring(text, at, 2), 16, 10).cast("int").alias(c) for c, at in (("r", 2), ("g", 4), ("b", 6))])


def bezier(text: Column) -> Column:
    """The four numbers of a cubic-bezier to four decimals; null for other text."""
    inner = F.regexp_extract(text, r"(?i)cubic-bezier\(([^)]*)\)", 1)
    p = F.transform(F.split(inner, ","), lambda x: F.bround(F.trim(x).try_cast("double"), 4))
    return F.when((F.size(p) == 4) & F.forall(p, lambda x: x.isNotNull()), p)


def milliseconds(text: Column) -> Column:
    """A CSS time as whole milliseconds, halves up; null for other text."""
    number = F.regexp_extract(text, r"^\s*(-?[\d.]+)\s*(ms|s)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*(-?[\d.]+)\s*(ms|s)\s*$", 2)
    return F.floor(F.when(unit == "s", number * 1000).otherwise(number) + 0.5).cast("long")


def composited(layers: Column, base: Column) -> Column:
    """Colour of a stack of backgrounds, nearest first, over a base: layers count up to the first that leaves nothing to see through (alpha 0.999 together)."""
    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(0.0).alias("a"))

    def under(acc: Column, x: Column) -> Column:
        seen = F.when(acc["a"] >= 0.999, 0.0).otherwise((1 - acc["a"]) * F.coalesce(x["a"], F.lit(0.0)))
        return F.struct(*[(acc[c] + seen * F.coalesce(x[c], F.lit(0.0))).alias(c) for c in "rgb"], (acc["a"] + seen).alias("a"))

    return F.aggregate(layers, start, under, lambda acc: F.struct(*[(acc[c] + (1 - acc["a"]) * base[c]).alias(c) for c in "rgb"]))
