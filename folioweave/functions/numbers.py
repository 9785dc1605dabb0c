"""Geometry, numbers, hashes, arrays and vectors (GEO, NUM, HSH, ARR) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    """GEO-01."""
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def contains(outer: Column, inner: Column, slack: float = 0) -> Column:
    """GEO-01."""
    return (outer["x0"] - slack <= inner["x0"]) & (outer["y0"] - slack <= inner["y0"]) & (outer["x1"] + slack >= inner["x1"]) & (outer["y1"] + slack >= inner["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """GEO-01."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def scaled(box: Column, scale: Column) -> Column:
    """GEO-02: page to view; scaled(box, 1 / scale) goes back."""
    return F.struct(*[(box[c] * scale).alias(c) for c in ("x0", "y0", "x1", "y1")])


def visible_share(top: Column, bottom: Column, view_top: Column, view_bottom: Column) -> Column:
    """GEO-03: the share of a height that is in view."""
    seen = F.least(bottom, view_bottom) - F.greatest(top, view_top)
    return F.greatest(F.lit(0.0), F.try_divide(seen, bottom - top))


def radius(rank: Column) -> Column:
    """GEO-04."""
    return F.lit(4.0) + F.sqrt(rank) * 28


def micro_usd(usd: Column) -> Column:
    """NUM-03: rounded up; by way of decimals, so that 0.1 is 100000."""
    return F.ceil(usd.cast("decimal(18,9)") * 1000000).cast("long")


def content_hash(*columns: Column | str) -> Column:
    """HSH-01."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stable_id(*parts: Column | str) -> Column:
    """HSH-02: a UUID-shaped id of the parts."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


# Colours of the first documents of a set.
COLOURS = ("#DB935F", "#6CACE4", "#80BD98", "#BC99DD", "#E0B45A", "#E58DA0", "#67C4C3", "#B3BF75")


def rolling_hash(text: Column) -> Column:
    """HSH-03: 31 h + c over the characters, modulo 2**32; a character beyond 16 bits counts as its first half."""
    half = lambda c: F.when(c > 0xFFFF, F.shiftright(c - 0x10000, 10) + 0xD800).otherwise(c)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + half(F.ascii(c))) % (1 << 32))


def colour(first: Column, place: Column) -> Column:
    """HSH-03: the colour of the document at a place (from 0) of its set's ids in order, of which `first` is the first: one of eight, then a hue a golden angle on, to three decimals."""
    h = rolling_hash(first)
    hue = (h % 360 + place * 137.508) % 360
    return F.when(place < len(COLOURS), F.element_at(F.array(*map(F.lit, COLOURS)), ((h + place) % len(COLOURS) + 1).cast("int"))).otherwise(F.concat(F.lit("hsl("), F.round(hue, 3).cast("decimal(6,3)").cast("string"), F.lit(" 50% 68%)")))


def usable_vector(v: Column, size: int) -> Column:
    """ARR-04: of the size, finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
