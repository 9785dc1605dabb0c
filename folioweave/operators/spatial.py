"""Joins of boxes on pages, by tiles.

A box has a class: the powers of two next above its width and its height. On the
grid of tiles of its class it touches few tiles (two a side, three with slack), so
it is copied little, and what meets it in a tile is about as large as itself or
lies close to it. Rows meet on (keys, class, tile), which spreads one page over
many tasks however many boxes it holds; pairs that share a tile are compared,
pages are never multiplied out.

A point, or a box that has to lie inside of another one, is in one tile of each
class, so no pair comes twice. Boxes that overlap are compared on the coarser of
their two classes, and only in the tile of the lower corner of what they share.

Where boxes that may contain others are FEW on a page, the page is one tile;
else rows probe the classes that its boxes have. For overlaps the classes of one
side are one row of at most CLASSES squared entries, which goes to all tasks. Boxes without a coordinate, or turned around, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
#: Tiles have sides of 2**0 to 2**CLASSES; wider boxes touch more tiles of the last class.
CLASSES = 24
#: Up to so many boxes that may contain others, a page is one tile.
FEW = 32


def _level(size: Column) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(1.0)))), F.lit(0)), F.lit(CLASSES)).cast("int")


def _whole() -> Column:
    return F.struct(F.lit(-1).alias("w"), F.lit(-1).alias("h"))


def _tile(x: Column, level: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(2.0), level)).cast("long")


def _classed(boxes: DataFrame, slack: float = 0) -> DataFrame:
    """Boxes, widened by slack as _x0 to _y1, with their class _c; bad ones left out."""
    wide = [F.col("x0") - slack, F.col("y0") - slack, F.col("x1") + slack, F.col("y1") + slack]
    out = boxes.where("x0 <= x1 AND y0 <= y1").withColumns({f"_{c}": x for c, x in zip(BOX, wide, strict=True)})
    return out.withColumn("_c", F.struct(_level(F.col("_x1") - F.col("_x0")).alias("w"), _level(F.col("_y1") - F.col("_y0")).alias("h")))


def _classes(classed: DataFrame) -> DataFrame:
    """One row: all classes that occur."""
    return F.broadcast(classed.agg(F.collect_set("_c").alias("_classes")))


def _on(df: DataFrame, level: Column) -> DataFrame:
    """A row for each tile of the grid `level` that a box touches."""
    x = F.sequence(_tile(F.col("_x0"), level["w"]), _tile(F.col("_x1"), level["w"]))
    y = F.sequence(_tile(F.col("_y0"), level["h"]), _tile(F.col("_y1"), level["h"]))
    return df.withColumn("_level", level).withColumn("_tx", F.explode(x)).withColumn("_ty", F.explode(y))


def containing(inner: DataFrame, outer: DataFrame, keys: list[str], slack: float = 0, compared: bool = False) -> DataFrame:
    """Rows of inner (keys, x0 to y1 and others), each with the columns of every outer box of its keys that, widened by slack, contains it.

    outer: keys, x0 to y1 and columns of other names than inner's. Its box is not
    returned, but its area, as _area. compared: also the pairs that were compared
    and do not fit, with _fits telling them apart.
    """
    o = _classed(outer, slack).withColumn("_area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    pages = o.groupBy(*keys).agg(F.when(F.count(F.lit(1)) <= FEW, F.array(_whole())).otherwise(F.collect_set("_c")).alias("_classes"))
    whole = F.col("_level.w") < 0
    # Merged: tiles are many times the file that they come from, from whose size a broadcast would be judged.
    o = o.join(pages.hint("merge"), keys).withColumn("_level", F.when(F.element_at("_classes", 1)["w"] < 0, _whole()).otherwise(F.col("_c"))).drop("_classes")
    side = lambda low, high, level: F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(_tile(F.col(low), level), _tile(F.col(high), level))))
    tiles = o.withColumn("_tx", side("_x0", "_x1", F.col("_c.w"))).withColumn("_ty", side("_y0", "_y1", F.col("_c.h"))).drop(*BOX, "_c")
    at = inner.where("x0 <= x1 AND y0 <= y1").join(pages.hint("merge"), keys).withColumn("_level", F.explode("_classes")).drop("_classes")
    own = lambda x, side: F.when(whole, F.lit(0).cast("long")).otherwise(_tile(F.col(x), F.col(f"_level.{side}")))
    at = at.withColumn("_tx", own("x0", "w")).withColumn("_ty", own("y0", "h"))
    met = at.join(tiles.hint("merge"), [*keys, "_level", "_tx", "_ty"])
    fits = (F.col("_x0") <= F.col("x0")) & (F.col("_y0") <= F.col("y0")) & (F.col("_x1") >= F.col("x1")) & (F.col("_y1") >= F.col("y1"))
    gone = [f"_{c}" for c in BOX] + ["_level", "_tx", "_ty"]
    return met.withColumn("_fits", fits).drop(*gone) if compared else met.where(fits).drop(*gone)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], compared: bool = False) -> DataFrame:
    """Pairs of boxes of the same keys that share more than an edge, each once: the columns of a, and those of b (of other names but for keys and box); b's box is not returned."""
    x, y = _classed(a), _classed(b)
    of = lambda df, other: df.join(_classes(other.select("_c")), F.lit(True), "inner").withColumn("_level", F.explode(F.array_distinct(F.transform("_classes", lambda c: F.struct(F.greatest(c["w"], F.col("_c.w")).alias("w"), F.greatest(c["h"], F.col("_c.h")).alias("h")))))).drop("_classes")
    left = _on(of(x, y), F.col("_level"))
    right = _on(of(y, x), F.col("_level")).drop(*BOX)
    right = right.withColumnsRenamed({f"_{c}": f"_b{c}" for c in BOX} | {"_c": "_bc"})
    met = left.join(right, [*keys, "_level", "_tx", "_ty"])
    own = (F.col("_level.w") == F.greatest(F.col("_c.w"), F.col("_bc.w"))) & (F.col("_level.h") == F.greatest(F.col("_c.h"), F.col("_bc.h")))
    here = (F.col("_tx") == _tile(F.greatest("_x0", "_bx0"), F.col("_level.w"))) & (F.col("_ty") == _tile(F.greatest("_y0", "_by0"), F.col("_level.h")))
    meet = (F.col("_x0") < F.col("_bx1")) & (F.col("_bx0") < F.col("_x1")) & (F.col("_y0") < F.col("_by1")) & (F.col("_by0") < F.col("_y1"))
    gone = [f"_{c}" for c in BOX] + [f"_b{c}" for c in BOX] + ["_level", "_tx", "_ty", "_c", "_bc"]
    met = met.where(own)
    return met.withColumn("_fits", here & meet).drop(*gone) if compared else met.where(here & meet).drop(*gone)
