"""Points in boxes: an equi join by cells of a grid, whose size follows the box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the finest cells, in the units of the page.
CELL = 32.0
#: Cells double in width from level to level.
LEVELS = 40


def in_boxes(points: DataFrame, boxes: DataFrame, by: list[str], slack: float = 0.0) -> DataFrame:
    """Pairs of points (by, x, y) and boxes (by, x0, y0, x1, y1) of the same key with the point inside, edges and `slack` around counted.

    A box lies in the cells, four at most, of the level whose cells are at least as wide as it; a point looks into its one
    cell of each level that its key's boxes have. So a point meets the boxes near it, not all of its page, and a huge
    box is four rows. Boxes and points with null or non-finite coordinates, and boxes turned inside out by more than the
    slack, hold nothing. Other columns of both sides must differ in name; by's columns come once.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < 1e15)
    b = boxes.filter(fine("x0") & fine("y0") & fine("x1") & fine("y1") & (F.col("x1") - F.col("x0") + 2 * slack >= 0) & (F.col("y1") - F.col("y0") + 2 * slack >= 0))
    width = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(0.0)) + 2 * slack
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, F.lit(1e-9)) / CELL)))).cast("int")
    b = b.withColumn("g_level", level).withColumnsRenamed({c: f"g_{c}" for c in by})
    size = F.lit(CELL) * F.pow(F.lit(2.0), F.col("g_level"))
    cells = lambda lo, hi: F.sequence(F.floor((F.col(lo) - slack) / size).cast("bigint"), F.floor((F.col(hi) + slack) / size).cast("bigint"))
    placed = b.withColumn("g_cx", F.explode(cells("x0", "x1"))).withColumn("g_cy", F.explode(cells("y0", "y1")))
    levels = b.groupBy(*[f"g_{c}" for c in by]).agg(F.collect_set("g_level").alias("p_levels")).withColumnsRenamed({f"g_{c}": f"l_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"l_{c}"))
    p = points.filter(fine("x") & fine("y")).join(levels, on).drop(*[f"l_{c}" for c in by]).withColumn("p_level", F.explode("p_levels")).drop("p_levels")
    at = F.lit(CELL) * F.pow(F.lit(2.0), F.col("p_level"))
    p = p.withColumns({"p_cx": F.floor(F.col("x") / at).cast("bigint"), "p_cy": F.floor(F.col("y") / at).cast("bigint")})
    on = (F.col("p_level") == F.col("g_level")) & (F.col("p_cx") == F.col("g_cx")) & (F.col("p_cy") == F.col("g_cy"))
    for c in by:
        on = on & (F.col(c) == F.col(f"g_{c}"))
    inside = F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack)
    return p.join(placed, on & inside).drop("p_level", "p_cx", "p_cy", "g_level", "g_cx", "g_cy", *[f"g_{c}" for c in by])


def touching(small: DataFrame, boxes: DataFrame, by: list[str], pairs: bool = False) -> DataFrame:
    """The rows of small (by, x0, y0, x1, y1, …) whose box shares area with any of the key's boxes (by, x0, y0, x1, y1).

    As in in_boxes(), each side lies in cells of a level; a small box looks into all its cells. Boxes without area, or null or non-finite ones, touch nothing.
    pairs: a row for each such box, as g_x0, g_y0, g_x1, g_y1.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < 1e15)
    real = fine("x0") & fine("y0") & fine("x1") & fine("y1") & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    fit = lambda: F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / CELL)))).cast("int")
    cell = lambda c, level: F.floor(F.col(c) / (F.lit(CELL) * F.pow(F.lit(2.0), F.col(level)))).cast("bigint")
    b = boxes.filter(real).select(*[F.col(c).alias(f"g_{c}") for c in by], fit().alias("g_level"), *["x0", "y0", "x1", "y1"])
    levels = b.groupBy(*[f"g_{c}" for c in by]).agg(F.collect_set("g_level").alias("p_levels")).withColumnsRenamed({f"g_{c}": f"l_{c}" for c in by})
    b = b.withColumn("g_cx", F.explode(F.sequence(cell("x0", "g_level"), cell("x1", "g_level")))).withColumn("g_cy", F.explode(F.sequence(cell("y0", "g_level"), cell("y1", "g_level"))))
    b = b.withColumnsRenamed({c: f"g_{c}" for c in ("x0", "y0", "x1", "y1")})
    on = F.lit(True)
    for c in by:
        on = on & (F.col(c) == F.col(f"l_{c}"))
    s = small.filter(real).withColumn("p_own", fit()).join(levels, on).drop(*[f"l_{c}" for c in by]).withColumn("p_level", F.explode("p_levels")).drop("p_levels")
    # Of boxes that are wide for the level, flat ones look into few cells, too; the others meet all boxes of that level.
    how = "inner" if pairs else "left_semi"
    near = (F.col("p_own") <= F.col("p_level") + 2) | ((cell("x1", "p_level") - cell("x0", "p_level") + 1) * (cell("y1", "p_level") - cell("y0", "p_level") + 1) <= 64)
    key = F.col("p_level") == F.col("g_level")
    for c in by:
        key = key & (F.col(c) == F.col(f"g_{c}"))
    share = (F.col("x0") < F.col("g_x1")) & (F.col("g_x0") < F.col("x1")) & (F.col("y0") < F.col("g_y1")) & (F.col("g_y0") < F.col("y1"))
    cells = s.filter(near).withColumn("p_cx", F.explode(F.sequence(cell("x0", "p_level"), cell("x1", "p_level")))).withColumn("p_cy", F.explode(F.sequence(cell("y0", "p_level"), cell("y1", "p_level"))))
    hit = cells.join(b, key & (F.col("p_cx") == F.col("g_cx")) & (F.col("p_cy") == F.col("g_cy")) & share, how).drop("p_cx", "p_cy")
    wide = s.filter(~near).join(b, key & share, how)
    return hit.unionByName(wide).drop("p_own", "p_level", "g_level", "g_cx", "g_cy", *[f"g_{c}" for c in by]).distinct()
