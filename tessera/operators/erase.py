"""Cutting boxes by boxes: what canopy leaves of rocks, and the cells that the rest touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.detections import BOX
from tessera.operators.habitat import touched

EDGES = ("xmin", "ymin", "xmax", "ymax")


def erased(rocks: DataFrame, canopy: DataFrame, cell: int = 256) -> DataFrame:
    """Rectangles left of each rock when the union of its scene's canopy boxes is cut away: det_id, scene_id, box.

    Rocks and canopy meet by grid cell. The edges of the canopy boxes over a rock split it into a small
    grid of its own; the fields that no box covers are the rest. A rock that is covered wholly gives no row.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    r = rocks.select("det_id", "scene_id", *BOX)
    rg = r.withColumn("_gx", span(BOX[0], BOX[2])).withColumn("_gy", span(BOX[1], BOX[3]))
    cg = canopy.select("scene_id", *EDGES).withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax"))
    part = [F.greatest(F.col(BOX[0]), F.col("xmin")), F.greatest(F.col(BOX[1]), F.col("ymin")), F.least(F.col(BOX[2]), F.col("xmax")), F.least(F.col(BOX[3]), F.col("ymax"))]
    over = rg.join(cg, ["scene_id", "_gx", "_gy"]).select("det_id", *[p.alias(n) for p, n in zip(part, EDGES, strict=True)]).filter("xmax > xmin and ymax > ymin")
    over = over.groupBy("det_id").agg(F.collect_set(F.struct(*EDGES)).alias("_cut"))
    r = r.join(over, "det_id", "left").withColumn("_cut", F.coalesce("_cut", F.expr("cast(array() as array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>)")))

    def cuts(axis: str, lo: str, hi: str):
        inner = F.concat(F.transform("_cut", lambda c: c[f"{axis}min"]), F.transform("_cut", lambda c: c[f"{axis}max"]))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.col(lo), F.col(hi)), inner)))

    r = r.withColumn("_xs", cuts("x", BOX[0], BOX[2])).withColumn("_ys", cuts("y", BOX[1], BOX[3]))
    slot = lambda c: F.explode(F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("lo"), F.slice(c, F.lit(2), F.size(c) - 1).alias("hi")))
    r = r.withColumn("_x", slot("_xs")).withColumn("_y", slot("_ys"))
    covered = F.exists("_cut", lambda c: (c["xmin"] <= F.col("_x.lo")) & (c["xmax"] >= F.col("_x.hi")) & (c["ymin"] <= F.col("_y.lo")) & (c["ymax"] >= F.col("_y.hi")))
    return r.filter(~covered).select("det_id", "scene_id", *[F.col(f"_{a}.{e}").alias(n) for n, (a, e) in zip(BOX, (("x", "lo"), ("y", "lo"), ("x", "hi"), ("y", "hi")), strict=True)])


def rest_area(pieces: DataFrame) -> DataFrame:
    """Area left of each rock."""
    return pieces.groupBy("scene_id", "det_id").agg(F.sum((F.col(BOX[2]) - F.col(BOX[0])) * (F.col(BOX[3]) - F.col(BOX[1]))).alias("area"))


def cells_touched(cells: DataFrame, boxes: DataFrame, size: int = 32, side: int = 32) -> DataFrame:
    """Cells that a box touches, borders included."""
    t = touched(boxes, BOX, size, side).select("scene_id", "row", "col").distinct()
    return cells.join(t, ["scene_id", "row", "col"], "left_semi")
