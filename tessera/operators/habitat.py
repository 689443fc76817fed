"""Cells over rasters: vegetation, rock counts, canopy, scores and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_grid(pixels: DataFrame, bh: int = 2, bw: int = 2, width: int = 64) -> DataFrame:
    """Means of the valid pixels of each block, numbered row by row; edge blocks may be partial."""
    if bh < 1 or bw < 1:
        raise ValueError("blocks must be positive")
    p = pixels.groupBy("scene_id", F.expr(f"cast(row div {bh} as int)").alias("row"), F.expr(f"cast(col div {bw} as int)").alias("col"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("valid"), F.col(c))), F.lit(0.0)).alias(c)
    g = p.agg(F.count_if("valid").alias("valid_px"), mean("r"), mean("g"), mean("b"))
    return g.withColumn("cell_id", F.col("row") * -(-width // bw) + F.col("col"))


def normalised(pixels: DataFrame, zero_is: str = "scale") -> DataFrame:
    """Bands by scene to 0..255, truncated. A band of one value keeps its difference (scale) or is 0 (zero)."""
    lo = pixels.groupBy("scene_id").agg(*[f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))])
    p = pixels.join(lo, "scene_id")
    out = []
    for c in "rgb":
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        x = ((F.col(c) - F.col(f"lo_{c}")) / F.when(span == 0, F.lit(1)).otherwise(span) * 255).cast("int")
        out.append((F.when(span == 0, F.lit(0)).otherwise(x) if zero_is == "zero" else x).alias(c))
    return p.select("scene_id", "row", "col", *out)


def dominant() -> Column:
    """Strictly largest channel of r, g, b: 1 for green, 2/3 for blue, 1/3 for red, 0 for a tie or no valid pixel."""
    return F.when(F.col("valid_px") > 0, dominant_of(F.col("r"), F.col("g"), F.col("b"))).otherwise(F.lit(0.0)).cast("float")


def dominant_of(r: Column, g: Column, b: Column) -> Column:
    return F.when((g > r) & (g > b), 3).when((b > r) & (b > g), 2).when((r > g) & (r > b), 1).otherwise(0) / F.lit(3.0)


def dtype_range(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - lo) / (hi - lo)))


def _joined(cells: DataFrame, hits: DataFrame) -> DataFrame:
    return cells.join(hits, ["scene_id", "row", "col"], "left")


def rocks_centroid(cells: DataFrame, rocks: DataFrame, size: int = 32) -> DataFrame:
    """Add rock_ct: centroids strictly inside; one on a border belongs to no cell. An equi-join on the cell's place."""
    x, y = (F.col("pixel_xmin") + F.col("pixel_xmax")) / 2, (F.col("pixel_ymin") + F.col("pixel_ymax")) / 2
    r = rocks.select("scene_id", F.floor(y / size).cast("int").alias("row"), F.floor(x / size).cast("int").alias("col"), (x / size).alias("_x"), (y / size).alias("_y"))
    n = r.filter((F.col("_x") > F.col("col")) & (F.col("_y") > F.col("row"))).groupBy("scene_id", "row", "col").agg(F.count(F.lit(1)).alias("rock_ct"))
    return _joined(cells, n).withColumn("rock_ct", F.coalesce("rock_ct", F.lit(0)))


def touched(boxes: DataFrame, box: tuple[str, str, str, str], size: int, side: int) -> DataFrame:
    """Add row and col of every cell that a box touches, borders included."""
    span = lambda lo, hi: F.explode(F.sequence(F.greatest(F.lit(0), (F.ceil(F.col(lo) / size) - 1).cast("int")), F.least(F.lit(side - 1), F.floor(F.col(hi) / size).cast("int"))))
    return boxes.withColumn("col", span(box[0], box[2])).withColumn("row", span(box[1], box[3]))


def rocks_intersects(cells: DataFrame, rocks: DataFrame, size: int = 32, side: int = 32) -> DataFrame:
    n = touched(rocks, ("pixel_xmin", "pixel_ymin", "pixel_xmax", "pixel_ymax"), size, side).groupBy("scene_id", "row", "col").agg(F.count(F.lit(1)).alias("rock_ct"))
    return _joined(cells, n).withColumn("rock_ct", F.coalesce("rock_ct", F.lit(0)))


def canopy_overlap(cells: DataFrame, canopy: DataFrame, size: int = 32, side: int = 32) -> DataFrame:
    """Add ratio: the sum, not the union, of overlaps by cell area; null where no box touches."""
    t = touched(canopy, ("xmin", "ymin", "xmax", "ymax"), size, side)
    part = lambda lo, hi, k: F.greatest(F.lit(0.0), F.least(F.col(hi), (F.col(k) + 1) * size) - F.greatest(F.col(lo), F.col(k) * size))
    s = t.groupBy("scene_id", "row", "col").agg((F.sum(part("xmin", "xmax", "col") * part("ymin", "ymax", "row")) / float(size * size)).alias("ratio"))
    return _joined(cells, s)


def blocked(cells: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Add blocked: overlap at or over the threshold, among cells that touch a canopy at all."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    return cells.withColumn("blocked", F.coalesce(F.least("ratio", F.lit(1.0)) >= threshold, F.lit(False)))


def eligible(need_rocks: bool) -> Column:
    ok = (F.col("valid_px") > 0) & ~F.col("blocked")
    return ok & (F.col("rock_ct") > 0) if need_rocks else ok


def rock_cap(cells: DataFrame, percentile: float = 95, need_rocks: bool = True) -> DataFrame:
    """By scene, the interpolated percentile of eligible positive counts; 1 where there is none."""
    if not 0 < percentile <= 100:
        raise ValueError("percentile must be in (0, 100]")
    p = F.percentile(F.when(eligible(need_rocks) & (F.col("rock_ct") > 0), F.col("rock_ct")), F.lit(percentile / 100))
    return cells.groupBy("scene_id").agg(p.alias("cap")).withColumn("cap", F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.lit(1.0)))


def scored(cells: DataFrame, wv: float = 0.7, wr: float = 0.3, percentile: float = 95, scaling: str = "absolute", need_rocks: bool = True, floor: bool = False) -> DataFrame:
    """Add rock_sc, raw_sc and score (floats). floor: min-max with a floored denominator, and left alone for one positive score."""
    if wv < 0 or wr < 0 or wv + wr == 0 or scaling not in ("absolute", "minmax"):
        raise ValueError("weights must not be negative or both 0, scaling absolute or minmax")
    c = cells.join(rock_cap(cells, percentile, need_rocks), "scene_id")
    c = c.withColumn("rock_sc", F.least(F.col("rock_ct") / F.col("cap"), F.lit(1.0)).cast("float"))
    raw = (F.col("veg_sc").cast("double") * wv + F.col("rock_sc").cast("double") * wr) / (wv + wr)
    c = c.withColumn("raw_sc", F.when(eligible(need_rocks), raw).otherwise(F.lit(0.0)).cast("float"))
    value = F.col("raw_sc").cast("double")
    if scaling == "absolute":
        return c.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).cast("float"))
    positive = F.when(F.col("raw_sc") > 0, value)
    c = c.join(cells_range(c, positive), "scene_id")
    span = F.col("_hi") - F.col("_lo")
    scaled = (value - F.col("_lo")) / (F.greatest(span, F.lit(1e-6)) if floor else span)
    one = F.when(F.col("_n") <= 1, value).otherwise(scaled) if floor else F.when(span > 0, scaled).otherwise(F.lit(1.0))
    return c.withColumn("score", F.when(F.col("raw_sc") > 0, one).otherwise(F.lit(0.0)).cast("float")).drop("_lo", "_hi", "_n")


def cells_range(cells: DataFrame, value: Column) -> DataFrame:
    return cells.groupBy("scene_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))


def rgba(score: str = "score") -> list[Column]:
    """Red to blue to green, transparent at 0."""
    s = F.col(score).cast("double")
    on = s > 0
    low, high = s / 0.5, (s - 0.5) / 0.5
    pick = lambda a, b: F.when(~on, F.lit(0.0)).when(s <= 0.5, a).otherwise(b).cast("int")
    return [pick(F.rint(255 * (1 - low)), F.lit(0.0)).alias("red"), pick(F.lit(0.0), F.rint(255 * high)).alias("green"), pick(F.rint(255 * low), F.rint(255 * (1 - high))).alias("blue"), F.when(on, 255).otherwise(0).alias("alpha")]


def zone(a: float = 0.33, b: float = 0.66, least: float = 0.0, score: str = "score") -> Column:
    """0 for none, 1 to 3 for low, medium, high; the float score is compared with double breaks."""
    if not 0 <= a < b <= 1:
        raise ValueError("breaks must satisfy 0 <= a < b <= 1")
    s = F.col(score).cast("double")
    return F.when(~(s > least), 0).when(s < a, 1).when(s < b, 2).otherwise(3)


LABELS = ("none", "low", "medium", "high")


def zones(cells: DataFrame, a: float = 0.33, b: float = 0.66, least: float = 0.0) -> DataFrame:
    z = cells.withColumn("zone_id", zone(a, b, least))
    return z.withColumn("zone", F.element_at(F.array(*map(F.lit, LABELS)), F.col("zone_id") + 1))


def dissolved(cells: DataFrame, cell_area: float = 1024.0, min_area: float = 0.0) -> DataFrame:
    """Cells, mean score and area of each zone of each scene."""
    d = cells.filter("zone_id > 0").groupBy("scene_id", "zone_id", "zone").agg(F.count(F.lit(1)).alias("cell_count"), F.avg(F.col("score").cast("double")).alias("mean_score"))
    return d.withColumn("area", F.col("cell_count") * cell_area).filter(F.col("area") >= min_area)


def upscaled(cells: DataFrame, factor: int = 2) -> DataFrame:
    """Each cell as factor x factor cells of its score (nearest)."""
    if factor < 1:
        raise ValueError("factor must be positive")
    k = F.sequence(F.lit(0), F.lit(factor - 1))
    up = cells.withColumn("_i", F.explode(k)).withColumn("_j", F.explode(k))
    return up.select("scene_id", (F.col("row") * factor + F.col("_i")).alias("row"), (F.col("col") * factor + F.col("_j")).alias("col"), "score")


def by_colormap(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """Add veg_sc for a single band r: that of the colour of its mean, halves to even, or its share of 255 where the table has none.

    colours: value, red, green, blue; at most one row for each value that the band's type has.
    """
    at = F.broadcast(colours.select(F.col("value").alias("_v"), "red", "green", "blue"))  # 2**16 rows at most
    c = cells.withColumn("_k", F.rint("r").cast("int")).join(at, F.col("_k") == F.col("_v"), "left")
    level = dominant_of(F.col("red"), F.col("green"), F.col("blue"))
    value = F.when(F.col("_v").isNull(), dtype_range(F.col("r"), 0, 255)).otherwise(level)
    return c.withColumn("veg_sc", F.when(F.col("valid_px") > 0, value).otherwise(F.lit(0.0))).drop("_k", "_v", "red", "green", "blue")


def valid_score(score: Column, nodata: float | None = None) -> Column:
    """Null where a score raster has no number: NaN, infinite or its nodata value."""
    ok = ~F.isnan(score - score)
    return F.when(ok if nodata is None else ok & (score != nodata), score)


def zone_ranges(cells: DataFrame, a: float = 0.33, b: float = 0.66, least: float = 0.0) -> DataFrame:
    """For each zone its cells, the least and most of their scores, and the range that it stands for."""
    z = cells.filter("zone_id > 0").groupBy("scene_id", "zone_id").agg(F.min("score").cast("double").alias("least"), F.max("score").cast("double").alias("most"), F.count(F.lit(1)).alias("cell_count"))
    edges = F.array(*map(F.lit, (least, a, b, 1.0)))
    return z.withColumn("score_min", F.element_at(edges, F.col("zone_id"))).withColumn("score_max", F.element_at(edges, F.col("zone_id") + 1))
