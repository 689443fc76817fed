"""Detections: tiling, decoding, sizes, filters and suppression of overlapping boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.storage import stored

BOX = ("pixel_xmin", "pixel_ymin", "pixel_xmax", "pixel_ymax")


def tile_windows(sizes: DataFrame, tile: int = 512, overlap: int = 128, shifted: bool = True) -> DataFrame:
    """Windows of (scene_id, width, height). shifted: edge tiles move inward and stay whole, repeats go; else they are cut."""
    if tile <= 0 or not 0 <= overlap < tile:
        raise ValueError("tile must be positive and overlap in [0, tile)")
    step = F.lit(tile - overlap)
    w = sizes.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, step))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, step)))
    if shifted:
        w = w.withColumn("_x", F.least("_x", F.greatest(F.lit(0), F.col("width") - tile))).withColumn("_y", F.least("_y", F.greatest(F.lit(0), F.col("height") - tile)))
    w = w.select("scene_id", F.col("_x").alias("col_off"), F.col("_y").alias("row_off"), F.least(F.lit(tile), F.col("width") - F.col("_x")).alias("width"), F.least(F.lit(tile), F.col("height") - F.col("_y")).alias("height"))
    return w.dropDuplicates() if shifted else w


def tile_count(width: Column, height: Column, tile: int = 512, overlap: int = 128, most: int | None = None) -> Column:
    """Windows that ``tile_windows`` makes before repeats go, ``most`` of them where that is set."""
    step = max(1, tile - overlap)
    n = F.ceil(width / step) * F.ceil(height / step)
    return n if most is None else F.least(n, F.lit(most))


def clamp_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Clamp to the image and drop boxes without area."""
    for axis, most in (("x", width), ("y", height)):
        for end in ("min", "max"):
            c = f"pixel_{axis}{end}"
            boxes = boxes.withColumn(c, F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most))))
    return boxes.filter("pixel_xmax > pixel_xmin and pixel_ymax > pixel_ymin")


def shifted(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Boxes of a tile (col_off, row_off, tile_width, tile_height) cut at its edges, then moved to the image's place.

    Boxes without area there go; a missing confidence is 0.
    """
    for axis, off, side in (("x", "col_off", "tile_width"), ("y", "row_off", "tile_height")):
        for end in ("min", "max"):
            c = f"pixel_{axis}{end}"
            boxes = boxes.withColumn(c, F.col(off) + F.greatest(F.lit(0.0), F.least(F.col(side).cast("double"), F.col(c))))
    whole = boxes.filter("pixel_xmax > pixel_xmin and pixel_ymax > pixel_ymin")
    return confident(whole.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), least)


def with_area(boxes: DataFrame, edges: tuple[str, ...] = BOX) -> DataFrame:
    """Without boxes that lack an edge or have no area."""
    return boxes.dropna(subset=list(edges)).filter((F.col(edges[2]) > F.col(edges[0])) & (F.col(edges[3]) > F.col(edges[1])))


def confident(boxes: DataFrame, least: float = 0.25) -> DataFrame:
    return boxes.filter(F.col("confidence") >= least)


def of_classes(boxes: DataFrame, names: list[str]) -> DataFrame:
    return boxes.filter(F.lower("class_name").isin([n.lower() for n in names]))


def georeference(boxes: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, corners: int = 4) -> DataFrame:
    """Map envelope of pixel boxes under x' = a x + b y + c, y' = d x + e y + f, from four corners or two opposite ones."""
    x0, y0, x1, y1 = map(F.col, BOX)
    points = [(x0, y0), (x1, y1)] + ([(x1, y0), (x0, y1)] if corners == 4 else [])
    xs, ys = [x * a + y * b + c for x, y in points], [x * d + y * e + f for x, y in points]
    return boxes.withColumns({"map_xmin": F.least(*xs), "map_ymin": F.least(*ys), "map_xmax": F.greatest(*xs), "map_ymax": F.greatest(*ys)})


def labels(bins: list[float]) -> list[str]:
    g = [f"{x:g}" for x in (0, *bins)]
    return [f"{p}-{q}" for p, q in zip(g, g[1:], strict=False)] + [f">{g[-1]}"]


METRICS = ("max_side_cm", "min_side_cm", "width_cm", "height_cm", "area_cm2")


def sized(boxes: DataFrame, cm_x: float, cm_y: float, bins: list[float], metric: str = "max_side_cm") -> DataFrame:
    """Add sizes in pixels and centimetres, and the half-open class of the metric."""
    if metric not in METRICS or not bins or any(x <= 0 for x in bins) or sorted(set(bins)) != list(bins):
        raise ValueError("unknown metric, or bins that are not positive and ascending")
    s = boxes.withColumns({"width_px": F.col("pixel_xmax") - F.col("pixel_xmin"), "height_px": F.col("pixel_ymax") - F.col("pixel_ymin")})
    s = s.withColumns({"width_cm": F.col("width_px") * cm_x, "height_cm": F.col("height_px") * cm_y})
    s = s.withColumn("area_cm2", F.col("width_cm") * F.col("height_cm"))
    value = {"max_side_cm": F.greatest("width_cm", "height_cm"), "min_side_cm": F.least("width_cm", "height_cm")}.get(metric, F.col(metric if metric in s.columns else "area_cm2"))
    s, names = s.withColumn("size_value", value), labels(bins)
    chain = F.when(F.col("size_value") < bins[0], names[0])
    for edge, name in zip(bins[1:], names[1:], strict=False):
        chain = chain.when(F.col("size_value") < edge, name)
    return s.withColumn("size_class", chain.otherwise(names[-1]))


def size_counts(boxes: DataFrame, bins: list[float], scenes: DataFrame | None = None) -> DataFrame:
    """Rows by scene and class, with zeros for classes that a scene lacks; scenes without boxes count if they are given."""
    every = (boxes if scenes is None else scenes).select("scene_id").distinct().withColumn("size_class", F.explode(F.array(*map(F.lit, labels(bins)))))
    n = boxes.groupBy("scene_id", "size_class").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["scene_id", "size_class"], "left").select("scene_id", "size_class", F.coalesce("n", F.lit(0)).alias("n"))


def iou(a: str, b: str) -> Column:
    col = lambda t, c: F.col(f"{t}.{c}")
    w = F.least(col(a, BOX[2]), col(b, BOX[2])) - F.greatest(col(a, BOX[0]), col(b, BOX[0]))
    h = F.least(col(a, BOX[3]), col(b, BOX[3])) - F.greatest(col(a, BOX[1]), col(b, BOX[1]))
    area = lambda t: (col(t, BOX[2]) - col(t, BOX[0])) * (col(t, BOX[3]) - col(t, BOX[1]))
    inter = w * h
    return F.when((w > 0) & (h > 0), inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


def conflicts(boxes: DataFrame, threshold: float, by_class: bool = True, closed: bool = True, cell: int = 256) -> DataFrame:
    """(hi, lo) pairs of det_id where the first suppresses the second. Boxes meet in grid cells; a pair counts in one of them only."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    g = boxes.withColumn("_gx", span(BOX[0], BOX[2])).withColumn("_gy", span(BOX[1], BOX[3]))
    a, b = g.alias("a"), g.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["scene_id", "_gx", "_gy", *["class_name"] * by_class]]
    first = (F.col("a.confidence") > F.col("b.confidence")) | (F.col("a.confidence") == F.col("b.confidence")) & (F.col("a.det_id") < F.col("b.det_id"))
    home = [F.floor(F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}")) / cell) == F.col(f"a.{k}") for c, k in ((BOX[0], "_gx"), (BOX[1], "_gy"))]
    overlap = iou("a", "b") >= threshold if closed else iou("a", "b") > threshold
    for c in (*on[1:], first, *home, overlap):
        on[0] = on[0] & c
    return a.join(b, on[0]).select(F.col("a.det_id").alias("hi"), F.col("b.det_id").alias("lo"))


def nms(boxes: DataFrame, threshold: float = 0.35, by_class: bool = True, closed: bool = True) -> DataFrame:
    """Greedy suppression by confidence, then det_id, as rounds: a box whose rivals are all out stays, and those it suppresses go.

    Same result as the sequential loop; the number of rounds is the longest chain of rivals.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    edges = stored(conflicts(boxes, threshold, by_class, closed), "nms-edges")
    out = None
    while not edges.isEmpty():
        kept = edges.select(F.col("hi").alias("k")).distinct().join(edges.select(F.col("lo").alias("k")).distinct(), "k", "left_anti")
        gone = edges.join(kept, edges["hi"] == kept["k"], "left_semi").select(F.col("lo").alias("g")).distinct()
        gone = stored(gone, "nms-gone")
        out = gone if out is None else out.union(gone)
        edges = stored(edges.join(gone, edges["lo"] == gone["g"], "left_anti").join(gone, F.col("hi") == gone["g"], "left_anti"), "nms-edges")
    return boxes if out is None else boxes.join(out, boxes["det_id"] == out["g"], "left_anti")


def summary(boxes: DataFrame) -> DataFrame:
    """Counts and the bounding box by scene."""
    w = boxes.groupBy("scene_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_name") == "rock").alias("n_rock"), F.min(BOX[0]).alias("xmin"), F.min(BOX[1]).alias("ymin"), F.max(BOX[2]).alias("xmax"), F.max(BOX[3]).alias("ymax"))


def numbered(boxes: DataFrame) -> DataFrame:
    """Detection numbers in the order of confidence, from 1, by scene."""
    return boxes.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy(F.desc("confidence"), "det_id")))


def points_hit(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """scene_id, point_id, det_id and size_class of the boxes within each point's radius."""
    near = points.withColumn("_gx", F.explode(F.sequence(F.floor((F.col("x") - F.col("radius")) / cell), F.floor((F.col("x") + F.col("radius")) / cell))))
    near = near.withColumn("_gy", F.explode(F.sequence(F.floor((F.col("y") - F.col("radius")) / cell), F.floor((F.col("y") + F.col("radius")) / cell))))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    g = boxes.withColumn("_gx", span(BOX[0], BOX[2])).withColumn("_gy", span(BOX[1], BOX[3]))
    dx = F.greatest(F.col(BOX[0]) - F.col("x"), F.lit(0.0), F.col("x") - F.col(BOX[2]))
    dy = F.greatest(F.col(BOX[1]) - F.col("y"), F.lit(0.0), F.col("y") - F.col(BOX[3]))
    return near.join(g, ["scene_id", "_gx", "_gy"]).filter(dx * dx + dy * dy <= F.col("radius") * F.col("radius")).select("scene_id", "point_id", "det_id", "size_class").dropDuplicates(["scene_id", "point_id", "det_id"])


def point_sizes(points: DataFrame, boxes: DataFrame, labels: list[str], cell: int = 256) -> DataFrame:
    """scene_id, point_id, x, y, n, sizes (a map of every label to its count) and status: OK, EMPTY, or NO_DATA where the scene has no boxes."""
    hit = points_hit(points, boxes, cell)
    n = hit.groupBy("scene_id", "point_id").agg(*[F.count_if(F.col("size_class") == x).alias(f"_{i}") for i, x in enumerate(labels)], F.count(F.lit(1)).alias("n"))
    some = boxes.select("scene_id").distinct().withColumn("_some", F.lit(True))
    out = points.join(n, ["scene_id", "point_id"], "left").join(some, "scene_id", "left")
    sizes = F.create_map(*[c for i, x in enumerate(labels) for c in (F.lit(x), F.coalesce(f"_{i}", F.lit(0)))])
    status = F.when(F.col("_some").isNull(), "NO_DATA").when(F.col("n") > 0, "OK").otherwise("EMPTY")
    return out.select("scene_id", "point_id", "x", "y", F.coalesce("n", F.lit(0)).alias("n"), sizes.alias("sizes"), status.alias("status"))


def special_points(points: DataFrame, boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Boxes within each point's radius (distance to the box) and their classes. points: point_id, scene_id, x, y, radius."""
    hit = points_hit(points, boxes, cell)
    n = hit.groupBy("scene_id", "point_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("size_class")), ",").alias("classes"))
    out = points.select("scene_id", "point_id").join(n, ["scene_id", "point_id"], "left")
    return out.select("scene_id", "point_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("classes", F.lit("")).alias("classes"), F.when(F.col("n") > 0, "OK").otherwise("EMPTY").alias("status"))
