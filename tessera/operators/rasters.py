"""Raster operators: colour ramp scores, green shares, interpolated upscaling, painting and connected parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.storage import stored

STEPS = 511


def colour_key(r: Column, g: Column, b: Column) -> list[Column]:
    """Mean colours as whole numbers of 0 to 255, halves to even; a colour of at most 1 in every band counts as a share of 255."""
    scale = F.when(F.greatest(r, g, b) <= 1, F.lit(255.0)).otherwise(F.lit(1.0))
    return [F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(c * scale))).cast("int") for c in (r, g, b)]


def ramp_score(r: Column, g: Column, b: Column) -> Column:
    """Score of the nearest of 511 colours from red over blue to green, in single precision; the first of equals.

    A step moves two channels by one each, so the squared distance along a leg is a parabola: only steps
    around its foot on either leg can be nearest, two more on each side than rounding could ask for.
    """
    k = [c.cast("float") for c in colour_key(r, g, b)]
    one, half, full = (F.lit(x).cast("float") for x in (1.0, 0.5, 255.0))

    def at(i: Column) -> Column:
        s = (i.cast("double") * F.lit(1.0 / (STEPS - 1))).cast("float")
        low, high = (s / half).cast("float"), ((s - half) / half).cast("float")
        zero = F.lit(0.0).cast("float")
        below = i <= (STEPS - 1) // 2
        ramp = (F.when(below, full * (one - low)).otherwise(zero), F.when(below, zero).otherwise(full * high), F.when(below, full * low).otherwise(full * (one - high)))
        d = [x - y for x, y in zip(ramp, k, strict=True)]
        return F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), i.alias("i"), s.alias("s"))

    red, green, blue = (c.cast("int") for c in k)
    feet = [(F.floor((255 - red + blue) / 2), 0, 255), (255 + F.floor((green + 255 - blue) / 2), 256, 510)]
    steps = [F.greatest(F.lit(lo), F.least(F.lit(hi), foot.cast("int") + o)) for foot, lo, hi in feet for o in (-2, -1, 0, 1, 2)]
    return F.array_min(F.transform(F.array(*steps), at))["s"]


def ramp_scored(cells: DataFrame) -> DataFrame:
    """Add veg_sc, worked out once for each distinct colour; 0 without valid pixels."""
    keys = [c.alias(n) for c, n in zip(colour_key(F.col("r"), F.col("g"), F.col("b")), ("_r", "_g", "_b"), strict=True)]
    c = cells.select("*", *keys)
    # a key of (1, 1, 1) or less is a colour already, not a share
    whole = lambda n: F.when(F.greatest("_r", "_g", "_b") <= 1, F.col(n) / F.lit(255.0)).otherwise(F.col(n).cast("double"))
    score = c.select("_r", "_g", "_b").distinct().withColumn("_s", ramp_score(whole("_r"), whole("_g"), whole("_b")))
    c = c.join(score, ["_r", "_g", "_b"])
    return c.withColumn("veg_sc", F.when(F.col("valid_px") > 0, F.col("_s")).otherwise(F.lit(0.0).cast("float"))).drop("_r", "_g", "_b", "_s")


def green_share(boxes: DataFrame, pixels: DataFrame, margin: float = 12.0, pixel: int = 1, width: int = 64, height: int = 64, block: int = 32) -> DataFrame:
    """Add green_ratio: the share of the pixels under a box whose green leads both other bands by the margin.

    Only green pixels are joined; the number of pixels under a box follows from its corners. Boxes and
    pixels meet by raster block. A box with no pixel has ratio 0.
    """
    if margin < 0:
        raise ValueError("margin must not be negative")
    edge = lambda c, f, most: F.greatest(F.lit(0), F.least(F.lit(most), f(F.col(c) / pixel).cast("int")))
    b = boxes.withColumns({"_c0": edge("pixel_xmin", F.floor, width), "_c1": edge("pixel_xmax", F.ceil, width), "_r0": edge("pixel_ymin", F.floor, height), "_r1": edge("pixel_ymax", F.ceil, height)})
    span = lambda lo, hi: F.explode(F.sequence((F.col(lo) / block).cast("int"), ((F.col(hi) - 1) / block).cast("int")))
    whole = (F.col("_c1") > F.col("_c0")) & (F.col("_r1") > F.col("_r0"))
    k = b.filter(whole).select("det_id", "scene_id", "_c0", "_c1", "_r0", "_r1").withColumn("_bx", span("_c0", "_c1")).withColumn("_by", span("_r0", "_r1"))
    g = pixels.filter((F.col("g") >= F.col("r") + margin) & (F.col("g") >= F.col("b") + margin))
    g = g.select("scene_id", "row", "col", (F.col("col") / block).cast("int").alias("_bx"), (F.col("row") / block).cast("int").alias("_by"))
    hit = k.join(g, ["scene_id", "_bx", "_by"]).filter("col >= _c0 and col < _c1 and row >= _r0 and row < _r1")
    n = hit.groupBy("det_id").agg(F.count(F.lit(1)).alias("_n"))
    b = b.join(n, "det_id", "left")
    ratio = F.when(whole, F.coalesce("_n", F.lit(0)) / ((F.col("_c1") - F.col("_c0")) * (F.col("_r1") - F.col("_r0")))).otherwise(F.lit(0.0))
    return b.withColumn("green_ratio", ratio).drop("_c0", "_c1", "_r0", "_r1", "_n")


def without_green(boxes: DataFrame, threshold: float = 0.35, closed: bool = True) -> DataFrame:
    """Drop boxes at or over the threshold (closed), or over it only."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    return boxes.filter(F.col("green_ratio") < threshold if closed else F.col("green_ratio") <= threshold)


def _tap(kind: str, x: float) -> float:
    """Weight of a sample at distance x."""
    x = abs(x)
    if kind == "bilinear":
        return max(0.0, 1 - x)
    if x < 1:
        return 1.5 * x**3 - 2.5 * x**2 + 1
    return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def interpolated(cells: DataFrame, factor: int = 2, kind: str = "bilinear", value: str = "score") -> DataFrame:
    """Upscale by a whole factor. Cells with a null or zero value are missing: weights of the others are
    rescaled, and the targets over a missing cell are left out. Cubic falls back to bilinear where one of
    its sixteen samples is missing. Each cell is sent to the 24 around it once; a target needs no more.
    """
    if factor < 1 or kind not in ("bilinear", "cubic"):
        raise ValueError("factor must be positive, kind bilinear or cubic")
    near = range(-2, 3)
    have = cells.filter(F.col(value) > 0).select("scene_id", "row", "col", F.col(value).cast("double").alias("v"))
    # key of a neighbour as its receiver sees it
    out = F.explode(F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(f"{i},{j}").alias("at")) for i in near for j in near]))
    sent = have.withColumn("_o", out).select("scene_id", (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), "_o.at", "v")
    got = sent.groupBy("scene_id", "row", "col").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m")).filter(F.map_contains_key("m", F.lit("0,0")))

    def mean(i: int, j: int, how: str) -> Column:
        u, v = (i + 0.5) / factor - 0.5, (j + 0.5) / factor - 0.5
        taps = [(f"{a},{b}", _tap(how, u - a) * _tap(how, v - b)) for a in near for b in near]
        taps = [(k, w) for k, w in taps if w != 0]
        lit = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in taps])
        known = F.filter(lit, lambda t: F.map_contains_key("m", t["k"]))
        total = lambda f: F.aggregate(known, F.lit(0.0), f)
        result = total(lambda n, t: n + t["w"] * F.try_element_at("m", t["k"])) / total(lambda n, t: n + t["w"])
        return F.when(F.size(known) == len(taps), result).otherwise(mean(i, j, "bilinear")) if how == "cubic" else result

    ks = range(factor)
    fine = F.explode(F.array(*[F.struct((F.col("row") * factor + i).alias("row"), (F.col("col") * factor + j).alias("col"), mean(i, j, kind).cast("float").alias(value)) for i in ks for j in ks]))
    return got.select("scene_id", fine.alias("t")).select("scene_id", "t.*")


def painted(cells: DataFrame, bh: int = 2, bw: int = 2, width: int = 64, height: int = 64) -> DataFrame:
    """Each pixel with the score of its cell; edge cells may be partial."""
    span = lambda c, n, most: F.explode(F.sequence(F.col(c) * n, F.least(F.col(c) * n + (n - 1), F.lit(most - 1))))
    return cells.select("scene_id", "col", "score", span("row", bh, height).alias("_r")).select("scene_id", F.col("_r").alias("row"), span("col", bw, width).alias("col"), "score")


def burned(boxes: DataFrame, pixel: int, order: str, value: str, width: int = 64, height: int = 64) -> DataFrame:
    """Pixels that boxes touch, borders included, with the value of the box that is last in order."""
    span = lambda lo, hi, most: F.explode(F.sequence(F.greatest(F.lit(0), (F.ceil(F.col(lo) / pixel) - 1).cast("int")), F.least(F.lit(most - 1), F.floor(F.col(hi) / pixel).cast("int"))))
    t = boxes.withColumn("col", span("pixel_xmin", "pixel_xmax", width)).withColumn("row", span("pixel_ymin", "pixel_ymax", height))
    return t.groupBy("scene_id", "row", "col").agg(F.max_by(value, order).alias(value))


def parts(cells: DataFrame, by: str = "zone_id", diagonal: bool = False) -> DataFrame:
    """Add part: the smallest cell_id among the like cells of its scene that a cell reaches over shared sides
    (diagonal: corners too). Rows without a positive value go.

    Labels pass along links and are then looked up in one another (pointer jumping), so that rounds grow
    with the logarithm of a part's width rather than the width.
    """
    own = stored(cells.filter(F.col(by) > 0), "parts-cells")
    at = own.select("scene_id", "row", "col", F.col(by).alias("_z"), "cell_id")
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
    aside = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    far = at.withColumn("_o", aside).select("scene_id", (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), "_z", F.col("cell_id").alias("a"))
    one = far.join(at, ["scene_id", "row", "col", "_z"]).select("scene_id", "a", F.col("cell_id").alias("b"))
    links = stored(one.union(one.select("scene_id", F.col("b"), F.col("a"))), "parts-links")
    label = own.select("scene_id", "cell_id", F.col("cell_id").alias("part"))
    while True:
        seen = links.join(label.withColumnRenamed("cell_id", "b"), ["scene_id", "b"]).select("scene_id", F.col("a").alias("cell_id"), "part")
        least = label.select("scene_id", "cell_id", "part", F.col("part").alias("old")).union(seen.withColumn("old", F.lit(None).cast(label.schema["part"].dataType)))
        least = least.groupBy("scene_id", "cell_id").agg(F.min("part").alias("part"), F.max("old").alias("old"))
        # what was the label of a cell takes over that cell's least neighbour, then the label of the label
        pull = least.groupBy("scene_id", "old").agg(F.min("part").alias("pulled")).withColumnRenamed("old", "cell_id")
        least = least.join(pull, ["scene_id", "cell_id"], "left").select("scene_id", "cell_id", F.least("part", F.coalesce("pulled", "part")).alias("part"), "old")
        least = stored(least, "parts-least")
        jump = least.select("scene_id", F.col("cell_id").alias("part"), F.col("part").alias("_next"))
        step = stored(least.join(jump, ["scene_id", "part"], "left").select("scene_id", "cell_id", F.least("part", F.coalesce("_next", "part")).alias("part"), "old"), "parts-labels")
        label = step.drop("old")
        if step.filter("part <> old").isEmpty():
            return own.join(label, ["scene_id", "cell_id"])


def part_table(cells: DataFrame, cell_area: float = 1024.0, min_area: float = 0.0) -> DataFrame:
    """One row for each connected part of a zone: cells, mean score, area, extent and zone_uid, numbered
    within its scene by zone and part."""
    p = cells.groupBy("scene_id", "zone_id", "part").agg(F.count(F.lit(1)).alias("cell_count"), F.avg(F.col("score").cast("double")).alias("mean_score"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
    p = p.withColumn("area", F.col("cell_count") * cell_area).filter(F.col("area") >= min_area)
    return p.withColumn("zone_uid", F.row_number().over(W.partitionBy("scene_id").orderBy("zone_id", "part")))


def border(cells: DataFrame, keys: tuple[str, ...] = ("scene_id", "zone_id", "part")) -> DataFrame:
    """Unit border edges of parts, (x0, y0) to (x1, y1), with the part on the right hand (y down)."""
    sides = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    side = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, "abcd", strict=True)]) for s in sides]))
    e = cells.select(*keys, "row", "col", side.alias("s")).select(*keys, *[(F.col(c) + F.col(f"s.{k}")).alias(n) for c, k, n in (("col", "a", "x0"), ("row", "b", "y0"), ("col", "c", "x1"), ("row", "d", "y1"))])
    # an edge inside a part occurs once each way
    ends = [f(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))]).alias(n) for f, n in ((F.least, "_p"), (F.greatest, "_q"))]
    e = e.select("*", *ends).groupBy(*keys, "_p", "_q").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return e.filter("_n = 1").select(*keys, "x0", "y0", "x1", "y1")


def polygons(cells: DataFrame) -> DataFrame:
    """Each part as WKT, its outer ring first, then holes, in cell units. One part's border is held at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    keys = ("scene_id", "zone_id", "part")
    return border(cells).groupBy(*keys).applyInPandas(_traced, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", wkt string")


def _traced(key, edges):
    import pandas as pd

    after: dict = {}
    for x0, y0, x1, y1 in edges[["x0", "y0", "x1", "y1"]].itertuples(index=False):
        after.setdefault((x0, y0), []).append((x1, y1))
    rings = []
    while after:
        start = at = min(after)
        ring, way = [start], None
        while True:
            ends = after[at]
            # where two corners touch, turn to the right: the part's sides, not its corners, hold it together
            ends.sort(key=lambda e: 0 if way is None else -(way[0] * (e[1] - at[1]) - way[1] * (e[0] - at[0])))
            to = ends.pop(0)
            if not ends:
                del after[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step == way:
                ring.pop()
            ring.append(to)
            way, at = step, to
            if at == start:
                break
        rings.append(ring)
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)))
    rings.sort(key=area, reverse=True)
    text = ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings)
    return pd.DataFrame([[*key, f"POLYGON ({text})"]], columns=["scene_id", "zone_id", "part", "wkt"])
