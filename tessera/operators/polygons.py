"""Polygons as rings (arrays of points x, y without the first repeated): area, centre, clipping, union and difference.

Area, centre, the test of a point and clipping by boxes are column expressions. Union and difference cut
all rings by a grid first, so that a task holds some neighbouring grid squares, and give trapezoids; array
operations go over all squares of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.detections import BOX

RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(box: tuple[str, str, str, str] = BOX) -> Column:
    x0, y0, x1, y1 = map(F.col, box)
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def _sides(ring: Column, f) -> Column:
    """f(point, next point) of every side."""
    return F.transform(ring, lambda p, i: f(p, F.get(ring, (i + 1) % F.size(ring))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def signed_area(ring: Column) -> Column:
    """Positive where the points run counter-clockwise with y up; 0 below three points."""
    return F.when(F.size(ring) >= 3, _total(_sides(ring, _cross)) / 2).otherwise(F.lit(0.0))


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Centre of mass; the mean of the points where the area is 0."""
    a = signed_area(ring)
    weighed = lambda c: _total(_sides(ring, lambda p, q: (p[c] + q[c]) * _cross(p, q))) / (6 * a)
    mean = lambda c: _total(F.transform(ring, lambda p: p[c])) / F.size(ring)
    return F.when(a != 0, point(weighed("x"), weighed("y"))).otherwise(point(mean("x"), mean("y")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the sides that a ray to the right crosses."""
    def crossed(p, q):
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(_sides(ring, crossed), F.lit(0), lambda a, v: a + v) % 2 == 1


def present(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """Without rows whose ring is null, holds a null or has no point."""
    whole = ~F.exists(ring, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    return shapes.filter(F.col(ring).isNotNull() & (F.size(ring) > 0) & whole)


def bounds(ring: str = "ring") -> list[Column]:
    side = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return [side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")]


def clipped(shapes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, ring: str = "ring", whole: Column | None = None) -> DataFrame:
    """Rings cut to a box, one half plane after another; rows without anything left go. whole: of rows that are known to lie in the box."""
    whole = F.lit(False) if whole is None else whole

    def half(axis: str, bound: Column, sign: int) -> Column:
        depth = lambda p: (p[axis] - bound) * sign

        def kept(p, q):
            t = depth(p) / (depth(p) - depth(q))
            along = lambda c: bound if c == axis else p[c] + t * (q[c] - p[c])
            none = F.array().cast(RING)
            return F.concat(F.when(depth(p) >= 0, F.array(p)).otherwise(none), F.when((depth(p) >= 0) != (depth(q) >= 0), F.array(point(along("x"), along("y")))).otherwise(none))

        return F.flatten(_sides(F.col(ring), kept))

    columns = [c for c in shapes.columns if c != ring]
    for axis, bound, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        # a generator, so that the optimizer does not copy a cut into the next, once for each use
        left = F.filter(F.array(F.when(whole, F.col(ring)).otherwise(half(axis, bound, sign))), lambda r: F.size(r) >= 3)
        shapes = shapes.select(*columns, F.explode(left).alias(ring))
    return shapes


def by_square(shapes: DataFrame, size: float, ring: str = "ring") -> DataFrame:
    """Each ring cut by the squares (gx, gy) of a grid that it reaches."""
    x0, y0, x1, y1 = bounds(ring)
    s = shapes.withColumns({"_a": F.floor(x0 / size), "_b": F.floor(x1 / size), "_c": F.floor(y0 / size), "_d": F.floor(y1 / size)})
    s = s.withColumn("_one", (F.col("_a") == F.col("_b")) & (F.col("_c") == F.col("_d")))
    s = s.withColumn("gx", F.explode(F.sequence("_a", "_b"))).withColumn("gy", F.explode(F.sequence("_c", "_d"))).drop("_a", "_b", "_c", "_d")
    return clipped(s, F.col("gx") * size, F.col("gy") * size, (F.col("gx") + 1) * size, (F.col("gy") + 1) * size, ring, F.col("_one")).drop("_one")


def covered_cells(shapes: DataFrame, size: float, columns: int) -> DataFrame:
    """Area by which rings cover each cell, summed: scene_id, cell_id, covered."""
    c = by_square(present(shapes), size).withColumn("_area", area(F.col("ring"))).filter("_area > 0")
    return c.groupBy("scene_id", (F.col("gy") * columns + F.col("gx")).cast("int").alias("cell_id")).agg(F.sum("_area").alias("covered"))


def zonal(shapes: DataFrame, pixels: DataFrame, pixel: float) -> DataFrame:
    """Valid pixels whose centre lies in each ring, and the means of their bands; (0, 0) for a ring without any. shapes: scene_id, shape_id, ring."""
    x0, y0, x1, y1 = bounds()
    first, last = lambda v: F.ceil(v / pixel - 0.5).cast("int"), lambda v: F.floor(v / pixel - 0.5).cast("int")
    s = present(shapes).withColumns({"_a": first(x0), "_b": last(x1), "_c": first(y0), "_d": last(y1)})
    near = s.filter("_a <= _b and _c <= _d").withColumn("col", F.explode(F.sequence("_a", "_b"))).withColumn("row", F.explode(F.sequence("_c", "_d")))
    near = near.filter(contains(F.col("ring"), (F.col("col") + 0.5) * pixel, (F.col("row") + 0.5) * pixel)).select("scene_id", "shape_id", "row", "col")
    n = near.join(pixels.filter("valid"), ["scene_id", "row", "col"]).groupBy("scene_id", "shape_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"]
    return shapes.select("scene_id", "shape_id").join(n, ["scene_id", "shape_id"], "left").select("scene_id", "shape_id", F.coalesce("n", F.lit(0)).alias("n"), *zero)


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] times, i itself and the numbers from first[i] on."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(count) - count), count)


def _shares(weight: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbours that weigh about PAIRS together, of one at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weight) // PAIRS)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(weight)], strict=True))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _next(size: np.ndarray) -> np.ndarray:
    """The place of each corner's successor, for rings of these sizes one after another."""
    end = np.cumsum(size)
    after = np.arange(1, int(size.sum()) + 1)
    after[end[size > 0] - 1] = (end - size)[size > 0]
    return after


def stacks(x: np.ndarray, y: np.ndarray, size: np.ndarray, sign: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the points in any of its rings of sign 1 and none of sign -1, as rows (xa, xb, low at xa, low at xb, high at xa,
    high at xb), and the rows' groups. x, y: corners of the rings, one ring after another; size, sign, group: of each ring, groups ascending.

    Between neighbouring x of corners and crossings no sides cross, so each strip is a stack of trapezoids. All groups share the
    array operations, which take some PAIRS of sides, or of sides and strips, at a time.
    """
    after, owner = _next(size), np.repeat(np.arange(len(size)), size)
    upright = x == x[after]
    right = (x < x[after])[~upright]
    ends = [v[~upright] for v in (x, y, x[after], y[after])]
    x0, y0, x1, y1 = (np.where(right, ends[i], ends[(i + 2) % 4]) for i in range(4))
    owner = owner[~upright]
    if not len(owner):
        return np.empty((0, 6)), np.empty(0, np.int64)
    of, n = group[owner], len(owner)
    slope = (y1 - y0) / (x1 - x0)
    level = y0 - slope * x0
    head = np.flatnonzero(_begins(of))
    many = np.diff(np.append(head, n))
    # crossings of a side with those after it in its group, if not all there are parallel
    bent = np.minimum.reduceat(slope, head) != np.maximum.reduceat(slope, head)
    rest = np.repeat((head + many) * bent, many) - (np.arange(n) + 1) * np.repeat(bent, many)
    xs, gs = [x0, x1], [of, of]
    for lo, hi in _shares(rest):
        i, j = _runs(np.arange(lo, hi) + 1, rest[lo:hi])
        i += lo
        turn = slope[i] - slope[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (level[j] - level[i]) / turn
        ok = (turn != 0) & (at > np.maximum(x0[i], x0[j])) & (at < np.minimum(x1[i], x1[j]))
        xs.append(at[ok])
        gs.append(of[i[ok]])
    cut, cut_of = np.concatenate(xs), np.concatenate(gs)
    order = np.lexsort((cut, cut_of))
    new = _begins(cut[order], cut_of[order])
    place = np.empty(len(cut), np.int64)
    place[order] = np.cumsum(new) - 1
    cut, cut_of = cut[order][new], cut_of[order][new]
    # a side spans the strips from its left end's place to its right end's
    begin, end = place[:n], place[n : 2 * n]
    live = np.cumsum(np.bincount(begin, minlength=len(cut)) - np.bincount(end, minlength=len(cut)))
    out, out_of = [], []
    for lo, hi in _shares(live):
        here = np.flatnonzero((begin < hi) & (end > lo))
        k, strip = _runs(np.maximum(begin[here], lo), np.minimum(end[here], hi) - np.maximum(begin[here], lo))
        k = here[k]
        order = np.lexsort((slope[k] * ((cut[strip] + cut[strip + 1]) / 2) + level[k], strip))
        k, strip = k[order], strip[order]
        # of a ring's sides in a strip, from low to high, every second ends what the one before began
        order = np.lexsort((owner[k], strip))
        first = _begins(owner[k][order], strip[order])
        nth = np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        step = np.empty(len(k), np.int64)
        step[order] = 1 - 2 * (nth % 2)
        s = sign[owner[k]]
        open_ = (np.cumsum(step * (s > 0)) > 0) & (np.cumsum(step * (s < 0)) == 0)
        was = np.append(False, open_[:-1])
        low, high, strip = k[open_ & ~was], k[was & ~open_], strip[open_ & ~was]
        a, b = cut[strip], cut[strip + 1]
        p = np.stack([a, b, *[slope[e] * at + level[e] for e in (low, high) for at in (a, b)]], axis=1)
        full = p[:, 4] + p[:, 5] > p[:, 2] + p[:, 3]
        out.append(p[full])
        out_of.append(cut_of[strip[full]])
    return np.concatenate(out), np.concatenate(out_of)


def trapezoids(plus: list[np.ndarray], minus: list[np.ndarray]) -> list[tuple[float, ...]]:
    """The points in any ring of plus and none of minus, as (xa, xb, low at xa, low at xb, high at xa, high at xb)."""
    rings = [np.asarray(r, float).reshape(-1, 2) for r in (*plus, *minus)]
    x, y = np.concatenate([*rings, np.empty((0, 2))]).T
    sign = np.repeat([1, -1], [len(plus), len(minus)])
    return [tuple(p) for p in stacks(x, y, np.array([len(r) for r in rings], np.int64), sign, np.zeros(len(rings), np.int64))[0].tolist()]


def halved(v: list[np.ndarray], size: np.ndarray, axis: int, bound: np.ndarray, sign: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rings (corners v = [x, y] one ring after another, and their numbers) cut by a half plane each; as ``clipped``, but rings may end up empty."""
    after = _next(size)
    depth = (v[axis] - np.repeat(bound, size)) * sign
    keep = depth >= 0
    cross = keep != keep[after]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = depth / (depth - depth[after])
        along = [np.repeat(bound, size) if c == axis else v[c] + t * (v[c][after] - v[c]) for c in (0, 1)]
    made = keep.astype(np.int64) + cross
    at = np.cumsum(made) - made
    out = []
    for c in (0, 1):
        w = np.empty(int(made.sum()))
        w[at[keep]] = v[c][keep]
        w[(at + keep)[cross]] = along[c][cross]
        out.append(w)
    owner = np.repeat(np.arange(len(size)), size)
    size = np.bincount(owner, made, len(size)).astype(np.int64)
    kept = size >= 3
    part = np.repeat(kept, size)
    return [w[part] for w in out], np.where(kept, size, 0)


def in_squares(x: np.ndarray, y: np.ndarray, size: np.ndarray, gx: np.ndarray, gy: np.ndarray, side: float) -> tuple:
    """Rings of larger squares (gx, gy), EACH squares long, cut by the squares they reach there: corners x, y, and for each part
    its size, its ring and its square's number in the larger one."""
    head = np.cumsum(size) - size
    spans = []
    for v, g in ((x, gx * EACH), (y, gy * EACH)):
        ends = [np.floor(f.reduceat(v, head) / side).astype(np.int64) for f in (np.minimum, np.maximum)]
        spans.append([np.clip(e, g, g + EACH - 1) for e in ends])
    (a, b), (c, d) = spans
    ring, i = _runs(np.zeros(len(size), np.int64), (b - a + 1) * (d - c + 1))
    sx, sy = a[ring] + i // (d - c + 1)[ring], c[ring] + i % (d - c + 1)[ring]
    corner = _runs(head[ring], size[ring])[1]
    v, n = [x[corner], y[corner]], size[ring]
    for axis, bound, sign in ((0, sx, 1), (0, sx + 1, -1), (1, sy, 1), (1, sy + 1, -1)):
        v, n = halved(v, n, axis, bound * side, sign)
    return *v, n, ring, (sx - gx[ring] * EACH) * EACH + sy - gy[ring] * EACH


PIECE = ("xa", "xb", "low_a", "low_b", "high_a", "high_b")
# Squares along an edge of what a task takes as a whole, and pairs that array operations take at once.
EACH, PAIRS = 8, 1 << 20


def _overlaid(plus: DataFrame, minus: DataFrame | None, size: float, found, schema: str) -> DataFrame:
    """found(pieces, places, scenes, squares' x, squares' y) as a batch, for whole squares; places say which scene and square a piece has."""
    cut = lambda s, sign: by_square(present(s.select(F.col("scene_id").cast("long"), "ring")), size * EACH).withColumn("sign", F.lit(sign))
    both = cut(plus, 1) if minus is None else cut(plus, 1).unionByName(cut(minus, -1))
    both = both.repartition("scene_id", "gx", "gy").sortWithinPartitions("scene_id", "gx", "gy")

    def overlaid(rows: pa.Table):
        rows = rows.combine_chunks()
        rings = rows.column("ring").combine_chunks()
        rings = rings if isinstance(rings, pa.ListArray) else rings.chunk(0)
        corners, n = rings.flatten(), np.diff(rings.offsets.to_numpy())
        x, y = (corners.field(c).to_numpy(zero_copy_only=False) for c in "xy")
        gx, gy, sign = (rows.column(c).to_numpy() for c in ("gx", "gy", "sign"))
        block = np.cumsum(_starts(rows)) - 1
        x, y, n, ring, square = in_squares(x, y, n, gx, gy, size)
        group = block[ring] * EACH**2 + square
        order = np.argsort(group, kind="stable")
        corner = _runs((np.cumsum(n) - n)[order], n[order])[1]
        pieces, of = stacks(x[corner], y[corner], n[order], sign[ring[order]], group[order])
        first = np.flatnonzero(_starts(rows))
        at, square = first[of // EACH**2], of % EACH**2
        return found(pieces, of, rows.column("scene_id").take(pa.array(at)), gx[at] * EACH + square // EACH, gy[at] * EACH + square % EACH)

    def run(batches):
        held = []
        for b in batches:
            t = pa.Table.from_batches([b])
            if held and t.num_rows:
                t = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t])
                starts = np.flatnonzero(_starts(t)[1:])
                t = t.slice(1)
            else:
                starts = np.flatnonzero(_starts(t)[1:]) + 1
            if len(starts):  # rows of the last block wait for the next batch
                yield overlaid(pa.concat_tables([*held, t.slice(0, starts[-1])]))
                held, t = [], t.slice(starts[-1])
            if t.num_rows:
                held.append(t)
        if held:
            yield overlaid(pa.concat_tables(held))

    return both.mapInArrow(run, schema)


def _starts(rows: pa.Table) -> np.ndarray:
    """Whether scene or larger square differ from the row before; a null scene is one of its own."""
    s = rows.column("scene_id")
    return _begins(s.is_null().to_numpy(), s.fill_null(0).to_numpy(), rows.column("gx").to_numpy(), rows.column("gy").to_numpy())


def overlay(plus: DataFrame, minus: DataFrame | None = None, size: float = 64.0) -> DataFrame:
    """Trapezoids (scene_id, xa, xb, low and high edges at both) of the union of plus without minus. Both: scene_id, ring."""
    def found(pieces, _of, scene, _gx, _gy):
        return pa.RecordBatch.from_arrays([scene.combine_chunks(), *[pa.array(c) for c in pieces.T]], names=["scene_id", *PIECE])

    return _overlaid(plus, minus, size, found, "scene_id long, " + ", ".join(f"{c} double" for c in PIECE))


def overlay_area(plus: DataFrame, minus: DataFrame | None = None, size: float = 64.0) -> DataFrame:
    """The area of ``overlay`` in each square (gx, gy) of the grid, without those of none: scene_id, gx, gy, area."""
    def found(pieces, of, scene, gx, gy):
        first = np.flatnonzero(_begins(of)) if len(of) else np.empty(0, np.int64)
        xa, xb, la, lb, ha, hb = pieces.T
        area = np.add.reduceat((xb - xa) * (ha - la + hb - lb) / 2, first) if len(of) else np.empty(0)
        return pa.RecordBatch.from_arrays([scene.take(pa.array(first)).combine_chunks(), pa.array(gx[first]), pa.array(gy[first]), pa.array(area)], names=["scene_id", "gx", "gy", "area"])

    return _overlaid(plus, minus, size, found, "scene_id long, gx long, gy long, area double")


def piece_area() -> Column:
    return (F.col("xb") - F.col("xa")) * (F.col("high_a") - F.col("low_a") + F.col("high_b") - F.col("low_b")) / 2


def piece_ring() -> Column:
    c = F.col
    return F.array(point(c("xa"), c("low_a")), point(c("xb"), c("low_b")), point(c("xb"), c("high_b")), point(c("xa"), c("high_a")))


def wkt(ring: Column) -> Column:
    text = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), text), ", "), F.lit("))"))


def simplified(ring: Column, tolerance: float) -> Column:
    """Without corners that lie within the tolerance of the line between their neighbours; every second of them at most, so that no run of corners vanishes at once."""
    if tolerance <= 0:
        return ring
    n = F.size(ring)

    def keep(p, i):
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        off = F.abs(dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"])) / F.sqrt(F.greatest(dx * dx + dy * dy, F.lit(1e-300)))
        return (i % 2 == 0) | (off > tolerance)

    out = F.filter(ring, keep)
    return F.when(F.size(out) >= 3, out).otherwise(ring)
