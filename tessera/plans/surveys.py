"""Queries of the detector stage, polygons, projections, special points, sinks and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import scratch_dir
from tessera.operators import detections as D
from tessera.operators import geodesy as G
from tessera.operators import habitat as H
from tessera.operators import inference as I
from tessera.operators import polygons as V
from tessera.operators import reports as P
from tessera.plans.registry import BINS, _class, _order, _sized, counted, grid, query, rounded, sized
from tessera.sources import geopackage, shapefiles
from tessera.sources import scenes as S

# Detector stage: windows of 32 pixels over rasters of 64, a box in each quarter.
NAMES, SIDE, STEP = ["rock", "shrub", "log"], 32, 24


def windows(s, d: str) -> DataFrame:
    return D.tile_windows(S.scenes(s, d).select("scene_id", F.lit(64).alias("width"), F.lit(64).alias("height")), SIDE, SIDE - STEP)


def detected(s, d: str, limit: int | None = None) -> DataFrame:
    out = I.detect(windows(s, d), S.pixels(s, d), I.quarters, NAMES, (SIDE, SIDE), 64, 64, 0.5, limit)
    return rounded(out, "confidence", *D.BOX)


_band = lambda c, m, sd: f"avg(((({c}::FLOAT / 255::FLOAT)::FLOAT - {m}::FLOAT)::FLOAT / {sd}::FLOAT)::FLOAT::DOUBLE) * 4"
_tiles = "SELECT DISTINCT scene_id, least(a.x, 32)::INT AS col_off, least(b.y, 32)::INT AS row_off FROM scenes, range(0, 64, 24) a(x), range(0, 64, 24) b(y)"


def _detect(limit: str = "") -> str:
    bands = ", ".join(_band(c, m, sd) for c, m, sd in zip("rgb", I.MEAN, I.DEVIATION, strict=True))
    side = lambda off, c, span, sign: f"round(greatest(0, least(64, {off} + {c} * 32 {sign} {span} * 32 / 2)), 6)"
    return f""", tl AS ({_tiles} {limit}),
qs AS (SELECT t.scene_id, col_off, row_off, (("row" - row_off) // 16 * 2 + (p.col - col_off) // 16)::INT AS query, [{bands}] AS logits
  FROM tl t JOIN pix p ON p.scene_id = t.scene_id AND p.col BETWEEN col_off AND col_off + 31 AND p."row" BETWEEN row_off AND row_off + 31 GROUP BY ALL),
pr AS (SELECT *, (0.5::DOUBLE + query % 2) / 2 AS cx, (0.5::DOUBLE + query // 2) / 2 AS cy, 1 / (1 + exp(-logits[class_id + 1])) AS conf
  FROM (SELECT *, unnest([0, 1, 2]) AS class_id FROM qs))
SELECT scene_id, col_off, row_off, query, class_id, ['rock', 'shrub', 'log'][class_id + 1] AS class_name, round(conf, 6) AS confidence,
  {side("col_off", "cx", "0.4::DOUBLE", "-")} AS pixel_xmin, {side("row_off", "cy", "0.3::DOUBLE", "-")} AS pixel_ymin,
  {side("col_off", "cx", "0.4::DOUBLE", "+")} AS pixel_xmax, {side("row_off", "cy", "0.3::DOUBLE", "+")} AS pixel_ymax
FROM pr WHERE conf >= 0.5"""


query("tile_detection", _detect())(detected)
query("tile_detection_first", _detect("ORDER BY scene_id, row_off, col_off LIMIT 3"))(lambda s, d: detected(s, d, 3))
query("tile_detection_smoke", _detect("ORDER BY scene_id, row_off, col_off LIMIT 1"))(lambda s, d: detected(s, d, 1))

# Boxes that reach over their tile's edge, some without a confidence.
TILE = "SELECT det_id, (det_id % 3 * 384)::INT AS col_off, (det_id % 2 * 384)::INT AS row_off, pixel_xmin - 500 AS x0, pixel_ymin - 500 AS y0, pixel_xmax - 500 AS x1, pixel_ymax - 500 AS y1, CASE WHEN det_id % 7 > 0 THEN confidence END AS c FROM det"


def in_tiles(s, d: str) -> DataFrame:
    b = S.detections(s, d).withColumns({c: F.col(c) - 500 for c in D.BOX}).withColumn("confidence", F.when(F.col("det_id") % 7 > 0, F.col("confidence")))
    return b.select("*", (F.col("det_id") % 3 * 384).cast("int").alias("col_off"), (F.col("det_id") % 2 * 384).cast("int").alias("row_off"), F.lit(512).alias("tile_width"), F.lit(512).alias("tile_height"))


_cut = lambda off, c: f"{off} + greatest(0, least(512, {c}))"
query("decode_tile_clamped", f"SELECT det_id, coalesce(c, 0) AS confidence, {_cut('col_off', 'x0')} AS pixel_xmin, {_cut('row_off', 'y0')} AS pixel_ymin, {_cut('col_off', 'x1')} AS pixel_xmax, {_cut('row_off', 'y1')} AS pixel_ymax FROM ({TILE}) WHERE least(512, x1) > greatest(0, x0) AND least(512, y1) > greatest(0, y0)")(
    lambda s, d: D.shifted(in_tiles(s, d)).select("det_id", "confidence", *D.BOX)
)
query("boxes_without_geometry_dropped", "SELECT det_id FROM det WHERE det_id % 5 > 0")(
    lambda s, d: D.with_area(S.detections(s, d).withColumn("pixel_xmax", F.when(F.col("det_id") % 10 > 0, F.col("pixel_xmax"))).withColumn("pixel_ymax", F.when(F.col("det_id") % 10 == 5, F.col("pixel_ymin")).otherwise(F.col("pixel_ymax")))).select("det_id")
)
query("tile_counts_capped", "SELECT scene_id, least(5, 9)::BIGINT AS n FROM scenes")(lambda s, d: S.scenes(s, d).select("scene_id", D.tile_count(F.lit(1024), F.lit(1024), most=5).alias("n")))

# Right triangles in the boxes, off the raster's own lines.
_dx, _dy = 0.13713, 0.29117
TRI = f"SELECT det_id, scene_id, pixel_xmin + {_dx}::DOUBLE AS x0, pixel_ymin + {_dy}::DOUBLE AS y0, pixel_xmax - pixel_xmin AS w, pixel_ymax - pixel_ymin AS h FROM det"


def triangles(s, d: str) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) + o for c, o in zip(D.BOX, (_dx, _dy, _dx, _dy), strict=True))
    return S.detections(s, d).select("scene_id", F.col("det_id").alias("shape_id"), F.array(V.point(x0, y0), V.point(x1, y0), V.point(x0, y1)).alias("ring"))


query("polygon_measures", f"SELECT det_id AS shape_id, round(w * h / 2, 6) AS area, round(x0 + w / 3, 6) AS x, round(y0 + h / 3, 6) AS y FROM ({TRI})")(
    lambda s, d: rounded(triangles(s, d).withColumn("_c", V.centroid(F.col("ring"))).select("shape_id", V.area(F.col("ring")).alias("area"), "_c.x", "_c.y"), "area", "x", "y")
)
# Below the long side, y is y0 + h (1 - (x - x0) / w): the area over a cell is a difference of squares.
_top = lambda x, y: f"pow(greatest(0, y0 + h * (1 - ({x} - x0) / w) - {y}), 2)"
_part = lambda y: f"({_top('xa', y)} - {_top('xb', y)})"
query(
    "polygon_cells",
    f"""SELECT scene_id, (r * 32 + c)::INT AS cell_id, round(sum(a), 4) AS covered FROM (
  SELECT *, ({_part("greatest(y0, r * 32)")} - {_part("(r * 32 + 32)")}) * w / h / 2 AS a FROM (
  SELECT *, greatest(x0, c * 32) AS xa, least(x0 + w, c * 32 + 32) AS xb FROM ({TRI}), range(0, 34) a(c), range(0, 34) b(r)
  WHERE c BETWEEN floor(x0 / 32) AND floor((x0 + w) / 32) AND r BETWEEN floor(y0 / 32) AND floor((y0 + h) / 32)))
WHERE a > 0 GROUP BY ALL HAVING round(sum(a), 4) > 0""",
)(lambda s, d: V.covered_cells(triangles(s, d), 32, 32).withColumn("covered", F.round("covered", 4)).filter("covered > 0"))
query(
    "polygon_zonal",
    f"""SELECT det_id AS shape_id, t.scene_id, count(r) AS n, round(coalesce(avg(r), 0), 6) AS r, round(coalesce(avg(g), 0), 6) AS g, round(coalesce(avg(b), 0), 6) AS b FROM ({TRI}) t
LEFT JOIN pix p ON p.scene_id = t.scene_id AND valid AND col * 16 + 8 >= x0 AND "row" * 16 + 8 >= y0 AND (col * 16 + 8 - x0) / w + ("row" * 16 + 8 - y0) / h < 1 GROUP BY ALL""",
)(lambda s, d: rounded(V.zonal(triangles(s, d), S.pixels(s, d), 16.0), "r", "g", "b"))


def rings(boxes: DataFrame, box=D.BOX) -> DataFrame:
    return boxes.select("scene_id", V.box_ring(box).alias("ring"))


def _lattice(table: str, box: tuple[str, ...]) -> str:
    a, b, c, e = box
    return f"SELECT scene_id, x, unnest(range({b}::BIGINT, {e}::BIGINT)) AS y FROM (SELECT scene_id, {b}, {e}, unnest(range({a}::BIGINT, {c}::BIGINT)) AS x FROM {table})"


_canopy = ("xmin", "ymin", "xmax", "ymax")
_all = _lattice("det", D.BOX)
query("polygon_union", f"SELECT scene_id, count(*)::DOUBLE AS area FROM (SELECT DISTINCT * FROM ({_all})) GROUP BY 1")(
    lambda s, d: V.overlay(rings(S.detections(s, d))).groupBy("scene_id").agg(F.round(F.sum(V.piece_area()), 4).alias("area"))
)
query("polygon_difference", f"SELECT scene_id, count(*)::DOUBLE AS area FROM (SELECT DISTINCT * FROM ({_all})) ANTI JOIN ({_lattice('canopy', _canopy)}) USING (scene_id, x, y) GROUP BY 1")(
    lambda s, d: V.overlay(rings(S.detections(s, d)), rings(S.canopy(s, d), _canopy)).groupBy("scene_id").agg(F.round(F.sum(V.piece_area()), 4).alias("area"))
)
query("cells_clipped_by_union", f"SELECT scene_id, ((y // 32) * 32 + x // 32)::INT AS cell_id, count(*)::DOUBLE AS area FROM (SELECT DISTINCT * FROM ({_all})) GROUP BY 1, 2")(
    lambda s, d: V.overlay_area(rings(S.detections(s, d)), size=32.0).select("scene_id", (F.col("gy") * 32 + F.col("gx")).cast("int").alias("cell_id"), F.round("area", 4).alias("area"))
)

# Places on the globe from the boxes' numbers.
LON, LAT = "(det_id % 360000 / 1000::DOUBLE - 180)", "(det_id * 7919 % 160000 / 1000::DOUBLE - 80)"
_zone = f"least(60, floor(({LON} + 180) / 6)::INT + 1)"


def places(s, d: str) -> DataFrame:
    i = F.col("det_id")
    return S.detections(s, d).select("det_id", (i % 360000 / 1000.0 - 180).alias("lon"), (i * 7919 % 160000 / 1000.0 - 80).alias("lat"))


def utm(s, d: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    x, y = G.to_utm(lon, lat, G.utm_zone(lon))
    return places(s, d).select("det_id", G.utm_epsg(lon, lat).cast("int").alias("epsg"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_e, _n = G.utm_sql("lon", "lat", "zone")
query("utm_places", f"SELECT det_id, zone + CASE WHEN lat < 0 THEN 32700 ELSE 32600 END AS epsg, round({_e}, 3) AS x, round({_n}, 3) AS y FROM (SELECT det_id, {LON} AS lon, {LAT} AS lat, {_zone} AS zone FROM det)")(utm)
query("pixel_ground_size", "SELECT scene_id, round(sqrt(pow(scene_id + 1, 2) + 0.04) * 0.3048 * 100, 6) AS cm_x, round(sqrt(0.01 + pow(scene_id + 2, 2)) * 0.3048 * 100, 6) AS cm_y FROM scenes")(
    lambda s, d: rounded(S.scenes(s, d).select("scene_id", *[c.alias(n) for c, n in zip(G.cm_per_pixel(F.col("scene_id") + 1.0, F.lit(0.1), F.lit(0.2), -(F.col("scene_id") + 2.0), G.unit_metres("foot")), ("cm_x", "cm_y"), strict=True)]), "cm_x", "cm_y")
)


# Special points: two of every scene, and one of a scene that has no boxes.
def points(s, d: str) -> DataFrame:
    three = F.explode(F.array(*[F.struct(F.lit(n).alias("point_id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(r).alias("radius")) for n, x, y, r in (("A", 256.0, 256.0, 80.0), ("B", 900.0, 120.0, 0.5))]))
    out = S.scenes(s, d).select("scene_id", three.alias("p")).select("scene_id", "p.*")
    return out.unionByName(s.range(1).select(F.lit(-1).cast("long").alias("scene_id"), F.lit("Z").alias("point_id"), *[F.lit(1.0).alias(c) for c in ("x", "y", "radius")]))


POINTS = f"""(SELECT scene_id, unnest(['A', 'B']) AS point_id, unnest([256.0, 900.0])::DOUBLE AS x, unnest([256.0, 120.0])::DOUBLE AS y, unnest([80.0, 0.5])::DOUBLE AS radius FROM scenes UNION ALL SELECT -1, 'Z', 1, 1, 1)"""
HIT = f"""(SELECT p.*, {_class} AS c, det_id FROM {POINTS} p LEFT JOIN {_sized} t ON t.scene_id = p.scene_id
  AND pow(greatest(pixel_xmin - x, 0, x - pixel_xmax), 2) + pow(greatest(pixel_ymin - y, 0, y - pixel_ymax), 2) <= radius * radius)"""
_counts = ", ".join(f"count(det_id) FILTER (c = '{x}') AS n{i}" for i, x in enumerate(D.labels(BINS)))


def point_sizes(s, d: str) -> DataFrame:
    return D.point_sizes(points(s, d), sized(s, d), D.labels(BINS))


query("special_point_sizes", f"SELECT scene_id, point_id, count(det_id) AS n, {_counts}, CASE WHEN scene_id NOT IN (SELECT scene_id FROM det) THEN 'NO_DATA' WHEN count(det_id) > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM {HIT} GROUP BY scene_id, point_id")(
    lambda s, d: point_sizes(s, d).select("scene_id", "point_id", "n", *[F.col("sizes")[x].alias(f"n{i}") for i, x in enumerate(D.labels(BINS))], "status")
)
_each = f"array_to_string(list_filter([{', '.join(f'''CASE WHEN n{i} > 0 THEN '{x}:' || n{i} END''' for i, x in enumerate(sorted(D.labels(BINS))))}], lambda v: v IS NOT NULL), ', ')"
_sorted = ", ".join(f"count(det_id) FILTER (c = '{x}') AS n{i}" for i, x in enumerate(sorted(D.labels(BINS))))
query("special_point_report", f"SELECT scene_id, point_id, '- ' || point_id || ' (' || printf('%.1f', x) || ', ' || printf('%.1f', y) || '): ' || CASE WHEN n > 0 THEN 'total=' || n || '; ' || {_each} ELSE 'none' END AS line FROM (SELECT scene_id, point_id, x, y, count(det_id) AS n, {_sorted} FROM {HIT} GROUP BY ALL)")(lambda s, d: P.point_text(point_sizes(s, d)))


# One summary a scene.
def metrics(s, d: str) -> DataFrame:
    boxes = S.detections(s, d)
    n = boxes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("raw"))
    kept = D.sized(D.confident(boxes), 1.5, 1.5, BINS)
    labels = D.labels(BINS)
    k = kept.groupBy("scene_id").agg(F.count(F.lit(1)).alias("kept"), F.create_map(*[c for x in labels for c in (F.lit(x), F.count_if(F.col("size_class") == x))]).alias("sizes"))
    z = H.zones(H.scored(counted(s, d)))
    c = z.groupBy("scene_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("score") > 0).alias("scored"), F.countDistinct(F.when(F.col("zone_id") > 0, F.col("zone_id"))).alias("zones"))
    out = n.join(k, "scene_id", "left").join(c, "scene_id", "left")
    return out.withColumn("green", F.col("raw") - F.col("kept"))


METRICS = f"""SELECT scene_id, raw, kept, raw - kept AS green, n0, n1, n2, n3, cells, blocked, scored, zones FROM (SELECT scene_id, count(*) AS raw, count(*) FILTER (confidence >= 0.25) AS kept,
  {", ".join(f"count(*) FILTER (confidence >= 0.25 AND {_class} = '{x}') AS n{i}" for i, x in enumerate(D.labels(BINS)))} FROM {_sized} GROUP BY 1)
JOIN (SELECT scene_id, count(*) AS cells, count(*) FILTER (blocked) AS blocked, count(*) FILTER (score > 0) AS scored, count(DISTINCT zone_id) FILTER (zone_id > 0) AS zones FROM zn GROUP BY 1) USING (scene_id)"""
query("run_counters", METRICS)(lambda s, d: metrics(s, d).select("scene_id", "raw", "kept", "green", *[F.col("sizes")[x].alias(f"n{i}") for i, x in enumerate(D.labels(BINS))], "cells", "blocked", "scored", "zones"))
_lines = ["'Run summary:'", "'  - Detections: ' || raw", "'  - After suppression: ' || kept", "'  - Removed as green: ' || green", "'  - By size:'", *[f"'      {x}: ' || n{i}" for i, x in enumerate(D.labels(BINS))], "'  - Grid cells: ' || cells", "'  - Blocked by canopy: ' || blocked", "'  - Scored above 0: ' || scored", "'  - Zones: ' || zones"]
query("run_report", f"SELECT scene_id, array_to_string([{', '.join(_lines)}], chr(10)) AS report FROM ({METRICS})")(lambda s, d: P.run_text(metrics(s, d), D.labels(BINS)))
query("durations", "SELECT det_id, CASE WHEN t >= 3600 THEN printf('%dh%02dm%02ds', t // 3600, t % 3600 // 60, t % 60) WHEN t >= 60 THEN printf('%dm%02ds', t // 60, t % 60) ELSE t || 's' END AS took FROM (SELECT det_id, greatest(0, round_even(confidence * 5000, 0))::BIGINT AS t FROM det)")(
    lambda s, d: S.detections(s, d).select("det_id", P.duration(F.col("confidence") * 5000).alias("took"))
)


# Single-band rasters: means of cells as keys of a colour table of sixteen colours, without one left out.
def colour_table(s) -> DataFrame:
    return s.range(256).filter("id % 16 <> 3").select(F.col("id").cast("int").alias("value"), *[F.expr(e).cast("double").alias(c) for c, e in (("red", "id * 7 % 256"), ("green", "id * 13 % 256"), ("blue", "id * 29 % 256"))])


query(
    "colormap_score",
    """SELECT scene_id, cell_id, round(CASE WHEN valid_px = 0 THEN 0 WHEN k % 16 = 3 THEN r / 255 WHEN g2 > r2 AND g2 > b2 THEN 3 / 3.0 WHEN b2 > r2 AND b2 > g2 THEN 2 / 3.0 WHEN r2 > g2 AND r2 > b2 THEN 1 / 3.0 ELSE 0 END::DOUBLE, 6) AS veg_sc
FROM (SELECT *, k * 7 % 256 AS r2, k * 13 % 256 AS g2, k * 29 % 256 AS b2 FROM (SELECT *, round_even(r, 0)::INT AS k FROM grid))""",
)(lambda s, d: rounded(H.by_colormap(H.cell_grid(S.pixels(s, d)), colour_table(s)).select("scene_id", "cell_id", "veg_sc"), "veg_sc"))
query("score_raster_valid", 'SELECT scene_id, "row", col, CASE WHEN r % 5 > 0 AND r <> 77 THEN r::DOUBLE END AS score FROM pix')(
    lambda s, d: S.pixels(s, d).withColumn("score", F.when(F.col("r") % 5 > 0, F.col("r").cast("double")).otherwise(F.lit(float("nan")))).select("scene_id", "row", "col", H.valid_score(F.col("score"), 77.0).alias("score"))
)
query("zone_ranges", "SELECT scene_id, zone_id, min(score)::DOUBLE AS least, max(score)::DOUBLE AS most, count(*) AS cell_count, CASE zone_id WHEN 1 THEN 0.0 WHEN 2 THEN 0.33 ELSE 0.66 END::DOUBLE AS score_min, CASE zone_id WHEN 1 THEN 0.33 WHEN 2 THEN 0.66 ELSE 1.0 END::DOUBLE AS score_max FROM zn WHERE zone_id > 0 GROUP BY 1, 2")(
    lambda s, d: H.zone_ranges(H.zones(H.scored(counted(s, d))))
)


# Sinks: what was written is read back.
def mapped(s, d: str) -> DataFrame:
    b = D.georeference(sized(s, d), 0.5, 0.0, 1000.0, 0.0, -0.5, 9000.0).withColumn("class_id", F.lit(1).cast("long"))
    return b.withColumn("map_xmin", F.when(F.col("det_id") % 10 > 0, F.col("map_xmin")))


def through_geopackage(s, d: str) -> DataFrame:
    path = f"{scratch_dir(s, 'sink')}/boxes.gpkg"
    geopackage.write(mapped(s, d), path, "rock boxes", 32619)
    return geopackage.read(s, path)


def through_shapefiles(s, d: str) -> DataFrame:
    where = scratch_dir(s, "sink")
    shapefiles.write(mapped(s, d), where, sized=True)
    return shapefiles.read(s, where, sized=True)


def through_bins(s, d: str) -> DataFrame:
    n = shapefiles.write_bins(mapped(s, d).filter("size_class <> '0-10'"), scratch_dir(s, "sink"), D.labels(BINS))
    return s.createDataFrame(list(n.items()), "size_class string, n long")


_written = "SELECT pixel_xmin * 0.5 + 1000 AS map_xmin, pixel_ymax * -0.5 + 9000 AS map_ymin, pixel_xmax * 0.5 + 1000 AS map_xmax, pixel_ymin * -0.5 + 9000 AS map_ymax"
query("sink_geopackage", f"{_written}, class_name, confidence, 1::BIGINT AS class_id FROM det WHERE det_id % 10 > 0")(through_geopackage)
query("sink_shapefile", f"{_written}, class_name, round(confidence, 6) AS confidence, {_class} AS size_class FROM {_sized} WHERE det_id % 10 > 0")(
    lambda s, d: through_shapefiles(s, d).select("map_xmin", "map_ymin", "map_xmax", "map_ymax", "class_name", F.round("confidence", 6).alias("confidence"), "size_class")
)
query("sink_size_bins", f"SELECT c AS size_class, count(det_id) AS n FROM (SELECT unnest({_order}) AS c) LEFT JOIN (SELECT det_id, {_class} AS c FROM {_sized} WHERE det_id % 10 > 0 AND {_class} <> '0-10') USING (c) GROUP BY 1")(through_bins)
