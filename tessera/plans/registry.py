"""All queries by name, with the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import decode as M
from tessera.operators import detections as D
from tessera.operators import erase as X
from tessera.operators import habitat as H
from tessera.operators import rasters as R
from tessera.operators import reports as P
from tessera.sources import scenes as S

BINS, CM = [10.0, 40.0, 100.0], 1.5
AFFINE = (0.5, 0.1, 1000.0, 0.2, -0.5, 9000.0)
QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = f"WITH RECURSIVE {S.SQL}{CELLS}\n{sql}"
        return f

    return add


def grid(spark, d: str) -> DataFrame:
    return H.cell_grid(S.pixels(spark, d)).withColumn("veg_sc", H.dominant())


def counted(spark, d: str) -> DataFrame:
    return H.blocked(H.canopy_overlap(H.rocks_centroid(grid(spark, d), S.detections(spark, d)), S.canopy(spark, d)))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


CELLS = """,
grid0 AS (SELECT scene_id, ("row"//2)::INT AS "row", (col//2)::INT AS col, count(*) FILTER (valid) AS valid_px,
  coalesce(avg(r) FILTER (valid), 0) AS r, coalesce(avg(g) FILTER (valid), 0) AS g, coalesce(avg(b) FILTER (valid), 0) AS b FROM pix GROUP BY 1, 2, 3),
grid AS (SELECT *, "row" * 32 + col AS cell_id, (CASE WHEN valid_px = 0 THEN 0 WHEN g > r AND g > b THEN 3 WHEN b > r AND b > g THEN 2 WHEN r > g AND r > b THEN 1 ELSE 0 END / 3.0::DOUBLE)::FLOAT AS veg_sc FROM grid0),
cen AS (SELECT scene_id, floor((pixel_ymin + pixel_ymax) / 2 / 32)::INT AS "row", floor((pixel_xmin + pixel_xmax) / 2 / 32)::INT AS col, (pixel_xmin + pixel_xmax) / 2 AS x, (pixel_ymin + pixel_ymax) / 2 AS y FROM det),
rocks AS (SELECT g.scene_id, g."row", g.col, count(c.x) AS rock_ct FROM grid g LEFT JOIN cen c ON c.scene_id = g.scene_id AND c.x > g.col * 32 AND c.x < g.col * 32 + 32 AND c.y > g."row" * 32 AND c.y < g."row" * 32 + 32 AND c."row" = g."row" AND c.col = g.col GROUP BY 1, 2, 3),
over AS (SELECT g.scene_id, g."row", g.col, sum(greatest(0, least(xmax, col * 32 + 32) - greatest(xmin, col * 32)) * greatest(0, least(ymax, "row" * 32 + 32) - greatest(ymin, "row" * 32))) / 1024 AS ratio
  FROM grid g JOIN canopy k ON k.scene_id = g.scene_id AND xmin <= col * 32 + 32 AND xmax >= col * 32 AND ymin <= "row" * 32 + 32 AND ymax >= "row" * 32 GROUP BY 1, 2, 3),
cells AS (SELECT g.*, rock_ct, ratio, coalesce(least(ratio, 1) >= 0.2, false) AS blocked FROM grid g JOIN rocks USING (scene_id, "row", col) LEFT JOIN over USING (scene_id, "row", col)),
caps AS (SELECT scene_id, coalesce(quantile_cont(rock_ct, 0.95) FILTER (valid_px > 0 AND NOT blocked AND rock_ct > 0), 1)::DOUBLE AS cap FROM cells GROUP BY 1),
raw0 AS (SELECT cells.*, cap, least(rock_ct / cap, 1)::FLOAT AS rock_sc FROM cells JOIN caps USING (scene_id)),
raws AS (SELECT *, CASE WHEN valid_px > 0 AND NOT blocked AND rock_ct > 0 THEN (veg_sc::DOUBLE * 0.7::DOUBLE + rock_sc::DOUBLE * 0.3::DOUBLE) / (0.7::DOUBLE + 0.3::DOUBLE) ELSE 0 END::FLOAT AS raw_sc,
  CASE WHEN valid_px > 0 AND NOT blocked THEN (veg_sc::DOUBLE * 0.7::DOUBLE + rock_sc::DOUBLE * 0.3::DOUBLE) / (0.7::DOUBLE + 0.3::DOUBLE) ELSE 0 END::FLOAT AS raw2 FROM raw0),
sc AS (SELECT *, greatest(0, least(1, raw_sc::DOUBLE))::FLOAT AS score FROM raws),
zn AS (SELECT *, CASE WHEN NOT score > 0 THEN 0 WHEN score::DOUBLE < 0.33::DOUBLE THEN 1 WHEN score::DOUBLE < 0.66::DOUBLE THEN 2 ELSE 3 END AS zone_id FROM sc)"""
WINDOWS = "SELECT scene_id, x AS col_off, y AS row_off, least(512, 1024 - x)::INT AS width, least(512, 1024 - y)::INT AS height FROM"


def sizes(spark, d: str) -> DataFrame:
    return S.scenes(spark, d).select("scene_id", F.lit(1024).alias("width"), F.lit(1024).alias("height"))


query("tile_windows", f"SELECT DISTINCT * FROM ({WINDOWS} (SELECT scene_id, least(a.x, 512)::INT AS x, least(b.y, 512)::INT AS y FROM scenes, range(0, 1024, 384) a(x), range(0, 1024, 384) b(y)))")(lambda s, d: D.tile_windows(sizes(s, d)))
query("tile_windows_clipped", f"{WINDOWS} (SELECT scene_id, a.x::INT AS x, b.y::INT AS y FROM scenes, range(0, 1024, 384) a(x), range(0, 1024, 384) b(y))")(lambda s, d: D.tile_windows(sizes(s, d), shifted=False))
NORM = ", ".join(f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0 ELSE trunc(({c} - min({c}) OVER w)::DOUBLE / (max({c}) OVER w - min({c}) OVER w) * 255)::INT END AS {c}" for c in "rgb")
query("band_normalise", f'SELECT scene_id, "row", col, {NORM} FROM pix WINDOW w AS (PARTITION BY scene_id)')(lambda s, d: H.normalised(S.pixels(s, d)))
query("band_normalise_clipped", f'SELECT scene_id, "row", col, {NORM} FROM pix WINDOW w AS (PARTITION BY scene_id)')(lambda s, d: H.normalised(S.pixels(s, d), "zero"))
query("confidence_filter", "SELECT det_id, scene_id, confidence FROM det WHERE confidence >= 0.25")(lambda s, d: D.confident(S.detections(s, d)).select("det_id", "scene_id", "confidence"))
query("decode_xyxy", "SELECT det_id, least(pixel_xmin, 1000) AS x0, least(pixel_ymin, 1000) AS y0, least(pixel_xmax, 1000) AS x1, least(pixel_ymax, 1000) AS y1 FROM det WHERE pixel_xmin < 1000 AND pixel_ymin < 1000")(
    lambda s, d: D.clamp_boxes(S.detections(s, d), 1000, 1000).select("det_id", *[F.col(c).alias(a) for c, a in zip(D.BOX, ("x0", "y0", "x1", "y1"), strict=True)])
)
query("class_filter", "SELECT det_id, class_name FROM det WHERE class_name = 'rock'")(lambda s, d: D.of_classes(S.detections(s, d), ["Rock"]).select("det_id", "class_name"))
_x, _y = "pixel_{0}*0.5::DOUBLE + pixel_{1}*0.1::DOUBLE + 1000::DOUBLE", "pixel_{0}*0.2::DOUBLE + pixel_{1}*(-0.5::DOUBLE) + 9000::DOUBLE"


def _envelope(corners) -> str:
    part = lambda f, t: f"round({f}({', '.join(t.format(*c) for c in corners)}), 6)"
    return f"SELECT det_id, {part('least', _x)} AS map_xmin, {part('least', _y)} AS map_ymin, {part('greatest', _x)} AS map_xmax, {part('greatest', _y)} AS map_ymax FROM det"


MAP = ("map_xmin", "map_ymin", "map_xmax", "map_ymax")
query("georeference", _envelope([("xmin", "ymin"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymax")]))(lambda s, d: rounded(D.georeference(S.detections(s, d), *AFFINE).select("det_id", *MAP), *MAP))
query("georeference_clipped", _envelope([("xmin", "ymin"), ("xmax", "ymax")]))(lambda s, d: rounded(D.georeference(S.detections(s, d), *AFFINE, corners=2).select("det_id", *MAP), *MAP))


def _nms(same: str, op: str, t: float) -> str:
    return f""", e AS (SELECT a.scene_id, a.det_id AS hi, b.det_id AS lo FROM det a JOIN det b ON a.scene_id = b.scene_id {same}
  AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.det_id < b.det_id))
  AND least(a.pixel_xmax, b.pixel_xmax) > greatest(a.pixel_xmin, b.pixel_xmin) AND least(a.pixel_ymax, b.pixel_ymax) > greatest(a.pixel_ymin, b.pixel_ymin)
  WHERE (least(a.pixel_xmax, b.pixel_xmax) - greatest(a.pixel_xmin, b.pixel_xmin)) * (least(a.pixel_ymax, b.pixel_ymax) - greatest(a.pixel_ymin, b.pixel_ymin))
   / ((a.pixel_xmax - a.pixel_xmin) * (a.pixel_ymax - a.pixel_ymin) + (b.pixel_xmax - b.pixel_xmin) * (b.pixel_ymax - b.pixel_ymin)
   - (least(a.pixel_xmax, b.pixel_xmax) - greatest(a.pixel_xmin, b.pixel_xmin)) * (least(a.pixel_ymax, b.pixel_ymax) - greatest(a.pixel_ymin, b.pixel_ymin))) {op} {t}),
q AS (SELECT scene_id, det_id, coalesce((SELECT list(hi) FROM e WHERE lo = det_id), []) AS above, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, det_id) AS i
  FROM det WHERE det_id IN (SELECT hi FROM e UNION SELECT lo FROM e)),
st AS (SELECT DISTINCT scene_id, 0::BIGINT AS i, []::BIGINT[] AS kept FROM q
  UNION ALL SELECT st.scene_id, q.i, CASE WHEN list_has_any(above, kept) THEN kept ELSE list_append(kept, det_id) END FROM st JOIN q ON q.scene_id = st.scene_id AND q.i = st.i + 1),
fin AS (SELECT unnest(kept) AS det_id FROM (SELECT scene_id, arg_max(kept, i) AS kept FROM st GROUP BY 1))
SELECT det_id, scene_id, class_name FROM det WHERE det_id NOT IN (SELECT det_id FROM q) OR det_id IN (SELECT det_id FROM fin)"""


def nms(name: str, sql: str, **how):
    QUERIES[name] = lambda s, d: D.nms(S.detections(s, d), **how).select("det_id", "scene_id", "class_name")
    SQL[name] = f"WITH RECURSIVE {S.SQL}{sql}"


nms("nms_class_aware", _nms("AND a.class_name = b.class_name", ">=", 0.35))
nms("nms_clipped", _nms("", ">", 0.35), by_class=False, closed=False)
_sized = "(SELECT *, greatest(pixel_xmax - pixel_xmin, pixel_ymax - pixel_ymin) * 1.5::DOUBLE AS size_value FROM det)"
_class = "CASE WHEN size_value < 10 THEN '0-10' WHEN size_value < 40 THEN '10-40' WHEN size_value < 100 THEN '40-100' ELSE '>100' END"


def sized(s, d: str) -> DataFrame:
    return D.sized(S.detections(s, d), CM, CM, BINS)


query("size_classes", f"SELECT det_id, size_value, {_class} AS size_class FROM {_sized}")(lambda s, d: sized(s, d).select("det_id", "size_value", "size_class"))
query("size_counts", f"SELECT scene_id, c AS size_class, count(det_id) AS n FROM (SELECT scene_id, unnest(['0-10', '10-40', '40-100', '>100']) AS c FROM scenes) LEFT JOIN (SELECT scene_id, det_id, {_class} AS c FROM {_sized}) USING (scene_id, c) GROUP BY 1, 2")(lambda s, d: D.size_counts(sized(s, d), BINS, S.scenes(s, d)))
query("size_bin_select", f"SELECT det_id FROM {_sized} WHERE {_class} = '10-40'")(lambda s, d: sized(s, d).filter("size_class = '10-40'").select("det_id"))
PLACE = ["scene_id", "cell_id"]
query("cell_grid", 'SELECT scene_id, cell_id, "row", col, valid_px, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM grid')(lambda s, d: rounded(H.cell_grid(S.pixels(s, d)), "r", "g", "b").select(*PLACE, "row", "col", "valid_px", "r", "g", "b"))
query("veg_dominant", "SELECT scene_id, cell_id, round(veg_sc::DOUBLE, 6) AS veg_sc FROM grid")(lambda s, d: rounded(grid(s, d).select(*PLACE, "veg_sc"), "veg_sc"))
query("veg_dtype_range", "SELECT scene_id, cell_id, round(greatest(0, least(1, g / 255)), 6) AS veg_sc FROM grid")(lambda s, d: rounded(H.cell_grid(S.pixels(s, d)).select(*PLACE, H.dtype_range(F.col("g"), 0, 255).alias("veg_sc")), "veg_sc"))
query("rocks_centroid", "SELECT scene_id, cell_id, rock_ct FROM cells")(lambda s, d: H.rocks_centroid(grid(s, d), S.detections(s, d)).select(*PLACE, "rock_ct"))
query("rocks_intersects", 'SELECT g.scene_id, cell_id, count(det_id) AS rock_ct FROM grid g LEFT JOIN det t ON t.scene_id = g.scene_id AND pixel_xmin <= col * 32 + 32 AND pixel_xmax >= col * 32 AND pixel_ymin <= "row" * 32 + 32 AND pixel_ymax >= "row" * 32 GROUP BY 1, 2')(
    lambda s, d: H.rocks_intersects(grid(s, d), S.detections(s, d)).select(*PLACE, "rock_ct")
)
query("canopy_overlap", "SELECT scene_id, cell_id, round(ratio, 6) AS ratio FROM cells")(lambda s, d: rounded(H.canopy_overlap(grid(s, d), S.canopy(s, d)).select(*PLACE, "ratio"), "ratio"))
query("canopy_block", "SELECT scene_id, cell_id, blocked FROM cells")(lambda s, d: H.blocked(H.canopy_overlap(grid(s, d), S.canopy(s, d))).select(*PLACE, "blocked"))
query("rock_cap", "SELECT scene_id, round(cap, 6) AS cap FROM caps")(lambda s, d: rounded(H.rock_cap(counted(s, d)), "cap"))
query("habitat_score", "SELECT scene_id, cell_id, round(rock_sc::DOUBLE, 6) AS rock_sc, round(score::DOUBLE, 6) AS score FROM sc")(lambda s, d: rounded(H.scored(counted(s, d)).select(*PLACE, "rock_sc", "score"), "rock_sc", "score"))
query(
    "habitat_score_minmax",
    "SELECT scene_id, cell_id, round((CASE WHEN raw_sc > 0 THEN CASE WHEN hi > lo THEN (raw_sc::DOUBLE - lo) / (hi - lo) ELSE 1 END ELSE 0 END)::FLOAT::DOUBLE, 6) AS score FROM raws JOIN (SELECT scene_id, min(raw_sc::DOUBLE) AS lo, max(raw_sc::DOUBLE) AS hi FROM raws WHERE raw_sc > 0 GROUP BY 1) USING (scene_id)",
)(lambda s, d: rounded(H.scored(counted(s, d), scaling="minmax").select(*PLACE, "score"), "score"))
query("habitat_score_clipped", "SELECT scene_id, cell_id, round(greatest(0, least(1, raw2::DOUBLE))::FLOAT::DOUBLE, 6) AS score FROM raws")(lambda s, d: rounded(H.scored(counted(s, d), need_rocks=False).select(*PLACE, "score"), "score"))
query(
    "score_rgba",
    "SELECT scene_id, cell_id, CASE WHEN score <= 0 THEN 0 WHEN s <= 0.5 THEN round_even(255 * (1 - s / 0.5::DOUBLE), 0) ELSE 0 END::INT AS red, CASE WHEN score <= 0 OR s <= 0.5 THEN 0 ELSE round_even(255 * ((s - 0.5::DOUBLE) / 0.5::DOUBLE), 0) END::INT AS green, CASE WHEN score <= 0 THEN 0 WHEN s <= 0.5 THEN round_even(255 * (s / 0.5::DOUBLE), 0) ELSE round_even(255 * (1 - (s - 0.5::DOUBLE) / 0.5::DOUBLE), 0) END::INT AS blue, CASE WHEN score > 0 THEN 255 ELSE 0 END AS alpha FROM (SELECT *, score::DOUBLE AS s FROM sc)",
)(lambda s, d: H.scored(counted(s, d)).select(*PLACE, *H.rgba()))
query("zone_classes", "SELECT scene_id, cell_id, zone_id, ['none', 'low', 'medium', 'high'][zone_id + 1] AS zone FROM zn")(lambda s, d: H.zones(H.scored(counted(s, d))).select(*PLACE, "zone_id", "zone"))
query("zone_counts", "SELECT scene_id, zone_id, count(*) AS n FROM zn GROUP BY 1, 2")(lambda s, d: H.zones(H.scored(counted(s, d))).groupBy("scene_id", "zone_id").agg(F.count(F.lit(1)).alias("n")))
query("zone_dissolve", "SELECT scene_id, zone_id, ['none', 'low', 'medium', 'high'][zone_id + 1] AS zone, count(*) AS cell_count, round(avg(score::DOUBLE), 6) AS mean_score, count(*) * 1024::DOUBLE AS area FROM zn WHERE zone_id > 0 GROUP BY 1, 2")(lambda s, d: rounded(H.dissolved(H.zones(H.scored(counted(s, d)))), "mean_score"))
query("upscale_nearest", 'SELECT scene_id, ("row" * 2 + i)::INT AS "row", (col * 2 + j)::INT AS col, round(score::DOUBLE, 6) AS score FROM sc, range(2) a(i), range(2) b(j)')(lambda s, d: rounded(H.upscaled(H.scored(counted(s, d))), "score"))
POINTS = [("a", 256.0, 256.0), ("b", 512.0, 512.0), ("c", 900.0, 120.0)]


@query(
    "special_points",
    f"""SELECT p.scene_id, point_id, count(det_id) AS n, coalesce(string_agg(DISTINCT size_class, ',' ORDER BY size_class), '') AS classes, CASE WHEN count(det_id) > 0 THEN 'OK' ELSE 'EMPTY' END AS status
FROM (SELECT scene_id, point_id, x, y FROM scenes, (VALUES {", ".join(map(str, POINTS))}) v(point_id, x, y)) p
LEFT JOIN (SELECT *, {_class} AS size_class FROM {_sized}) t ON t.scene_id = p.scene_id
 AND greatest(pixel_xmin - x, 0, x - pixel_xmax) ** 2 + greatest(pixel_ymin - y, 0, y - pixel_ymax) ** 2 <= 6400 GROUP BY 1, 2""",
)
def points(s, d: str) -> DataFrame:
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("point_id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in POINTS]))
    return D.special_points(S.scenes(s, d).select("scene_id", p.alias("p")).select("scene_id", "p.*", F.lit(80.0).alias("radius")), sized(s, d))


query("detection_order", "SELECT det_id, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, det_id)::INT AS rank FROM det")(lambda s, d: D.numbered(S.detections(s, d)).select("det_id", "rank"))
query("run_summary", "SELECT scene_id, count(*) AS n, count(*) FILTER (class_name = 'rock') AS n_rock, min(pixel_xmin) AS xmin, min(pixel_ymin) AS ymin, max(pixel_xmax) AS xmax, max(pixel_ymax) AS ymax FROM det GROUP BY 1")(lambda s, d: D.summary(S.detections(s, d)))


# --- raster neighbourhoods, parts, cutting and model outputs ---
RAMP = ", ".join(f"{v}::FLOAT AS {n}" for n, v in (("pr", "CASE WHEN i <= 255 THEN 255::FLOAT * (1::FLOAT - s / 0.5::FLOAT) ELSE 0 END"), ("pg", "CASE WHEN i <= 255 THEN 0 ELSE 255::FLOAT * ((s - 0.5::FLOAT) / 0.5::FLOAT) END"), ("pb", "CASE WHEN i <= 255 THEN 255::FLOAT * (s / 0.5::FLOAT) ELSE 255::FLOAT * (1::FLOAT - (s - 0.5::FLOAT) / 0.5::FLOAT) END")))
KEY = ", ".join(f"greatest(0, least(255, round_even(CASE WHEN greatest(r, g, b) <= 1 THEN {c} * 255 ELSE {c} END, 0)))::INT AS k{c}" for c in "rgb")
query(
    "veg_ramp",
    f""", ramp AS (SELECT i, s, {RAMP} FROM (SELECT i, (i * (1.0::DOUBLE / 510))::FLOAT AS s FROM range(511) t(i))),
keyed AS (SELECT *, {KEY} FROM grid),
near AS (SELECT kr, kg, kb, arg_min(s, ((pr - kr::FLOAT) * (pr - kr::FLOAT) + (pg - kg::FLOAT) * (pg - kg::FLOAT) + (pb - kb::FLOAT) * (pb - kb::FLOAT), i)) AS s FROM (SELECT DISTINCT kr, kg, kb FROM keyed), ramp GROUP BY 1, 2, 3)
SELECT scene_id, cell_id, round(CASE WHEN valid_px > 0 THEN s ELSE 0 END::DOUBLE, 6) AS veg_sc FROM keyed JOIN near USING (kr, kg, kb)""",
)(lambda s, d: rounded(R.ramp_scored(H.cell_grid(S.pixels(s, d))).select(*PLACE, "veg_sc"), "veg_sc"))
GREEN = """SELECT det_id, scene_id, (count(*) FILTER (g >= r + 12 AND g >= b + 12))::DOUBLE / count(*) AS ratio FROM det JOIN pix USING (scene_id)
  WHERE col >= floor(pixel_xmin / 16) AND col < ceil(pixel_xmax / 16) AND "row" >= floor(pixel_ymin / 16) AND "row" < ceil(pixel_ymax / 16) GROUP BY 1, 2"""
query("green_ratio", f"SELECT det_id, round(coalesce(ratio, 0), 6) AS green_ratio FROM det LEFT JOIN ({GREEN}) USING (det_id)")(lambda s, d: rounded(R.green_share(S.detections(s, d), S.pixels(s, d), pixel=16).select("det_id", "green_ratio"), "green_ratio"))
query("green_filter", f"SELECT det_id FROM det LEFT JOIN ({GREEN}) USING (det_id) WHERE coalesce(ratio, 0) < 0.35")(lambda s, d: R.without_green(R.green_share(S.detections(s, d), S.pixels(s, d), pixel=16)).select("det_id"))
query("green_filter_clipped", f"SELECT det_id FROM det LEFT JOIN ({GREEN}) USING (det_id) WHERE coalesce(ratio, 0) <= 0.35")(lambda s, d: R.without_green(R.green_share(S.detections(s, d), S.pixels(s, d), pixel=16), closed=False).select("det_id"))
query(
    "habitat_score_minmax_clipped",
    "SELECT scene_id, cell_id, round((CASE WHEN raw2 > 0 THEN CASE WHEN n <= 1 THEN raw2::DOUBLE ELSE (raw2::DOUBLE - lo) / greatest(hi - lo, 0.000001::DOUBLE) END ELSE 0 END)::FLOAT::DOUBLE, 6) AS score FROM raws JOIN (SELECT scene_id, min(raw2::DOUBLE) AS lo, max(raw2::DOUBLE) AS hi, count(*) AS n FROM raws WHERE raw2 > 0 GROUP BY 1) USING (scene_id)",
)(lambda s, d: rounded(H.scored(counted(s, d), scaling="minmax", need_rocks=False, floor=True).select(*PLACE, "score"), "score"))


def _upscaled(kind: str) -> str:
    x = "abs((i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE - a)"
    cubic = f"CASE WHEN {x} < 1 THEN 1.5::DOUBLE * {x} ** 3 - 2.5::DOUBLE * {x} ** 2 + 1 WHEN {x} < 2 THEN -0.5::DOUBLE * {x} ** 3 + 2.5::DOUBLE * {x} ** 2 - 4 * {x} + 2 ELSE 0 END"
    pick = "CASE WHEN count(*) FILTER (c <> 0) = 16 THEN sum(c * v) / sum(c) ELSE sum(l * v) / sum(l) END" if kind == "cubic" else "sum(l * v) / sum(l)"
    return f""", tap AS (SELECT i, a, greatest(0, 1 - {x}) AS l, {cubic} AS c FROM range(2) p(i), range(-2, 3) q(a)),
wt AS (SELECT s.i, t.i AS j, s.a, t.a AS b, s.l * t.l AS l, s.c * t.c AS c FROM tap s, tap t)
SELECT m.scene_id, (m."row" * 2 + i)::INT AS "row", (m.col * 2 + j)::INT AS col, round(({pick})::FLOAT::DOUBLE, 4) AS score
FROM sc m, wt JOIN (SELECT scene_id AS z, "row" AS y, col AS x, score::DOUBLE AS v FROM sc WHERE score > 0) n ON z = m.scene_id AND y = m."row" + a AND x = m.col + b
WHERE m.score > 0 GROUP BY 1, 2, 3"""


for _kind in ("bilinear", "cubic"):
    query(f"upscale_{_kind}", _upscaled(_kind))(lambda s, d, k=_kind: R.interpolated(H.scored(counted(s, d)), 2, k).withColumn("score", F.round(F.col("score").cast("double"), 4)))
query("paint_cells", 'SELECT scene_id, ("row" * 2 + i)::INT AS "row", (col * 2 + j)::INT AS col, round(score::DOUBLE, 6) AS score FROM sc, range(2) a(i), range(2) b(j)')(lambda s, d: rounded(R.painted(H.scored(counted(s, d))), "score"))
query("burn_boxes", 'SELECT scene_id, p."row", p.col, arg_max(confidence, det_id) AS confidence FROM det JOIN (SELECT scene_id, "row", col FROM pix) p USING (scene_id) WHERE pixel_xmin <= (col + 1) * 16 AND pixel_xmax >= col * 16 AND pixel_ymin <= ("row" + 1) * 16 AND pixel_ymax >= "row" * 16 GROUP BY 1, 2, 3')(
    lambda s, d: R.burned(S.detections(s, d), 16, "det_id", "confidence").select("scene_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "confidence")
)
LINKED = """, live AS (SELECT scene_id, cell_id, "row", col, zone_id, score FROM zn WHERE zone_id > 0),
nb AS (SELECT a.scene_id, a.cell_id AS a, b.cell_id AS b FROM live a JOIN live b ON a.scene_id = b.scene_id AND a.zone_id = b.zone_id AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
reach AS (SELECT scene_id, cell_id AS a, cell_id AS b FROM live UNION SELECT reach.scene_id, reach.a, nb.b FROM reach JOIN nb ON nb.scene_id = reach.scene_id AND nb.a = reach.b),
lab AS (SELECT scene_id, a AS cell_id, min(b) AS part FROM reach GROUP BY 1, 2)"""


def parted(s, d: str) -> DataFrame:
    return R.parts(H.zones(H.scored(counted(s, d))))


query("zone_parts", f"""{LINKED}
SELECT scene_id, zone_id, part, count(*) AS cell_count, round(avg(score::DOUBLE), 6) AS mean_score, min("row") AS row0, max("row") AS row1, min(col) AS col0, max(col) AS col1, count(*) * 1024::DOUBLE AS area,
  row_number() OVER (PARTITION BY scene_id ORDER BY zone_id, part)::INT AS zone_uid FROM lab JOIN live USING (scene_id, cell_id) GROUP BY 1, 2, 3""")(lambda s, d: rounded(R.part_table(parted(s, d)), "mean_score"))  # fmt: skip
query("zone_borders", f"{LINKED} SELECT scene_id, zone_id, part, 4 * count(*) - sum(coalesce(n, 0))::BIGINT AS n_edges FROM lab JOIN live USING (scene_id, cell_id) LEFT JOIN (SELECT scene_id, a AS cell_id, count(*) AS n FROM nb GROUP BY 1, 2) USING (scene_id, cell_id) GROUP BY 1, 2, 3")(
    lambda s, d: R.border(parted(s, d)).groupBy("scene_id", "zone_id", "part").agg(F.count(F.lit(1)).alias("n_edges"))
)
COVERED = """SELECT DISTINCT det_id, x, y FROM (SELECT det_id, x, unnest(range(greatest(pixel_ymin, ymin)::BIGINT, least(pixel_ymax, ymax)::BIGINT)) AS y FROM (
  SELECT det_id, pixel_ymin, pixel_ymax, ymin, ymax, unnest(range(greatest(pixel_xmin, xmin)::BIGINT, least(pixel_xmax, xmax)::BIGINT)) AS x FROM det JOIN canopy c ON c.scene_id = det.scene_id
  AND pixel_xmin < xmax AND pixel_xmax > xmin AND pixel_ymin < ymax AND pixel_ymax > ymin))"""


def pieces(s, d: str) -> DataFrame:
    return X.erased(S.detections(s, d), S.canopy(s, d))


query("rocks_erased", f"SELECT scene_id, det_id, area FROM (SELECT scene_id, det_id, (pixel_xmax - pixel_xmin) * (pixel_ymax - pixel_ymin) - coalesce(n, 0)::DOUBLE AS area FROM det LEFT JOIN (SELECT det_id, count(*) AS n FROM ({COVERED}) GROUP BY 1) USING (det_id)) WHERE area > 0")(lambda s, d: X.rest_area(pieces(s, d)))
query(
    "cells_in_extent",
    f""", free AS (SELECT scene_id, x, y FROM (SELECT scene_id, det_id, x, unnest(range(pixel_ymin::BIGINT, pixel_ymax::BIGINT)) AS y FROM (
  SELECT scene_id, det_id, pixel_ymin, pixel_ymax, unnest(range(pixel_xmin::BIGINT, pixel_xmax::BIGINT)) AS x FROM det)) ANTI JOIN ({COVERED}) USING (det_id, x, y)),
cx AS (SELECT DISTINCT scene_id, c, y FROM (SELECT scene_id, y, unnest([x // 32, (x + 1) // 32, CASE WHEN x % 32 = 0 THEN x // 32 - 1 ELSE x // 32 END]) AS c FROM (SELECT DISTINCT * FROM free))),
cy AS (SELECT DISTINCT scene_id, c, r FROM (SELECT scene_id, c, unnest([y // 32, (y + 1) // 32, CASE WHEN y % 32 = 0 THEN y // 32 - 1 ELSE y // 32 END]) AS r FROM cx))
SELECT scene_id, cell_id FROM grid SEMI JOIN cy ON cy.scene_id = grid.scene_id AND cy.c = grid.col AND cy.r = grid."row" """,
)(lambda s, d: X.cells_touched(grid(s, d), pieces(s, d)).select(*PLACE))
NAMES = ["background", "rock", "shrub"]
_e = lambda k: f"embedding[6 * q + {k}]::DOUBLE"


def tensors(s, d: str) -> DataFrame:
    """Ten queries of four box values and three logits a vector."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("query"))
    e = lambda k: F.element_at("embedding", F.col("query") * 6 + k).cast("double")
    off = lambda m: (F.expr(m) * 384).cast("int")
    return v.select(F.col("vec_id").alias("tile_id"), off("vec_id % 2").alias("col_off"), off("vec_id div 2 % 2").alias("row_off"), F.lit(512).alias("tile_width"), F.lit(512).alias("tile_height"), "query",
                    (e(1) + 0.55).alias("cx"), (e(2) + 0.55).alias("cy"), (e(3) + 0.55).alias("w"), (e(4) + 0.55).alias("h"), F.array(e(5) * 4, e(6) * 4, (e(5) - e(6)) * 4).alias("logits"))


_side = lambda off, c, s, sign: f"greatest(0, least(1024, {off} + {c} * 512 {sign} {s} * 512 / 2))"
query(
    "tensor_decode",
    f"""SELECT tile_id, query, class_id, class_name, round(confidence, 6) AS confidence, round(x0, 6) AS pixel_xmin, round(y0, 6) AS pixel_ymin, round(x1, 6) AS pixel_xmax, round(y1, 6) AS pixel_ymax FROM (
  SELECT *, ['background', 'rock', 'shrub'][class_id + 1] AS class_name, 1 / (1 + exp(-l)) AS confidence, {_side("ox", "cx", "w", "-")} AS x0, {_side("oy", "cy", "h", "-")} AS y0, {_side("ox", "cx", "w", "+")} AS x1, {_side("oy", "cy", "h", "+")} AS y1 FROM (
  SELECT *, c::INT AS class_id, CASE c WHEN 0 THEN l5 * 4 WHEN 1 THEN l6 * 4 ELSE (l5 - l6) * 4 END AS l FROM (
  SELECT vec_id AS tile_id, q::INT AS query, vec_id % 2 * 384 AS ox, vec_id // 2 % 2 * 384 AS oy, {_e(1)} + 0.55::DOUBLE AS cx, {_e(2)} + 0.55::DOUBLE AS cy, {_e(3)} + 0.55::DOUBLE AS w, {_e(4)} + 0.55::DOUBLE AS h, {_e(5)} AS l5, {_e(6)} AS l6 FROM embeddings, range(10) t(q)), range(1, 3) u(c)))
WHERE confidence >= 0.25 AND x1 > x0 AND y1 > y0""",
)(lambda s, d: rounded(M.from_tensors(tensors(s, d), NAMES, 1024, 1024), "confidence", *D.BOX))


def payloads(s, d: str) -> DataFrame:
    """Detections as JSON in three shapes: under predictions, nested boxes below other keys, a bare list."""
    x, y, w, h = (F.expr(e) for e in ("(pixel_xmin + pixel_xmax) / 2", "(pixel_ymin + pixel_ymax) / 2", "pixel_xmax - pixel_xmin", "pixel_ymax - pixel_ymin"))
    sides = [x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")]
    flat = F.to_json(F.struct(F.array(F.struct(*sides, "confidence", F.col("class_name").alias("class"))).alias("predictions"), F.struct(F.lit(1024).alias("width"), F.lit("1024").alias("height")).alias("image")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(*sides).alias("bbox"), F.col("confidence").alias("score"), F.col("class_name").alias("label"), F.lit("7").alias("classId"))).alias("predictions")).alias("step"))).alias("outputs")))
    bare = F.to_json(F.array(F.struct(*sides, F.col("confidence").alias("class_confidence"), "class_name")))
    kind = F.col("det_id") % 3
    return S.detections(s, d).select(F.col("det_id").alias("tile_id"), F.lit(0).alias("col_off"), F.lit(0).alias("row_off"), F.lit(1024).alias("tile_width"), F.lit(1024).alias("tile_height"), F.when(kind == 0, flat).when(kind == 1, nested).otherwise(bare).alias("payload"))


query("json_decode", "SELECT det_id AS tile_id, class_name, confidence, CASE WHEN det_id % 3 = 1 THEN 7 END::BIGINT AS class_id, pixel_xmin, pixel_ymin, pixel_xmax, pixel_ymax FROM det WHERE confidence >= 0.25 AND pixel_xmax > pixel_xmin AND pixel_ymax > pixel_ymin")(lambda s, d: M.from_json(payloads(s, d), 1024, 1024))
_order = "['0-10', '10-40', '40-100', '>100']"
query("size_report", f"""SELECT scene_id, '| Bin | Count |' || chr(10) || '|---|---:|' || chr(10) || string_agg('| ' || c || ' | ' || n || ' |', chr(10) ORDER BY list_position({_order}, c)) AS report FROM (
  SELECT scene_id, c, count(det_id) AS n FROM (SELECT scene_id, unnest({_order}) AS c FROM scenes) LEFT JOIN (SELECT scene_id, det_id, {_class} AS c FROM {_sized}) USING (scene_id, c) GROUP BY 1, 2) GROUP BY 1""")(lambda s, d: P.size_table(D.size_counts(sized(s, d), BINS, S.scenes(s, d)), D.labels(BINS)))  # fmt: skip
query("size_file_labels", f"SELECT size_class, CASE WHEN size_class = '>100' THEN 'gt_100' ELSE replace(size_class, '-', '_') END AS label, count(*) AS n FROM (SELECT {_class} AS size_class FROM {_sized}) GROUP BY 1")(lambda s, d: sized(s, d).groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).withColumn("label", P.file_label(F.col("size_class"))))
query("tile_counts", "SELECT scene_id, 9::BIGINT AS n FROM scenes")(lambda s, d: sizes(s, d).select("scene_id", D.tile_count(F.col("width"), F.col("height")).alias("n")))
