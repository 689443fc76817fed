"""Detector stage, polygons, projections, settings and sinks on small cases."""

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import decode, geodesy, inference, polygons
from tessera.operators import detections as D
from tessera.operators import reports as P
from tessera.sources import geopackage, settings, shapefiles

RING = "scene_id long, shape_id long, ring array<struct<x:double,y:double>>"


def total(pieces) -> float:
    return sum((xb - xa) * (ha - la + hb - lb) / 2 for xa, xb, la, lb, ha, hb in pieces)


def test_overlay_of_crossing_rings():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    diamond = np.array([(2, -2), (6, 2), (2, 6), (-2, 2)], float)
    assert total(polygons.trapezoids([square, diamond], [])) == pytest.approx(32 + 16 - 16)  # the square lies within
    tri = np.array([(3, 1), (9, 1), (3, 7)], float)
    both = 0.5  # of the square and the triangle: x and y from 3 and 1 to 4, all of it below the long side
    inside = 1 * 3
    assert total(polygons.trapezoids([square, tri], [])) == pytest.approx(16 + 18 - inside)
    assert total(polygons.trapezoids([square], [tri])) == pytest.approx(16 - inside)
    assert total(polygons.trapezoids([square], [diamond])) == 0 and polygons.trapezoids([], [square]) == [] and both
    rng = np.random.default_rng(3)
    rings = [rng.uniform(0, 10, (3, 2)) for _ in range(12)]
    at = rng.uniform(0, 10, (40_000, 2))

    def covers(r):
        out = np.zeros(len(at), bool)
        for p, q in zip(r, np.roll(r, -1, axis=0), strict=True):
            out ^= ((p[1] > at[:, 1]) != (q[1] > at[:, 1])) & (at[:, 0] < p[0] + (at[:, 1] - p[1]) * (q[0] - p[0]) / (q[1] - p[1]))
        return out

    held = np.any([covers(r) for r in rings[:8]], axis=0) & ~np.any([covers(r) for r in rings[8:]], axis=0)
    assert total(polygons.trapezoids(rings[:8], rings[8:])) == pytest.approx(100 * held.mean(), abs=1.0)


def test_overlay_of_many_squares(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rings = {s: [[*map(tuple, (rng.uniform(-60, 300, 2) + rng.uniform(0, r, (k, 2))).tolist())] for r, k in zip(rng.choice([3, 30, 200], 25), rng.integers(3, 7, 25), strict=True)] for s in (0, 1, 2, None)}
    frame = lambda part: spark.createDataFrame([(s, r) for s in rings for r in rings[s][part]], "scene_id long, ring array<struct<x:double,y:double>>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        pieces = polygons.overlay(frame(slice(0, 18)), frame(slice(18, 25)), size=8.0)
        squares = polygons.overlay_area(frame(slice(0, 18)), frame(slice(18, 25)), size=8.0)
        assert not any("GroupsInPandas" in d._jdf.queryExecution().executedPlan().toString() for d in (pieces, squares))  # no call a square
        by = {r.scene_id: r.a for r in pieces.groupBy("scene_id").agg(F.sum(polygons.piece_area()).alias("a")).collect()}
        cells = squares.collect()
        want = {(r.scene_id, int((r.xa + r.xb) // 16), int((r.low_a + r.high_b) // 16)) for r in pieces.collect() if r.xb - r.xa > 1e-6 and min(r.high_a - r.low_a, r.high_b - r.low_b) > 1e-6}
        assert polygons.overlay(frame(slice(0, 0))).collect() == polygons.overlay_area(frame(slice(0, 0))).collect() == []
    finally:
        spark.conf.set(name, before)
    assert len({(r.scene_id, r.gx, r.gy) for r in cells}) == len(cells) and want <= {(r.scene_id, r.gx, r.gy) for r in cells}
    for s, r in rings.items():
        r = [np.array(x) for x in r]
        whole = polygons.trapezoids(r[:18], r[18:])
        assert by[s] == pytest.approx(total(whole)) == pytest.approx(sum(c.area for c in cells if c.scene_id == s))
        with monkeypatch.context() as m:
            m.setattr(polygons, "PAIRS", 40, raising=False)
            assert polygons.trapezoids(r[:18], r[18:]) == whole


def test_rings_as_columns(spark):
    rows = [(0, 1, [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0)]), (0, 2, None), (0, 3, []), (0, 4, [(5.0, 5.0)]), (0, 5, [(1.0, None), (2.0, 2.0), (3.0, 1.0)])]
    shapes = spark.createDataFrame(rows, RING)
    ring = F.col("ring")
    got = polygons.present(shapes).select("shape_id", polygons.area(ring).alias("a"), polygons.centroid(ring).alias("c"), polygons.contains(ring, F.lit(5.0), F.lit(6.0)).alias("in"), polygons.wkt(ring).alias("w")).collect()
    assert {r.shape_id: (r.a, r["in"]) for r in got} == {1: (800.0, True), 4: (0.0, False)}
    assert got[0].c.x == pytest.approx(40 / 3) and got[1].c.x == 5.0 and got[0].w == "POLYGON ((0.0 0.0, 40.0 0.0, 0.0 40.0, 0.0 0.0))"
    cells = {r.cell_id: r.covered for r in polygons.covered_cells(shapes, 32, 32).collect()}
    assert sum(cells.values()) == pytest.approx(800) and cells == pytest.approx({0: 736, 1: 32, 32: 32})
    empty = spark.createDataFrame([], "scene_id long, row int, col int, r int, g int, b int, valid boolean")
    assert {(r.n, r.r) for r in polygons.zonal(shapes, empty, 16.0).collect()} == {(0, 0.0)}
    octagon = [(float(x), float(y)) for x, y in ((0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10))]
    flat = spark.createDataFrame([(0, 1, octagon)], RING).select(polygons.simplified(ring, 0.5).alias("s"), polygons.simplified(ring, 0.0).alias("z")).first()
    assert len(flat.s) == 4 and len(flat.z) == 5


def test_projection_and_ground_size(spark):
    lon, lat = F.col("lon"), F.col("lat")
    x, y = geodesy.to_utm(lon, lat, geodesy.utm_zone(lon))
    at = [(3.0, 0.0), (3.0, 60.0), (2.294497, 48.858222), (180.0, -10.0)]
    rows = spark.createDataFrame(at, "lon double, lat double").select(x.alias("x"), y.alias("y"), geodesy.utm_epsg(lon, lat).alias("e")).collect()
    assert (rows[0].x, rows[0].y, rows[0].e) == (500000.0, 0.0, 32631)
    e2 = geodesy.FLATTENING * (2 - geodesy.FLATTENING)

    def plain(lam, phi):
        """The older series in powers of the longitude, over the meridian's length by sums."""
        steps = (np.arange(200_000) + 0.5) * phi / 200_000
        arc = (geodesy.AXIS * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5).sum() * phi / 200_000
        n, t, c = geodesy.AXIS / np.sqrt(1 - e2 * np.sin(phi) ** 2), np.tan(phi) ** 2, e2 / (1 - e2) * np.cos(phi) ** 2
        k = lam * np.cos(phi)
        east = n * (k + (1 - t + c) * k**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e2 / (1 - e2)) * k**5 / 120)
        north = arc + n * np.tan(phi) * (k * k / 2 + (5 - t + 9 * c + 4 * c * c) * k**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e2 / (1 - e2)) * k**6 / 720)
        return 500000 + 0.9996 * east, 0.9996 * north + (0 if phi >= 0 else 10_000_000)

    for (a, b), r, middle in zip(at, rows, (3, 3, 3, 177), strict=True):
        assert (r.x, r.y) == pytest.approx(plain(np.radians(a - middle), np.radians(b)), abs=0.005)
    assert rows[3].e == 32760
    assert geodesy.manual_cm(2.0) == (2.0, 2.0) and geodesy.manual_cm(x=1.0, y=3.0) == (1.0, 3.0) and geodesy.manual_cm() is None
    for wrong in (lambda: geodesy.manual_cm(x=1.0), lambda: geodesy.unit_metres("cubit"), lambda: geodesy.manual_cm(0.0)):
        with pytest.raises(ValueError):
            wrong()
    assert geodesy.refined((4, 0, 7, 0, -4, 9), 2) == (2, 0, 7, 0, -2, 9)


def test_model_inputs_and_outputs():
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    x = inference.tensor(image, 4, 4)
    assert x.shape == (3, 4, 4) and x.dtype == np.float32 and x[1, 2, 3] == pytest.approx((34 / 255 + 0 - 0.456 + 0) / 0.224, abs=1e-3)
    flat = inference.tensor(np.full((4, 6, 3), 51, np.uint8), 8, 3)
    assert flat.shape == (3, 8, 3) and np.allclose(flat[0], (0.2 - 0.485) / 0.229, atol=1e-5)
    boxes, logits = inference.boxes_and_logits([np.zeros((1, 9, 7)), np.zeros((1, 9, 4)), np.zeros((1, 9, 3)), np.zeros(2)], 3)
    assert boxes.shape[-1] == 4 and logits.shape[-1] == 3
    assert inference.boxes_and_logits([np.zeros((1, 9, 4)), np.zeros((1, 9, 7))], 3)[1].shape[-1] == 7
    with pytest.raises(ValueError):
        inference.boxes_and_logits([np.zeros((1, 9, 4))], None)
    assert inference.backend("a/m.ONNX") == "onnx" and inference.backend("x", "remote") == "remote" and inference.first_match(["b", "a"]) == "a" and inference.first_match([]) is None
    with pytest.raises(ValueError):
        inference.backend("m.bin")


def test_payload_shapes(spark):
    box = {"x": 10, "y": "20", "width": 4, "height": 6}
    deep = "[" * 3000 + "]" * 3000
    cases = {
        "flat": ({"predictions": [box | {"score": 0.9, "class": "log"}, {"x": 1}], "image": {"width": 50, "height": "100"}}, [("log", 0.9)]),
        "inside": ([{"outputs": {"predictions": [{"bounding_box": box, "confidence": 0.5, "classId": "3"}]}}], [("rock", 0.5)]),
        "bare": ([box | {"confidence": 1}], [("rock", 1.0)]),
        "mixed": ([box | {"confidence": 1}, 5], []),
        "weak": ([box], []),
        "number": ([box | {"confidence": "x"}], []),
        "infinite": ([box | {"confidence": 1, "x": float("inf")}], []),
    }
    rows = [(k, 0, 0, 100, 100, json.dumps(v[0])) for k, v in cases.items()] + [("null", 0, 0, 100, 100, None), ("broken", 0, 0, 100, 100, "{"), ("deep", 0, 0, 100, 100, deep)]
    tiles = spark.createDataFrame(rows, "tile_id string, col_off int, row_off int, tile_width int, tile_height int, payload string")
    got = decode.from_json(tiles, 100, 100).collect()
    assert sorted((r.tile_id, r.class_name, r.confidence) for r in got) == sorted((k, *x) for k, v in cases.items() for x in v[1])
    by = {r.tile_id: r for r in got}
    assert (by["flat"].pixel_xmin, by["flat"].pixel_xmax, by["flat"].pixel_ymin) == (16.0, 24.0, 17.0) and by["inside"].class_id == 3 and by["bare"].class_id is None


def test_settings(tmp_path):
    assert settings.env_file("# c\nexport A='x y'\nB=1=2\n\nC\n") == {"A": "x y", "B": "1=2"}
    s = settings.Settings.from_json('{"tile": 640, "breaks": [0.2, 0.5], "api_key": "abc"}')
    assert s.tile == 640 and '"***"' in s.to_json() and "abc" not in s.to_json()
    for wrong in ('{"tile": 0}', '{"overlap": 512}', '{"bins": [5, 3]}', '{"breaks": [0.6, 0.5]}', '{"weights": [0, 0]}', '{"no": 1}', '{"max_tiles": 0}'):
        with pytest.raises(ValueError):
            settings.Settings.from_json(wrong)
    run = settings.run_folder(str(tmp_path), s, "one")
    settings.log(run, "begun")
    assert json.loads((run / "run_config.json").read_text())["tile"] == 640 and (run / "run_log.txt").read_text() == "begun\n"
    model = tmp_path / "m.onnx"
    assert settings.class_names(str(model)) == [] and settings.input_size(str(model)) == 640
    (tmp_path / "classes.txt").write_text("# all\nrock # a\nlog\n")
    (tmp_path / "environment.json").write_text('{"RESOLUTION": "704"}')
    assert settings.class_names(str(model)) == ["rock # a", "log"] and settings.input_size(str(model)) == 704
    assert decode.sidecar_names('{"class_name": ["a"]}') == ["a"] and decode.sidecar_names('{"names": "a, b"}') == ["a", "b"]
    assert decode.sidecar_names('{"names": {"10": "c", "2": "b"}}') == ["b", "c"] and decode.sidecar_names("names:\n  0: x\n  1: y\nnc: 2") == ["x", "y"]


def test_scenes_without_boxes_and_null_edges(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 0, "rock", 0.5, 0.0, 0.0, 5.0, 5.0)], "det_id long, scene_id long, class_name string, confidence double, pixel_xmin double, pixel_ymin double, pixel_xmax double, pixel_ymax double")
    sized = D.sized(boxes, 1.0, 1.0, [10.0])
    scenes = spark.createDataFrame([(0,), (7,)], "scene_id long")
    assert {(r.scene_id, r.size_class): r.n for r in D.size_counts(sized, [10.0], scenes).collect()} == {(0, "0-10"): 1, (0, ">10"): 0, (7, "0-10"): 0, (7, ">10"): 0}
    mapped = D.georeference(sized, 1, 0, 0, 0, 1, 0)
    odd = mapped.unionByName(mapped.withColumn("map_xmax", F.lit(None).cast("double")))
    assert shapefiles.write(odd, str(tmp_path / "s"), sized=True) == 1
    assert shapefiles.write_bins(odd, str(tmp_path / "b"), ["0-10", ">10"]) == {"0-10": 1, ">10": 0} and (tmp_path / "b" / "bin__gt_10").is_dir()
    assert geopackage.write(odd, str(tmp_path / "g.gpkg"), "a b!", 4326) == 1 and geopackage.read(spark, str(tmp_path / "g.gpkg")).first().map_xmax == 5.0
    with pytest.raises(FileExistsError):
        geopackage.write(odd, str(tmp_path / "g.gpkg"), "x", 4326)
    assert geopackage.layer_name("__") == "detections" and geopackage.layer_name("a b!") == "a_b"


def test_geopackage_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geopackage, "SHARE", 700, raising=False)
    monkeypatch.setattr(geopackage, "BLOCK", 300, raising=False)
    i = F.col("id")
    boxes = spark.range(0, 5000, 1, 7).select(*[(F.when(i % 10 > 0, i) if c == "map_xmin" else i + k).cast("double").alias(c) for k, c in enumerate(geopackage.MAP)], F.when(i % 3 > 0, i.cast("string")).alias("class_name"), F.when(i % 4 > 0, i / 5000).alias("confidence"))
    path = f"file://{tmp_path}/a b%.gpkg"
    assert geopackage.write(boxes, path, "x", 32619) == 4500 and [p.name for p in tmp_path.iterdir()] == ["a b%.gpkg"]
    back = geopackage.read(spark, path)
    assert "MapInArrow" in back._jdf.queryExecution().executedPlan().toString() and back.rdd.getNumPartitions() == 7  # not from a list of the driver's
    want = [(*(float(k + d) for d in range(4)), str(k) if k % 3 else None, k / 5000 if k % 4 else None, None) for k in range(5000) if k % 10]
    assert [tuple(r) for r in back.collect()] == want
    db = sqlite3.connect(tmp_path / "a b%.gpkg")
    assert db.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchall() == [(1, 2, 5001, 5002, 32619)]
    geom = db.execute("SELECT geom FROM x WHERE fid = 1").fetchone()[0]
    assert geom == b"GP\x00\x01" + struct.pack("<ibIII10d", 32619, 1, 3, 1, 5, 1, 2, 3, 2, 3, 4, 1, 4, 1, 2) and db.execute("PRAGMA application_id").fetchone() == (0x47504B47,)
    none = f"{tmp_path}/none.gpkg"
    assert geopackage.write(boxes.filter("id < 0"), none, "x", 4326) == 0 and geopackage.read(spark, none).collect() == []
    with pytest.raises(ValueError):
        geopackage.write(boxes, "hdfs://a/b.gpkg", "x", 4326)


def test_durations_and_labels(spark):
    rows = spark.createDataFrame([(-3.0,), (0.5,), (61.4,), (3723.0,)], "s double").select(P.duration(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == ["0s", "0s", "1m01s", "1h02m03s"]
    assert P.labels_to_write(["a", "b", "c"], False, "b") == ["b"] and P.labels_to_write(["a", "b"], True, None) == ["a", "b"] and P.labels_to_write(["a"], False, None) == []
    left = spark.createDataFrame([(10.0, 2, 4), (5.0, 0, 4), (5.0, 4, 4)], "e double, d long, t long").select(P.remaining(F.col("e"), F.col("d"), F.col("t")).alias("r")).collect()
    assert [r.r for r in left] == [10.0, 0.0, 0.0]
