"""Files, polygons, interpolation and decoding on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import decode, erase, rasters
from tessera.sources import geotiff, shapefiles

CELLS = "scene_id long, cell_id int, row int, col int, zone_id int, score float"


def grid(rows):
    return [(0, r * len(line) + c, r, c, int(ch), int(ch) / 4) for r, line in enumerate(rows) for c, ch in enumerate(line)]


def test_parts_and_polygons(spark):
    # a ring around a hole, a corner touch, and one long snake
    cells = spark.createDataFrame(grid(["111001111", "101100001", "111001111", "222201000", "000201111"]), CELLS)
    found = rasters.parts(cells)
    n = {(r.zone_id, r.part): r["count"] for r in found.groupBy("zone_id", "part").count().collect()}
    assert n == {(1, 0): 9, (1, 5): 14, (2, 27): 5}
    assert rasters.parts(cells, diagonal=True).select("zone_id", "part").distinct().count() == 3
    wkt = {r.part: r.wkt for r in rasters.polygons(found).collect()}
    for part, text in wkt.items():
        rings = [[tuple(map(int, p.split())) for p in ring.split(", ")] for ring in text[10:-2].split("), (")]
        areas = [abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2 for r in rings]
        assert all(r[0] == r[-1] for r in rings) and areas[0] - sum(areas[1:]) == next(v for (_, p), v in n.items() if p == part)
    assert wkt[0].count("(") == 3
    assert rasters.parts(cells.limit(0)).count() == 0


@pytest.mark.parametrize("factor", [1, 3])
def test_cubic_against_plain_sums(spark, factor):
    rng = np.random.default_rng(1)
    a = rng.uniform(0.1, 1, (9, 9))
    a[4, 7] = 0
    cells = spark.createDataFrame([(0, 0, r, c, 1, float(a[r, c])) for r in range(9) for c in range(9)], CELLS)
    got = {(r.row, r.col): r.score for r in rasters.interpolated(cells, factor, "cubic").collect()}
    a = a.astype("f4").astype("f8")
    assert len(got) == 80 * factor**2
    k = lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) < 1 else -0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 if abs(x) < 2 else 0
    for (y, x), v in got.items():
        u, w = (y + 0.5) / factor - 0.5, (x + 0.5) / factor - 0.5
        if 2 < u < 5 and 2 < w < 4:
            assert v == pytest.approx(sum(a[i, j] * k(u - i) * k(w - j) for i in range(9) for j in range(9)), abs=1e-6)


def test_shapefiles_round_trip(spark, tmp_path):
    rows = [("rock", 0.5, 3, 1.0, 2.0, 3.0, 4.0, 10.0, 20.0, 30.0, 40.0), ("é" + "x" * 60, 0.25, None, 0.0, 0.0, 1.0, 1.0, -5.0, 2.0, 6.0, 8.0), (None, 0.125, 0, 9.0, 9.0, 10.0, 10.0, 0.0, 0.0, 1.0, 1.0)]
    cols = "class_name string, confidence double, class_id long, pixel_xmin double, pixel_ymin double, pixel_xmax double, pixel_ymax double, map_xmin double, map_ymin double, map_xmax double, map_ymax double"
    boxes = spark.createDataFrame(rows, cols).repartition(2)
    assert shapefiles.write(boxes, str(tmp_path / "a"), projection="LOCAL_CS[]") == 3
    got = sorted(tuple(r) for r in shapefiles.read(spark, str(tmp_path / "a")).select("confidence", "class_name", "class_id", "map_xmin", "map_ymax", "pixel_xmax").collect())
    assert got == [(0.125, None, 0, 0.0, 1.0, 10.0), (0.25, "x" * 49, None, -5.0, 8.0, 1.0), (0.5, "rock", 3, 10.0, 40.0, 3.0)]
    with pytest.raises(FileExistsError):
        shapefiles.write(boxes, str(tmp_path / "a"))
    for shp in (tmp_path / "a").glob("*.shp"):
        data = shp.read_bytes()
        assert int.from_bytes(data[24:28], "big") * 2 == len(data) and shp.with_suffix(".prj").exists()
    assert shapefiles.write(boxes.limit(0), str(tmp_path / "a"), overwrite=True) == 0


def test_geotiff_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(s, r, c, (r * 40 + c + s) / 7, r, c, s, 255) for s in (1, 2) for r in range(33) for c in range(40) if (r + c) % 5], "scene_id long, row int, col int, score float, red int, green int, blue int, alpha int")
    assert geotiff.write(cells, str(tmp_path / "f"), ["score"], 40, 33).count() == 2
    back = geotiff.read(spark, str(tmp_path / "f")).filter("valid").select(F.regexp_extract("path", r"scene_(\d+)", 1).cast("long").alias("scene_id"), "row", "col", F.element_at("values", 1).cast("float").alias("score"))
    assert back.exceptAll(cells.select("scene_id", "row", "col", "score")).count() == 0 and back.count() == cells.count()
    geotiff.write(cells, str(tmp_path / "b"), ["red", "green", "blue", "alpha"], 40, 33, nodata=None).count()
    got = geotiff.rgb(geotiff.read(spark, str(tmp_path / "b"))).filter("element_at(values, 4) = 255")
    assert got.count() == cells.count() and got.filter("r <> row or g <> col").count() == 0


def test_json_payloads(spark):
    box = '{"x": 5, "y": 5, "width": 4, "height": 2, "confidence": "0.9"}'
    texts = [None, "", "{", "[]", f"[{box}, 3]", f"[{box}, {box}]", f'{{"a": {{"predictions": [{box}, {{}}], "image": {{"width": 50}}}}, "b": [[{box}]]}}', '[{"x": "q", "y": 1, "width": 2, "height": 2, "score": 1, "class_id": "z"}]']
    tiles = spark.createDataFrame([(i, 0, 0, 100, 100, t) for i, t in enumerate(texts)], "tile_id long, col_off int, row_off int, tile_width int, tile_height int, payload string")
    got = [(r.tile_id, r.class_id, r.pixel_xmin, r.pixel_xmax) for r in decode.from_json(tiles, 100, 100).orderBy("tile_id", "pixel_xmax").collect()]
    assert got == [(5, None, 3.0, 7.0), (5, None, 3.0, 7.0), (6, None, 3.0, 7.0), (6, None, 6.0, 14.0), (7, None, 0.0, 1.0)]


def test_sidecars_and_names(spark):
    for text in ('["a", "b"]', '{"classes": {"1": "b", "0": "a"}}', '{"names": ["a", "b"]}', "a, b", "# x\na\nb\n", "names:\n  0: a\n  1: 'b'\n", "names: [a, b]", "names:\n- a\n- b"):
        assert decode.sidecar_names(text) == ["a", "b"], text
    ids = spark.createDataFrame([(0,), (5,), (None,)], "i int")
    assert [r[0] for r in ids.select(decode.class_name(F.col("i"), ["a", "b"])).collect()] == ["a", "5", "rock"]
    assert [r[0] for r in ids.select(decode.class_name(F.col("i"), ["a"])).collect()] == ["a", "5", "a"]


def test_erase_by_overlapping_boxes(spark):
    kinds = "scene_id long, {0}xmin double, {0}ymin double, {0}xmax double, {0}ymax double"
    rocks = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 20.0, 0.0, 24.0, 4.0), (3, 0, 250.0, 250.0, 262.0, 262.0)], "det_id long, " + kinds.format("pixel_"))
    canopy = spark.createDataFrame([(0, 2.0, 2.0, 6.0, 6.0), (0, 4.0, 4.0, 12.0, 8.0), (0, 19.0, -1.0, 30.0, 9.0), (0, 255.0, 255.0, 257.0, 257.0), (1, 0.0, 0.0, 99.0, 99.0)], kinds.format(""))
    left = {r.det_id: r.area for r in erase.rest_area(erase.erased(rocks, canopy)).collect()}
    assert left == {1: 100 - 16 - 24 + 4, 3: 140}
