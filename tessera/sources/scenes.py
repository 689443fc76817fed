"""Scene inputs: detections, canopy boxes and raster pixels, derived from the given tables.

A scene is a canvas of 1024 x 1024 map units with y down; a raster pixel is 16 units wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANVAS, PIXEL = 1024, 16

DETECTIONS = """
SELECT o_orderkey AS det_id, {o_orderkey div 3000} AS scene_id,
  CASE o_orderstatus WHEN 'F' THEN 'rock' WHEN 'O' THEN 'shrub' ELSE 'log' END AS class_name,
  ((o_orderkey*o_orderkey*17 + o_orderkey*7919)%997)/cast(1000 AS DOUBLE) AS confidence,
  cast(x0 AS DOUBLE) AS pixel_xmin, cast(y0 AS DOUBLE) AS pixel_ymin,
  cast(least(x0+6+o_custkey%41,1024) AS DOUBLE) AS pixel_xmax, cast(least(y0+6+(o_custkey*3+o_orderkey)%41,1024) AS DOUBLE) AS pixel_ymax
FROM (SELECT *, (o_orderkey*o_orderkey*31+o_orderkey*7907)%1013 AS x0,
                (o_orderkey*o_orderkey*13+o_orderkey*6871)%1009 AS y0 FROM orders)"""
CANOPY = """
SELECT p_partkey AS canopy_id, {p_partkey div 400} AS scene_id, cast(x0 AS DOUBLE) AS xmin, cast(y0 AS DOUBLE) AS ymin,
  cast(x0+10+p_size AS DOUBLE) AS xmax, cast(y0+10+(p_partkey*3)%45 AS DOUBLE) AS ymax
FROM (SELECT *, (p_partkey*p_partkey*29+p_partkey*631)%997 AS x0, (p_partkey*p_partkey*7+p_partkey*877)%991 AS y0 FROM part)"""


def _duck(sql: str) -> str:
    return sql.replace("{o_orderkey div 3000}", "o_orderkey//3000").replace("{p_partkey div 400}", "p_partkey//400")


def _spark(sql: str, table: str, frame: str) -> str:
    return sql.replace("{", "").replace("}", "").replace(f"FROM {table}", f"FROM {frame}")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_spark(DETECTIONS, "orders", "{t}"), t=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_spark(CANOPY, "part", "{t}"), t=spark.read.parquet(f"{sf_dir}/part.parquet"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("scene_id").distinct()


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, row, col, r, g, b, valid): 64 x 64 a scene; as many rasters in turn as the table has whole groups of 64 vectors."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rasters = max(1, table.count() // 64)
    v = table.filter(F.col("vec_id") < 64 * rasters).select("vec_id", "embedding", F.posexplode("embedding").alias("col", "_"))
    band = lambda k: F.expr(f"cast(greatest(0, least(255, floor((cast(element_at(embedding, (col + {k}) % 64 + 1) as double) + 0.55D) * 230))) as int)")
    p = v.select(F.expr("vec_id div 64").alias("_band"), F.expr("cast(vec_id % 64 as int)").alias("row"), "col", band(0).alias("r"), band(21).alias("g"), band(42).alias("b"), F.expr("(vec_id * 64 + col) % 17 <> 0").alias("valid"))
    s = scenes(spark, sf_dir).withColumn("_band", F.col("scene_id") % rasters)
    return s.join(p, "_band").select("scene_id", "row", "col", "r", "g", "b", "valid")


#: The same inputs as DuckDB common table expressions.
SQL = f"""det AS ({_duck(DETECTIONS)}),
canopy AS ({_duck(CANOPY)}),
scenes AS (SELECT DISTINCT scene_id FROM det),
pix AS (SELECT s.scene_id, (v.vec_id%64)::INT AS "row", v.col::INT AS col,
  greatest(0,least(255,floor((embedding[col+1]::DOUBLE+0.55)*230)::INT)) AS r,
  greatest(0,least(255,floor((embedding[(col+21)%64+1]::DOUBLE+0.55)*230)::INT)) AS g,
  greatest(0,least(255,floor((embedding[(col+42)%64+1]::DOUBLE+0.55)*230)::INT)) AS b,
  (v.vec_id*64+v.col)%17 <> 0 AS valid
  FROM scenes s JOIN (SELECT vec_id, unnest(range(64)) AS col, embedding FROM embeddings WHERE vec_id < (SELECT greatest(1, count(*) // 64) * 64 FROM embeddings)) v ON v.vec_id//64 = s.scene_id % (SELECT greatest(1, count(*) // 64) FROM embeddings))"""
