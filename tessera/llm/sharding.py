"""Extendible hashing of documents into shards under a byte limit.

A document's key is the first 60 bits of the MD5 of its doc_id. The directory is indexed by a
prefix of the key; a bucket splits on one more bit only while it holds more than the limit, so
shards have prefixes of different lengths and none overlap. Byte sums of all prefixes come from one
aggregation over fine cells, and each cell points at its shortest prefix that fits; cells that are
still too large go another round with eight more bits. Only sums by cell meet; documents move once,
by cell, and the cells are even because the key is a hash.

Defined cases: null or empty text has 0 bytes and still gets a shard; a null doc_id hashes as the
empty string; an empty table gives no rows; one document over the limit, or rows that share one
doc_id, cannot split and make a shard of their own with ``oversized`` true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored

BITS = 60
#: Production size of a shard: what a loader fetches by one request and shuffles as a unit.
SHARD_BYTES = 256 * 1024
SLACK, DEEPER = 4, 8


def key() -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix as bits), shard_docs, shard_bytes, oversized."""
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), key().alias("_h"))
    rows = stored(rows, "sharding-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits, parts = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK), []
    while True:
        cell = F.shiftright("_h", BITS - bits)
        sums = rows.groupBy(cell.alias("_c")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        paths = sums.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("p", F.expr(f"shiftright(_c, {bits} - d)"))
        nodes = paths.groupBy("d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), (F.min("lo") == F.max("hi")).alias("one"))
        fits = nodes.filter((F.col("b") <= limit) | F.col("one") | (F.lit(bits) == BITS) & (F.col("d") == BITS))
        directory = paths.select("_c", "d", "p").join(fits, ["d", "p"]).groupBy("_c").agg(F.min(F.struct("d", "p", "n", "b")).alias("leaf"))
        placed = stored(rows.withColumn("_c", cell).join(directory, "_c", "left"), "sharding-placed")
        parts.append(placed.filter(F.col("leaf").isNotNull()))
        rows = placed.filter(F.col("leaf").isNull()).select("doc_id", "n_bytes", "_h")
        if bits == BITS or rows.isEmpty():
            break
        bits = min(BITS, bits + DEEPER)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    name = F.when(F.col("leaf.d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(leaf.p), leaf.d, '0')"))
    return out.select("doc_id", "n_bytes", F.col("leaf.d").alias("depth"), name.alias("shard"), F.col("leaf.n").alias("shard_docs"), F.col("leaf.b").alias("shard_bytes"), (F.col("leaf.b") > limit).alias("oversized"))


def op10(spark, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


def sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
x AS (SELECT r.*, d::INTEGER AS depth, h >> ({BITS} - d)::INTEGER AS p FROM r, range(0, {BITS + 1}) AS t(d)),
s AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS n, min(h) OVER w = max(h) OVER w AS one
      FROM x WINDOW w AS (PARTITION BY depth, p)),
f AS (SELECT doc_id, n_bytes, h, min(depth) AS depth, arg_min(p, depth) AS p, arg_min(n, depth) AS n, arg_min(b, depth) AS b
      FROM s WHERE b <= {limit} OR one OR depth = {BITS} GROUP BY doc_id, n_bytes, h)
SELECT r.doc_id, r.n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard,
       n::BIGINT AS shard_docs, b::BIGINT AS shard_bytes, b > {limit} AS oversized
FROM r JOIN f ON r.h = f.h AND r.n_bytes = f.n_bytes AND r.doc_id IS NOT DISTINCT FROM f.doc_id"""
