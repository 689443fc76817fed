"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate; the rates nearest to 1 in relative entropy that give every source its
target words, none over CAP, are exp(dual * words of the document), cut at CAP, with a dual variable for each
source's token constraint. The dual is convex; each Newton iteration takes the tilted words (the
gradient) and their slope (the Hessian, which is diagonal) of all sources from one distributed sum over the counts
of (source, size), held within a bracket of the solution. Sums are exact decimals, so reruns agree.

Rates become whole copies. A document gets the whole part of its rate, and one more if a hash of doc_id, less the
rest of its rate, is under a limit; the source's limit is where its words meet the target, near 0. A small pool of
documents of every size on both sides of that limit, a few of each power of two, is then chosen anew: largest
first, whatever still fits, from several starting sizes, and one over the target where that is nearer. What a
source's documents get therefore follows from a few values (dual, limit, ids of the pool), so copies are decided
row by row: documents are joined with one small row for each source and never shuffled by source.

Defined cases: null or blank text has size 0, rate 1 and one copy, which takes no words; a null source is a source of
its own, last in order; a source without words has target 0; a target of CAP times a source's words gives every
document CAP copies; rows that share doc_id and size are decided alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BUCKETS = 3  # hex digits of the hash by which sums are gathered
STEPS, RESIDUAL = 200, 1e-12  # of the Newton iterations, at most, and of target words
POOL, STARTS = 8, 32  # documents of a power of two on each side of the limit that are chosen anew; starting sizes tried
WORD = r"[^\x20\x09-\x0D]+"


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to (_s, source_size): weights in turn by code point, null last; no target over twice its size."""
    last = W.orderBy(F.col("_s").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(last) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("_cap", (CAP * F.col("source_size")).cast("double"))
    before = W.orderBy(F.col("_cap") / F.col("weight"), F.col("_s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rest = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    s = s.withColumn("_t", rest / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("_full", F.col("_cap") <= F.col("_t") * F.col("weight"))
    s = s.withColumn("_level", F.max(F.when(~F.col("_full"), F.col("_t"))).over(whole))
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * F.col("_level"))).drop("_cap", "_t", "_full", "_level")


def solved(rows: DataFrame, s: DataFrame) -> DataFrame:
    """Add ``dual`` to s (_s, source_size, target): the solution of sum(size * min(CAP, exp(dual * size))) = target; null for none or all.

    As sizes are 1 or more, it lies between 0 and log(target / source_size).
    """
    sizes = stored(rows.filter("size > 0").groupBy(F.col("_s").alias("_hs"), "size").agg(F.count(F.lit(1)).alias("n")), "mixing-sizes")
    ratio = F.log(F.col("target") / F.col("source_size"))
    open_ = s.filter((F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size")))
    state = open_.select(F.col("_s").alias("_ds"), F.col("target").alias("_t"), F.least(F.lit(0.0), ratio).alias("_lo"), F.greatest(F.lit(0.0), ratio).alias("_hi"), F.lit(0.0).alias("dual"), F.lit(False).alias("_met"))
    state, exact = stored(state, "mixing-dual"), lambda c: F.sum(c.cast("decimal(28,9)")).cast("double")
    step = 0
    while step < STEPS and not state.filter("not _met").isEmpty():
        step += 1
        tilted = sizes.join(state.filter("not _met"), F.col("_hs").eqNullSafe(F.col("_ds"))).withColumn("_e", F.exp(F.col("dual") * F.col("size")))
        words = F.col("n") * F.col("size") * F.least(F.lit(float(CAP)), F.col("_e"))
        slope = F.when(F.col("_e") < CAP, F.col("n") * F.col("size") * F.col("size") * F.col("_e")).otherwise(F.lit(0.0))
        sums = tilted.groupBy(F.col("_ds").alias("_gs")).agg(exact(words).alias("_f"), exact(slope).alias("_g"))
        q = state.join(sums, F.col("_ds").eqNullSafe(F.col("_gs")), "left")
        low, high = F.when(F.col("_f") < F.col("_t"), F.col("dual")).otherwise(F.col("_lo")), F.when(F.col("_f") >= F.col("_t"), F.col("dual")).otherwise(F.col("_hi"))
        newton = F.col("dual") - F.log(F.col("_f") / F.col("_t")) * F.col("_f") / F.when(F.col("_g") > 0, F.col("_g"))
        inside = (newton > low) & (newton < high) if step <= 30 or step % 2 else F.lit(False)
        after = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise((low + high) / 2)
        met = F.col("_met") | (F.abs(F.col("_f") - F.col("_t")) <= RESIDUAL * F.col("_t")) | (after == F.col("dual"))
        state = stored(q.select("_ds", "_t", F.when(F.col("_met"), F.col("_lo")).otherwise(low).alias("_lo"), F.when(F.col("_met"), F.col("_hi")).otherwise(high).alias("_hi"), F.when(met, F.col("dual")).otherwise(after).alias("dual"), met.alias("_met")), "mixing-dual")
    return s.join(state.select("_ds", "dual"), s["_s"].eqNullSafe(F.col("_ds")), "left").drop("_ds")


def rate() -> Column:
    """Of a row joined with its source's target, source_size and dual."""
    full = F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    tilt = F.least(F.lit(float(CAP)), F.exp(F.col("dual") * F.col("size")))
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(tilt, full))


def tilted(rows: DataFrame, s: DataFrame) -> DataFrame:
    """rows (_s, _k: hash of doc_id, size) with their source's columns, ``rate``, ``whole``, and _k as the rank by hash less the rest of the rate."""
    t = rows.join(s.withColumnRenamed("_s", "_ts"), F.col("_s").eqNullSafe(F.col("_ts"))).drop("_ts").withColumn("rate", rate())
    t = t.withColumn("whole", F.floor(F.col("rate") + 1e-9))
    unit = F.conv(F.substring("_k", 1, 10), 16, 10).cast("double") / float(1 << 40)
    level = F.floor((unit - (F.col("rate") - F.col("whole")) + 1) * float(1 << 39)).cast("long")
    return t.withColumn("_k", F.concat(F.lower(F.lpad(F.hex(level), 10, "0")), F.col("_k")))


def plan(rows: DataFrame) -> DataFrame:
    """For each source what decides its documents' copies. rows: _s, _k (hash of doc_id), size."""
    sums = rows.groupBy("_s").agg(F.sum("size").alias("source_size"))
    s = stored(solved(rows, stored(targets(sums), "mixing-targets")), "mixing-sources")
    rows = tilted(rows, s)
    got = rows.groupBy(F.col("_s").alias("_gs")).agg(F.sum(F.col("whole") * F.col("size")).alias("_got"))
    s = s.join(got, F.col("_s").eqNullSafe(F.col("_gs")), "left").drop("_gs").withColumn("_gap", F.col("target") - F.col("_got")).drop("_got")
    s = stored(s, "mixing-gaps")
    rows = rows.filter(F.col("whole") < CAP).select("_s", "_k", "size")

    # the hash below which documents get one more copy: sums by leading digits first, then the rows of one of them
    digits = F.substring("_k", 1, BUCKETS)
    cells = rows.groupBy("_s", digits.alias("_d")).agg(F.sum("size").alias("z"))
    upto = W.partitionBy("_s").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("z1", F.sum("z").over(upto)).withColumn("z0", F.col("z1") - F.col("z"))
    gap = s.select("_s", "_gap")
    edge = cells.join(gap, cells["_s"].eqNullSafe(gap["_s"])).drop(gap["_s"]).filter((F.col("z0") <= F.col("_gap")) & (F.col("z1") > F.col("_gap")))
    edge = edge.groupBy("_s").agg(F.min(F.struct("_d", "z0", "_gap")).alias("e")).select(F.col("_s").alias("_es"), F.col("e._d").alias("_ed"), "e.z0", "e._gap")
    in_edge = rows.withColumn("_d", digits)
    in_edge = in_edge.join(edge, in_edge["_s"].eqNullSafe(edge["_es"]) & (in_edge["_d"] == edge["_ed"]))
    run = F.col("z0") + F.sum("size").over(W.partitionBy("_s").orderBy("_k").rangeBetween(W.unboundedPreceding, 0))
    over = in_edge.withColumn("_run", run).filter(F.col("_run") > F.col("_gap"))
    limit = over.groupBy("_s").agg(F.min("_k").alias("limit")).withColumnRenamed("_s", "_ls")
    s = s.join(limit, s["_s"].eqNullSafe(limit["_ls"]), "left").drop("_ls").withColumn("limit", F.coalesce("limit", F.lit("g")))
    s = s.withColumn("limit", F.when(F.col("_gap") > 0, F.col("limit")).otherwise(F.lit("")))
    return _chosen(rows, stored(s, "mixing-limits"))


def _chosen(rows: DataFrame, s: DataFrame) -> DataFrame:
    """Add to s extra (ids from the limit on that get one more copy) and without (ids before it that do not)."""
    p = s.filter("_gap > 0").select(F.col("_s").alias("_ps"), "_gap", "limit")
    side = rows.join(p, rows["_s"].eqNullSafe(p["_ps"])).filter("size > 0").withColumn("_in", F.col("_k") < F.col("limit"))
    nearest = W.partitionBy("_s", "_in", F.length(F.bin("size"))).orderBy(F.when(~F.col("_in"), F.col("_k")), F.when(F.col("_in"), F.col("_k")).desc())
    keys = side.withColumn("_i", F.row_number().over(nearest)).filter(F.col("_i") <= POOL).select("_ps", F.col("_k").alias("_pk")).distinct()
    took = side.filter("_in").groupBy("_ps").agg(F.sum("size").alias("took"))
    pool = rows.join(keys, rows["_s"].eqNullSafe(keys["_ps"]) & (rows["_k"] == keys["_pk"])).groupBy("_ps", "_k").agg(F.sum("size").alias("z"))
    pool = pool.groupBy("_ps").agg(F.reverse(F.array_sort(F.collect_list(F.struct("z", F.col("_k").alias("k"))))).alias("pool"))

    q = p.join(pool.withColumnRenamed("_ps", "_qs"), F.col("_ps").eqNullSafe(F.col("_qs"))).drop("_qs")
    took = took.withColumnRenamed("_ps", "_qs")
    q = q.join(took, F.col("_ps").eqNullSafe(F.col("_qs")), "left").drop("_qs")
    back = F.aggregate(F.filter("pool", lambda x: x["k"] < F.col("limit")), F.lit(0).cast("long"), lambda n, x: n + x["z"])
    q = q.withColumn("_open", F.col("_gap") - F.coalesce("took", F.lit(0)) + back)
    none = F.struct(F.col("_open").alias("gap"), F.array().cast("array<string>").alias("ids"))
    fit = lambda a, x: F.when(x["z"] <= a["gap"], F.struct((a["gap"] - x["z"]).alias("gap"), F.array_append(a["ids"], x["k"]).alias("ids"))).otherwise(a)
    tries = F.transform(F.sequence(F.lit(1), F.least(F.lit(STARTS), F.size("pool"))), lambda i: F.struct(i.alias("i"), F.aggregate(F.slice("pool", i, F.size("pool")), none, fit).alias("a")))
    rest = lambda t: F.try_element_at(F.filter("pool", lambda x: (x["z"] > t["a"]["gap"]) & ~F.array_contains(t["a"]["ids"], x["k"])), F.lit(-1))
    tries = F.transform(tries, lambda t: F.struct(t["i"].alias("i"), t["a"].alias("a"), rest(t).alias("o")))
    over = lambda t: F.coalesce(t["o"]["z"] < 2 * t["a"]["gap"], F.lit(False))
    tries = F.transform(tries, lambda t: F.struct(
        F.when(over(t), t["o"]["z"] - t["a"]["gap"]).otherwise(t["a"]["gap"]).alias("off"), t["i"].alias("i"),
        F.when(over(t), F.array_append(t["a"]["ids"], t["o"]["k"])).otherwise(t["a"]["ids"]).alias("ids"),
    ))
    q = q.withColumn("ids", F.array_min(tries)["ids"])
    q = q.select("_ps", F.filter("ids", lambda k: k >= F.col("limit")).alias("extra"), F.transform(F.filter("pool", lambda x: (x["k"] < F.col("limit")) & ~F.array_contains("ids", x["k"])), lambda x: x["k"]).alias("without"))
    nothing = F.array().cast("array<string>")
    s = s.join(q, s["_s"].eqNullSafe(q["_ps"]), "left").drop("_ps")
    return stored(s.withColumns({c: F.coalesce(c, nothing) for c in ("extra", "without")}), "mixing-choice")


def copies() -> Column:
    """Of a row of tilted() by plan()."""
    more = (F.col("_k") < F.col("limit")) & ~F.array_contains("without", F.col("_k")) | F.array_contains("extra", F.col("_k"))
    return F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(CAP), F.col("whole") + more.cast("long"))).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("_s"), _key().alias("_k"), size().alias("size"))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of every row of docs."""
    rows = stored(_rows(docs), "mixing-rows")
    out = tilted(rows, plan(rows)).withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.round("rate", 4).alias("rate"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    p = plan(stored(_rows(docs).drop("doc_id"), "mixing-rows"))
    whole = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_s"), _key().alias("_k"), size().alias("size"))
    out = tilted(whole, p).withColumn("_c", copies()).filter(F.col("_c") > 0)
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c")))).select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return decide(documents(spark, sf_dir))


def sql() -> str:
    return f"""
WITH RECURSIVE r AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS t
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, CASE WHEN cap <= t * weight THEN cap ELSE weight * max(t) FILTER (cap > t * weight) OVER () END AS target FROM s2),
hs AS (SELECT source, list((size, n)) AS xs FROM (SELECT source, size, count(*)::DOUBLE AS n FROM r WHERE size > 0 GROUP BY ALL) GROUP BY source),
dual AS (SELECT s3.source, xs, target, least(0, ln(target / source_size)) AS lo, greatest(0, ln(target / source_size)) AS hi, 0 AS i
  FROM s3 JOIN hs ON s3.source IS NOT DISTINCT FROM hs.source WHERE target > 0 AND target < {CAP} * source_size
  UNION ALL SELECT source, xs, target, CASE WHEN f < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < target THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(xs, lambda x: x[2] * x[1] * least({CAP}, exp((lo + hi) / 2 * x[1])))) AS f FROM dual WHERE i < 100)),
s4 AS (SELECT s3.*, (lo + hi) / 2 AS d FROM s3 LEFT JOIN dual ON s3.source IS NOT DISTINCT FROM dual.source AND i = 100),
u AS (SELECT doc_id, r.source, k AS h, size, CASE WHEN size = 0 THEN 1 WHEN d IS NOT NULL THEN least({CAP}, exp(d * size)) WHEN source_size > 0 THEN least({CAP}, target / source_size) ELSE 0 END::DOUBLE AS rate
  FROM r JOIN s4 ON r.source IS NOT DISTINCT FROM s4.source),
v AS (SELECT *, lpad(printf('%x', floor((('0x' || substr(h, 1, 10))::BIGINT / {float(1 << 40)}::DOUBLE - (rate - whole) + 1) * {float(1 << 39)}::DOUBLE)::BIGINT), 10, '0') || h AS k
  FROM (SELECT *, floor(rate + 1e-9::DOUBLE)::BIGINT AS whole FROM u)),
s6 AS (SELECT s4.*, target - got AS gap FROM s4 JOIN (SELECT source, sum(whole * size) AS got FROM v GROUP BY source) g ON s4.source IS NOT DISTINCT FROM g.source),
rr AS (SELECT doc_id, source, k, size FROM v WHERE whole < {CAP}),
run AS (SELECT rr.*, sum(size) OVER (PARTITION BY source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z FROM rr),
lims AS (SELECT run.source, min(k) FILTER (z > gap) AS lim FROM run JOIN s6 ON run.source IS NOT DISTINCT FROM s6.source GROUP BY run.source),
s7 AS (SELECT s6.*, CASE WHEN gap > 0 THEN coalesce(lim, 'g') ELSE '' END AS lim FROM s6 LEFT JOIN lims ON s6.source IS NOT DISTINCT FROM lims.source),
near AS (SELECT rr.*, lim, row_number() OVER (PARTITION BY rr.source, rr.k < lim, length(bin(size)) ORDER BY CASE WHEN rr.k >= lim THEN rr.k END, CASE WHEN rr.k < lim THEN rr.k END DESC) AS i
  FROM rr JOIN s7 ON rr.source IS NOT DISTINCT FROM s7.source WHERE gap > 0 AND size > 0),
pool AS (SELECT rr.source, rr.k, sum(size)::BIGINT AS z FROM rr JOIN (SELECT DISTINCT source, k FROM near WHERE i <= {POOL}) p ON rr.source IS NOT DISTINCT FROM p.source AND rr.k = p.k GROUP BY ALL),
arr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY z DESC, k DESC) AS i FROM pool),
g0 AS (SELECT source, lim, gap - coalesce((SELECT sum(size) FROM rr WHERE rr.source IS NOT DISTINCT FROM s7.source AND rr.k < s7.lim), 0)
  + coalesce((SELECT sum(z) FROM pool WHERE pool.source IS NOT DISTINCT FROM s7.source AND pool.k < s7.lim), 0) AS gap FROM s7 WHERE gap > 0),
walk AS (SELECT g0.source, arr.i AS st, arr.i - 1 AS i, gap::DOUBLE AS gap, []::VARCHAR[] AS ids FROM g0 JOIN arr ON arr.source IS NOT DISTINCT FROM g0.source WHERE arr.i <= {STARTS}
  UNION ALL SELECT w.source, st, a.i, CASE WHEN z <= gap THEN gap - z ELSE gap END, CASE WHEN z <= gap THEN list_append(ids, k) ELSE ids END
  FROM walk w JOIN arr a ON a.source IS NOT DISTINCT FROM w.source AND a.i = w.i + 1),
ends AS (SELECT w.*, (SELECT min((z, k)) FROM arr a WHERE a.source IS NOT DISTINCT FROM w.source AND z > w.gap AND NOT list_contains(ids, a.k)) AS o
  FROM walk w WHERE i = (SELECT max(a.i) FROM arr a WHERE a.source IS NOT DISTINCT FROM w.source)),
tries AS (SELECT source, st, CASE WHEN o[1] < 2 * gap THEN o[1] - gap ELSE gap END AS off, CASE WHEN o[1] < 2 * gap THEN list_append(ids, o[2]) ELSE ids END AS ids FROM ends),
best AS (SELECT source, arg_min(ids, (off, st)) AS ids FROM tries GROUP BY source)
SELECT doc_id, size, source_size, target, c * size AS taken, c AS copies, round(rate, 4) AS rate FROM (
  SELECT v.*, s.source_size, s.target, CASE WHEN size = 0 THEN 1 ELSE least({CAP}, whole + CASE WHEN pool.k IS NOT NULL THEN list_contains(ids, v.k) ELSE v.k < s.lim END::BIGINT) END::BIGINT AS c
  FROM v JOIN s7 s ON v.source IS NOT DISTINCT FROM s.source LEFT JOIN best ON best.source IS NOT DISTINCT FROM v.source
  LEFT JOIN pool ON pool.source IS NOT DISTINCT FROM v.source AND pool.k = v.k)"""
