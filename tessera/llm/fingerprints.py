"""Homomorphic multiset fingerprints: wide vectors hashed from paragraphs, summed modulo powers of two.

A paragraph (a line of the text) gives eight 40-bit hashes and, for its pairs of adjacent words, 126
counters of hash bits. A text's fingerprint is the sum over its paragraphs, so order does not
matter, and adding or removing a paragraph adds or subtracts its vector (``combine``). The hashes
tell multisets of paragraphs apart; the counters, taken as a random projection of the word pairs,
give the likeness of two fingerprints as the cosine between them, 0 at least.

The sums are plain aggregations over exploded word pairs, with seven counters in each long.

Defined cases: null text counts as empty, which is one empty paragraph without word pairs; two
fingerprints without word pairs have likeness 1 if equal, else 0; repeated doc_ids are rows of
their own, ordered by their text's hash; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, SPACES, documents, stored

HASHES, HASH_BITS = 8, 40
#: Counters lie seven in a long, nine bits each, for nine shifts of each of two 64-bit hashes.
LANE, FIELDS = 9, 7
SPREAD = sum(1 << LANE * i for i in range(FIELDS))
#: A text has under 2**31 bytes, so counters of 32 bits hold its word pairs without wrapping; ``likeness`` rests on that.
LANE_MASK, OUT_BITS, HASH_MASK = (1 << LANE) - 1, 32, (1 << HASH_BITS) - 1
OUT_MASK = (1 << OUT_BITS) - 1
PART = (1 << LANE) - 1  # word pairs that are summed before counters are unpacked, so that none overflows
ROWS_PER_CHUNK, CHUNKS, FINE = 2000, 4096, 64


def paragraph_hashes(text: Column) -> list[Column]:
    lines = F.split(text, "\n", -1)
    hash_ = lambda p, j: F.xxhash64(p, F.lit(j)).bitwiseAND(F.lit(HASH_MASK))
    total = lambda j: F.aggregate(lines, F.lit(0).cast("long"), lambda a, p: (a + hash_(p, j)).bitwiseAND(F.lit(HASH_MASK)))
    return [total(j) for j in range(HASHES)]


def word_pairs(text: Column) -> Column:
    """Hashes of adjacent words within each paragraph; its last word stands alone."""
    lines = F.transform(F.filter(F.transform(F.split(text, "\n", -1), lambda p: F.btrim(p, F.lit(SPACES))), lambda p: F.length(p) > 0), lambda p: F.split(p, SPACE))
    return F.flatten(F.transform(lines, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of (*keys, text), keys without repeats: keys, ``n``, ``lanes`` and ``hashes``.

    The keys' partitioning is kept, so rows dealt by the first key are not dealt again. What goes
    along is made of numbers, and sums are few: larger code would not be compiled by the JVM.
    """
    ends = [f"_e{j}" for j in range(HASHES)]
    r = rows.select(*keys, *[h.alias(e) for e, h in zip(ends, paragraph_hashes(F.col("text")), strict=True)], word_pairs(F.col("text")).alias("_w"))
    r = r.select(*keys, *ends, F.posexplode_outer("_w").alias("_i", "_h"))  # apart from the hashes, which would run for each pair
    r = r.select(*keys, *ends, F.expr(f"coalesce(_i, 0) div {PART}").alias("_part"), "_h", F.xxhash64("_h", F.lit(1)).alias("_h2"))
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(SPREAD))).alias(f"_p{h}{k}") for h in ("_h", "_h2") for k in range(LANE)]
    g = r.groupBy(*keys, *ends, "_part").agg(F.count("_h").alias("_n"), *sums)
    packs = F.array(*[F.coalesce(F.col(f"_p{h}{k}"), F.lit(0).cast("long")) for h in ("_h", "_h2") for k in range(LANE)])
    g = g.select(*keys, *ends, "_n", packs.alias("_p")).groupBy(*keys, *ends).agg(F.sum("_n").alias("n"), F.collect_list("_p").alias("_ps"))
    unpacked = F.transform("_ps", lambda p: F.flatten(F.transform(p, lambda x: F.array(*[F.shiftrightunsigned(x, LANE * j).bitwiseAND(F.lit(LANE_MASK)) for j in range(FIELDS)]))))
    g = g.select(*keys, *ends, "n", unpacked.alias("_l"))
    added = F.aggregate("_l", F.array_repeat(F.lit(0).cast("long"), 2 * LANE * FIELDS), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return g.select(*keys, "n", F.transform(added, lambda x: x.bitwiseAND(F.lit(OUT_MASK))).alias("lanes"), F.array(*ends).alias("hashes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes or hashes of two fingerprints added, or with sign -1 the second taken away; mask as the part's width."""
    return F.zip_with(a, b, lambda p, q: p + sign * q)


def as_text(n: Column, lanes: Column, hashes: Column) -> Column:
    low = lambda c, w: F.lower(F.lpad(F.hex(c), w, "0"))
    return F.concat(low(n, 8), F.array_join(F.transform(hashes, lambda x: low(x, HASH_BITS // 4)), ""), F.array_join(F.transform(lanes, lambda x: low(x, OUT_BITS // 4)), ""))


def likeness(n1: Column, l1: Column, h1: Column, n2: Column, l2: Column, h2: Column) -> Column:
    dot = lambda a, m, b, n: F.aggregate(F.zip_with(a, b, lambda p, q: (2.0 * p - m) * (2.0 * q - n)), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot(l1, n1, l1, n1)) * F.sqrt(dot(l2, n2, l2, n2))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(norms > 0, dot(l1, n1, l2, n2) / norms).otherwise(F.lit(0.0))))
    return F.when((n1 == n2) & (l1 == l2) & (h1 == h2), F.lit(1.0)).otherwise(cosine)


def _chunk(ids: DataFrame) -> tuple[Column, int]:
    """Even ranges of ``_o`` as a number from 0; their count grows with the rows, up to CHUNKS."""
    rows = ids.count()
    n = max(1, min(CHUNKS, -(-rows // ROWS_PER_CHUNK)))
    cuts = sorted({*(ids.agg(F.percentile_approx("_o", [i / n for i in range(1, n)], 100 * n)).first()[0] or [])}) if n > 1 else []
    if not cuts:
        return F.lit(0), 1
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("_o")))
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs]).cast("array<long>")
    coarse = cuts[FINE - 1 :: FINE]
    rest = [[c for c in cuts[i : i + FINE] if c not in set(coarse)] for i in range(0, len(cuts) + 1, FINE)]
    high = below(longs(coarse)) if coarse else F.lit(0)
    fine = longs(rest[0]) if len(rest) == 1 else F.get(F.array(*[longs(x) for x in rest]), high)
    return high * FINE + below(fine), n


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and likeness to that and to the next document.

    One exchange deals the texts by ranges of doc_id; each range also gets the first document of
    the next. Everything after keeps that partitioning.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("_o"))
    chunk, _ = _chunk(d.select("_o"))
    d = d.withColumn("_chunk", chunk)
    firsts = d.groupBy("_chunk").agg(F.min("_o").alias("_o"))
    prev = F.coalesce(F.lag("_chunk").over(W.orderBy("_chunk")), F.max("_chunk").over(W.partitionBy()))
    firsts = stored(firsts.select(prev.alias("_prev"), "_o"), "fingerprint-firsts")  # CHUNKS rows at most
    guests = d.drop("_chunk").join(F.broadcast(firsts), "_o").withColumnRenamed("_prev", "_chunk")
    both = d.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    order = W.partitionBy("_chunk").orderBy("_guest", "_o", F.xxhash64("text"), "text")
    r = both.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))
    texts = F.when(F.col("_guest") == 0, F.array(F.col("text"), edited)).otherwise(F.array(F.col("text")))
    r = r.select("_chunk", "_r", "_guest", "doc_id", n.cast("long").alias("n_chars"), F.posexplode(texts).alias("_e", "text"))
    sha = F.when(F.col("_e") == 1, F.sha2("text", 256))
    longs = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10).cast("long").alias(f"_s{i}") for i in range(4)]
    f = fingerprint(r.select("*", *longs), ["_chunk", "_r", "_e", "_guest", "doc_id", "n_chars", *[f"_s{i}" for i in range(4)]])
    along = W.partitionBy("_chunk").orderBy("_r", "_e")
    f = f.withColumn("_v", F.struct("n", "lanes", "hashes", *[f"_s{i}" for i in range(4)])).select("_chunk", "_r", "_e", "_guest", "doc_id", "n_chars", "_v")
    f = f.withColumn("_v1", F.lead("_v", 1).over(along)).withColumn("_v2", F.lead("_v", 2).over(along)).filter((F.col("_e") == 0) & (F.col("_guest") == 0))
    part = lambda v: (F.col(f"{v}.n"), F.col(f"{v}.lanes"), F.col(f"{v}.hashes"))
    hex_ = F.concat(*[F.lower(F.lpad(F.hex(F.col(f"_v1._s{i}")), 16, "0")) for i in range(4)])
    return f.select(
        "doc_id", "n_chars", hex_.alias("edited_sha256"), as_text(*part("_v")).alias("fingerprint"), as_text(*part("_v1")).alias("edited_fingerprint"),
        likeness(*part("_v"), *part("_v1")).alias("near_edited"), likeness(*part("_v"), *part("_v2")).alias("near_next"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return compare(documents(spark, sf_dir))
