"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text becomes a vector of four transformed statistics. Within each group of language and
source the concentration steps of the minimum covariance determinant run as aggregations: rows
are binned by Mahalanobis distance, the bins carry counts and moments, and the next estimate
comes from the nearest bins that hold three quarters of the group. One small row for each group
and bin crosses the network, whatever the group's size. Statistics are fixed-point integers, so
the moments are exact and reruns agree.

Defined cases: a null, blank or short text fails the base rules. A null language or source is a
group of its own. Groups under ``least`` rows are judged by all rows of their language, and languages under it by
all rows of the table, however few: the floors keep any covariance regular. Rows that fail the base rules are in
no estimate. Repeated rows count each time. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, words

#: Statistics are kept as multiples of 1/SCALE.
SCALE = 1024
#: The least standard deviation of each statistic: those of one value would otherwise reject any other.
FLOOR = (0.08, 0.3, 0.4, 0.4)
#: Share of a group that the estimate rests on, and the factor that makes its covariance
#: consistent for normal data: 0.75 / P(chi2 with 6 degrees < the 0.75 quantile with 4).
CORE, CONSISTENT = 0.75, 1.486
#: Squared distance beyond which a text goes: chi2 with 4 degrees exceeds it once in 2e7.
CUT = 40.0
D, STEPS = len(FLOOR), 4
#: Rows of a group or language that has an estimate of its own: five for each dimension.
LEAST = 5 * D
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
SYMBOLS = r"[#*$%&|<>]"
POSITION = (1 << 21) - 1


def statistics(docs: DataFrame) -> DataFrame:
    """Add a struct ``_q`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines.

    Repeated windows: hashes of the 3-word windows, each with its position in the low bits, are
    sorted; neighbours of equal hash whose words are equal too are repeats. Texts with over 2**21
    words sort pairs of the full hash and position instead.
    """
    d = docs.withColumn("_w", words(F.col("text"))).withColumn("_n", F.size("_w"))
    d = d.withColumn("_ln", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    at = lambda a, i: F.get(F.col(a), i)
    window = lambda i: F.xxhash64(at("_w", i), at("_w", i + 1), at("_w", i + 2))
    same = lambda p, q: (at("_w", p) == at("_w", q)) & (at("_w", p + 1) == at("_w", q + 1)) & (at("_w", p + 2) == at("_w", q + 2))
    every = F.sequence(F.lit(0), F.col("_n") - 3)
    fits = (F.col("_n") >= 3) & (F.col("_n") <= POSITION)
    d = d.withColumn("_s", F.when(fits, F.sort_array(F.transform(every, lambda i: window(i).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("_b", F.when(F.col("_n") > POSITION, F.sort_array(F.transform(every, lambda i: F.struct(window(i).alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    top = lambda x: F.shiftrightunsigned(x, 21)
    place = lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")
    near = lambda x, y: F.coalesce((top(x) == top(y)) & same(place(x), place(y)), F.lit(False))
    alike = lambda x, y: F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))
    d = d.withColumn(
        "_p",
        F.when(F.col("_n") > POSITION, F.transform(F.filter("_b", lambda x, j: alike(x, at("_b", j + 1)) | alike(x, at("_b", j - 1))), lambda x: x["i"]))
        .otherwise(F.transform(F.filter("_s", lambda x, j: near(x, at("_s", j + 1)) | near(x, at("_s", j - 1))), place)),
    )
    d = d.withColumn("_p", F.sort_array("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(at("_p", j + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("_ln") - F.size(F.array_distinct("_ln"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_ln").cast("long").alias("n_lines"),
    )
    # a generator, so that the optimizer doesn't copy these expressions into later filters, once for each use
    return d.select(*docs.columns, F.explode_outer(F.array(q)).alias("_q"))


def failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def vector(q: str = "_q") -> list[Column]:
    """Mean word length, and the shares of symbols, repeated lines and repeated words, on log scales."""
    c = lambda n: F.col(f"{q}.{n}").cast("double")
    raw = [
        F.log((c("word_chars") + 1) / (c("n_words") + 1)),
        F.log(1 + 100 * c("n_symbols") / (c("word_chars") + 1)),
        F.log(1 + 10 * c("n_dup_lines") / (c("n_lines") + 1)),
        F.log(1 + 10 * c("n_repeat_words") / (c("n_words") + 1)),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"_x{i}") for i, x in enumerate(raw)]


def key() -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.concat_ws("\x1f", part(F.col("lang")), part(F.col("source")))


def distance(rows: DataFrame) -> DataFrame:
    """Add ``_d2``, the squared Mahalanobis distance by the Cholesky factor in _m and _l columns."""
    for i in range(D):
        z = F.col(f"_x{i}") / float(SCALE) - F.col(f"_m{i}")
        for j in range(i):
            z = z - F.col(f"_l{i}{j}") * F.col(f"_z{j}")
        rows = rows.withColumn(f"_z{i}", z / F.col(f"_l{i}{i}"))
    d2 = F.col("_z0") * F.col("_z0")
    for i in range(1, D):
        d2 = d2 + F.col(f"_z{i}") * F.col(f"_z{i}")
    return rows.withColumn("_d2", d2).drop(*[f"_z{i}" for i in range(D)])


def factor(moments: DataFrame, scale: float) -> DataFrame:
    """Means and Cholesky factor from the sums ``n``, ``_x`` and ``_xx``, with the floors added."""
    n = F.col("n").cast("double")
    p = moments.select("_g", "n", *[f"_x{i}" for i in range(D)], *[f"_xx{i}{j}" for i, j in PAIRS])
    for i in range(D):
        p = p.withColumn(f"_m{i}", F.col(f"_x{i}") / n / SCALE)
    for i, j in PAIRS:
        cov = (F.col(f"_xx{i}{j}") / n / (SCALE * SCALE) - F.col(f"_m{i}") * F.col(f"_m{j}")) * scale
        p = p.withColumn(f"_c{i}{j}", cov + (FLOOR[i] ** 2 if i == j else 0.0))
    for j in range(D):
        low = F.col(f"_c{j}{j}")
        for k in range(j):
            low = low - F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}")
        p = p.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(low, F.lit(1e-9))))
        for i in range(j + 1, D):
            x = F.col(f"_c{i}{j}")
            for k in range(j):
                x = x - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            p = p.withColumn(f"_l{i}{j}", x / F.col(f"_l{j}{j}"))
    return p.select("_g", *[f"_m{i}" for i in range(D)], *[f"_l{i}{j}" for i, j in PAIRS])


def _step(rows: DataFrame, params: DataFrame, scale: float) -> DataFrame:
    """One concentration step: moments of the nearest bins that hold the core."""
    near = distance(rows.join(params, "_g"))
    bin_ = F.least(F.greatest(F.floor(F.log2(F.col("_d2") + 2.0**-10) * 16), F.lit(-160)), F.lit(400)).cast("int")
    binned = near.groupBy("_g", bin_.alias("_b")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(D)],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_xx{i}{j}") for i, j in PAIRS],
    )
    upto = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    core = binned.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("_all", F.sum("n").over(W.partitionBy("_g")))
    core = core.filter(F.col("_before") < F.ceil(CORE * F.col("_all")))
    sums = core.groupBy("_g").agg(F.sum("n").alias("n"), *[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(D)], *[F.sum(f"_xx{i}{j}").alias(f"_xx{i}{j}") for i, j in PAIRS])
    return factor(sums, scale)


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians, to 1/64, and the floors as scale."""
    each = rows.select("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f"_x{i}") / 16).cast("int").alias("v")) for i in range(D)])).alias("e"))
    held = each.groupBy("_g", F.col("e.i").alias("i"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("_g", "i")
    upto = by.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    middle = held.withColumn("_c", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(by)).filter(2 * F.col("_c") >= F.col("_all"))
    median = middle.groupBy("_g").agg(*[(F.min(F.when(F.col("i") == i, F.col("v"))) / 64.0).alias(f"_m{i}") for i in range(D)])
    return median.select("_g", *[f"_m{i}" for i in range(D)], *[F.lit(FLOOR[i] if i == j else 0.0).alias(f"_l{i}{j}") for i, j in PAIRS])


def fit(stats: DataFrame, least: int = LEAST, steps: int = STEPS) -> DataFrame:
    """Estimates by key of language and source (``_k``) from rows of ``_k``, ``_lang``, ``_x*``.

    A key under ``least`` rows takes the estimate of all rows of its language, or else of all rows.
    """
    sizes = stats.groupBy("_k", "_lang").agg(F.count(F.lit(1)).alias("n")).withColumn("_nl", F.sum("n").over(W.partitionBy("_lang")))
    own, lang, every = F.concat(F.lit("s"), F.col("_k")), F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col("_lang")), F.lit("-"))), F.lit("all")
    sizes = sizes.select("_k", F.when(F.col("n") >= least, own).when(F.col("_nl") >= least, lang).otherwise(every).alias("_g"), F.array(own, lang, every).alias("_in"))
    groups = stored(sizes, "quality-groups")
    pools = stored(groups.select("_k", F.explode("_in").alias("_g")).join(groups.select("_g").distinct(), "_g", "left_semi"), "quality-pools")
    groups = groups.drop("_in")
    rows = stats.join(pools, "_k").select("_g", *[f"_x{i}" for i in range(D)])
    params = stored(_start(rows), "quality-start")
    for k in range(steps):
        params = stored(_step(rows, params, CONSISTENT), f"quality-step{k}")
    return groups.join(params, "_g").drop("_g")


def _features(docs: DataFrame) -> DataFrame:
    return statistics(docs).withColumn("_failed", failed()).withColumn("_k", key()).select("*", *vector())


def _judged(rows: DataFrame, params: DataFrame, cut: float) -> DataFrame:
    """Add ``_d2`` and ``_kept``; those without an estimate fail the base rules."""
    seen = distance(rows.join(params, "_k", "left"))
    return seen.withColumn("_kept", ~F.col("_failed") & F.coalesce(F.col("_d2") <= cut, F.lit(True)))


def assess(docs: DataFrame, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the squared distance of every row of docs."""
    rows = _features(docs.select("doc_id", "text", "lang", "source")).drop("text", "source").withColumnRenamed("lang", "_lang")
    rows = stored(rows, "quality-rows")
    out = _judged(rows, fit(rows.filter(~F.col("_failed")), least), cut)
    return out.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_d2").alias("distance"))


def keep(docs: DataFrame, least: int = LEAST, cut: float = CUT) -> DataFrame:
    """The rows of docs that pass, with all their columns. The text is read twice and never shuffled."""
    bare = docs.select("doc_id", "text", "lang", "source")
    rows = stored(_features(bare).filter(~F.col("_failed")).select("_k", F.col("lang").alias("_lang"), *[f"_x{i}" for i in range(D)]), "quality-rows")
    params = stored(fit(rows, least), "quality-params")
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    out = _judged(_features(whole).drop("doc_id", "text", "lang", "source"), params, cut)
    return out.filter("_kept").select("_row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir))
