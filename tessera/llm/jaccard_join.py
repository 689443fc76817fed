"""N-gram Jaccard self-join of documents by prefixes under several global token orders.

A document is the set of hashes of its word n-grams. Two sets of Jaccard t or more have at least
a(x) = ceil(t |x|) tokens in common, so, whatever total order the tokens have, the first l of these are among
the first |x| - a(x) + l of x, and likewise of y: the prefixes, for l(x) a third of |x| - a(x) + 1, share
min(l(x), l(y)) tokens. Here each of several orders puts rare tokens first (by a fixed-size counting
sketch of all documents) and breaks ties by another hash; a candidate must pass under every one.

1. ``node``: documents of equal sets are one node (a hash of the set), so copies meet once.
2. Prefix tokens of all orders are dealt by token and size class (partners lie in one); tokens held by
   one node drop out, and nodes that have too few left under some order drop out too.
3. Each bucket of the first order has a hub, the node of the most frequent tokens. Two
   candidates share a bucket, so they share a hub, and groups by hub hold every candidate pair.
4. Within a group the filters of all orders are intersected on the prefixes alone, with a bound from parity
   bitmaps: the sets' hashed bits, of which a token that only one set has flips one, so that
   no more bits differ than tokens do. Members without a candidate leave before any set is read, and those
   that candidates connect get one of them as their centre.
5. Workers read each member's text once more, map its centre's set, test the two exactly and keep the
   difference, which is short for near copies. Members that link with their centre need no test with
   each other, as only components are asked for; the others are verified against their centre's whole group:
   |x ^ y| = |dx| + |dy| - 2 |dx & dy|.
6. Components of the links, by distributed star contraction.

Groups over BLOCK members are cut into pairs of blocks, so that no task holds a larger one.

Nothing is capped: buckets of any size are handled, and no pair of two linked texts is lost.

Defined cases: a text of fewer words than n is one token; null and blank texts are empty sets, linked
with nothing; rows that share a doc_id are one document; a text without a doc_id is linked by an equal
set only, and its component is the smallest doc_id there (null if none); an empty table gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import Files, documents, ran, remove, scratch, stored

ORDERS = 3
CELLS, PAGE = 1 << 20, 1 << 16  # counters of the sketch, and counters in a row of it
BLOCK = 2048  # members of a group that are compared in one task
ROWS = 512  # of them that are compared with all at once
NEEDED = 64  # files of sorted nodes, at least


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Ascending distinct token hashes of each row."""
    h, w = blocks.words(data, at)
    if len(h) >= n:
        grams = h[: len(h) - n + 1]
        for k in range(1, n):
            grams = blocks.mix(grams * np.uint64(3) + h[k : len(h) - n + 1 + k])
    out = []
    for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = blocks.mix(whole * np.uint64(5) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node(tokens: np.ndarray) -> np.int64:
    return blocks.mix(blocks.mix(tokens).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]


def _sets(batches, n: int):
    for batch in batches:
        data, at = blocks.buffers(batch.column("text"))
        for i, j, part, offsets in blocks.chunks(data, at):
            yield batch.slice(i, j - i), shingles(part, offsets, n)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - 20)).astype(np.int64)


def parity(tokens: np.ndarray) -> bytes:
    """A bit a hash value, more of them than tokens, flipped by each token that has it."""
    bits = max(64, 1 << len(tokens).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """A row a document (doc_id, n, node, bits), and pages of each task's counters."""
    names = ["page", "doc_id", "n", "node", "bits", "counters"]

    def run(batches):
        counters = np.zeros(CELLS, np.uint64)
        for batch, sets in _sets(batches, n):
            if sets:
                counters += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint64)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, -1), pa.int32()), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(node(s)) if len(s) else 0 for s in sets], pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(k, pa.binary())],
                names=names,
            )
        pages = [p for p in range(CELLS // PAGE) if counters[p * PAGE : (p + 1) * PAGE].any()]
        k = len(pages)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pages, pa.int32()), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.binary()), pa.array([blocks.planes(counters[p * PAGE : (p + 1) * PAGE]) for p in pages], pa.binary())],
            names=names,
        )

    return docs.mapInArrow(run, "page int, doc_id long, n long, node long, bits binary, counters binary")


def _sketch(scan: DataFrame) -> np.ndarray:
    """Levels of token frequency by cell, CELLS bytes: 0 for the usual, one more for each doubling beyond four times that."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(blocks.unplanes(b, np.uint64) for b in rows["counters"])
        return pd.DataFrame({"page": [rows["page"].iloc[0]], "counters": [blocks.planes(total)]})

    counts = np.zeros(CELLS)
    pages = scan.filter("page >= 0").select("page", "counters").withColumn("_salt", F.pmod(F.xxhash64("counters"), F.lit(16)))
    half = pages.groupBy("page", "_salt").applyInPandas(add, "page int, counters binary")
    for r in half.groupBy("page").applyInPandas(add, "page int, counters binary").collect():  # CELLS / PAGE rows
        counts[r.page * PAGE : (r.page + 1) * PAGE] = blocks.unplanes(r.counters, np.uint64)
    usual = max(counts.mean(), 1.0)
    return np.floor(np.log2(np.maximum(counts / usual, 2.0))).astype(np.uint8) - np.uint8(1)


def _least(n: int, num: int, den: int) -> int:
    """Tokens of the intersection that the prefix of a set of n holds."""
    return max(1, (n - (num * n + den - 1) // den + 1) // 3)


def _prefix(n: int, num: int, den: int) -> int:
    return min(n, n - (num * n + den - 1) // den + _least(n, num, den))


def _bands(n: int, num: int, den: int) -> list[int]:
    """Size classes, by doubling: a set's own, and the next if a partner may lie there."""
    own = n.bit_length()
    return [own, own + 1] if den * n >= num * (1 << own) else [own]


def _postings(docs: DataFrame, n: int, num: int, den: int, orders: int, levels) -> DataFrame:
    """(token, ord, band, node, need, typical): prefix tokens by order and size class, and how many of them a partner must have."""
    names = ["token", "ord", "band", "node", "need", "typical"]

    def run(batches):
        rank = levels.value
        for _, sets in _sets(batches, n):
            parts: list[list] = [[] for _ in names]
            for s in sets:
                if not len(s):
                    continue
                p, level, own = _prefix(len(s), num, den), rank[_cell(s)], node(s)
                fewest = _least(-(-num * len(s) // den), num, den)  # a partner is no smaller than that
                heavy = int(level.sum(dtype=np.int64) * 1000 // len(s))
                for k in range(orders):
                    tie = blocks.mix(s + np.uint64(k + 1))
                    key = (tie >> np.uint64(8)) | (level.astype(np.uint64) << np.uint64(56))
                    first = np.argpartition(key, p - 1)[:p] if p < len(s) else slice(None)
                    for band in _bands(len(s), num, den):
                        for part, x, kind in zip(parts, (blocks.mix(tie[first] + np.uint64(band)).view(np.int64), k, band, own, fewest, heavy), (np.int64, np.int8, np.int8, np.int64, np.int32, np.int32), strict=True):
                            part.append(x if isinstance(x, np.ndarray) else np.full(p, x, kind))
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=names)

    return docs.mapInArrow(run, "token long, ord byte, band byte, node long, need int, typical int")


def _shards(rows: int) -> int:
    return max(NEEDED, min(1 << 16, rows // 2000))


def _each_shard(rows: DataFrame, shards: int, write) -> None:
    """write(rows of a shard by number, shard) for every shard, so that a file that is missing later is an error."""

    def run(mine: pd.DataFrame) -> pd.DataFrame:
        s = int(mine["shard"].iloc[0])
        write(mine[~mine["_none"]], s)
        return pd.DataFrame({"shard": [s]})

    rows = rows.withColumn("shard", F.pmod("node", F.lit(shards)).cast("int")).withColumn("_none", F.lit(False))
    blank = [F.lit(0 if f.dataType.typeName() == "long" else None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-2]]
    every = rows.sparkSession.range(shards).select(*blank, F.col("id").cast("int").alias("shard"), F.lit(True).alias("_none"))
    ran(rows.union(every).groupBy("shard").applyInPandas(run, "shard int"))


def _write_nodes(nodes: DataFrame, root: str, shards: int) -> None:
    """Sorted files of (node, doc_id): which document a node's set is read from."""

    def write(rows: pd.DataFrame, s: int) -> None:
        r = rows.sort_values("node")
        files = Files(root)
        files.write(f"node{s}", [r["node"].to_numpy(np.int64).tobytes()])
        files.write(f"doc{s}", [r["doc_id"].to_numpy(np.int64).tobytes()])

    _each_shard(nodes, shards, write)


def _write_members(members: DataFrame, root: str, shards: int) -> None:
    """Sorted files of (node, doc_id), and each one's centres one after another."""

    def write(rows: pd.DataFrame, s: int) -> None:
        r = rows.sort_values("node")
        files = Files(root)
        files.write(f"node{s}", [r["node"].to_numpy(np.int64).tobytes()])
        files.write(f"doc{s}", [r["doc_id"].to_numpy(np.int64).tobytes()])
        files.write(f"hubsat{s}", [np.concatenate([[0], np.cumsum(r["hubs"].map(len))]).astype(np.int64).tobytes()])
        files.write(f"hubs{s}", [np.asarray(x, np.int64).tobytes() for x in r["hubs"]])

    _each_shard(members, shards, write)


def _write_sets(sets: DataFrame, root: str, shards: int) -> None:
    """Sorted files of nodes, and their tokens one after another."""

    def write(rows: pd.DataFrame, s: int) -> None:
        r = rows.drop_duplicates("node").sort_values("node")
        tokens = [blocks.unpack_sorted(b) for b in r["tokens"]]
        files = Files(root)
        files.write(f"set{s}", [r["node"].to_numpy(np.int64).tobytes()])
        files.write(f"setat{s}", [np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64).tobytes()])
        files.write(f"tokens{s}", [t.tobytes() for t in tokens])

    _each_shard(sets, shards, write)


class _Mapped:
    """Lookups in the files, mapped when first asked for."""

    def __init__(self, root: str, shards: int):
        self.files, self.shards, self.maps = Files(root), shards, {}

    def array(self, name: str, shard: int, dtype=np.int64) -> np.ndarray:
        if (name, shard) not in self.maps:
            path = self.files.path(f"{name}{shard}")
            self.maps[name, shard] = np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        return self.maps[name, shard]

    def place(self, name: str, x: int) -> tuple[int, int]:
        """Shard and place of x, -1 if it isn't there."""
        shard = x % self.shards
        keys = self.array(name, shard)
        at = int(np.searchsorted(keys, x))
        return shard, at if at < len(keys) and keys[at] == x else -1

    def wanted(self, x: int, doc) -> tuple[int, int]:
        shard, at = self.place("node", x)
        return shard, at if at >= 0 and self.array("doc", shard)[at] == doc else -1


def _wanted_sets(docs: DataFrame, n: int, root: str, shards: int) -> DataFrame:
    """(node, tokens) of the nodes in the files, read from the one document that stands for each."""

    def run(batches):
        m = _Mapped(root, shards)
        for batch, sets in _sets(batches, n):
            out = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                if len(s) and m.wanted(x := int(node(s)), doc)[1] >= 0:
                    out.append((x, blocks.pack_sorted(s)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["node", "tokens"])

    return docs.mapInArrow(run, "node long, tokens binary")


def _differences(docs: DataFrame, n: int, num: int, den: int, root: str, shards: int, hub_root: str, hub_shards: int) -> DataFrame:
    """For each member in the files and each of its centres: sizes of both sets, whether they link, and their packed symmetric difference."""
    kinds = {"hub": pa.int64(), "node": pa.int64(), "n": pa.int64(), "hub_n": pa.int64(), "near": pa.bool_(), "delta": pa.binary()}

    def run(batches):
        m, h = _Mapped(root, shards), _Mapped(hub_root, hub_shards)
        for batch, sets in _sets(batches, n):
            out = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                if not len(s):
                    continue
                shard, at = m.wanted(x := int(node(s)), doc)
                if at < 0:
                    continue
                first, last = m.array("hubsat", shard)[at : at + 2]
                for hub in m.array("hubs", shard)[first:last].tolist():
                    hs, place = h.place("set", hub)
                    begin, end = h.array("setat", hs)[place : place + 2]
                    base = np.asarray(h.array("tokens", hs, np.uint64)[begin:end])
                    delta = np.setxor1d(s, base, assume_unique=True)
                    out.append((hub, x, len(s), len(base), bool(_linked(len(s), len(base), len(delta), num, den)), blocks.pack_sorted(delta)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return docs.mapInArrow(run, "hub long, node long, n long, hub_n long, near boolean, delta binary")


def _linked(n1, n2, xor, num: int, den: int):
    return den * ((n1 + n2 - xor) // 2) >= num * ((n1 + n2 + xor) // 2)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _postings_of(arrays: list[np.ndarray]):
    """Tokens held by two members or more: for each member its tokens' numbers, for each number its members."""
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    _, number, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True) if len(owner) else (None, np.zeros(0, int), np.zeros(0, int))
    live = count[number] > 1
    owner, number = owner[live], number[live]
    order = np.argsort(number, kind="stable")
    members, starts = owner[order], np.searchsorted(number[order], np.arange(len(count) + 1))
    mine = np.searchsorted(owner, np.arange(len(arrays) + 1))
    lists = lambda i: [members[starts[t] : starts[t + 1]] for t in number[mine[i] : mine[i + 1]]]
    return lists


def group_links(nodes, sizes, deltas, near, asked, num: int, den: int) -> list[tuple[int, int]]:
    """Links of the members asked with all of a group, whose near members link with its centre, as far as they span components."""
    m = len(nodes)
    d = np.array([len(x) for x in deltas])
    sizes = np.asarray(sizes)
    union, edges, centre = _Union(m), [], np.flatnonzero(near)
    for i in centre.tolist():
        union.join(int(centre[0]), i)
    common = _postings_of(deltas)
    for i in np.flatnonzero(asked).tolist():
        held = common(i)
        both = np.bincount(np.concatenate(held), minlength=m) if held else np.zeros(m, np.int64)
        for j in np.flatnonzero(_linked(sizes[i], sizes, d[i] + d - 2 * both, num, den)).tolist():
            if i != j and union.join(i, j):
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def candidates(sigs, orders: int, sizes, bits, num: int, den: int) -> np.ndarray:
    """By member of a group, the first member that candidates connect it with; -1 for one without a candidate.

    Candidates are of like size, have no more bits of difference than linked sets can have, and
    enough prefix tokens in common under every order.
    """
    m = len(sigs)
    sizes = np.asarray(sizes, np.int64)
    width = min(map(len, bits))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) if len(b) > width else np.frombuffer(b, np.uint8) for b in bits])
    least = np.maximum(1, (sizes - (num * sizes + den - 1) // den + 1) // 3)
    label, found, shared = np.arange(m), np.zeros(m, bool), None
    for low in range(0, m, ROWS):
        rows = np.arange(low, min(m, low + ROWS))
        differ = np.zeros((len(rows), m), np.float32)
        for at in range(0, width, 256):
            x = np.unpackbits(folded[:, at : at + 256], axis=1).astype(np.float32)
            ones = x.sum(1)
            differ += ones[rows, None] + ones[None, :] - 2 * (x[rows] @ x.T)
        fits = den * np.minimum(sizes[rows, None], sizes) >= num * np.maximum(sizes[rows, None], sizes)
        fits &= (den + num) * differ <= (den - num) * (sizes[rows, None] + sizes)
        fits[rows - low, rows] = False
        for i in rows[fits.any(1)].tolist():
            pick = np.flatnonzero(fits[i - low])
            pick = pick[pick > i]
            if not len(pick) or found[i] and (label[pick] == label[i]).all():
                continue
            shared = shared or [_postings_of([x[(x & 3) == k] for x in sigs]) for k in range(orders)]
            for lists in shared:  # the filters of all orders, intersected before any set is looked at
                held = lists(i)
                counts = np.bincount(np.concatenate(held), minlength=m) if held else np.zeros(m, np.int64)
                pick = pick[counts[pick] >= np.minimum(least[i], least[pick])]
            if len(pick):
                ends = np.unique(np.append(label[pick], label[i]))
                label[np.isin(label, ends)] = ends[0]
                found[pick] = found[i] = True
    return np.where(found, label, -1)


def _cells(rows: DataFrame) -> DataFrame:
    """Cut groups of m members into pairs of blocks; a member goes to each pair that its block is in."""
    cut = rows.withColumn("_nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.expr("sequence(0, _nb - 1)"))).withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    return cut.drop("m", "_nb", "_b", "_o")


def _rest_cells(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """Deal members not near their centre, by block, to every block of their centre's group, and all members to every block of those. rest: hub, m, r."""
    cut = rows.join(rest, "hub").withColumn("_nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("_nr", F.ceil(F.col("r") / BLOCK).cast("int"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    places = F.expr("flatten(transform(sequence(0, _nr - 1), i -> transform(sequence(0, _nb - 1), j -> struct(i, j))))")
    mine = F.filter(places, lambda p: (p["j"] == F.col("_b")) | ~F.col("near") & (p["i"] == F.col("_r")))
    cut = cut.withColumn("_b", block("_nb")).withColumn("_r", block("_nr")).withColumn("_p", F.explode(mine))
    asked = ~F.col("near") & (F.col("_p.i") == F.col("_r"))
    return cut.select("hub", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), "node", "n", asked.alias("asked"), "near", "delta")


def links(docs: DataFrame, n: int, num: int, den: int, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of all documents, and edges (a, b) between nodes that span the components of linked sets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scan = stored(_scan(docs, n), "jaccard-scan")
    levels = spark.sparkContext.broadcast(_sketch(scan))  # CELLS bytes
    nodes = scan.filter("page = -1").select("doc_id", "n", "node")

    by = W.partitionBy("token")
    posts = _postings(docs.filter("doc_id is not null"), n, num, den, orders, levels)
    posts = posts.withColumn("_last", F.lag("node").over(by.orderBy("node"))).withColumn("_lo", F.min("node").over(by)).withColumn("_hi", F.max("node").over(by))
    posts = posts.withColumn("_df", F.count(F.lit(1)).over(by)).withColumn("hub", F.max(F.struct("typical", "node")).over(by)["node"])
    posts = posts.filter((F.col("_lo") != F.col("_hi")) & ~F.col("_last").eqNullSafe(F.col("node")))  # once a node, whatever its copies
    # a signature is 14 bits of a token and its order: tokens that fall together can only add candidates
    sig = ((F.col("token").bitwiseAND(F.lit((1 << 14) - 1)) - F.lit(1 << 13)) * 4 + F.col("ord")).cast("short")
    at_first = F.col("ord") == 0
    posts = posts.select("node", "band", "need", sig.alias("sig"), F.when(at_first, F.col("_df").cast("int")).alias("df"), F.when(at_first, F.col("hub")).alias("hub"))
    live = posts.repartition("node", "band").groupBy("node", "band").agg(F.collect_list("sig").alias("sig"), F.collect_list(F.when(F.col("hub").isNotNull(), F.struct("df", "sig", "hub"))).alias("first"), F.max("need").alias("need"))
    for k in range(orders):
        live = live.filter(F.size(F.filter("sig", lambda s: s.bitwiseAND(F.lit(3).cast("short")) == k)) >= F.col("need"))  # noqa: B023
    # Partners share ``need`` tokens of the first order or more; by bucket size, the first of those is not among either's
    # last need - 1. Tokens of one size and signature stand in any order if they have one hub, and else in that of their hubs.
    ranked = F.array_sort("first")
    hubs = F.array_distinct(F.transform(F.slice(ranked, F.lit(1), F.size("first") - F.col("need") + 1), lambda s: s["hub"]))
    member = stored(live.select("node", "band", "sig", hubs.alias("hubs")), "jaccard-members")
    pairs = member.select("node", "band", F.explode("hubs").alias("hub"))
    held = pairs.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")  # one member alone has no partner

    def able(rows: pa.Table) -> pa.Table:
        x = rows.column("node").to_numpy()
        order = np.argsort(x)
        x, bits, sig = x[order], rows.column("bits").to_pylist(), rows.column("sig").combine_chunks()
        values, at = sig.values.to_numpy(), sig.offsets.to_numpy()
        label = candidates([values[at[i] : at[i + 1]] for i in order], orders, rows.column("n").to_numpy()[order], [bits[i] for i in order], num, den)
        return pa.table({"hub": x[label[label >= 0]], "node": x[label >= 0]})

    sizes = scan.filter("page = -1 and n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    wide = pairs.join(held, ["hub", "band"]).join(member.select("node", "band", "sig").join(sizes, "node"), ["node", "band"])
    able_in = _cells(wide).select("hub", "band", "_i", "_j", "node", "sig", "n", "bits").groupBy("hub", "band", "_i", "_j")
    pairs = able_in.applyInArrow(able, "hub long, node long").distinct()
    pairs = stored(pairs, "jaccard-pairs")
    stand = stored(nodes.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "jaccard-stand")
    hubs = pairs.select(F.col("hub").alias("node")).distinct()
    root, hub_root, set_root = (scratch(spark, f"jaccard-{x}") for x in ("nodes", "hubs", "sets"))
    shards, hub_shards = _shards(pairs.count()), _shards(hubs.count())
    _write_nodes(stand.join(hubs, "node"), hub_root, hub_shards)
    _write_sets(_wanted_sets(docs, n, hub_root, hub_shards), set_root, hub_shards)
    at = pairs.groupBy("node").agg(F.sort_array(F.collect_list("hub")).alias("hubs"))
    _write_members(at.join(stand, "node"), root, shards)
    apart = stored(_differences(docs, n, num, den, root, shards, set_root, hub_shards), "jaccard-differences")
    for path in (root, hub_root, set_root):
        remove(spark, path)
    rest = apart.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("near")).alias("r")).filter("r > 0")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = group_links(rows["node"].to_numpy(), rows["n"].to_numpy(), [blocks.unpack_sorted(b) for b in rows["delta"]], rows["near"].to_numpy(), rows["asked"].to_numpy(), num, den)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    cut = _rest_cells(apart.drop("hub_n"), rest)
    edges = cut.groupBy("hub", "_i", "_j").applyInPandas(compare, "a long, b long")
    stars = apart.filter("near and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return nodes, stored(edges.union(stars).distinct(), "jaccard-edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by large and small stars until nothing changes."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "stars")
    mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct(), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id of equal set) of every row of docs."""
    if not 0 < num <= den or n < 1 or not 1 <= orders <= 4:
        raise ValueError("the least similarity must be in (0, 1], n positive, and orders 1 to 4")
    nodes, edges = links(docs, n, num, den, orders)
    roots = components(edges)
    by_node = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    by_node = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = by_node.groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = by_node.join(by_root, "root").select(F.col("node").alias("_node"), "class_id", "component_id")
    out = nodes.join(known, (nodes["node"] == known["_node"]) & (nodes["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, orders: int = 2) -> DataFrame:
    """The rows of docs without those whose doc_id is not the smallest of its component.

    The ids that go are written as sorted files and mapped by the workers, so texts are not shuffled. Rows that
    share a doc_id stay or go together, and rows without one stay: there is no id to choose them by.
    """
    gone = stored(join(docs, n, num, den, orders).filter("component_id <> doc_id").select(F.col("doc_id").alias("node"), "doc_id").distinct(), "jaccard-gone")
    root, shards = scratch(docs.sparkSession, "jaccard-gone"), _shards(gone.count())
    _write_nodes(gone, root, shards)

    def run(batches):
        m = _Mapped(root, shards)
        for batch in batches:
            ids = batch.column("doc_id")
            known, x = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype(np.int64)
            out = np.zeros(len(x), bool)
            for shard in np.unique(x % shards).tolist():
                pick = np.flatnonzero(x % shards == shard)
                out[pick] = blocks.find(m.array("node", shard), x[pick])[1]
            yield batch.filter(pa.array(~(out & known)))

    return docs.mapInArrow(run, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


def sql(n: int = 3, num: int = 90, den: int = 100) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, u.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) u ON r.y = u.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT doc_id, list_sort(s) AS s FROM s),
q AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM k)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, class_id FROM s JOIN c ON s.doc_id = x JOIN q ON s.doc_id = q.doc_id"""
