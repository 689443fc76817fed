"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, kept as sorted hash arrays that workers map.

Counting. Tasks hash the words of whole Arrow columns, count distinct words and then distinct n-grams
of word numbers in blocks, and send each shard one compact array a block. Reducers merge a
shard's arrays and write them, sorted, as plain files in the shared folder (``Files``). Counts of a lower
order are of the distinct n-grams above, so reducers send each n-gram without its first word on to the next order. Word
shards are ranges of the word hash, others hashes of the context; contexts with over a
shard's share of the tokens are dealt by n-gram, and only their totals are joined up again. Number of shards
follows the input, so a reducer's memory does not. The model holds every n-gram of the corpus.

Scoring. Workers map the files and look up the sorted distinct keys of a block of texts: a context by search among its
shard's, then a word by search among the 4-byte words after that context.

  p(w|uv) = (c(uvw) - D(c)) / c(uv.) + g(uv) p(w|v)
  p(w|v) = (a(vw) - D'(a)) / a(v.) + g(v) p(w)
  p(w) = (a(w) - D"(a)) / a(.) + g / (V + 1)

a is the number of distinct words before; at order 2 pairs keep their counts. D are the three discounts of each order; an
unseen context leaves the order below, an unknown word 1 / (V + 1) of what the discounts free. A text has a start before it
for each word of the longest context.

Where a corpus is so small that no count is 1, 2, 3 or 4, discounts are FEW.
Every shard writes its files, empty or not: one that is missing is an error and not an empty count.

Defined cases: a null or blank text is one end token. Without training rows V is 0 and every token
has probability 1. Repeated rows count each time. A null doc_id counts as the empty string's crc32, 0.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import Files, documents, input_bytes, remove, scratch, stored

#: The end of a text among word hashes.
END = np.uint64(0x454E44)
#: The start before a text, where words are hashes; its number is V.
START = np.uint64(0x535441)
NONE = np.uint64(0xFFFFFFFF)  # the number of an unknown word within a key
ORDER = 3
BLOCK = 700_000  # tokens counted or scored at once
SHARD_INPUT = 4 << 20  # bytes of input by shard
FEW = (0.5, 1.0, 1.5)  # discounts that counts cannot tell


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 == 1


def _tokens(batches, extra: int = 0):
    """Blocks of (token hashes with END after each text, offsets by text, rows) over Arrow batches."""
    held, sizes, kept, n = [], [], [], 0

    def done():
        hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
        return hashes, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), kept

    for batch in batches:
        data, at = blocks.buffers(batch.column("text"))
        for i, j, part, offsets in blocks.chunks(data, at):
            h, w = blocks.words(part, offsets)
            held.append(np.insert(h, w[1:], END))
            sizes.append(np.diff(w) + 1)
            kept.append(batch.slice(i, j - i))
            n += len(held[-1])
            if n >= BLOCK:
                yield done()
                held, sizes, kept, n = [], [], [], 0
    if held:
        yield done()


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b) if b else b


def _send(shards: np.ndarray, keys: np.ndarray, words: np.ndarray | None, counts: np.ndarray) -> list[tuple]:
    """One row a shard: its keys (words or contexts), ascending, the words after contexts, and counts."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order].astype(np.uint32)  # of one block, so below 2**32
    words = None if words is None else words[order].astype(np.uint32)
    if not len(shards):
        return []
    heads = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
    ends = [*heads[1:], len(shards)]
    return [(int(shards[a]), _zip(blocks.pack_sorted(keys[a:b])), None if words is None else _zip(blocks.planes(words[a:b])), _zip(blocks.planes(counts[a:b]))) for a, b in zip(heads, ends, strict=True)]


SENT = "shard int, keys binary, words binary, counts binary"
_SENT = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _merged(rows: pd.DataFrame):
    return blocks.merge_counts([blocks.unpack_sorted(_unzip(b)) for b in rows["keys"]], [blocks.unplanes(_unzip(b), np.uint32) for b in rows["counts"]])


def _coded(x: np.ndarray) -> list[bytes]:
    """Whole numbers as a byte each; places and values of those of 255 and more come before."""
    big = np.flatnonzero(x >= 255)
    return [np.array([len(big)], np.uint64).tobytes(), big.astype(np.int64).tobytes(), x[big].astype(np.int64).tobytes(), np.minimum(x, 255).astype(np.uint8).tobytes()]


def _within(table: np.ndarray, low: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the ascending part of the table from low to end, each its own, and whether they are there."""
    low, high = low.copy(), end.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        below = table[mid] < keys[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    there = low < end
    there[there] = table[low[there]] == keys[there]
    return low, there


def _grams(contexts: np.ndarray, words: np.ndarray):
    """Distinct contexts, and each row's key: the place of its context, then its word."""
    distinct, place = np.unique(contexts, return_inverse=True)
    return distinct, place.astype(np.uint64) << np.uint64(32) | words.astype(np.uint64) & NONE


def _of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4 and 3 or more, and the sum."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum()), int(counts.sum())]


class Model:
    """What workers need: the folder, the shards and a few numbers. Arrays are mapped where they are used."""

    def __init__(self, root: str, shards: int, order: int):
        self.root, self.shards, self.order = root, shards, order
        self.bits = shards.bit_length() - 1
        self.starts = np.zeros(shards + 1, np.int64)
        self.total = 0
        self.heavy = {k: np.zeros(0, np.uint64) for k in (2, 3)}
        self.heavy_stats = {k: np.zeros((0, 4)) for k in (2, 3)}
        self.discounts = {}
        self.unigram = (0, 0, 0, 0)

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def array(self, name: str, dtype) -> np.ndarray:
        """Mapped anew at each use, so that a worker holds pages of one shard at a time."""
        path = Files(self.root).path(name)  # every shard has its files, so a missing one is an error
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)

    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of ascending hashes; -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        cuts = np.searchsorted(self.word_shard(h), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b and self.starts[s + 1] > self.starts[s]:
                at, there = blocks.find(self.array(f"word{s}", np.uint64), h[a:b])
                out[a:b] = np.where(there, at + self.starts[s], -1)
        return out

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of a coded array by word number; ids ascending."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.starts)
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out[a:b] = self.numbers(f"{name}{s}", ids[a:b] - self.starts[s])
        return out

    def numbers(self, name: str, at: np.ndarray) -> np.ndarray:
        """Values of a coded array at the places given."""
        raw = self.array(name, np.uint8)
        n = int(raw[:8].view(np.uint64)[0])
        out = raw[8 + 16 * n :][at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = raw[8 + 8 * n : 8 + 16 * n].view(np.int64)[np.searchsorted(raw[8 : 8 + 8 * n].view(np.int64), at[big])]
        return out

    def dealt(self, k: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Shards of n-grams: by context, heavy contexts by n-gram."""
        by = blocks.mix(contexts)
        hot = np.flatnonzero(blocks.find(self.heavy[k], contexts)[1])
        by[hot] = blocks.mix(by[hot] + words[hot].astype(np.uint64))
        return (by % np.uint64(self.shards)).astype(np.int64)

    def grams(self, k: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams of order k: counts (0: unseen), and (total, n1, n2, n3+) of their contexts."""
        count, stats, shard = np.zeros(len(words)), np.zeros((len(words), 4)), self.dealt(k, contexts, words)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            pick = order[cuts[s] : cuts[s + 1]]
            at, there = blocks.find(self.array(f"context{k}-{s}", np.uint64), contexts[pick])
            pick, at = pick[there], at[there]
            if not len(pick):
                continue
            first = self.array(f"first{k}-{s}", np.uint32)
            a, b = first[at].astype(np.int64), first[at + 1].astype(np.int64)
            stats[pick, :3] = self.numbers(f"stats{k}-{s}", (at[:, None] * 3 + np.arange(3)).ravel()).reshape(-1, 3)
            stats[pick, 3] = b - a - stats[pick, 1] - stats[pick, 2]
            at, there = _within(self.array(f"next{k}-{s}", np.uint32), a, b, words[pick].astype(np.uint32))
            count[pick[there]] = self.numbers(f"count{k}-{s}", at[there])
        at, there = blocks.find(self.heavy[k], contexts)
        if there.any():
            stats[there] = self.heavy_stats[k][at[there]]
        return count, stats


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """From how many counts are 1 to 4; fixed ones where a small corpus lacks any of those, so that an unknown word always has its share."""
    if not all(n[:4]):
        return FEW
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in zip((1, 2, 3), raw, strict=True))


def _discounted(c: np.ndarray, d: tuple) -> np.ndarray:
    return c - np.select([c >= 3, c == 2, c == 1], [d[2], d[1], d[0]], 0.0)


def _before(x: np.ndarray, at: np.ndarray, start, back: int) -> np.ndarray:
    """What stands ``back`` places before each token of its text, or the start."""
    out = np.empty_like(x)
    out[back:] = x[: len(x) - back]
    for i in range(back):
        place = at[:-1] + i
        out[place[place < at[1:]]] = start
    return out


def _numbered(model: Model, hashes: np.ndarray):
    """Distinct hashes' word numbers (-1 unknown), the way back to tokens, and the number of each token."""
    distinct, back = np.unique(hashes, return_inverse=True)
    known = model.ids(distinct)
    return known, back, known[back]


def _contexts(model: Model, k: int, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose k - 1 predecessors are all known or starts, and these as one number."""
    last = _before(ids, at, model.size, 1)
    if k == 2:
        rows = np.flatnonzero(last >= 0)
        return rows, last[rows].astype(np.uint64)
    first = _before(ids, at, model.size, 2)
    rows = np.flatnonzero((first >= 0) & (last >= 0))
    return rows, first[rows].astype(np.uint64) << np.uint64(32) | last[rows].astype(np.uint64)


def _hot(hashes: np.ndarray, at: np.ndarray, keys: np.ndarray, counts: np.ndarray, least: float):
    """Pairs of following words, starts included, that stand before at least ``least`` tokens of a block, and how often."""
    often = keys[counts >= least]
    often = np.unique(np.append(often, START)) if len(at) - 1 >= least else often
    first, last = _before(hashes, at, START, 2), _before(hashes, at, START, 1)
    a, there = blocks.find(often, first)
    b, too = blocks.find(often, last)
    pairs, n = np.unique((a * max(1, len(often)) + b)[there & too], return_counts=True)
    pairs, n = pairs[n >= least], n[n >= least]
    return often[pairs // max(1, len(often))], often[pairs % max(1, len(often))], n


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count docs (column text) and write the model of order 2 or 3 to the shared folder."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    docs = docs.select("text")
    size = input_bytes(docs)
    shards = 1 << max(3, min(16, (max(1, size) // SHARD_INPUT).bit_length()))
    root = scratch(spark, "ngram-lm")
    model = Model(root, shards, order)
    #: An empty array for each shard, so that shards without a row are written too.
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(None).cast("binary").alias("words"), F.lit(b"").alias("counts"))
    empty = every.withColumn("words", F.lit(b""))

    def count_words(batches):
        for hashes, at, _ in _tokens(batches):
            keys, counts = np.unique(hashes, return_counts=True)
            rows = _send(model.word_shard(keys), keys, None, counts)
            if order == 3:
                # Half a share of a block: a context with a whole share of all tokens has half of that or more from blocks where it is sent.
                u, v, n = _hot(hashes, at, keys, counts, len(hashes) / (2 * shards))
                for s in np.unique(model.word_shard(u)):
                    pick = model.word_shard(u) == s
                    rows.append((int(s), u[pick].tobytes(), v[pick].tobytes(), n[pick].astype(np.uint32).tobytes()))
            yield _batch(rows)

    def write_words(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        plain = rows["words"].isna()
        keys, counts = _merged(rows[plain])
        Files(root).write(f"word{s}", [keys.tobytes()])
        Files(root).write(f"seen{s}", _coded(counts))
        out = pd.DataFrame({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())], "most": [int(counts.max(initial=0))], "u": [0], "v": [0]})
        hot = rows[~plain]
        if not len(hot):
            return out
        u, v, n = (np.frombuffer(b"".join(hot[c]), t) for c, t in (("keys", np.int64), ("words", np.int64), ("counts", np.uint32)))
        sums = pd.DataFrame({"u": u, "v": v, "n": n.astype(np.int64)}).groupby(["u", "v"], as_index=False).sum()
        return pd.concat([out, sums.assign(shard=-1, total=0, most=0)])[out.columns]

    found = docs.mapInArrow(count_words, SENT).union(every).groupBy("shard").applyInPandas(write_words, "shard int, n long, total long, most long, u long, v long")
    found = stored(found, "ngram-words")
    each = {r.shard: r for r in found.filter("shard >= 0").collect()}  # a row a shard
    model.starts = np.concatenate([[0], np.cumsum([each[s].n for s in range(shards)])])
    model.total = sum(r.total for r in each.values())
    if model.size >= (1 << 32) - 1:
        raise ValueError("over 2**32 distinct words")
    #: Contexts with more than a shard's share of all tokens, at most as many as shards; the driver reads no more.
    heavy = []
    for s in range(shards):
        if each[s].most * shards > model.total:
            counts = model.numbers(f"seen{s}", np.arange(each[s].n))
            heavy += [int(i + model.starts[s]) for i in np.flatnonzero(counts * shards > model.total)]
    texts = docs.count()
    heavy += [model.size] * (texts * shards > model.total)
    model.heavy[2] = np.sort(np.array(heavy, np.uint64))
    hot = found.filter((F.col("shard") == -1) & (F.col("n") * (2 * shards) >= model.total)).select("u", "v").collect()  # at most twice as many as shards
    hot = np.array([(r.u, r.v) for r in hot], np.int64).reshape(-1, 2).view(np.uint64)
    known, back = np.unique(hot, return_inverse=True)
    ids = np.where(known == START, model.size, model.ids(known))[back.ravel()].reshape(-1, 2).astype(np.uint64)
    model.heavy[3] = np.sort(ids[:, 0] << np.uint64(32) | ids[:, 1])

    def count_grams(batches):
        for hashes, at, _ in _tokens(batches):
            _, _, ids = _numbered(model, hashes)
            del hashes
            contexts, keys = _grams(_contexts(model, order, ids, at)[1], ids)
            keys, counts = np.unique(keys, return_counts=True)
            contexts, words = contexts[(keys >> np.uint64(32)).astype(np.int64)], keys & NONE
            yield _batch(_send(model.dealt(order, contexts, words), contexts, words, counts))

    cols = ["n1", "n2", "n3", "n4", "n3p", "total"]

    def wide(b: bytes) -> np.ndarray:
        return blocks.unplanes(b, np.uint32)

    def writer(k: int):
        def write_grams(rows: pd.DataFrame) -> pd.DataFrame:
            s = int(rows["shard"].iloc[0])
            contexts, words, counts = (np.concatenate([f(_unzip(b)) for b in rows[c]]) for c, f in (("keys", blocks.unpack_sorted), ("words", wide), ("counts", wide)))
            del rows
            contexts, keys = _grams(contexts, words)
            del words
            keys, counts = blocks.merge_counts([keys], [counts])
            place = (keys >> np.uint64(32)).astype(np.int64)
            heads = np.searchsorted(place, np.arange(len(contexts)))
            stats = np.stack([np.add.reduceat(x.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)
            files = Files(root)
            files.write(f"context{k}-{s}", [contexts.tobytes()])
            if len(keys) >= 1 << 32:
                raise ValueError("over 2**32 n-grams in a shard")
            files.write(f"first{k}-{s}", [np.append(heads, len(keys)).astype(np.uint32).tobytes()])
            files.write(f"next{k}-{s}", [(keys & NONE).astype(np.uint32).tobytes()])
            files.write(f"count{k}-{s}", _coded(counts))
            files.write(f"stats{k}-{s}", _coded(stats[:, :3].ravel()))  # the fourth follows from how many words there are
            out = [(-1, *_of(counts), 0, None, None, None)]
            out += [(-2, *map(int, stats[i]), 0, 0, int(contexts[i].view(np.int64)), None, None, None) for i in np.flatnonzero(blocks.find(model.heavy[k], contexts)[1])]
            words = keys & NONE
            if k == 2:
                words, n = np.unique(words, return_counts=True)
                cuts = np.searchsorted(words, model.starts.astype(np.uint64))
                sent = [(t, _zip(blocks.pack_sorted(words[a:b])), b"", _zip(blocks.planes(n[a:b].astype(np.uint32)))) for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            else:
                pairs, n = np.unique((contexts[place] & NONE) << np.uint64(32) | words, return_counts=True)
                below, words = pairs >> np.uint64(32), pairs & NONE
                sent = _send(model.dealt(k - 1, below, words), below, words, n)
            out += [(t, 0, 0, 0, 0, 0, 0, 0, *arrays) for t, *arrays in sent]
            return pd.DataFrame(out, columns=["shard", *cols, "context", "keys", "words", "counts"])

        return write_grams

    def write_contexts(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        keys, counts = _merged(rows)
        a = np.zeros(int(model.starts[s + 1] - model.starts[s]), np.int64)
        a[keys.astype(np.int64) - model.starts[s]] = counts
        Files(root).write(f"contexts{s}", _coded(a))
        return pd.DataFrame([(s, *_of(a))], columns=["shard", *cols])

    longs = ", ".join(f"{c} long" for c in cols)
    sent, used = docs.mapInArrow(count_grams, SENT), None
    for k in range(order, 1, -1):
        sent = sent.union(empty).groupBy("shard").applyInPandas(writer(k), f"shard int, {longs}, context long, keys binary, words binary, counts binary")
        sent = stored(sent, f"ngram-{k}")
        if used:  # the order above, now counted
            remove(spark, used)
        used = os.path.dirname(sent.inputFiles()[0])
        n = sent.filter("shard = -1").agg(*[F.sum(c).alias(c) for c in cols]).first()
        model.discounts[k] = _discounts([n[c] or 0 for c in cols])
        model.heavy_stats[k] = np.zeros((len(model.heavy[k]), 4))  # a heavy word that is no context, such as the end, keeps zeros
        for r in sent.filter("shard = -2").groupBy("context").agg(*[F.sum(c).alias(c) for c in cols[:4]]).collect():  # one a heavy context
            model.heavy_stats[k][np.searchsorted(model.heavy[k], np.int64(r.context).view(np.uint64))] = [r.n1, r.n2, r.n3, r.n4]
        sent = sent.filter("shard >= 0").select("shard", "keys", "words", "counts")
    first = sent.union(empty).groupBy("shard").applyInPandas(write_contexts, f"shard int, {longs}").collect()
    remove(spark, used)
    n = [sum(r[c] for r in first) for c in cols]
    model.discounts[1], model.unigram = _discounts(n), (n[5], n[0], n[1], n[4])
    return model


SCORED = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with token counts and the log10 probabilities of each text."""
    fields = docs.select(*keep).schema
    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        n, v = model.total, model.size
        d1, below = model.discounts[1], max(1, model.unigram[0])
        left = float(np.dot(d1, model.unigram[1:])) / below if model.unigram[0] else 1.0
        for hashes, at, kept in _tokens(batches):
            known, back, ids = _numbered(model, hashes)
            order = np.argsort(known, kind="stable")
            low = int(np.searchsorted(known[order], 0))
            seen, contexts = np.zeros(len(known)), np.zeros(len(known))
            pick = order[low:]
            seen[pick] = model.by_id("seen", known[pick])
            contexts[pick] = model.by_id("contexts", known[pick])
            base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))[back]
            p = (_discounted(contexts, d1) / below + left / (v + 1))[back]
            for k in range(2, model.order + 1):
                rows, held = _contexts(model, k, ids, at)  # an unknown word too pays its context's way down
                held, keys = _grams(held, ids[rows])
                keys, there = np.unique(keys, return_inverse=True)
                count, stats = model.grams(k, held[(keys >> np.uint64(32)).astype(np.int64)], keys & NONE)
                have, d = stats[:, 0] > 0, model.discounts[k]
                total = np.where(have, stats[:, 0], 1)
                u = np.where(have, _discounted(count, d) / total, 0.0)
                g = np.where(have, stats[:, 1:] @ np.array(d) / total, 1.0)
                p[rows] = u[there] + g[there] * p[rows]
            rows = pa.Table.from_batches(kept).select(keep).combine_chunks()
            columns = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in keep]
            columns += [pa.array(np.diff(at)), pa.array(blocks.row_sums((seen > 0).astype(np.int64)[back], at)), pa.array(np.full(len(at) - 1, n, np.int64))]
            columns += [pa.array(np.add.reduceat(x, at[:-1])) for x in (base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + SCORED)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.filter(~held_out()), ORDER)
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
