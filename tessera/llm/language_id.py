"""Language proportions of a text by expectation-maximisation over word likelihoods.

Training counts byte trigrams of words (letters, A-Z lowered, with their edges) by language in a
fixed number of hashed cells: a task sends pages of its counters, so what is gathered depends
on the number of languages alone. A text is then a mixture: each word comes from one language with the
text's proportion of it, and has the product of its trigrams' probabilities there. The proportions are
fitted by EM for all languages, then again within the largest one, two and so on, as long as any text can gain;
the set with the best likelihood, less a price for each further language, is taken with the proportions in it.

Training is on all labelled rows, without sampling. Defined cases: null texts, texts without a letter,
and any text where nothing was learned are ``und`` with score 0; rows without a language are not learned
from, but predicted; a text with letters but no labelled trigram gets the most common language's share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import documents, stored

CELLS, PAGE = 1 << 17, 1 << 14
SMOOTH = 0.2
STEPS, AGAIN = 12, 4
#: What a further language must add to the log-likelihood: for each word, and times the log of their number.
PER_WORD, PER_LOG = 0.15, 1.0
#: Letters keep their byte (A-Z lowered; bytes of other scripts too), all else parts words.
LETTER = np.full(256, 32, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
BLOCK = 8 << 20


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 == 2


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams around each letter byte, each word's start among them, and each row's among the words."""
    b = LETTER[data]
    inside = b != 32
    left, right = np.empty_like(b), np.empty_like(b)
    left[1:], right[:-1] = b[:-1], b[1:]
    if len(b):
        left[0] = right[-1] = 32
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(b))]
        left[edges] = 32
        right[edges - 1] = 32
    place = np.flatnonzero(inside)
    code = (left[place].astype(np.uint64) << np.uint64(16)) | (b[place].astype(np.uint64) << np.uint64(8)) | right[place]
    cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64)
    starts = np.flatnonzero(left[place] == 32)
    return cell, starts, np.searchsorted(place[starts] if len(place) else place, at)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (cells, languages) from docs' text and lang."""

    def count(batches):
        held: dict = {}
        for batch in batches:
            data, at = blocks.buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for i, j, part, offsets in blocks.chunks(data, at, BLOCK):
                cell, starts, rows = trigrams(part, offsets)
                bounds = np.append(starts, len(cell))[rows]
                for k, lang in enumerate(langs[i:j]):
                    c = held.setdefault(lang, np.zeros(CELLS, np.uint64))
                    mine = cell[bounds[k] : bounds[k + 1]]
                    if len(mine) > CELLS // 8:
                        c += np.bincount(mine, minlength=CELLS).astype(np.uint64)
                    else:
                        np.add.at(c, mine, np.uint64(1))
        for lang, c in held.items():
            pages = range(CELLS // PAGE)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(pages), "page": pa.array(list(pages), pa.int32()), "counts": [blocks.planes(c[p * PAGE : (p + 1) * PAGE]) for p in pages]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(blocks.unplanes(b, np.uint64) for b in rows["counts"])
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "page": rows["page"].iloc[:1], "counts": [blocks.planes(total)]})

    kind = "lang string, page int, counts binary"
    sent = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(count, kind)
    sums = sent.groupBy("lang", "page", F.pmod(F.xxhash64("counts"), F.lit(8))).applyInPandas(add, kind).groupBy("lang", "page").applyInPandas(add, kind)
    got: dict = {}
    for r in stored(sums, "language-counts").collect():  # CELLS counters a language
        got.setdefault(r.lang, np.zeros(CELLS))[r.page * PAGE : (r.page + 1) * PAGE] = blocks.unplanes(r.counts, np.uint64)
    langs = sorted(got)
    counts = np.stack([got[x] for x in langs], 1) if langs else np.zeros((CELLS, 0))
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * CELLS)).astype(np.float32)


def mixtures(cell: np.ndarray, starts: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by text within the chosen set (rows without words: zeros), and that set as a mask."""
    n, k = len(rows) - 1, logs.shape[1]
    shares, chosen = np.zeros((n, k)), np.zeros((n, k), bool)
    size = np.diff(rows)
    full = np.flatnonzero(size > 0)
    if not len(full) or not k:
        return shares, chosen
    word = np.add.reduceat(logs[cell], starts, axis=0)
    best = word.max(1, keepdims=True)
    like = np.exp(word - best)
    owner = np.repeat(np.arange(len(full)), size[full])
    heads = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    level = np.add.reduceat(best[:, 0].astype(np.float64), heads)

    def fit(p: np.ndarray, steps: int):
        p = p / p.sum(1, keepdims=True)
        for _ in range(steps):
            r = like * p[owner].astype(np.float32)
            r /= np.maximum(r.sum(1, keepdims=True), np.float32(1e-30))
            p = np.add.reduceat(r, heads, axis=0) / size[full][:, None]
        total = np.maximum((like * p[owner].astype(np.float32)).sum(1), np.float32(1e-30))
        return p, np.add.reduceat(np.log(total.astype(np.float64)), heads) + level

    every, _ = fit(np.ones((len(full), k)), STEPS)
    order = np.argsort(-every, 1, kind="stable")
    price = PER_WORD * size[full] + PER_LOG * np.log(size[full] + 1)
    top, won, held = np.full(len(full), -np.inf), np.zeros((len(full), k), bool), np.zeros((len(full), k))
    for m in range(1, k + 1):
        if not (level - (m - 1) * price > top).any():  # no set is likelier than each word's best language
            break
        mask = np.zeros((len(full), k))
        np.put_along_axis(mask, order[:, :m], 1.0, 1)
        p, value = fit(every * mask, AGAIN if m > 1 else 0)
        value = value - (m - 1) * price
        better = value > top
        top[better], won[better], held[better] = value[better], mask[better] > 0, p[better]
    shares[full], chosen[full] = held, won
    return shares, chosen


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of it) and langs (the chosen set, joined) of docs."""
    table = docs.sparkSession.sparkContext.broadcast(logs)  # CELLS numbers a language

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            data, at = blocks.buffers(batch.column("text"))
            for i, j, part, offsets in blocks.chunks(data, at):
                shares, chosen = mixtures(*trigrams(part, offsets), table.value)
                raw = part.tobytes()
                ok = [len(langs) > 0 and letter.search(raw[offsets[r] : offsets[r + 1]].decode()) is not None for r in range(j - i)]
                pick = np.where(chosen, shares, -1.0).argmax(1) if langs else np.zeros(j - i, int)
                pred = [langs[k] if o else "und" for k, o in zip(pick.tolist(), ok, strict=True)]
                score = [min(1.0, max(0.0, float(shares[r, k]))) if o else 0.0 for r, (k, o) in enumerate(zip(pick.tolist(), ok, strict=True))]
                sets = [",".join(langs[k] for k in np.flatnonzero(chosen[r])) if o else "" for r, o in enumerate(ok)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "langs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs string")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, logs = train(docs.filter(~held_out()))
    return predict(docs, langs, logs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")
