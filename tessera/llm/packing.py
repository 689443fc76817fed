"""Shortest-pack-first packing over the histogram of lengths.

Texts are encoded once and cut into pieces of at most ``width`` ids. The histogram of piece lengths has
``width`` entries whatever the data, so the driver plans on it: lengths go longest first, each onto
the packs that are shortest so far among those with room, as counts of packing patterns. A pattern's
places for a length are a run of ranks, and pieces meet them by their rank among pieces of their
length. Ranks are counted in two levels (chunks of each length, then rows of a chunk), so a length
that a third of all pieces have is spread over many tasks.

Defined cases: null or empty text is one piece of the end id alone; repeated rows and doc_ids are pieces of
their own; an empty table gives no rows. sequence_id is unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import documents, stored
from tessera.llm.encoding import encoder, with_end

WIDTH, END = 2048, 1
CHUNK_ROWS, CHUNKS = 20_000, 4096
CODED = 2 << 20  # bytes encoded at once; arrays of some fifty bytes for each are held meanwhile
RANKS = 1 << 44  # ranks of one length; lengths are told apart above it


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of each text."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        encode = encoder(path, spaces=False, lower=True).encode
        for batch in batches:
            data, at = blocks.buffers(batch.column("text"))
            for i, j, part, offsets in blocks.chunks(data, at, CODED):
                ids, rows = with_end(*encode(part, offsets), end)
                ids = ids.astype("<u4")
                total = np.diff(rows)
                n = -(-total // width)
                owner = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * width
                length = np.minimum(width, total[owner] - start)
                begin = rows[owner] + start
                crc = [zlib.crc32(ids[b : b + k].data) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[owner])], names=names)

    return docs.select("doc_id", "text").mapInArrow(blocks.settled(run), ", ".join(f"{c} long" for c in names))


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths from the longest) so that each length is used as often as it occurs."""
    room: dict[int, list] = defaultdict(list)
    most = 0  # the largest room of an open pack
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        free = most
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free < length:
                room[width - length].append((left, (length,)))
                most = max(most, width - length)
                break
            count, pack = room[free].pop()
            used = min(count, left)
            if used < count:
                room[free].append((count - used, pack))
            room[free - length].append((used, (*pack, length)))
            left -= used
        while most and not room[most]:
            most -= 1
    return [x for free in sorted(room) for x in room[free]]


def places(packs: list[tuple[int, tuple[int, ...]]]):
    """Arrays by ascending (length, first rank): key, first sequence, offset. Their size depends on the histogram's width alone."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            rows.append((length * RANKS + used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, from 0, among the rows of equal length."""
    n = rows.count()
    chunks = max(1, min(CHUNKS, n // CHUNK_ROWS))
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    counts = rows.groupBy("length", "_c").agg(F.count(F.lit(1)).alias("k"))
    before = W.partitionBy("length").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    own = F.row_number().over(W.partitionBy("length", "_c").orderBy("doc_id", "start", "ids_crc32"))
    return rows.withColumn("_own", own).join(counts, ["length", "_c"]).withColumn("rank", F.col("_base") + F.col("_own") - 1).drop("_c", "_own", "_base")


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, end: int = END) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    if width < 1:
        raise ValueError("width must be positive")
    rows = stored(pieces(docs, path or tokenizer_path(), width, end), "packing-pieces")
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # width rows at most
    key, first, offset = places(patterns(histogram, width))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches):
        for b in batches:
            at = b.column("length").to_numpy() * RANKS + b.column("rank").to_numpy()
            i = np.searchsorted(key, at, "right") - 1
            columns = [b.column(c) for c in names[:5]] + [pa.array(first[i] + at - key[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked(rows).mapInArrow(place, ", ".join(f"`{c}` long" for c in names))


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
