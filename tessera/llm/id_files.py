"""Token-id files with Elias-Fano document boundaries.

A shard file holds its documents' ids one after another (two bytes each where the vocabulary allows),
then the n + 1 boundaries as an Elias-Fano sequence: ``low`` bits of each packed side by side, and
the rest in unary in a bit vector, about two bits a document; the place of every SAMPLE-th set bit
makes select, and so any document's offset, a short scan. The ascending doc_ids are kept likewise.
There is no table of 64-bit offsets: a reader takes blocks of offsets by select.

Files go to the shared folder, ranges of doc_id in order, and are streamed by block while written.

Defined cases: null text is empty, and has the end id alone; null doc_ids come first, are counted in
the foot, and read back as null; repeated doc_ids are ordered by text; an empty table makes no rows.
"""

from __future__ import annotations

import json
import mmap
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import Files, documents, input_bytes, scratch
from tessera.llm.encoding import encoder, with_end

END = 0
SHARD_INPUT = 32 << 20
SAMPLE = 256
READ = 10_000  # documents read at once


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class EliasFano:
    """A sequence that does not fall, of n values from 0 to top."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low, dtype=np.uint64)
        lows = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low, lows, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if len(bits) < 1 << 32 else np.uint64))

    def __getitem__(self, i: int) -> int:
        """The i-th value: select on the unary bits from the nearest sample, then the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE, at // 8
        skip = at % 8
        while True:
            bits = np.flatnonzero(np.unpackbits(self.highs[byte : byte + 64], bitorder="little")[skip:])
            if len(bits) > need:
                one = byte * 8 + skip + int(bits[need])
                break
            need, byte, skip = need - len(bits), byte + 64, 0
        first = i * self.low
        held = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little") >> (first % 8)
        return ((one - i) << self.low) | (held & ((1 << self.low) - 1))

    def values(self, i: int, j: int) -> np.ndarray:
        """Values i to j: select of the first, and the unary bits from there to the sample after the last."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, after = int(self.samples[i // SAMPLE]), -(-j // SAMPLE)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.highs)
        bits = np.unpackbits(self.highs[first // 8 : (end + 7) // 8], bitorder="little")[first % 8 :]
        ones = np.flatnonzero(bits)[i % SAMPLE : i % SAMPLE + j - i] + first
        high = (ones - np.arange(i, j)).astype(np.uint64)
        if not self.low:
            return high
        at = i * self.low
        low = np.unpackbits(self.lows[at // 8 : (j * self.low + 7) // 8], bitorder="little")[at % 8 :][: (j - i) * self.low].reshape(j - i, self.low)
        return (high << np.uint64(self.low)) | (low.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        """All values at once."""
        high = (np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n] - np.arange(self.n)).astype(np.uint64)
        if not self.low:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
        return (high << np.uint64(self.low)) | (bits << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def parts(self) -> list[np.ndarray]:
        return [self.lows, self.highs, self.samples]


class IdFile:
    """A shard file, mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        (size,) = struct.unpack("<q", self.data[-8:])
        self.foot = json.loads(self.data[-8 - size : -8])
        self.ids = self._array(self.foot["ids"])
        self.bounds, self.docs = (EliasFano(self.foot[k]["n"], self.foot[k]["low"], *map(self._array, self.foot[k]["parts"])) for k in ("bounds", "docs"))

    def _array(self, spec) -> np.ndarray:
        at, n, kind = spec
        return np.frombuffer(self.data, np.dtype(kind), n, at)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Of documents i to j; nulls come first."""
        none = self.foot["nulls"]
        known = self.docs.values(max(0, i - none), max(0, j - none)).astype(np.int64) + self.foot["first"]
        return [None] * max(0, min(j, none) - i) + known.tolist()


def _file(parts, kind: str, facts: dict):
    """The pieces of a shard file from (doc_ids, ids, row offsets) blocks; facts are filled in on the way."""
    ids_n, at, docs, lens = 0, 0, [], []
    for owners, ids, rows in parts:
        docs += owners
        lens.append(np.diff(rows))
        ids_n += len(ids)
        out = ids.astype(kind).tobytes()
        at += len(out)
        yield out
    foot = {"ids": [0, ids_n, kind], "nulls": sum(d is None for d in docs)}
    known = np.array([d for d in docs if d is not None], np.int64)
    foot["first"] = int(known[0]) if len(known) else 0
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lens))]) if lens else np.zeros(1, np.int64)
    for name, values in (("bounds", ends), ("docs", (known - foot["first"]).view(np.uint64))):
        e = EliasFano.encode(values)
        held = []
        for x in e.parts():
            pad = -at % 8
            yield b"\0" * pad
            held.append([at + pad, len(x), x.dtype.str])
            yield x.tobytes()
            at += pad + x.nbytes
        foot[name] = {"n": e.n, "low": e.low, "parts": held}
    text = json.dumps(foot).encode()
    yield text + struct.pack("<q", len(text))
    facts |= {"docs": len(docs), "tokens": ids_n, "bytes": at + len(text) + 8}


def write(docs: DataFrame, root: str, path: str | None = None, end: int = END, shard_input: int = SHARD_INPUT) -> list[tuple[str, int, int]]:
    """Encode docs in order of doc_id into files below root: (name, documents, ids) of each, in order."""
    path = path or tokenizer_path()
    shards = max(1, -(-input_bytes(docs) // shard_input))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        coder = encoder(path, spaces=True, lower=False)
        kind = "<u2" if coder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        name, facts = f"ids-{TaskContext.get().partitionId():06d}", {}

        def parts():
            for batch in batches:
                data, at = blocks.buffers(batch.column("text"))
                for i, j, part, offsets in blocks.chunks(data, at, 4 << 20):
                    yield batch.column("doc_id").slice(i, j - i).to_pylist(), *with_end(*coder.encode(part, offsets), end)

        Files(root).write(name, _file(parts(), kind, facts))
        yield pa.RecordBatch.from_pydict({"name": [name], "docs": [facts["docs"]], "ids": [facts["tokens"]]})

    return sorted((r.name, r.docs, r.ids) for r in ordered.mapInArrow(run, "name string, docs long, ids long").collect())  # a row a file


def read(spark, root: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    base = np.cumsum([0, *[f[2] for f in files]])
    rows = [(f[0], int(b)) for f, b in zip(files, base, strict=False) if f[1]]
    if not rows:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in names))
    spec = spark.createDataFrame(rows, "name string, base long").repartition(len(rows))

    def run(batches):
        for b in batches:
            for name, first in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = IdFile(Files(root).path(name))
                for i in range(0, len(f), READ):
                    j = min(len(f), i + READ)
                    ends = f.bounds.values(i, j + 1).astype(np.int64)
                    crc = [zlib.crc32(f.ids[a:e].astype("<u4").data) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(i, j), pa.int64()), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=names)

    return spec.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def op8(spark, sf_dir: str) -> DataFrame:
    root = scratch(spark, "id-files")
    return read(spark, root, write(documents(spark, sf_dir), root))
