"""Secret scans: Aho-Corasick keywords, anchored patterns at their hits, then embedded checksums.

One automaton finds all keywords of all kinds in a single pass over a text's bytes (A-Z lowered).
Only at a hit is the pattern of its kind tried, anchored there. Kinds that carry a checksum are
kept only if it holds: the last six characters of the hosting and package tokens are the CRC32 of
the thirty before in base 62; a JSON web token's header must decode to an object with ``alg``. Runs
of hex digits have no keyword and are found by one pattern that needs 32 of them.

Defined cases: null and empty texts have no spans; matches of a kind do not overlap, also where one
fails its length or checksum; offsets count code points, ends exclusive; spans of different kinds may
overlap, and go by start, then kind. Repeated rows are scanned each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents

KINDS = ("assign", "access", "hex", "host", "package", "jwt", "pem")
BASE = KINDS[:3]
#: Keywords by kind, and what must follow from the keyword's start on.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "host": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "host": re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "package": re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
}
HEX = re.compile(rb"[0-9a-f]{32,}")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS62[r] + out
    return out.rjust(width, "0")


def checksum_holds(body: bytes) -> bool:
    """Thirty characters and their CRC32 in six base-62 digits."""
    return base62(zlib.crc32(body[:-6]), 6).encode() == body[-6:]


def _header_holds(part: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(head, dict) and "alg" in head


VALID = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "host": lambda m: checksum_holds(m[1]),
    "package": lambda m: checksum_holds(m[1]),
    "jwt": lambda m: _header_holds(m[1]),
    "pem": lambda m: True,
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(text: str | None, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans, upto = [], dict.fromkeys(KINDS, 0)
    for last, (kind, n) in words.iter(raw.translate(LOWER).decode("latin-1")):
        at = last - n + 1
        if at < upto[kind]:
            continue
        m = PATTERNS[kind].match(raw, at)
        if m:
            upto[kind] = m.end()
            if VALID[kind](m):
                spans.append((at, m.end(), kind))
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    if spans and len(raw) != len(text):
        edges = sorted({x for s in spans for x in s[:2]})
        points, done, n = {}, 0, 0
        for x in edges:
            n += len(raw[done:x].decode("utf-8", "surrogatepass"))
            points[x], done = n, x
        spans = [(points[a], points[b], k) for a, b, k in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row of docs."""

    def run(batches):
        words = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t.as_py(), words)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the hash of their spans, and all spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret (overlapping spans together) replaced in ``text``; ``n_chars``, if there, follows the text."""
    names = docs.columns

    def run(batches):
        words = automaton()
        for b in batches:
            out = []
            for t in b.column("text"):
                t = t.as_py()
                done, parts = 0, []
                for s, e, _ in find(t, words):
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                out.append(t if not parts else "".join([*parts, t[done:]]))
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*names)


def op4(spark, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
