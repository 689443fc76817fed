"""The pipeline's stages on sf0.001, each on what the one before kept, against plain versions."""

import collections
import re
import zlib

import corpus_pipeline as P
import numpy as np
from tessera.llm import packing, quality, secrets
from tessera.llm.common import documents, stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark):
    from tokenizers import Tokenizer

    docs, kept = documents(spark, SF), {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, SF), f"test-{name}")
        assert name == P.STAGES[-1][0] or out.columns == docs.columns
        kept[name] = out.collect()
        docs = out

    good = {r.doc_id for r in quality.op1(spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in kept["quality"]} == good

    texts = {r.doc_id: r.text for r in kept["quality"]}
    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[root(b)] = root(a)
    unique = [r.doc_id for r in kept["near_duplicates"]]
    assert sorted(map(root, unique)) == sorted({root(i) for i in ids})

    words, clean = secrets.automaton(), {r.doc_id: r.text for r in kept["secrets"]}
    assert sorted(clean) == sorted(unique)
    for i, t in clean.items():
        found = secrets.find(texts[i] or "", words)
        assert (t == texts[i]) == (not found)
        assert not any((texts[i] or "")[a:b] in t for a, b, kind in found if kind in ("access", "hex"))

    mixed = collections.Counter(r.doc_id for r in kept["mixing"])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2
    assert all(r.text == clean[r.doc_id] for r in kept["mixing"])

    coder = Tokenizer.from_file(packing.tokenizer_path())
    coded = {i: np.array([*coder.encode(clean[i] or "", add_special_tokens=False).ids, 1], "<u4") for i in mixed}
    pieces = collections.Counter()
    for r in kept["packing"]:
        assert r.ids_crc32 == zlib.crc32(coded[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] += r.length
    assert all(pieces[i] == n * len(coded[i]) for i, n in mixed.items()) and set(pieces) == set(mixed)
