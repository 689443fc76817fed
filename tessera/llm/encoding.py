"""Whole texts to token ids by the tokenizers library, each distinct word encoded once.

A text is cut before each run of white space; what lies between two cuts (white space, then a word)
is encoded alike wherever it stands, because no rule of these tokenizers looks over such a cut. Ids of
distinct pieces are kept in sorted hash arrays and gathered for whole Arrow columns. Texts in
which that could fail (white space beyond ASCII, special tokens) go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from tessera.llm import blocks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Distinct pieces that are remembered; beyond that the memory starts anew.
MEMORY = 1_500_000
BATCH = 4000
#: Texts that are encoded whole: special tokens' marks, and white space that is not one of the six characters.
WHOLE = re.compile(rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_encoders: dict = {}


class Encoder:
    """spaces: whether white space counts (byte-level) or only parts words; lower: whether A-Z are as a-z."""

    def __init__(self, path: str, spaces: bool, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces, self.lower = Tokenizer.from_file(path), spaces, lower
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), BATCH) for e in self.tokenizer.encode_batch(texts[i : i + BATCH], add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, at: np.ndarray):
        if not self.spaces:
            return blocks.word_bounds(data, at)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = blocks.SPACE[data]
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], len(data))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows together, and each row's offsets among them."""
        raw = data.tobytes()
        odd = np.zeros(len(at) - 1, bool)
        for m in WHOLE.finditer(raw):
            odd[np.searchsorted(at, m.start(), "right") - 1] = True
        starts, ends = self._pieces(data, at)
        hashed = blocks.span_hashes(blocks.LOWER[data] if self.lower else data, starts, ends)
        rows = np.searchsorted(starts, at)
        keys, first, back = np.unique(hashed, return_index=True, return_inverse=True)
        spot, known = blocks.find(self.keys, keys)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > MEMORY:
                self.forget()
                new = np.arange(len(keys))
            got = self._encode([raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            held = np.concatenate(self.starts)
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self.starts = [held, held[-1] + np.cumsum(lens)]
            self.ids.append(np.fromiter((x for g in got for x in g), np.uint32, int(lens.sum())))
            where = np.searchsorted(self.keys, keys[new])
            self.place = np.insert(self.place, where, np.arange(len(held) - 1, len(held) - 1 + len(new)))
            self.keys = np.insert(self.keys, where, keys[new])
            spot, _ = blocks.find(self.keys, keys)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
            self.starts = [np.concatenate(self.starts)]
        flat, begins = self.ids[0], self.starts[0]
        entry = self.place[spot][back] if len(keys) else np.zeros(0, np.int64)
        lens = begins[entry + 1] - begins[entry]
        heads = np.cumsum(lens) - lens
        ids = flat[np.repeat(begins[entry] - heads, lens) + np.arange(int(lens.sum()))] if len(lens) else np.zeros(0, np.uint32)
        ends_ = np.concatenate([[0], np.cumsum(lens)])[rows]
        if odd.any():
            whole = np.flatnonzero(odd)
            given = dict(zip(whole.tolist(), self._encode([raw[at[i] : at[i + 1]].decode() for i in whole.tolist()]), strict=True))
            parts = [np.array(given[i], np.uint32) if i in given else ids[ends_[i] : ends_[i + 1]] for i in range(len(odd))]
            ids, ends_ = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends_


def encoder(path: str, spaces: bool, lower: bool) -> Encoder:
    """One for each worker, kept between tasks."""
    if (path, spaces, lower) not in _encoders:
        _encoders.clear()
        _encoders[path, spaces, lower] = Encoder(path, spaces, lower)
    return _encoders[path, spaces, lower]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after each row."""
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))
