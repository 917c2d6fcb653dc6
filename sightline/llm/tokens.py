"""Token ids of whole texts, with each distinct word encoded once per worker.

A text is cut before every white-space byte that stands alone between two characters that are not white space. No piece of a
byte-level pre-tokenizer crosses such a place, so encoding the chunks apart gives the ids of the whole text. Chunks are told apart by
two 64-bit hashes; ids of chunks seen before come from a table that the worker process keeps between tasks (bounded, see
``ENTRIES``), new ones from the tokenizers library, many in one call.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sightline.llm import wordarrays as wa

SLOTS = 1 << 22
ENTRIES = 1_500_000
LONGEST_KEPT = 256
TOGETHER = 4000

GRAPH = np.zeros(256, bool)
GRAPH[33:127] = True
# Bytes that surely begin a character that is not white space.
SOLID = GRAPH.copy()
SOLID[0xC3:0xF5] = True
SOLID[0xE1:0xE4] = False


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def worker_tokens(path: str) -> ChunkTokens:
    """The table of this worker process for the tokenizer at ``path``."""
    kept = sys.modules.setdefault("_sightline_worker", types.ModuleType("_sightline_worker")).__dict__
    if ("tokens", path) not in kept:
        kept["tokens", path] = ChunkTokens(path)
    return kept["tokens", path]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a chunk begins; every text that is not empty begins one."""
    first = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        space = wa.IS_SPACE[data]
        first[1:-2] = space[1:-1] & ~space[:-2] & ~space[2:] & (GRAPH[data[:-2]] | SOLID[data[2:]])
    first[offsets] = True
    return np.flatnonzero(first[:-1])


class ChunkTokens:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)
        self.clear()

    def clear(self):
        self.keys = np.zeros(SLOTS, np.uint64)
        self.checks = np.zeros(SLOTS, np.uint64)
        self.entry = np.full(SLOTS, -1, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.counts = np.zeros(1 << 12, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32)
        self.n = self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other (unsigned 32-bit), and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = [np.empty(len(starts), np.uint64) for _ in range(2)]
        for lo, hi in self._blocks(starts, ends):
            at = starts[lo]
            for out, h in zip(hashes, wa.byte_hashes(data[at : ends[hi - 1]], starts[lo:hi] - at, ends[lo:hi] - at)):
                out[lo:hi] = h
        where = self._find(*hashes)
        if (where < 0).any():
            where = self._learn(data, starts, ends, hashes, where)
        counts = self.counts[where].astype(np.int64)
        bounds = wa.prefix(counts)
        ids = self.pool[np.repeat(self.starts[where] - bounds[:-1], counts) + np.arange(bounds[-1])].astype(np.uint32)
        return ids, bounds[np.searchsorted(starts, offsets)]

    @staticmethod
    def _blocks(starts, ends):
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + wa.BLOCK, "right")))
            yield lo, hi
            lo = hi

    def _find(self, first, second):
        where = np.full(len(first), -1, np.int64)
        slot = (first >> np.uint64(42)).astype(np.int64)
        left = np.arange(len(first))
        while len(left):
            entry = self.entry[slot]
            hit = (entry >= 0) & (self.keys[slot] == first[left]) & (self.checks[slot] == second[left])
            where[left[hit]] = entry[hit]
            go = (entry >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & (SLOTS - 1)
        return where

    def _learn(self, data, starts, ends, hashes, where):
        """Encodes the chunks that are not known, once each, and looks all up again."""
        missing = np.flatnonzero(where < 0)
        first = np.unique(hashes[0][missing] ^ (hashes[1][missing] * np.uint64(3)), return_index=True)[1]
        new = missing[first]
        if self.n + len(new) > ENTRIES:
            self.clear()
            where[:] = -1
            missing = np.arange(len(starts))
            new = missing[np.unique(hashes[0] ^ (hashes[1] * np.uint64(3)), return_index=True)[1]]
        self._store(self._encoded(data, starts[new], ends[new]), hashes[0][new], hashes[1][new])
        where[missing] = self._find(hashes[0][missing], hashes[1][missing])
        return where

    def _encoded(self, data, starts, ends):
        """Ids of chunks: those that may follow one another in a text are encoded together, the others one by one."""
        joinable = (ends - starts > 1) & wa.IS_SPACE[data[starts]] & ~wa.IS_SPACE[data[ends - 1]]
        joinable[joinable] = SOLID[data[starts[joinable] + 1]]
        out: list = [None] * len(starts)
        raw = data.tobytes()
        text = [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        together = np.flatnonzero(joinable)
        alone = np.flatnonzero(~joinable).tolist()
        for lo in range(0, len(together), TOGETHER):
            part = together[lo : lo + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([text[k] for k in part])], add_special_tokens=False)[0].ids, np.int64)
            wanted = np.cumsum(ends[part] - starts[part])
            reached = np.cumsum(self.lengths[ids])
            cut = np.searchsorted(reached, wanted)
            if len(ids) and (cut < len(ids)).all() and (reached[cut] == wanted).all():
                for k, piece in zip(part, np.split(ids, cut[:-1] + 1)):
                    out[k] = piece
            else:
                alone += part.tolist()
        for k, found in zip(alone, self.tokenizer.encode_batch_fast([text[k] for k in alone], add_special_tokens=False)):
            out[k] = np.array(found.ids, np.int64)
        return out

    def _store(self, pieces, first, second):
        counts = np.array([len(p) for p in pieces], np.int64)
        n, total = self.n + len(pieces), self.used + int(counts.sum())
        for name, size in (("starts", n), ("counts", n), ("pool", total)):
            old = getattr(self, name)
            if size > len(old):
                grown = np.zeros(max(size, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.counts[self.n : n] = counts
        self.starts[self.n : n] = self.used + wa.prefix(counts)[:-1]
        self.pool[self.used : total] = np.concatenate(pieces)
        number = np.arange(self.n, n, dtype=np.int32)
        slot = (first >> np.uint64(42)).astype(np.int64)
        while len(number):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = number[free]
            won = self.entry[slot] == number
            self.keys[slot[won]], self.checks[slot[won]] = first[won], second[won]
            number, first, second, slot = number[~won], first[~won], second[~won], (slot[~won] + 1) & (SLOTS - 1)
        self.n, self.used = n, total
