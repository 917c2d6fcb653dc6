"""Token ids in compressed binary files: an adaptive range coder with escapes from order 2 over order 1 to order 0.

A block holds up to ``BLOCK`` ids and starts from a fresh model, so that blocks are decoded independently; each carries a CRC-32 of
its ids. This is escape coding, not context mixing: no probabilities of the orders are combined. Order 2 and order 1 each offer
one id, the one that followed their context last, from hashed tables of ``SLOTS2`` and ``SLOTS1`` places. The widths of "order 2 is
right", "order 1 is right" and "neither" are learned per pair of confidences. In the last case order 0 decides at the level of
ranges: an adaptive distribution over ``CELLS`` ranges of ids, then the place in the range, all places alike.

Blocks of a segment are coded in lockstep, one numpy lane per block: low and range have 64 bits, 32-bit words are written when
the range falls below 2**32, and carries run back into the words already written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
CELLS = 32
BITS = 14
ONE = 1 << BITS
PLACE = 13
SLOTS2, SLOTS1 = 1 << 9, 1 << 8
MAGIC = b"SLRC"
HEAD = "<4sIIIQ"
HEAD_SIZE = struct.calcsize(HEAD)
_U = np.uint64
WORD = _U(32)
LEAST = _U(1 << 32)


def cell_bits(vocabulary: int) -> np.ndarray:
    """Sizes of the ranges, as powers of two that grow with every third range and together hold the vocabulary."""
    steps = np.arange(CELLS) // 3
    for least in range(-10, PLACE + 1):
        bits = np.clip(steps + least, 0, PLACE)
        if (1 << bits).sum() >= vocabulary:
            return bits
    raise ValueError(f"a vocabulary of {vocabulary} is too large for this format")


class Model:
    """What all lanes predict; encoder and decoder call the same steps in the same order."""

    def __init__(self, lanes: int, vocabulary: int):
        self.lane = np.arange(lanes)
        self.table2 = np.zeros(lanes * SLOTS2, np.uint32)
        self.table1 = np.zeros(lanes * SLOTS1, np.uint32)
        self.base2, self.base1, self.base_p = self.lane * SLOTS2, self.lane * SLOTS1, self.lane * 16
        self.base_c = self.lane * (CELLS + 1)
        trust = np.array([128, 4500, 9000, 13000], np.int32)
        self.right2 = np.tile(np.repeat(trust, 4), lanes)
        self.right1 = np.tile(np.tile(trust, 4), lanes)
        self.bits = cell_bits(vocabulary)
        self.borders = np.append(0, np.cumsum(1 << self.bits))
        self.fine = PLACE - self.bits
        self.cdf = np.tile((np.arange(CELLS + 1) * (ONE // CELLS)).astype(np.int16), (lanes, 1))
        place = np.arange(CELLS + 1)
        self.goal = np.where(place[None, :] <= np.arange(CELLS)[:, None], place, ONE - CELLS + place).astype(np.int16)
        self.last1 = np.zeros(lanes, np.uint32)
        self.last2 = np.zeros(lanes, np.uint32)
        self.seen = 0

    def narrow(self, lanes: int) -> None:
        """Goes on with the first lanes only."""
        if lanes == len(self.lane):
            return
        for name in ("lane", "base2", "base1", "base_p", "base_c", "cdf", "last1", "last2"):
            setattr(self, name, getattr(self, name)[:lanes])

    def predict(self):
        """Predicted ids, and the widths (out of ``ONE``) of the intervals of order 2 and order 1."""
        hashed = self.last1 * np.uint32(0x9E3779B1)
        self.at1 = self.base1 + (hashed >> np.uint32(24))
        self.at2 = self.base2 + ((hashed + self.last2 * np.uint32(0x85EBCA6B)) >> np.uint32(23))
        self.held2, self.held1 = self.table2.take(self.at2), self.table1.take(self.at1)
        self.id2, self.id1 = self.held2 >> np.uint32(2), self.held1 >> np.uint32(2)
        self.conf2, self.conf1 = self.held2 & np.uint32(3), self.held1 & np.uint32(3)
        self.at_p = self.base_p + (self.conf2 * np.uint32(4) + self.conf1)
        self.p2, self.p1 = self.right2.take(self.at_p), self.right1.take(self.at_p)
        return self.p2, (((ONE - self.p2) * self.p1) >> BITS) * (self.id1 != self.id2)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, cell: np.ndarray) -> None:
        """Moves every part of the model towards what came. ``hit2``, ``hit1``: which order coded the id."""
        right = ONE - 256
        self.right2[self.at_p] = self.p2 + ((hit2 * np.int32(right) - self.p2 + 31) >> 5)
        self.right1[self.at_p] = self.p1 + (((hit1 * np.int32(right) - self.p1 + 31) >> 5) * ~hit2)
        fresh = (ids << np.uint32(2)) | np.uint32(1)
        for table, at, held, conf, hit in (
            (self.table2, self.at2, self.held2, self.conf2, hit2), (self.table1, self.at1, self.held1, self.conf1, self.id1 == ids),
        ):
            table[at] = np.where(hit, held + (conf < 3), np.where(conf > 1, held - np.uint32(1), fresh))
        change = self.goal.take(cell, axis=0)
        change -= self.cdf
        change >>= np.int16(4 if self.seen < 48 else 5)
        self.cdf += change
        self.seen += 1
        self.last2, self.last1 = self.last1, ids


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """A segment: header, one (words, checksum) pair per block, then the words of all blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes = -(-n // block)
    checks = [zlib.crc32(ids[k * block : (k + 1) * block]) for k in range(lanes)]
    if not n:
        return struct.pack(HEAD, MAGIC, 1, vocabulary, block, 0)
    columns = np.zeros((lanes, block), np.uint32)
    columns.reshape(-1)[:n] = ids
    columns = np.ascontiguousarray(columns.T)
    tail = n - (lanes - 1) * block
    model = Model(lanes, vocabulary)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    room = block + 16
    # By word number first: lanes stand at about the same one, so that what is written together lies together.
    words, count = np.zeros((room, lanes), np.uint32), np.zeros(lanes, np.int64)
    cells = (np.searchsorted(model.borders, np.arange(model.borders[-1]), "right") - 1).astype(np.int64)

    def put(active, start, share, unit):
        add = start * unit
        part = low[:active]
        part += add
        for k in np.flatnonzero(part < add):
            at = count[k] - 1
            while words[at, k] == 0xFFFFFFFF:
                words[at, k] = 0
                at -= 1
            words[at, k] += np.uint32(1)
        left = share * unit
        full = np.flatnonzero(left < LEAST)
        if len(full):
            words[count[full], full] = low[full] >> WORD
            count[full] += 1
            low[full] <<= WORD
            left[full] <<= WORD
        return left

    for step in range(min(block, n)):
        active = lanes if step < tail else lanes - 1
        if not active:
            break
        model.narrow(active)
        now = columns[step, :active]
        width2, width1 = model.predict()
        hit2 = now == model.id2
        hit1 = (now == model.id1) & (width1 > 0)
        miss = ~(hit2 | hit1)
        start = width2 * ~hit2 + width1 * miss
        share = np.where(hit2, width2, np.where(hit1, width1, ONE - width2 - width1))
        width = put(active, start.astype(np.uint64), share.astype(np.uint64), width[:active] >> _U(BITS))
        cell = cells.take(now)
        at = model.base_c + cell
        flat = model.cdf.reshape(-1)
        row = flat.take(at).astype(np.int64)
        each = (flat.take(at + 1) - row) << model.fine.take(cell)
        start = (row << PLACE) + (now - model.borders.take(cell)) * each
        share = np.where(miss, each, 1 << (BITS + PLACE))
        width = put(active, (start * miss).astype(np.uint64), share.astype(np.uint64), width >> _U(BITS + PLACE))
        model.learn(now, hit2, hit1, cell)
    # Two more words give the decoder the whole of low.
    lane = np.arange(lanes)
    for part in (low >> WORD, low & _U(0xFFFFFFFF)):
        words[count, lane] = part
        count += 1
    index = np.stack([count.astype("<u4"), np.array(checks, "<u4")], axis=1)
    taken = np.arange(room)[None, :] < count[:, None]
    return struct.pack(HEAD, MAGIC, 1, vocabulary, block, n) + index.tobytes() + words.T[taken].astype("<u4").tobytes()


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ``ValueError`` on a damaged one."""
    if len(data) < HEAD_SIZE:
        raise ValueError("segment is cut short")
    magic, version, vocabulary, block, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a segment of this format")
    if not n:
        return np.zeros(0, np.uint32)
    lanes = -(-n // block)
    if len(data) < HEAD_SIZE + 8 * lanes:
        raise ValueError("segment is cut short")
    index = np.frombuffer(data, "<u4", 2 * lanes, HEAD_SIZE).reshape(lanes, 2)
    count = index[:, 0].astype(np.int64)
    if len(data) != HEAD_SIZE + 8 * lanes + 4 * int(count.sum()):
        raise ValueError("segment has the wrong length")
    words = np.zeros((lanes, int(count.max()) + 4), np.uint32)
    words[np.arange(words.shape[1])[None, :] < count[:, None]] = np.frombuffer(data, "<u4", offset=HEAD_SIZE + 8 * lanes)
    words = np.ascontiguousarray(words.T)
    out = np.zeros((block, lanes), np.uint32)
    tail = n - (lanes - 1) * block
    model = Model(lanes, vocabulary)
    code = (words[0].astype(np.uint64) << WORD) | words[1]
    at = np.full(lanes, 2)
    width = np.full(lanes, (1 << 64) - 1, np.uint64)
    end = len(words) - 1
    cells = (np.searchsorted(model.borders, np.arange(model.borders[-1]), "right") - 1).astype(np.int64)

    def take(active, start, share, unit):
        part = code[:active]
        part -= start * unit
        left = share * unit
        full = np.flatnonzero(left < LEAST)
        if len(full):
            code[full] = (code[full] << WORD) | words[np.minimum(at[full], end), full]
            at[full] += 1
            left[full] <<= WORD
        return left

    for step in range(min(block, n)):
        active = lanes if step < tail else lanes - 1
        if not active:
            break
        model.narrow(active)
        width2, width1 = model.predict()
        unit = width[:active] >> _U(BITS)
        value = np.minimum(code[:active] // unit, _U(ONE - 1)).astype(np.int32)
        hit2 = value < width2
        miss = value >= width2 + width1
        hit1 = ~(hit2 | miss)
        start = width2 * ~hit2 + width1 * miss
        share = np.where(hit2, width2, np.where(hit1, width1, ONE - width2 - width1))
        width = take(active, start.astype(np.uint64), share.astype(np.uint64), unit)
        unit = width >> _U(BITS + PLACE)
        value = np.minimum(code[:active] // unit, _U((1 << (BITS + PLACE)) - 1)).astype(np.int64)
        below = np.packbits(model.cdf[:, 1:] <= (value >> PLACE).astype(np.int16)[:, None], axis=1)
        cell = np.bitwise_count(below.view(np.uint32)[:, 0]).astype(np.int64)
        flat = model.cdf.reshape(-1)
        row = flat.take(model.base_c + cell).astype(np.int64)
        each = (flat.take(model.base_c + cell + 1) - row) << model.fine.take(cell)
        place = (value - (row << PLACE)) // each
        share = np.where(miss, each, 1 << (BITS + PLACE))
        width = take(active, (((row << PLACE) + place * each) * miss).astype(np.uint64), share.astype(np.uint64), unit)
        now = np.where(hit2, model.id2, np.where(hit1, model.id1, model.borders.take(cell) + place)).astype(np.uint32)
        out[step, :active] = now
        model.learn(now, hit2, hit1, cells.take(now))
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n]
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4")) != index[k, 1]:
            raise ValueError(f"block {k} is damaged")
    return ids
