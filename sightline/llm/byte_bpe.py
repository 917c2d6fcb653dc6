"""Byte-level BPE over Arrow columns: texts to token ids by a rank file, and ids back to bytes.

Texts are cut into the matches of the library's usual pattern (contractions, words, numbers, signs, white space), found on whole
columns of characters at once. Tier one: a minimal perfect hash over the vocabulary has exactly one slot per token; a piece is hashed,
its slot looked up and the bytes compared, so a hit is never wrong whatever the hash. Tier two: other pieces are merged from
single bytes, which form a linked list, by a heap of neighbouring pairs in order of rank, leftmost first. What tier two found for
short pieces is remembered per worker process, bounded by ``ENTRIES``.

Both directions are row by row: no shuffle, so no hot group. Work goes through slices of about 1 MB, so memory follows the slice, or
the longest single text; a piece of any length is merged in n log n steps.

Defined results: a null or empty text has no ids, null ids give no bytes; repeated rows and null doc_ids stay as rows of their own;
there are no ties (rank, then place); an empty table gives an empty table. ``encoded`` reads two columns and ignores the others;
``decoded`` keeps all columns and lengthens the name of its own where it is taken. An id that is not in the vocabulary is an error.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import wordarrays as wa
from sightline.llm.tables import fresh, id_and_text, lists

ENTRIES = 400_000
LONGEST_REMEMBERED = 64
OTHER, LETTER, NUMBER, SPACE = range(4)
APOSTROPHE, BLANK = 0x27, 0x20

_U = np.uint64


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def char_classes() -> tuple[np.ndarray, np.ndarray]:
    """First characters of runs of one class over all of Unicode, and the classes, as the library's own patterns see them."""
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kind = np.zeros(0x110000, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)
        kind[[ord(c) for c in bytes(matched).decode()]] = number
    first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    return first, kind[first]


def _class_table(runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    first, kind = runs
    return np.repeat(kind, np.diff(np.append(first, 0x110000)))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at ``at`` in UTF-8 bytes."""
    lead = data[at].astype(np.int32)
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        tail = [padded[at[wide] + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        b = lead[wide]
        two = (b & 0x1F) << 6 | tail[0]
        three = (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
        four = (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        lead[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    return lead


def piece_starts(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bytes at which the pattern's matches begin, for texts that begin at ``offsets``; every text that is not empty begins one."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    if not n:
        return at
    char = _code_points(data, at)
    kind = classes[char]
    row = np.zeros(n + 1, bool)
    row[np.searchsorted(at, offsets)] = True
    row[n] = True
    first = row[:-1].copy()
    first[1:] |= kind[1:] != kind[:-1]
    starts = first.copy()
    # The last white-space character before other text is apart from those before it, and a blank joins what follows.
    after = np.flatnonzero(first & (kind != SPACE) & ~row[:-1])
    after = after[kind[after - 1] == SPACE]
    starts[after - 1] = True
    starts[after] = char[after - 1] != BLANK
    # An apostrophe alone between text and letters may begin a contraction.
    quote = np.flatnonzero((char == APOSTROPHE) & starts & ~row[1:])
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = char[quote + 1]
        two = np.where(row[np.minimum(quote + 2, n)], 0, char[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        starts[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        starts[rest[rest < n]] = True
    return at[starts]


class PerfectHash:
    """A minimal perfect hash: ``n`` distinct 64-bit keys to the numbers 0 to ``n - 1``.

    Keys are dealt to small buckets. Buckets are placed from the largest down, each with the first pilot that sends all of its
    keys to free slots; a bucket of one key names a free slot itself (a negative pilot).
    """

    TOGETHER = 32

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        self.pilots = np.zeros(self.buckets, np.int64)
        free = np.ones(self.n, bool)
        bucket = self._scaled(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            members, pilot = keys[order[ends[b] - sizes[b] : ends[b]]], 0
            while True:
                slots = self._slots(members, np.arange(pilot, pilot + self.TOGETHER)[:, None])
                ranked = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1))
                if len(good):
                    break
                pilot += self.TOGETHER
            self.pilots[b] = pilot + good[0]
            free[slots[good[0]]] = False
        alone = np.flatnonzero(sizes == 1)
        self.pilots[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    @staticmethod
    def _scaled(values, n):
        return ((values >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)

    def _slots(self, keys, pilots):
        return self._scaled(wa.mixed(keys ^ wa.mixed(pilots.astype(np.uint64) + _U(1))), self.n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; some slot for a key that was not among those given."""
        pilots = self.pilots[self._scaled(keys, self.buckets)]
        return np.where(pilots < 0, -1 - pilots, self._slots(keys, pilots))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: pairs of neighbours merge in order of rank, the leftmost first."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        # A pair counts only while both of its parts are as they were when it was put in.
        if after[left] != middle or after[middle] != end:
            continue
        after[left], after[middle] = end, 0
        if end < n:
            before[end] = left
            if (rank := ranks.get(piece[left : after[end]])) is not None:
                heapq.heappush(heap, (rank, left, end, after[end]))
        if (start := before[left]) >= 0 and (rank := ranks.get(piece[start:end])) is not None:
            heapq.heappush(heap, (rank, start, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class ByteBPE:
    """The vocabulary of a rank file with both tiers and the way back."""

    def __init__(self, path: str, runs: tuple[np.ndarray, np.ndarray]):
        self.ranks = read_ranks(path)
        self.classes = _class_table(runs)
        tokens = list(self.ranks)
        sizes = np.array([len(t) for t in tokens], np.int64)
        starts = wa.prefix(sizes)[:-1]
        data = np.frombuffer(b"".join(tokens), np.uint8)
        self.longest = int(sizes.max())
        own = wa.PieceBytes(data, starts, sizes)
        keys = own.hashes()
        self.hash = PerfectHash(keys)
        slots = self.hash.slots(keys)
        numbers = np.array(list(self.ranks.values()), np.int64)
        self.slot_id, self.slot_size = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        self.slot_id[slots], self.slot_size[slots] = numbers, sizes
        self.slot_bytes = np.zeros((-(-self.longest // 8), len(tokens)), np.uint64)
        for k in range(len(self.slot_bytes)):
            which = np.flatnonzero(sizes > 8 * k)
            self.slot_bytes[k, slots[which]] = own.eight(k, which)
        self.known = np.zeros(int(numbers.max()) + 1, bool)
        self.token_start, self.token_size = np.zeros(len(self.known), np.int64), np.zeros(len(self.known), np.int64)
        self.known[numbers], self.token_start[numbers], self.token_size[numbers] = True, starts, sizes
        self.token_data = data
        self.forget()

    def forget(self):
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, pieces: wa.PieceBytes) -> np.ndarray:
        """Tier one: ids of the pieces that are tokens, -1 for the others."""
        out = np.full(len(pieces.sizes), -1, np.int64)
        fits = np.flatnonzero(pieces.sizes <= self.longest)
        inside = pieces.taken(fits)
        slots = self.hash.slots(inside.hashes())
        same = self.slot_size[slots] == inside.sizes
        which, k = np.flatnonzero(same), 0
        while len(which):
            same[which] = self.slot_bytes[k, slots[which]] == inside.eight(k, which)
            k += 1
            which = which[same[which] & (inside.sizes[which] > 8 * k)]
        out[fits[same]] = self.slot_id[slots[same]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = piece_starts(data, offsets, self.classes)
        ends = np.append(starts[1:], len(data))
        ids = self.whole(wa.PieceBytes(data, starts, ends - starts))
        counts = np.ones(len(ids), np.int64)
        missing = np.flatnonzero(ids < 0)
        entries = self._merged(data, starts[missing], ends[missing])
        counts[missing] = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        bounds = wa.prefix(counts)
        out = np.empty(bounds[-1], np.int32)
        out[bounds[:-1]] = ids
        if len(missing):
            long = counts[missing]
            at = np.repeat(bounds[missing] - wa.prefix(long)[:-1], long) + np.arange(long.sum())
            out[at] = np.frombuffer(b"".join(entries), np.int32)
        return out, bounds[np.searchsorted(starts, offsets)]

    def _merged(self, data, starts, ends) -> list[bytes]:
        """Tier two: 32-bit ids of each piece; those of pieces used lately are kept, in two generations of ``ENTRIES``."""
        raw, out = data.tobytes(), []
        for s, e in zip(starts.tolist(), ends.tolist()):
            piece = raw[s:e]
            found = self.recent.get(piece)
            if found is None:
                found = self.older.get(piece) or array("i", merged(piece, self.ranks)).tobytes()
                if e - s <= LONGEST_REMEMBERED:
                    if len(self.recent) >= ENTRIES:
                        self.recent, self.older = {}, self.recent
                    self.recent[piece] = found
            out.append(found)
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens one after the other, and where each token's begin."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.token_size[ids]
        bounds = wa.prefix(sizes)
        at = np.repeat(self.token_start[ids] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return self.token_data[at], bounds


def worker_bpe(path: str, runs: tuple[np.ndarray, np.ndarray]) -> ByteBPE:
    """The vocabulary of this worker process; built once and kept between tasks."""
    kept = sys.modules.setdefault("_sightline_worker", types.ModuleType("_sightline_worker")).__dict__
    if ("bpe", path) not in kept:
        kept["bpe", path] = ByteBPE(path, runs)
    return kept["bpe", path]


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every text, without special tokens."""
    path, runs = path or default_path(), char_classes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, runs)
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                ids, bounds = bpe.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists(pa.array(ids), bounds)], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns and ``decoded``: the bytes that the ids stand for (those of a whole text are UTF-8)."""
    path, runs, name = path or default_path(), char_classes(), fresh(tokens, "decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, runs)
        for batch in batches:
            column, row = batch.column(ids_col), 0
            sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            bounds = wa.prefix(sizes)
            values = column.flatten().to_numpy(zero_copy_only=False)
            while row < len(column):
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + (wa.SLICE >> 2), "right")) - 1)
                data, at = bpe.decode(values[bounds[row] : bounds[end]])
                offsets = pa.array(at[bounds[row : end + 1] - bounds[row]], pa.int64())
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, offsets.buffers()[1], pa.py_buffer(data)])
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.binary())], [*part.schema.names, name])
                row = end

    return tokens.mapInArrow(decode, T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, and digests of the ids (decimal, one space apart) and of the decoded bytes of ``decoded`` rows."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
