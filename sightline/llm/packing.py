"""Documents packed into sequences of fixed length.

Documents become token ids with an end id; only those longer than ``capacity`` are cut, from the end, so that the first piece
may be shorter. Pieces are dealt to partitions by hash and packed by best-fit decreasing: each goes to the fullest
sequence that still has room. A dual feasible function never lets the values of pieces that share a sequence add up to
more than one, so the sum over a partition's pieces is a lower bound on its number of sequences. Partitions that reach
their best bound are certified and done. The others keep their full sequences and give the pieces of the rest into a common
pool, which is dealt anew and packed again; a round counts only if it needs fewer sequences, and ``ROUNDS`` are tried.

A partition holds about ``PIECES`` pieces of a few bytes whatever the input is, and there are as many partitions as that needs.
Texts are read once; afterwards only lengths move. Defined results: null and empty texts are a single end id; repeated rows are
packed one by one; null ids are kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.llm.tables import id_and_text
from sightline.llm.tokens import default_path, worker_tokens
from sightline.session import materialize

CAPACITY = 2048
END_ID = 0
PIECES = 50_000
ROUNDS = 2
TEXT_SLICE = 1 << 21


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, the ``ids`` of every piece."""
    path = tokenizer or default_path()

    def cut(batches):
        tokens = worker_tokens(path)
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text"), TEXT_SLICE):
                ids, bounds = tokens.encode(data, offsets)
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                length = np.diff(bounds)
                count = -(-length // capacity)
                doc = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = length - (count - 1) * capacity
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                size = np.where(piece > 0, capacity, first[doc])
                view = memoryview(ids).cast("B")
                at = (bounds[doc] + start) * 4
                checks = [zlib.crc32(view[a : a + n]) for a, n in zip(at.tolist(), (size * 4).tolist())]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                    pa.array(start), pa.array(size), pa.array(checks, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return id_and_text(docs, id_col, text_col).mapInArrow(cut, schema)


def bound(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound on sequences over two families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int(counts @ x) // capacity)
    for least in range(1, capacity // 2 + 1, max(1, capacity // 128)):
        f = np.where(x > capacity - least, capacity, np.where(x >= least, x, 0))
        best = max(best, -(-int(counts @ f) // capacity))
    for k in range(1, 11):
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int(counts @ f) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, and the length of every sequence."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, filled = 0, []
    order = np.argsort(-lengths, kind="stable")
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, bin_ = capacity, len(filled)
            filled.append(0)
        place[k], offset[k] = bin_, filled[bin_]
        filled[bin_] += size
        if room > size:
            if not rooms[room - size]:
                some |= 1 << (room - size)
            rooms[room - size].append(bin_)
    return place, offset, np.array(filled, np.int64)


def _packed(pieces: DataFrame, round_: int, capacity: int) -> DataFrame:
    """One round: ``row``, ``length``, ``sequence_id``, ``offset``, ``open`` (gives its place up)."""
    parts = max(1, -(-pieces.count() // PIECES))

    def pack(table):
        row, lengths = (table.column(c).to_numpy() for c in ("row", "length"))
        part = table.column("part")[0].as_py()
        place, offset, filled = best_fit(lengths, capacity)
        certified = len(filled) == bound(lengths, capacity)
        given = (filled[place] < capacity) & (not certified)
        return pa.table({
            "row": row, "length": lengths, "sequence_id": (round_ << 56) + (part << 28) + place, "offset": offset, "open": given,
        })

    dealt = pieces.select("row", "length", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts)).cast("int").alias("part"))
    return materialize(
        dealt.groupBy("part").applyInArrow(pack, "row long, length long, sequence_id long, offset long, open boolean"),
        "packed",
    )


def packed(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and their ``sequence_id`` and ``offset``."""
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = _packed(rows.select("row", "length"), 0, capacity)
    done = placed.where("not open")
    pool = placed.where("open")
    for number in range(1, rounds + 1):
        before = pool.select("sequence_id").distinct().count()
        if not before:
            break
        again = _packed(pool.select("row", "length"), number, capacity)
        if again.select("sequence_id").distinct().count() >= before:
            break
        done, pool = done.unionByName(again.where("not open")), again.where("open")
    return rows.join(done.unionByName(pool).select("row", "sequence_id", "offset"), "row").drop("row")
