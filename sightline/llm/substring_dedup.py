"""Removal of passages that earlier documents already have.

Every window of ``window`` words gets a Rabin-Karp hash; Spark counts in which documents each hash starts, and the windows
that a document with a smaller id has too merge into maximal intervals of words to remove.

Windows that cannot repeat are not sent anywhere. Texts that equal another one are settled by their digest. Of the others,
each window is known by the least hash of the shorter runs in it; two equal windows have the same, so only windows whose
least run occurs in two documents are candidates. This drops no repeat. Candidates are compared by 96 bits of hash.

Groups: a hash or text that very many documents share is counted by partial aggregation and joined back as one row, so
no task holds its members together. What is collected per document is bounded by that document.

Defined results: null and empty texts have no words; null ids lose nothing and take nothing away; rows with one id do not
take words from each other; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.llm.tables import id_and_text, lists, signed
from sightline.session import materialize

WINDOW = 50


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words to remove, for documents that have any: ``doc_id``, ``text_key``, ``removed`` (intervals of word numbers)."""
    keyed = _keyed(docs, id_col, text_col)
    scanned = materialize(_sampled(keyed.where("doc_id is not null"), window), "windows-sampled")
    firsts = scanned.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    marked = scanned.join(firsts, "digest")
    copies = marked.where((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)).select(
        "doc_id", "text_key",
        F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))).alias("removed"),
    ).distinct()

    seeds = materialize(
        marked.where("doc_id = first_id").select("doc_id", "text_key", F.explode("samples").alias("seed")), "window-seeds",
    )
    shared = (
        seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi").select("seed")
    )
    wanted = seeds.join(shared, "seed").groupBy("doc_id", "text_key").agg(F.collect_set("seed").alias("seeds"))
    held = materialize(_candidates(keyed.join(wanted, ["doc_id", "text_key"]), window), "window-candidates")
    counted = (
        held.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    )
    late = (
        held.join(counted, ["h1", "h2"]).where("doc_id > lo")
        .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("starts"))
    )
    return _merged(late, window).unionByName(copies)


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents less the words in ``spans``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words, one space apart)."""
    keyed = _keyed(docs, id_col, text_col).drop("digest")
    return _kept(keyed.join(spans, ["doc_id", "text_key"], "left"))


def _keyed(docs, id_col, text_col):
    return id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.unhex(F.md5("text")).alias("digest"), "text",
    )


def _least_runs(words: wa.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that lie in one text, and the least hash among the runs in each."""
    n = len(words.starts)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spread = max(1, window * 3 // 5)
    runs = wa.window_hashes(words.hashes[0], window - spread + 1, wa.WORD_BASES[0])
    least = wa.sliding_min(runs, spread)
    at = np.flatnonzero(words.rows[: n - window + 1] == words.rows[window - 1 :])
    return at, least[at]


def _sampled(keyed, window):
    def sample(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                words = wa.Words(data, offsets, hashes=1)
                at, least = _least_runs(words, window)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
                found = np.searchsorted(at[new], words.offsets)
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("doc_id", "text_key", "digest")), pa.array(words.counts.astype(np.int32)),
                     lists(signed(least[new]), found)],
                    ["doc_id", "text_key", "digest", "n_words", "samples"],
                )

    return keyed.mapInArrow(sample, "doc_id long, text_key long, digest binary, n_words int, samples array<long>")


def _candidates(keyed, window):
    """Windows whose least run is among the document's ``seeds``."""

    def emit(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                words = wa.Words(data, offsets)
                at, least = _least_runs(words, window)
                rows = batch.slice(lo, hi - lo)
                seeds = rows.column("seeds")
                wanted = np.unique(seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                at = at[np.isin(least, wanted)]
                row = words.rows[at]
                first, second = (wa.window_hashes(h, window, b)[at] for h, b in zip(words.hashes, wa.WORD_BASES))
                yield pa.RecordBatch.from_arrays(
                    [signed(first), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     rows.column("doc_id").take(pa.array(row)), rows.column("text_key").take(pa.array(row)),
                     pa.array((at - words.offsets[row]).astype(np.int32))],
                    ["h1", "h2", "doc_id", "text_key", "at"],
                )

    return keyed.select("doc_id", "text_key", "text", "seeds").mapInArrow(
        emit, "h1 long, h2 int, doc_id long, text_key long, at int",
    )


def _merged(late, window):
    """Window starts of each document as maximal intervals."""

    def merge(batches):
        for batch in batches:
            starts = batch.column("starts")
            ends = starts.offsets.to_numpy().astype(np.int64)
            at = starts.values.to_numpy().astype(np.int64)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] > at[:-1] + window
            new[ends[:-1]] = True
            last = np.append(new[1:], True)[: len(at)]
            pairs = pa.StructArray.from_arrays(
                [pa.array(at[new].astype(np.int32)), pa.array((at[last] + window).astype(np.int32))], ["start", "end"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), lists(pairs, np.append(0, np.cumsum(new))[ends])],
                ["doc_id", "text_key", "removed"],
            )

    return late.mapInArrow(merge, "doc_id long, text_key long, removed array<struct<start: int, end: int>>")


def _kept(joined):
    def keep(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                words = wa.Words(data, offsets, hashes=0)
                rows = batch.slice(lo, hi - lo)
                gone = _covered(rows.column("removed"), words)
                kept = np.flatnonzero(~gone)
                row = words.rows[kept]
                final = np.append(row[1:] != row[:-1], True)[: len(kept)]
                steps = np.zeros(len(data) + 2, np.int8)
                steps[words.starts[kept]] += 1
                np.subtract.at(steps, words.ends[kept] + ~final, 1)
                inside = np.cumsum(steps[: len(data)], dtype=np.int8).view(bool)
                text = np.where(wa.IS_SPACE[data], np.uint8(32), data)[inside]
                bounds = wa.prefix(inside.astype(np.int64))[offsets].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(words.counts.astype(np.int64)),
                     pa.array(wa.per_row(gone, words.offsets)),
                     pa.StringArray.from_buffers(hi - lo, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(text)))],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return joined.select("doc_id", "text", "removed").mapInArrow(
        keep, "doc_id long, n_words long, n_removed long, kept string",
    )


def _covered(removed: pa.Array, words: wa.Words) -> np.ndarray:
    """Which words lie in the intervals of their row."""
    removed = pa.ListArray.from_arrays(*_plain_list(removed))
    pairs = removed.values
    row = np.repeat(np.arange(len(removed)), np.diff(removed.offsets.to_numpy()))
    steps = np.zeros(len(words.starts) + 1, np.int64)
    for name, step in (("start", 1), ("end", -1)):
        np.add.at(steps, words.offsets[row] + pairs.field(name).to_numpy(zero_copy_only=False), step)
    return np.cumsum(steps[:-1]) > 0


def _plain_list(column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of a list column, nulls as empty lists."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), column.flatten()
