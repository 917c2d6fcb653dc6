"""Collocations: phrases whose words occur together more often than their parts would suggest.

First pass: every task counts the phrases of a run of text exactly (dense numbers of words and phrases, no hashing) and sends hashes
with counts, packed by hash partition. Each hash partition merges what it gets into one Misra-Gries summary. Its capacity
exceeds its mass divided by the threshold, and it never takes more than ``threshold - 1`` from any counter: rather than that it
grows. So a phrase that reaches the threshold keeps a counter, whatever else shares its hash. The counters, widened by what was
taken, mark a bitmap of ``FILTER_BITS`` bits (16 MB at any input size), of which each partition makes its own stretch.

Second pass: phrases whose bit is set are counted exactly, as strings. The bitmap only saves work: what it lets through in vain, at
very large inputs many, falls to the exact counts. Parts of a frequent phrase are frequent, so the scores need nothing more.

Hot groups: a phrase with a third of all occurrences is one entry per run of text and task; language totals are sums; parts that very
many phrases begin or end with are attached by a broadcast of at most ``HOT_PARTS`` rows. Partitions grow in number with the
input (``PART_BYTES`` of text each). Memory follows ``RUN_WORDS`` words, or the longest single text.

Defined results: null and empty texts have no words, a null language is ``und``; repeated rows count each time; phrases of any length
of word are counted; ties go by count, then bytes of the phrase; further columns are ignored; an empty table gives an empty table.
Counts up to 10**16 are exact in the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.llm.tables import signed
from sightline.session import materialize

LONGEST = 3
THRESHOLD = 10
CONTAINED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
RUN_WORDS = 1_500_000
PART_BYTES = 64 << 20
FILTER_BITS = 27
HOT_PARTS = 1000
FOLD = 1 << 19

_U = np.uint64
IS_BREAK, IS_GAP = np.zeros(256, bool), np.zeros(256, bool)
IS_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
IS_GAP[[*b" \t"]] = True
IS_GAP |= IS_BREAK


def _columns(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Run]:
    """The words of a task's rows, about ``size`` at a time."""
    run = _Run()
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for lo, hi, data, offsets in wa.slices(batch.column("text")):
            run.add(data, offsets, names, codes[lo:hi])
            if run.n >= size:
                yield run
                run = _Run()
    if run.n:
        yield run


class _Run:
    """Words under dense numbers, and the exact number of times each phrase of some words occurs."""

    def __init__(self):
        self.n, self.langs = 0, {}
        self.bytes, self.sizes, self.joined, self.lang = [], [], [], []

    def add(self, data, offsets, names, codes):
        folded = wa.LOWER[data]
        starts, ends = wa.spans(IS_GAP[folded], offsets)
        if not len(starts):
            return
        row = np.searchsorted(offsets, starts, "right") - 1
        # Two words belong together if no row and no sign lies between them.
        breaks = wa.prefix(IS_BREAK[folded].astype(np.int64))[starts]
        joined = np.zeros(len(starts), bool)
        joined[1:] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        numbers = np.array([self.langs.setdefault(name, len(self.langs)) for name in names], np.int64)
        self.bytes.append(folded[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
        self.sizes.append(ends - starts)
        self.joined.append(joined)
        self.lang.append(numbers[codes[row]].astype(np.int32))
        self.n += len(starts)

    def counted(self):
        """Per phrase length: the number of each phrase's beginning (one word shorter), that of its last word, and exact counts.

        Only what the next length needs is held meanwhile; ``members`` goes back over the lengths that were yielded.
        """
        data, sizes = np.concatenate(self.bytes), np.concatenate(self.sizes)
        joined, lang = np.concatenate(self.joined), np.concatenate(self.lang)
        self.bytes = self.sizes = self.joined = self.lang = None
        words = pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(wa.prefix(sizes)), pa.py_buffer(data)).dictionary_encode()
        del data, sizes
        # The same word in two languages is two words here.
        of_lang = np.int64(len(self.langs))
        numbers, number = _numbered(words.indices.to_numpy().astype(np.int64) * of_lang + lang)
        self.words = words.dictionary
        del words, lang
        self.word_of, self.lang_of = (numbers // of_lang).astype(np.int32), (numbers % of_lang).astype(np.int32)
        n_words = np.int64(len(numbers))
        counts = np.bincount(number, minlength=n_words)
        self.steps = [(None, np.arange(n_words, dtype=np.int32))]
        yield *self.steps[0], counts
        known, possible = number, np.ones(self.n, bool)
        for size in range(2, LONGEST + 1):
            # ``known[i]`` numbers the phrase of size - 1 words that ends at word i - 1 of a phrase that goes on there.
            possible = np.append(False, possible[:-1]) & joined
            at = np.flatnonzero(possible).astype(np.int32)
            keys = known[at - 1].astype(np.int64)
            keys *= n_words
            keys += number[at]
            known = None
            if size < LONGEST:
                keys, again = _numbered(keys)
                counts = np.bincount(again, minlength=len(keys))
                known = np.zeros(self.n, np.int32)
                known[at] = again
                del again
            else:
                keys.sort()
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                counts, keys = np.diff(first, append=len(keys)), keys[first]
                del first
            del at
            self.steps.append(((keys // n_words).astype(np.int32), (keys % n_words).astype(np.int32)))
            del keys
            yield *self.steps[-1], counts

    def hashed(self):
        """Per phrase length: one hash per phrase, of its language and words, and the counts."""
        hashes = None
        for beginning, last, counts in self.counted():
            if hashes is None:
                word, lang = (_text_hashes(x) for x in (self.words, pa.array(list(self.langs), pa.string())))
                word_hash = wa.mixed(word[self.word_of] ^ wa.mixed(lang[self.lang_of]))
                hashes = wa.mixed(word_hash[last])
            else:
                hashes = wa.mixed(hashes[beginning] * _U(0x9E3779B97F4A7C15) + word_hash[last])
            yield hashes, counts

    def members(self, size: int, which: np.ndarray) -> np.ndarray:
        """The word numbers of some phrases of ``size`` words, a row each."""
        out = np.empty((len(which), size), np.int32)
        for place in range(size - 1, -1, -1):
            beginning, last = self.steps[place]
            out[:, place] = last[which]
            which = beginning[which] if place else None
        return out


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each key its number among them."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return keys[first], number


def _text_hashes(column: pa.Array) -> np.ndarray:
    """Hashes that find the place of a phrase. Equality never rests on them, so the beginning of a long word will do."""
    data, offsets = wa.text_buffers(column)
    return wa.PieceBytes(data, offsets[:-1], np.diff(offsets)).hashes(reach=64)


class MisraGries:
    """A summary of (hash, count) entries that loses no key with ``threshold`` or more.

    ``expected`` is the mass it is made for. ``taken`` is what every counter may be short of. What is merged into it are summaries of
    runs from which nothing was taken.
    """

    def __init__(self, threshold: int, expected: int):
        self.threshold, self.expected = threshold, expected
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.mass = self.taken = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n_waiting = 0

    @property
    def capacity(self) -> int:
        return max(self.mass, self.expected) // self.threshold + 1

    def merge(self, keys: np.ndarray, counts: np.ndarray):
        self._waiting.append((keys, counts))
        self._n_waiting += len(keys)
        if self._n_waiting >= max(FOLD, len(self.keys)):
            self.fold()

    def fold(self):
        if not self._waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self._waiting)])
        new = [c.astype(np.int64) for _, c in self._waiting]
        self.mass += sum(int(c.sum()) for c in new)
        counts = np.concatenate([self.counts, *new])
        self._waiting, self._n_waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first)
        if len(self.keys) > self.capacity:
            # The largest counter that would not fit, but never more in all than a frequent key can spare.
            step = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            step = min(step, self.threshold - 1 - self.taken)
            if step > 0:
                self.taken += step
                left = self.counts > step
                self.keys, self.counts = self.keys[left], self.counts[left] - step

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold, among them all that have."""
        self.fold()
        return self.keys[self.counts + self.taken >= self.threshold]


def frequent_filter(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """First pass: a bitmap with the bits of all phrases that occur ``threshold`` times in a language (one bit per hash prefix)."""
    rows = _columns(docs, text_col, lang_col)
    size = rows.agg(
        F.sum(F.octet_length("text")).alias("n_bytes"),
        F.sum(F.length("text") - F.length(F.translate("text", " \t\n", "")) + 1).alias("n_words"),
    ).first()
    part_bits = min(max(6, int((size["n_bytes"] or 0) // PART_BYTES).bit_length()), FILTER_BITS)
    expected = LONGEST * (size["n_words"] or 0) >> part_bits

    run_words, filter_bits = RUN_WORDS, FILTER_BITS

    def pack(batches):
        return _packed_runs(batches, run_words, part_bits)

    def fold(batches):
        part, summary = None, None
        for batch in batches:
            for number, hashes, counts in zip(*batch.columns):
                number, hashes, counts = number.as_py(), hashes.as_buffer(), counts.as_buffer()
                if number != part:
                    if summary is not None:
                        yield _stretch(part, summary, part_bits, filter_bits)
                    part, summary = number, MisraGries(threshold, expected)
                summary.merge(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32))
        if summary is not None:
            yield _stretch(part, summary, part_bits, filter_bits)

    packed = rows.mapInArrow(pack, "part int, hashes binary, counts binary")
    laid = packed.repartition(1 << part_bits, "part").sortWithinPartitions("part")
    stretches = materialize(laid.mapInArrow(fold, "part int, bits binary"), "phrase-filter")
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    each = len(bits) >> part_bits if part_bits <= FILTER_BITS - 3 else 0
    # Bounded: all stretches together are the bitmap.
    for row in stretches.collect():
        stretch = np.frombuffer(row["bits"], np.uint8)
        if each:
            bits[row["part"] * each : (row["part"] + 1) * each] = stretch
        else:
            bits[row["part"] << FILTER_BITS - part_bits >> 3] |= stretch[0]
    return bits


def _packed_runs(batches: Iterator[pa.RecordBatch], run_words: int, part_bits: int) -> Iterator[pa.RecordBatch]:
    """What the first pass sends: the hashes of each run and phrase length with their counts."""
    for run in _runs(batches, run_words):
        for hashes, counts in run.hashed():
            if len(hashes):
                yield _packed(hashes, counts, part_bits)


def _packed(hashes: np.ndarray, counts: np.ndarray, part_bits: int) -> pa.RecordBatch:
    """Hashes with counts, a row per hash partition."""
    parts = (hashes >> _U(64 - part_bits)).astype(np.uint16 if part_bits <= 16 else np.uint32)
    order = np.argsort(parts, kind="stable").astype(np.int32)
    hashes, counts, parts = hashes[order], counts[order].astype(np.uint32), parts[order]
    first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    bounds = np.append(first, len(parts)).astype(np.int32)
    columns = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in (hashes, counts)]
    return pa.RecordBatch.from_arrays([pa.array(parts[first].astype(np.int32)), *columns], ["part", "hashes", "counts"])


def _bit(hashes: np.ndarray, filter_bits: int) -> np.ndarray:
    return (hashes >> _U(64 - filter_bits)).astype(np.int64)


def _stretch(part: int, summary: MisraGries, part_bits: int, filter_bits: int) -> pa.RecordBatch:
    """The part of the bitmap that the hashes of one partition fall into (whole bytes)."""
    size = max(8, 1 << filter_bits - part_bits)
    base = (part << filter_bits - part_bits) // 8 * 8
    flags = np.zeros(size, bool)
    flags[_bit(summary.survivors(), filter_bits) - base] = True
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "bits"],
    )


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Exact counts of all phrases with ``threshold`` or more occurrences: ``lang``, ``size`` (words), ``phrase``, ``a``; the row
    of size 0 has the number of all word occurrences. Written out."""
    bits = docs.sparkSession.sparkContext.broadcast(frequent_filter(docs, threshold, text_col, lang_col))

    run_words, filter_bits = RUN_WORDS, FILTER_BITS

    def count(batches):
        for run in _runs(batches, run_words):
            langs, words = list(run.langs), None
            for size, (hashes, counts) in enumerate(run.hashed(), 1):
                if size == 1:
                    words = run.words.to_pylist()
                    totals = np.bincount(run.lang_of, counts, len(langs)).astype(np.int64)
                    yield _counted_rows(langs, np.zeros(len(langs), np.int64), [""] * len(langs), totals)
                at = _bit(hashes, filter_bits)
                keep = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                del at
                for lo in range(0, len(keep), 1 << 16):
                    which = keep[lo : lo + (1 << 16)]
                    part = run.members(size, which)
                    texts = [" ".join([words[w] for w in row]) for row in run.word_of[part].tolist()]
                    of = run.lang_of[part[:, 0]].tolist()
                    yield _counted_rows([langs[k] for k in of], np.full(len(part), size), texts, counts[which])

    rows = _columns(docs, text_col, lang_col).mapInArrow(count, "lang string, size int, phrase string, a long")
    found = rows.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= threshold) | (F.col("size") == 0))
    return materialize(found, "phrase-counts")


def _counted_rows(langs, sizes, phrases, counts):
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sizes.astype(np.int32)), pa.array(phrases, pa.string()), pa.array(counts.astype(np.int64))],
        ["lang", "size", "phrase", "a"],
    )


def _attached(cuts: DataFrame, held: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of its column ``part`` as ``name``; parts of very many cuts do not meet in one task. ``held`` are the
    cuts as written."""
    known = counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    # At most HOT_PARTS parts can have more uses than this.
    often = max(HOT_PARTS, held.count() // HOT_PARTS)
    hot = held.groupBy("lang", part).count().where(F.col("count") > often).select("lang", part)
    common = materialize(known.join(F.broadcast(hot), ["lang", part], "left_semi"), "common-parts")
    few = cuts.join(F.broadcast(common), ["lang", part])
    rest = cuts.join(F.broadcast(common.select("lang", part)), ["lang", part], "left_anti").join(known, ["lang", part])
    return few.unionByName(rest)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All phrases of 2 or 3 words that are not contained in a longer one about as frequent: ``lang``, ``phrase``, ``a`` (its count), ``l``
    and ``r`` (the counts of its parts at the lowest cut), ``n`` (words of the language) and ``score``."""
    counts = phrase_counts(docs, threshold, text_col, lang_col)
    parts = counts.where("size > 0")
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    shorter = phrases.where("size > 2").select("lang", "a", F.explode(F.array(*(
        F.array_join(F.slice("words", first, LONGEST - 1), " ") for first in range(1, LONGEST)
    ))).alias("phrase"))
    longer = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(f"longer_a IS NULL OR 100 * longer_a < {CONTAINED_PERCENT} * a")
    cuts = materialize(kept.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("left_part"),
        F.array_join(F.expr("slice(words, k + 1, size - k)"), " ").alias("right_part"),
    ), "phrase-cuts")
    scored = _attached(_attached(cuts, cuts, parts, "left_part", "l"), cuts, parts, "right_part", "r")
    exact = "(CAST({0} AS DECIMAL(16, 0)) * CAST({1} AS DECIMAL(16, 0)))"
    score = f"({exact.format('a', 'a')} * CAST({SCALE} AS DECIMAL(7, 0))) DIV {exact.format('l', 'r')}"
    lowest = scored.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    totals = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    return lowest.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def top_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` of each language with their ``rank``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
