"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A lexicon is learned: for words and word beginnings, documents of either label that contain them are counted, and those
   with a high smoothed log-odds and enough support are kept, at most ``LEXICON`` of them.
2. Each text becomes a few numbers: densities and weights of lexicon hits, how many hits have a second-person word within
   ``NEAR`` words, rates of capitals and punctuation, and of words that mix letters with digits or symbols.
3. Boosted trees learn the label from the numbers, and an isotonic fit turns their margin into a probability.

Lexicon and trees learn from different rows (by the same checksum that holds rows out), so the trees see honest lexicon
features. Training uses at most about ``SAMPLE`` rows of each label and part, drawn by a hash of the id; that bound is the only
one. Label, language, source and id are no inputs of a score. The driver holds the lexicon and the model, both bounded.

Defined results: null and empty texts have all features 0 and get the score of such rows; rows with a null id are never learned
from; repeated rows get equal scores; labels of unknown documents and null labels are left out; without training rows of both
labels every score is the share of label 1 (0 without any); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.llm.tables import id_and_text, signed
from sightline.session import materialize

SAMPLE = 8000
LEXICON = 5000
MIN_SUPPORT, MIN_SHARE, MIN_ODDS = 3, 0.004, 2.5
PREFIXES = (3, 4, 5, 6)
NEAR = 5
HELD_OUT, LEXICON_PARTS, TREE_PARTS = 2, (0, 1), (3,)
THRESHOLD = 0.3
FEATURES = ["hit_density", "hits", "weight", "top_weight", "address", "capitals", "punctuation", "obfuscation"]
SECOND_PERSON = "you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti su".split()

IS_GAP = np.zeros(256, bool)
IS_GAP[:128] = True
IS_GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
CAPITAL, DIGIT, PUNCT = np.zeros(256, bool), np.zeros(256, bool), IS_GAP.copy()
CAPITAL[65:91] = True
DIGIT[48:58] = True
PUNCT[:33] = False
PUNCT[127] = False


def part_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(wa.Words(data, np.array([0, len(data)]), wa.LOWER, hashes=1, gap=wa.IS_SPACE).hashes[0])


def _terms(data, words):
    """Hashes of each word and of its beginnings, one row per kind; 0 where a word is too short."""
    out = [words.hashes[0]]
    size = words.ends - words.starts
    for width in PREFIXES:
        term = np.zeros(len(size), np.uint64)
        for lo in range(0, len(data), wa.BLOCK):
            a, b = np.searchsorted(words.starts, (lo, lo + wa.BLOCK))
            long = a + np.flatnonzero(size[a:b] > width)
            at = words.starts[long] - lo
            term[long] = wa.mixed(wa.byte_hashes(wa.LOWER[data[lo : lo + wa.BLOCK + width]], at, at + width, wa.BASES[:1])[0])
        out.append(term)
    return np.stack(out)


def learned_lexicon(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and weights of the terms that tell label 1 from label 0 in ``train`` (text, label)."""

    def count(batches):
        for batch in batches:
            label = batch.column("label").to_numpy()
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                words = wa.Words(data, offsets, wa.LOWER, hashes=1, gap=IS_GAP)
                terms = _terms(data, words)
                rows = np.broadcast_to(words.rows, terms.shape)[terms != 0]
                terms = terms[terms != 0]
                new = ~wa.later_copies(terms, rows)
                terms, positive = terms[new], label[lo:hi][rows[new]] == 1
                found, at = np.unique(terms, return_inverse=True)
                total = np.bincount(at, minlength=len(found))
                ones = np.bincount(at, weights=positive, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([signed(found), pa.array(ones), pa.array(total - ones)], ["term", "ones", "zeros"])

    n = dict(train.groupBy("label").count().collect())
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        return np.zeros(0, np.uint64), np.zeros(0)
    weight = F.log((F.col("ones") + 0.5) / (ones + 1.0)) - F.log((F.col("zeros") + 0.5) / (zeros + 1.0))
    kept = (
        train.select("text", "label").mapInArrow(count, "term long, ones long, zeros long")
        .groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(F.col("ones") >= max(MIN_SUPPORT, MIN_SHARE * ones)).withColumn("weight", weight).where(F.col("weight") >= MIN_ODDS)
        .orderBy(F.desc("weight"), F.desc("ones"), "term").limit(LEXICON).collect()
    )
    terms = np.array([r["term"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.array([r["weight"] for r in kept], float)[order]


def text_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id`` and the features of every row of ``docs`` (doc_id, text)."""
    terms, weights = lexicon
    second = _hash_of(SECOND_PERSON)

    def measure(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                columns = _features(data, offsets, terms, weights, second)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, columns)], ["doc_id", *FEATURES],
                )

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _features(data, offsets, terms, weights, second):
    words = wa.Words(data, offsets, wa.LOWER, hashes=1, gap=IS_GAP)
    n = np.maximum(words.counts, 1)
    value = np.zeros(len(words.starts))
    if len(terms):
        for found in _terms(data, words):
            at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
            value = np.maximum(value, np.where(terms[at] == found, weights[at], 0.0))
    hit = value > 0
    you = np.flatnonzero(np.isin(words.hashes[0], second))
    near = np.zeros(len(value), bool)
    for step in range(-NEAR, NEAR + 1):
        to = you + step
        good = (to >= 0) & (to < len(value))
        near[to[good][words.rows[to[good]] == words.rows[you[good]]]] = True
    hits, weight = wa.per_row(hit, words.offsets), np.diff(wa.prefix(value)[words.offsets])
    top = np.zeros(len(n))
    np.maximum.at(top, words.rows[hit], value[hit])
    size = np.maximum(np.diff(offsets), 1)
    whole = wa.Words(data, offsets, hashes=0)
    letters, odd = wa.prefix((~IS_GAP[data] & ~DIGIT[data]).astype(np.int64)), wa.prefix((DIGIT[data] | PUNCT[data]).astype(np.int64))
    inner = np.maximum(whole.ends - 1, whole.starts)
    mixed = (letters[whole.ends] > letters[whole.starts]) & (odd[inner] > odd[np.minimum(whole.starts + 1, inner)])
    return (
        hits / n, np.log1p(hits), weight / n, top, wa.per_row(hit & near, words.offsets) / np.maximum(hits, 1),
        wa.per_row(CAPITAL[data], offsets) / size, wa.per_row(PUNCT[data], offsets) / size,
        wa.per_row(mixed, whole.offsets) / np.maximum(whole.counts, 1),
    )


def _sampled(labels: DataFrame, parts) -> DataFrame:
    """At most about ``SAMPLE`` rows of either label from the given parts, by a hash of the id: few enough to be broadcast."""
    rows = labels.where(part_of(F.col("doc_id")).isin(list(parts)))
    n = dict(rows.groupBy("label").count().collect())
    share = {label: min(1.0, SAMPLE / count) for label, count in n.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    return rows.where(draw < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))


def scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``."""
    plain = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    texts = materialize(plain.join(F.broadcast(_sampled(known, LEXICON_PARTS)), "doc_id").select("text", "label"), "toxicity-lexicon")
    measured = materialize(text_features(plain, learned_lexicon(texts)), "toxicity-features")
    held_out = F.coalesce(part_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")

    train = materialize(measured.join(F.broadcast(_sampled(known, TREE_PARTS)), "doc_id"), "toxicity-train")
    n = dict(train.groupBy("label").count().collect())
    if not n.get(0) or not n.get(1):
        share = F.lit(float(n.get(1, 0)) / max(sum(n.values()), 1))
        return measured.select("doc_id", held_out, share.alias("score"), (share >= THRESHOLD).cast("int").alias("predicted"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=3, maxIter=12, stepSize=0.3, maxBins=64,
                          minInstancesPerNode=2, seed=1, checkpointInterval=-1).fit(gather.transform(train))
    margin = lambda df: trees.transform(gather.transform(df)).withColumn(
        "margin", vector_to_array("rawPrediction")[1],
    )
    calibrated = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
        margin(train).select("margin", F.col("label").cast("double").alias("label")),
    )
    scored = calibrated.transform(margin(measured).select("doc_id", "margin")).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
