import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import collocations as col, queries
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def speech(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢字", "a\xa0b", "x" * 70, "x" * 71, "tab", "end"]
    marks = [" ", " ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r", "; ", " -"]
    texts = []
    for k in range(n):
        body = "".join(draw.choices(words, [9, 2, 5, 3, 3, 2, 1, 1, 1, 1, 1, 1, 1])[0] + draw.choice(marks) for _ in range(draw.randrange(60)))
        texts.append((k, "new york city " * (k % 3) + body, ["en", "fr", None, "und"][k % 4]))
    return [*texts, (n, None, "en"), (n + 1, "", None), (n + 2, " \t. , ", "fr"), texts[0], texts[0]]


@pytest.mark.parametrize("setting", [{}, {"RUN_WORDS": 40, "FILTER_BITS": 9}, {"HOT_PARTS": 1, "PART_BYTES": 40, "RUN_WORDS": 200}])
def test_against_plain_python(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(col, name, value)
    rows = speech(4, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    clashing = docs.withColumns({c: F.lit("x") for c in ("size", "phrase", "a", "n", "rank", "part", "words", "k")})
    for threshold in (3, 10):
        got = col.top_collocations(col.collocations(clashing, threshold), 40)
        assert got.columns == COLUMNS
        wanted = set(plain.collocations([(t, g) for _, t, g in rows], threshold, 40))
        assert wanted and {tuple(r) for r in got.collect()} == wanted


def test_no_frequent_key_is_lost():
    draw = np.random.default_rng(6)
    for case in range(60):
        threshold = int(draw.integers(2, 12))
        total, summary = Counter(), col.MisraGries(threshold, int(draw.integers(0, 5000)))
        for _ in range(int(draw.integers(1, 20))):
            keys = np.unique(draw.zipf(1.3, 400) % (1 << 40)).astype(np.uint64)
            counts = draw.integers(1, 4, len(keys)) * (1 if case % 2 else 1 + (keys == 1) * 500)
            total.update(dict(zip(keys.tolist(), counts.tolist())))
            summary.merge(keys, counts)
            if draw.random() < 0.7:
                summary.fold()
        kept = set(summary.survivors().tolist())
        assert {k for k, n in total.items() if n >= threshold} <= kept
        assert summary.taken < threshold and summary.mass == sum(total.values())
        assert all(n <= total[k] for k, n in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_the_summary_stays_small():
    summary = col.MisraGries(10, 400_000)
    for lo in range(0, 400_000, 20_000):
        summary.merge(np.arange(lo, lo + 20_000, dtype=np.uint64), np.ones(20_000, np.int64))
        summary.fold()
    assert len(summary.keys) <= summary.capacity and not len(summary.survivors())


def test_a_run_takes_little_memory():
    draw = np.random.default_rng(3)
    words = draw.zipf(1.2, 300_000) % 30_000
    texts = [" ".join(f"w{w}" for w in part) for part in np.split(words, 100)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr"] * 50, "text": texts})
    tracemalloc.start()
    sent = sum(1 for _ in col._packed_runs(iter([batch]), 10**6, 6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == col.LONGEST and peak < 120 * len(words)


def test_exact_scores_beyond_64_bits(spark):
    row = [(10**14, 10**14 + 1, 10**15)]
    exact = "(CAST({0} AS DECIMAL(16, 0)) * CAST({1} AS DECIMAL(16, 0)))"
    got = spark.createDataFrame(row, "a long, l long, r long").selectExpr(
        f"({exact.format('a', 'a')} * CAST({col.SCALE} AS DECIMAL(7, 0))) DIV {exact.format('l', 'r')} AS score"
    ).first()
    assert got.score == 10**6 * row[0][0] ** 2 // (row[0][1] * row[0][2])


def test_empty_table(no_docs):
    assert col.top_collocations(col.collocations(no_docs)).collect() == []


def test_query_against_plain_python(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op11_collocations(spark, SMALL).collect()} == set(plain.collocations(rows))
