import random

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import near_dedup, substring_dedup, wordarrays as wa
from sightline.llm.components import components
from tests.llm import plain
from tests.llm.conftest import SCHEMA, prose


def test_words_and_windows_agree_with_regular_expressions(monkeypatch):
    monkeypatch.setattr(wa, "BLOCK", 64)
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab \n\té") for _ in range(draw.choice([0, 1, 5, 50, 300]))) for _ in range(150)] + [None, "", " "]
    seen = {}
    for lo, hi, data, offsets in wa.slices(pa.array(texts), 500):
        found = wa.Words(data, offsets)
        for r in range(lo, hi):
            a, b = found.offsets[r - lo], found.offsets[r - lo + 1]
            got = [bytes(data[s:e]).decode() for s, e in zip(found.starts[a:b], found.ends[a:b])]
            assert got == plain.words(texts[r])
            for w, h in zip(got, found.hashes[0][a:b]):
                assert seen.setdefault(w, h) == h
        at, (first, _) = found.windows(3)
        for p, h in zip(at, first):
            key = tuple(bytes(data[s:e]) for s, e in zip(found.starts[p : p + 3], found.ends[p : p + 3]))
            assert seen.setdefault(key, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliding_minimum():
    values = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for size in (1, 2, 3, 7, 16, 31):
        assert wa.sliding_min(values, size).tolist() == [min(values[k : k + size]) for k in range(200 - size + 1)]


def test_components_of_chains_stars_and_rings(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    ring = [(300 + k, 300 + (k + 1) % 9) for k in range(9)]
    made = components(spark.createDataFrame(chain + star + ring + [(5, 5)], "a long, b long"))
    got = {r.node: r.component for r in made.collect()}
    assert all(got[k] == 100 for k in range(100, 161))
    assert all(got[k] == 7 for k in range(200, 260)) and got[7] == 7
    assert {got[300 + k] for k in range(9)} == {300} and 5 not in got


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_agree_with_all_pairs(docs, rows, size):
    got = near_dedup.near_duplicates(docs, shingle=size).collect()
    want = plain.classes([(r[0], r[1]) for r in rows if r[0] is not None], size)
    named = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert named == sorted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    alone = [r for r in got if r.doc_id is None]
    assert len(alone) == 1 and alone[0].component_id is None and alone[0].kept


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(4)
    base = prose(9, 80)
    texts = []
    for _ in range(220):
        text = list(base)
        for k in draw.sample(range(80), draw.randrange(1, 16)):
            text[k] = "new" + str(draw.randrange(9999))
        texts.append(" ".join(text))
    table = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(table, SCHEMA), shingle=2).collect()
    want = {i: c for i, _, c in plain.classes(list(enumerate(texts)))}
    assert {r.doc_id: r.component_id for r in got} == want


def test_blocks_of_a_family_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dedup, "MINOR", 4)
    monkeypatch.setattr(near_dedup, "FIRST_TREES", 1)
    test_a_large_group_of_near_copies(spark)


def test_a_large_sparse_family_keeps_its_links_at_the_threshold(spark, monkeypatch):
    """Pages at about 0.7 to each other, in pairs at exactly 0.8: no region may be left out for its size."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 64)
    monkeypatch.setattr(near_dedup, "MINOR", 2)
    monkeypatch.setattr(near_dedup, "FIRST_TREES", 1)
    draw, base, texts = random.Random(8), [f"word{k}" for k in range(91)], []
    for n in range(300):
        places = [k + draw.randrange(2) for k in draw.sample(range(1, 88, 3), 9)]
        text = list(base)
        for k in places[:4]:
            text[k] = f"own{n}at{k}"
        twin = list(text)
        for k in places[4:]:
            twin[k] = f"twin{n}at{k}"
        texts += [" ".join(text), " ".join(twin)]
    got = near_dedup.near_duplicates(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA), shingle=2).collect()
    want = {i: c for i, _, c in plain.classes(list(enumerate(texts)))}
    assert sum(c < i for i, c in want.items()) >= 300
    assert {r.doc_id: r.component_id for r in got} == want


def test_one_document_of_each_group_stays(docs, clashing, rows):
    got = near_dedup.without_near_duplicates(clashing, shingle=2)
    assert got.columns == clashing.columns
    want = {i for i, _, c in plain.classes([(r[0], r[1]) for r in rows if r[0] is not None]) if i == c}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(want)


def test_removed_passages_agree_with_brute_force(docs, rows):
    spans = substring_dedup.repeated_spans(docs)
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, plain.sha(r.kept)) for r in substring_dedup.without_spans(docs, spans).collect())))
    want = sorted(map(str, ((row[0], *w) for row, w in zip(rows, plain.without_repeats([(r[0], r[1]) for r in rows])))))
    assert got == want


@pytest.mark.parametrize("window", [1, 3, 7])
def test_short_windows(spark, window):
    draw = random.Random(window)
    table = [(k, " ".join(draw.choice("abcdef") for _ in range(draw.randrange(0, 40))), "", "", 0) for k in range(25)]
    docs = spark.createDataFrame(table, SCHEMA)
    spans = substring_dedup.repeated_spans(docs, window)
    got = {r.doc_id: (r.n_words, r.n_removed, plain.sha(r.kept)) for r in substring_dedup.without_spans(docs, spans).collect()}
    assert [got[k] for k in range(25)] == plain.without_repeats([(r[0], r[1]) for r in table], window)


def test_empty_tables(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []
    assert substring_dedup.without_spans(no_docs, substring_dedup.repeated_spans(no_docs)).collect() == []
