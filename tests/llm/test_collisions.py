"""Texts made to collide under polynomial hashes modulo 2**64, and columns named like the operators' own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import decontamination, near_dedup, quality_rules, queries, substring_dedup, tokens, wordarrays as wa
from tests.llm import plain
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_tokens import crc, ids_of


def thue_morse(doublings, first="a", second="b"):
    """A Thue-Morse word and its complement."""
    one, two = [first], [second]
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


ONE, TWO = ("".join(w) for w in thue_morse(10))


def hashes_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return wa.Words(data, np.array([0, len(data)]))


@pytest.mark.parametrize("doublings", [3, 6, 10, 12, 14])
def test_words_that_defeat_polynomials_differ(doublings):
    for letters in ("ab", "az", "05"):
        one, two = ("".join(w) for w in thue_morse(doublings, *letters))
        for first in hashes_of(f"{one} {two} {one}").hashes:
            assert first[0] != first[1] and first[0] == first[2]


def test_hashes_depend_on_every_byte_and_place():
    seen = set()
    base = bytes(range(65, 91)) * 2
    for size in range(0, 41):
        seen.add(base[:size])
        for k in range(size):
            seen.add(base[:k] + b"?" + base[k + 1 : size])
    texts = sorted(seen)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for found in wa.byte_hashes(data, ends - [len(t) for t in texts], ends):
        assert len(set(found.tolist())) == len(texts)
    zeros = np.zeros(40, np.uint8)
    assert len(set(wa.byte_hashes(zeros, np.zeros(41, np.int64), np.arange(41))[0].tolist())) == 41


@pytest.mark.parametrize("size", [65, 100, 1024, 1500])
def test_wide_windows_differ_too(size):
    one, two = thue_morse(10)
    found = hashes_of(" ".join(one + two + one + two))
    for h, base in zip(found.hashes, wa.WORD_BASES):
        windows = wa.window_hashes(h, size, base)
        words = one + two + one + two
        seen = {}
        for k, value in enumerate(windows.tolist()):
            assert seen.setdefault(tuple(words[k : k + size]), value) == value
        assert len(set(seen.values())) == len(seen)


def test_colliding_chunks_get_their_own_ids():
    tokenizer = Tokenizer.from_file(tokens.default_path())
    table = tokens.ChunkTokens(tokens.default_path())
    texts = [ONE, TWO, f"x {ONE}", f"x {TWO}"]
    for lo, hi, data, offsets in wa.slices(pa.array(texts)):
        ids, bounds = table.encode(data, offsets)
        for r in range(lo, hi):
            assert ids[bounds[r - lo] : bounds[r - lo + 1]].tolist() == ids_of(tokenizer, texts[r], 0)[:-1]


def test_colliding_texts_keep_their_results(spark, tmp_path):
    lead = prose(31, 49)
    texts = [f"x {ONE}", f"x {TWO}", " ".join([*lead, ONE]), " ".join([*lead, TWO]), f"{ONE}\n{TWO}\n{ONE}"]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in enumerate(texts)], SCHEMA)
    linked = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert linked == {i: c for i, _, c in plain.classes(list(enumerate(texts)))}
    judged = {r.doc_id: r.n_dup_lines for r in quality_rules.judged_documents(docs).collect()}
    assert judged == {k: plain.counts(t)[3] for k, t in enumerate(texts)} and judged[4] == 1
    removed = substring_dedup.without_spans(docs, substring_dedup.repeated_spans(docs)).collect()
    assert {r.doc_id: r.n_removed for r in removed} == dict.fromkeys(range(5), 0)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(tokens.default_path())
    files = {r.doc_id: r.ids_crc32 for r in queries.QUERIES["op1_token_files"](spark, str(tmp_path)).collect()}
    assert files == {k: crc(ids_of(tokenizer, t, 2)) for k, t in enumerate(texts)}
    packed = {}
    for r in queries.QUERIES["op7_best_fit_packing"](spark, str(tmp_path)).collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for k, t in enumerate(texts):
        ids = ids_of(tokenizer, t, 0)
        assert sorted(packed[k]) == [(s, n, crc(ids[s : s + n])) for s, n, _ in sorted(packed[k])]


@pytest.fixture(scope="module")
def taken(spark):
    """Documents with further columns under the names the two filters use for what they join."""
    base = prose(41, 60)
    texts = [" ".join(base), " ".join(base), " ".join(prose(42, 40)), None, "short"]
    docs = spark.createDataFrame([(k, t, "en", "src", 0) for k, t in enumerate(texts)], SCHEMA)
    return docs.withColumns({n: F.lit("x") for n in ("kept_id", "leak_id", "Leak_Key", "text_key", "item_id", "start")}), base


def test_filters_leave_columns_of_any_name(spark, taken):
    docs, base = taken
    got = near_dedup.without_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 2, 3, 4]
    bench = spark.createDataFrame([(1, " ".join(base[:30]))], "item_id long, text string")
    got = decontamination.without_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 3, 4]


def test_unlike_texts_of_one_id_both_stay(spark):
    texts = [(1, " ".join(prose(51, 30))), (1, " ".join(prose(52, 30))), (1, " ".join(prose(51, 30))), (2, "other"), (None, "a"), (None, "a")]
    docs = spark.createDataFrame([(k, t, "en", "src", 0) for k, t in texts], SCHEMA)
    got = near_dedup.without_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", texts[0][1]), ("1", texts[1][1]), ("2", "other"), ("None", "a"), ("None", "a")])
