import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.errors import PythonException

from sightline.llm import byte_bpe, queries, wordarrays as wa

SMALL = "/root/testdata/sf0.001"
PARTS = [
    "a", "b", "é", " ", "  ", "\n", "\t", " ", "\u0085", "　", "漢", "1", "'s", "'", "'re", "'ll", "'t", "'ve", "'d", "'m", "l", "r", "e", "S",
    ".", "!", "<|endoftext|>", "\x1c", "😀", "ſ", "²", " ", "՘", "\U0002ebf0", "the", "hello", " world", "\r\n", "\x00",
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(byte_bpe.default_path(), byte_bpe.char_classes())


def test_ids_are_those_of_the_library(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ENTRIES", 300)
    draw = random.Random(3)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(0, 30))) for _ in range(20000)]
    texts += ["".join(map(chr, range(lo, lo + 700))) for lo in range(0, 0xD000, 700)]
    for lo, hi, data, offsets in wa.slices(pa.array(texts), 20000):
        ids, bounds = bpe.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts[lo:hi]]
        assert bytes(bpe.decode(ids)[0]) == bytes(data)


def test_merging_order_and_long_pieces(bpe, library):
    draw = random.Random(5)
    pieces = ["ab" * 40000, "x" * 30001, "".join(draw.choice("abcdeinort") for _ in range(20000)), "漢" * 3000, "é"]
    for piece in pieces:
        assert byte_bpe.merged(piece.encode(), bpe.ranks) == library.encode_ordinary(piece)
    # Words whose polynomial hashes modulo 2**64 are equal, whatever the odd base.
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    ids, bounds = bpe.encode(*wa.text_buffers(pa.array([one, other])))
    assert ids[: bounds[1]].tolist() == library.encode_ordinary(one) and ids[bounds[1] :].tolist() == library.encode_ordinary(other)


def test_perfect_hash_is_minimal():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 5000):
        keys = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
        found = byte_bpe.PerfectHash(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(len(keys)))


def test_defined_results(spark, docs, rows, clashing, no_docs, library):
    got = byte_bpe.decoded(byte_bpe.encoded(docs)).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded).decode()) for r in got) == sorted(
        (str(r[0]), library.encode_ordinary(r[1] or ""), r[1] or "") for r in rows
    )
    extra = byte_bpe.encoded(clashing.withColumn("ids", clashing.doc_id))
    assert extra.columns == ["doc_id", "ids"] and extra.count() == len(rows)
    assert byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(no_docs))).collect() == []
    odd = spark.createDataFrame([(1, [220, 262], "x"), (2, None, "y"), (3, [], None)], "n int, ids array<int>, decoded string")
    back = byte_bpe.decoded(odd)
    assert back.columns == ["n", "ids", "decoded", "decoded_"]
    assert {r.n: bytes(r.decoded_) for r in back.collect()} == {1: library.decode_bytes([220, 262]), 2: b"", 3: b""}
    with pytest.raises(PythonException, match="not in the vocabulary"):
        byte_bpe.decoded(spark.createDataFrame([([50256],)], "ids array<int>")).collect()


def test_query_against_the_library(spark, library):
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    expected = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        expected.add((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = queries.op13_byte_bpe(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == expected
