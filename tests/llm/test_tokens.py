import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import packing, range_coder, sharding, token_files, tokens, wordarrays as wa
from sightline.session import scratch_path
from tests.llm import plain
from tests.llm.conftest import SCHEMA

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_chunks_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "ENTRIES", 9000)
    table, draw = tokens.ChunkTokens(tokens.default_path()), random.Random(3)
    parts = ["a", "b", "é", " ", "\n", "\t", " ", "\u0085", " ", "　", "漢", "1", "'s", ".", "!", "<|endoftext|>", "\x1c", "😀", "ſ", "²"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(0, 30))) for _ in range(9000)]
    for lo, hi, data, offsets in wa.slices(pa.array(texts), 20000):
        ids, bounds = table.encode(data, offsets)
        for r in range(lo, hi):
            assert ids[bounds[r - lo] : bounds[r - lo + 1]].tolist() == ids_of(tokenizer, texts[r], 0)[:-1], texts[r]


@pytest.mark.parametrize("vocabulary", [1, 3, 300, 50257])
def test_coder_round_trips(vocabulary):
    draw = np.random.default_rng(vocabulary)
    for n in (0, 1, 2, 1023, 1024, 1025, 5000):
        for ids in (draw.integers(0, vocabulary, n), np.full(n, vocabulary - 1), np.minimum(draw.zipf(1.3, n), vocabulary) - 1):
            data = range_coder.encode_blocks(ids.astype(np.uint32), vocabulary)
            assert (range_coder.decode_blocks(data) == ids).all()
    assert len(range_coder.encode_blocks(np.full(100_000, vocabulary - 1, np.uint32), vocabulary)) < 8000


def test_coder_notices_damage():
    data = range_coder.encode_blocks(np.arange(5000, dtype=np.uint32) % 900, 50257)
    for at in (0, 30, len(data) - 9):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            range_coder.decode_blocks(bytes(bad))
    for size in (0, 10, 40, len(data) - 4):
        with pytest.raises(ValueError):
            range_coder.decode_blocks(data[:size])


def test_token_files(spark, docs, rows, tokenizer, no_docs, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 3000)
    path = scratch_path(spark, "tokens-test")
    token_files.write_tokens(docs, path)
    made = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in made] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    at, texts = 0, defaultdict(list)
    for row in rows:
        texts[row[0]].append(ids_of(tokenizer, row[1], 2))
    for r in made:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in texts[r.doc_id] and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    path = scratch_path(spark, "tokens-none")
    token_files.write_tokens(no_docs, path)
    assert token_files.read_tokens(spark, path).collect() == []


def test_best_fit_and_bound():
    draw = np.random.default_rng(5)
    for _ in range(60):
        lengths = draw.integers(1, 65, draw.integers(1, 40))
        place, offset, filled = packing.best_fit(lengths, 64)
        assert (filled <= 64).all() and filled.sum() == lengths.sum() and packing.bound(lengths, 64) <= len(filled)
        for b in range(len(filled)):
            here = sorted(zip(offset[place == b], lengths[place == b]))
            assert [o for o, _ in here] == np.append(0, np.cumsum([n for _, n in here]))[:-1].tolist()
    assert packing.bound(np.full(9, 40), 64) == 9


def test_packing(spark, docs, rows, tokenizer, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 6)
    made = packing.packed(packing.token_pieces(docs, with_ids=True)).collect()
    texts, sequences, pieces = defaultdict(list), defaultdict(list), defaultdict(list)
    for row in rows:
        texts[row[0]].append(ids_of(tokenizer, row[1], 0))
    for r in made:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.length == len(r.ids) <= 2048 and crc(r.ids) == r.ids_crc32
    for i, own in pieces.items():
        n = len(texts[i])
        own.sort(key=lambda r: r.piece)
        want = sorted(texts[i])
        assert sum(r.length for r in own) == sum(map(len, want)) and len([r for r in own if r.piece == 0]) == n
        for r in own:
            first = (len(want[0]) - 1) % 2048 + 1
            assert r.ids == want[0][r.start : r.start + r.length]
            assert (r.start, r.length) == ((0, first) if r.piece == 0 else (first + (r.piece - 1) * 2048, 2048))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    assert packing.packed(packing.token_pieces(no_docs)).collect() == []


def test_shards(spark, docs, clashing, rows, no_docs):
    texts = [("copy " * 9, k) for k in range(4000)] + [(f"text {k} " * (k % 40), 5000 + k) for k in range(4000)]
    many = spark.createDataFrame([(k, t, "", "", 0) for t, k in texts], SCHEMA)
    made = sharding.assigned(many).collect()
    size = [sum(r.size for r in made if r.shard == s) for s in range(16)]
    assert max(size) - min(size) < 0.02 * sum(size) / 16
    for s in range(16):
        assert sorted(r.slot for r in made if r.shard == s) == list(range(sum(r.shard == s for r in made)))
    cut = defaultdict(set)
    for r in made:
        cut[r.text].add(r.shard)
    assert sum(len(s) > 1 for t, s in cut.items() if t != "copy " * 9) <= 15

    got = sharding.assigned(clashing)
    assert got.columns == [*clashing.columns, "size_", "shard_", "slot_"]
    assert sorted(r["size_"] for r in got.collect()) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert sharding.assigned(no_docs).collect() == []


def test_written_shards(spark, docs, rows):
    path = scratch_path(spark, "shards-test")
    sharding.write_shards(docs, path, shards=4)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and {r.shard for r in back.collect()} <= set(range(4))


def test_pipeline_agrees_with_plain_python(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [" ".join(plain.words(r.text.lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "pipeline-test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality rules":
            passing = plain.passing([(i, r.text, r.source) for i, r in kept.items()])
            kept = {i: r for i, r in kept.items() if i in passing}
        elif name == "MinHash near-dedup":
            alone = plain.classes([(i, r.text) for i, r in kept.items()], 5)
            kept = {i: kept[i] for i, _, c in alone if i == c}
        elif name == "benchmark decontamination":
            kept = {i: r for i, r in kept.items() if not any(b in " ".join(plain.words(r.text.lower())) for b in bench)}
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == set(kept), name
    for i, r in got.items():
        assert r.n_chars == len(r.text) and not plain.base_pii(r.text)
        assert (r.text == kept[i].text) == (not plain.base_pii(kept[i].text)) or "[" in r.text
    packed = corpus_pipeline.run(spark, SMALL)
    total = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in total} == {i: len(ids_of(tokenizer, r.text, 0)) for i, r in got.items()}
