import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm import conversation_repair as repair, queries
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows):
    """Audit rows of (conv_id, turn, role, text) rows without two different rows of one turn."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    out = set()
    for conv, own in by_conv.items():
        *numbers, lines = plain.repair(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)))
        out.add((conv, *numbers, plain.sha("\n".join(lines))))
    return out


def made_up(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        role, texts = 0, ["Yes.", "No!", "and then", " ", "", "So? ", "é.\n", "\x85", ".", "ok"]
        for turn in range(draw.randrange(1, longest)):
            role = draw.choice(["user", "assistant", "assistant", "user", "system", "tool", None]) if draw.random() < 0.5 else ["user", "assistant"][turn % 2]
            text = draw.choice(texts) if draw.random() < 0.4 else f"t{draw.randrange(1000)}" + draw.choice([".", "!", "?", "", " "])
            if draw.random() < 0.9:
                rows.append((conv if conv else None, turn * 2 - (turn % 3 == 0), role, None if draw.random() < 0.03 else text))
    return rows


def test_classes_are_few_and_steps_are_costs():
    assert len(repair.CLASSES) < 30 and repair.CLASSES[repair.END] == (0, 4, 2, 0)
    draw = random.Random(1)
    letters, ends = {"system": 0, "user": 1, "assistant": 2, "tool": 3}, [".", "", "x"]
    for _ in range(1500):
        rows = [(k, draw.choice(list(letters)), draw.choice(["", f"{k}.", f"{k}"])) for k in range(draw.randrange(0, 8))]
        codes = bytes((1 if not t else 0 if t[-1] == "." else 3) * 4 + letters[r] for _, r, t in rows)
        found, cost, state = repair.traced(codes, repair.backward(codes), repair.START)
        audit = "".join(found) + repair.ENDINGS[state]
        assert (cost + 2 * len(repair.ENDINGS[state]), audit) == plain.repair(rows)[5:7]


def test_passes_meet_the_direct_vectors():
    draw = random.Random(2)
    for kind in ("any", "never meets"):
        for _ in range(200):
            codes = bytes(draw.randrange(16) if kind == "any" else draw.choice([4, 5, 8, 3]) for _ in range(draw.randrange(1, 40)))
            starts = repair.start_classes(codes)
            assert [repair.backward(codes, c)[0] for c in range(len(repair.CLASSES))] == list(starts)
            cut = draw.randrange(len(codes))
            assert repair.start_classes(codes[:cut])[repair.start_classes(codes[cut:])[0]] == starts[0]


@pytest.mark.parametrize("rows_in_chunk", [3, 65536])
def test_conversations_in_chunks(spark, monkeypatch, rows_in_chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", rows_in_chunk)
    rows = made_up(7, 60, 25) + [(900, k, "user", "same.") for k in range(70)] + [(901, k, "tool", f"{k}.") for k in range(70)]
    rows += [(902, k, ["user", "assistant"][k % 2], "x" * (200_000 if k == 5 else 3) + f"{k}.") for k in range(9)]
    found = repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = repair.audits(found)
    assert got.columns == COLUMNS
    assert {tuple(r) for r in got.collect()} == expected(rows) and got.count() == len(expected(rows))
    turns = defaultdict(list)
    for r in repair.repaired_turns(found).orderBy("part", "seq", "at").collect():
        turns[r.conv_id].append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in turns.values())


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 10)
    for rows in ([(1, None, "user", "again.")] * 300, [(1, k, "assistant", f"{k}") for k in range(300)]):
        got = repair.audits(repair.repaired(spark.createDataFrame(rows, SCHEMA)))
        assert {tuple(r) for r in got.collect()} == expected(rows) and got.count() == 1


def test_defined_results(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x."), (None, None, "user", "a."), (None, 4, "assistant", "b"), (2, 3, "user", "q?"), (2, 3, "user", "q?")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in repair.audits(repair.repaired(table)).collect()} == expected(rows)
    clashing = table.withColumns({c: F.lit("x") for c in ("tie", "row", "kind", "part", "seq", "codes", "open", "copy")})
    assert {tuple(r) for r in repair.audits(repair.repaired(repair.damaged(clashing))).collect()} == expected(plain.damaged(rows))
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audits(repair.repaired(empty)).collect() == [] and repair.repaired_turns(repair.repaired(empty)).collect() == []


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = expected(plain.damaged(rows))
    gone = {r[0] for r in rows} - {r[0] for r in wanted}
    wanted |= {(c, 0, 0, 0, 0, 0, 0, "", plain.sha("")) for c in gone}
    got = queries.op12_conversation_repair(spark, SMALL)
    assert got.columns == COLUMNS and {tuple(r) for r in got.collect()} == wanted
