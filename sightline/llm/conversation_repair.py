"""Repair of conversations by the cheapest edits, with an audit trail.

A conversation should be an optional system turn and then pairs of user and assistant turns, or nothing. Keep costs 0, giving a turn
the role user or assistant 2, deleting it 3 (a must for blank and repeated turns), inserting an empty turn 2; a truncated turn that
stays adds 1. Costs to the end run backwards over the turns, a vector of one cost per state of the pattern (Viterbi). The audit
then goes forward along cheapest edits and takes the least letter of D, I, K and R wherever several are as cheap.

Long conversations are many chunks worked on in parallel, by rank convergence. Vectors that differ by a constant lead to the same
edits, so a vector counts as its class; costs are small integers, and there are only a few classes (``CLASSES``). Each chunk starts
from a speculative class at its end. Fix-up passes start from each other class and stop where they meet what is there, that is, where
vectors differ only by a constant; the few that never meet run through. So a chunk knows what it makes of any vector, and the
true vectors are stitched from the last chunk to the first, tracing likewise from the first to the last. Only these small maps of a
conversation meet in one task. No number of passes over the table depends on the data.

Rows are laid out by ranges of (conversation, turn, role, text hash, row number) and cut into chunks of at most ``CHUNK_ROWS`` rows or
``CHUNK_BYTES`` of text, so a conversation with a third of all rows, or one turn repeated as often, is many chunks; only runs that may go
on elsewhere take the further steps. A turn that repeats one of an earlier chunk is found by a keyed grouping of one row per chunk
and text. The digest over one conversation's text is sequential by definition: it is computed as its chunks stream by.

Defined results: null roles and texts count as one space, a null ``conv_id`` is one more conversation, null turns come first and do not
count for gaps; rows of one turn go by role, then by a hash of the text; repeated rows are repeated turns; texts of any length are
one row of a chunk; further columns are ignored; an empty table gives an empty table. The input must read the same when read
again, as files do.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize

CHUNK_ROWS = 1 << 16
CHUNK_BYTES = 8 << 20
SPACES = " \t\n\x0b\x0c\r"
LETTERS = "sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn that is made to fit, and its role.
FITTED = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: (state, letter) to the state after a turn that is kept.
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
RELABEL, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
CODES = 16

CHUNK = (
    "conv_id long, part int, seq long, open boolean, turns array<long>, roles array<string>, texts array<string>, codes binary,"
    " digests array<binary>"
)
REPAIRED = (
    "conv_id long, part int, seq long, open boolean, blank long, duplicate long, truncated long, illegal long, first_letter int,"
    " last_letter int, first_turn long, last_turn long, n_turns long, cost long, audit string, roles array<string>, texts array<string>"
)


def _row_costs(after: tuple[int, ...], code: int) -> tuple[list[int], dict]:
    """Costs to the end before a turn of this code, and the edits of each state as (letter, cost, next state), of the turn itself."""
    fault, letter = divmod(code, 4)
    edits = {}
    for state in FITTED:
        edits[state] = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            extra = CUT_OFF if fault == TRUNCATED else 0
            if (state, letter) in KEPT:
                edits[state].append(("K", extra, KEPT[state, letter]))
            edits[state].append(("R", RELABEL + extra, FITTED[state][0]))
    return _with_inserts([min(cost + after[to] for _, cost, to in edits[state]) for state in FITTED]), edits


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in FITTED:
        costs = [min(costs[s], INSERT + costs[FITTED[s][0]]) for s in FITTED]
    return costs


def _normal(costs) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def _least_audit(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    """Letters up to and including the turn's own edit, their cost and the state they lead to."""
    before, edits = _row_costs(after, code)
    letters, spent = "", 0
    while True:
        options = [(letter, cost, to, cost + after[to]) for letter, cost, to in edits[state]]
        to = FITTED[state][0]
        options.append(("I", INSERT, to, INSERT + before[to]))
        letter, cost, to, _ = min(o for o in options if o[3] == before[state])
        letters, spent, state = letters + letter, spent + cost, to
        if letter != "I":
            return letters, spent, state


def _tables():
    """Classes of cost vectors, their steps per code of a turn, and the least audit per class behind the turn, code and state."""
    far = 1 << 30
    end = _normal(_with_inserts([0, far, far, 0]))
    classes, queue, steps = {end: 0}, deque([end]), []
    while queue:
        vector = queue.popleft()
        for code in range(CODES):
            found = _normal(_row_costs(vector, code)[0])
            if found not in classes:
                classes[found] = len(classes)
                queue.append(found)
            steps.append(classes[found])
    audits = [_least_audit(v, code, state) for v in classes for code in range(CODES) for state in FITTED]
    return list(classes), steps, audits


#: Class 0 is the true vector behind the last turn; it is the speculative one elsewhere.
CLASSES, STEPS, AUDITS = _tables()
END = 0
ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def backward(codes: bytes, at_end: int = END) -> list[int]:
    """The class of the cost vector before each turn, and behind the last."""
    out = [at_end] * (len(codes) + 1)
    for k in range(len(codes) - 1, -1, -1):
        at_end = out[k] = STEPS[at_end * CODES + codes[k]]
    return out


def start_classes(codes: bytes) -> bytes:
    """For each class at the end of a chunk, the class at its start: a speculative pass, and fix-up passes until they meet it."""
    speculative = backward(codes)
    out = bytearray(len(CLASSES))
    for first in range(len(CLASSES)):
        at = first
        for k in range(len(codes) - 1, -1, -1):
            if at == speculative[k + 1]:
                at = speculative[0]
                break
            at = STEPS[at * CODES + codes[k]]
        out[first] = at
    return bytes(out)


def traced(codes: bytes, classes: list[int], state: int) -> tuple[list[str], int, int]:
    """Letters per turn along the least audit, their cost and the last state."""
    letters, spent = [], 0
    for k, code in enumerate(codes):
        found, cost, state = AUDITS[(classes[k + 1] * CODES + code) * 4 + state]
        letters.append(found)
        spent += cost
    return letters, spent, state


def end_states(codes: bytes, at_end: int) -> bytes:
    """For each state before a chunk, the state behind it."""
    classes = backward(codes, at_end)
    return bytes(traced(codes, classes, state)[2] for state in FITTED)


def _code(role: str, text: str, seen: set) -> int:
    letter = LETTERS.find(role[:1]) if role[:1] in tuple(LETTERS) else 3
    solid = text.rstrip(SPACES)
    if not solid:
        fault = BLANK
    elif (role, text) in seen:
        fault = DUPLICATE
    else:
        fault = NO_FAULT if solid[-1] in ".!?" else TRUNCATED
    seen.add((role, text))
    return fault * 4 + letter


def _digest(conv_id, role: str, text: str) -> bytes:
    made = hashlib.blake2b(f"{conv_id}:{len(role)}:{role}:".encode(), digest_size=16)
    made.update(text.encode())
    return made.digest()


def _chunk_row(conv_id, part, seq, is_open, rows):
    seen: set = set()
    codes = bytes(_code(role, text, seen) for _, role, text in rows)
    digests = None
    if is_open:
        digests = [_digest(conv_id, r, t) if c >> 2 in (NO_FAULT, TRUNCATED) else None for (_, r, t), c in zip(rows, codes)]
    turns, roles, texts = map(list, zip(*rows))
    return (conv_id, part, seq, is_open, turns, roles, texts, codes, digests)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _emitted(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their weight in bytes as batches of about 4 MB."""
    held, weight = [], 0
    for size, row in rows:
        held.append(row)
        weight += size + 200
        if weight > 4 << 20:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _cells(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def chunks(conversations: DataFrame) -> DataFrame:
    """Runs of neighbouring turns of one conversation, with a code (fault and role) per turn, written out.

    ``open`` chunks are parts of a conversation that may have others: it was cut, or begins or ends a task's range.
    """
    max_rows, max_bytes = CHUNK_ROWS, CHUNK_BYTES
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "tie", "row"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    schema = _arrow(CHUNK)

    def cut(batches):
        part = TaskContext.get().partitionId()
        held, size, seq, conv, is_open = [], 0, 0, None, True
        for batch in batches:
            for found, turn, role, text in _cells(batch):
                if held and (found != conv or len(held) >= max_rows or size >= max_bytes):
                    is_open = is_open or found == conv
                    yield size, _chunk_row(conv, part, seq, is_open, held)
                    held, size, seq, is_open = [], 0, seq + 1, is_open and found == conv
                conv = found
                held.append((turn, role, text))
                size += len(text) + len(role)
        if held:
            yield size, _chunk_row(conv, part, seq, True, held)

    return materialize(laid.mapInArrow(lambda batches: _emitted(cut(batches), schema), CHUNK), "conversation-chunks")


def _repeats_marked(held: DataFrame) -> DataFrame:
    """Codes of the open chunks, with turns that repeat one of an earlier chunk marked as such."""
    turns = held.where("open").select("part", "seq", F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    firsts = turns.groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = turns.join(firsts, "digest").where("struct(part, seq) > first").groupBy("part", "seq").agg(F.collect_list("at").alias("late"))
    opened = held.where("open").select("conv_id", "part", "seq", "codes").join(late, ["part", "seq"], "left")
    ddl = "conv_id long, part int, seq long, codes binary"
    schema = _arrow(ddl)

    def mark(batches):
        for batch in batches:
            for conv, part, seq, codes, places in _cells(batch):
                marked = bytearray(codes)
                for k in places or ():
                    marked[k] = DUPLICATE * 4 + marked[k] % 4
                yield len(marked), (conv, part, seq, bytes(marked))

    return materialize(
        opened.select("conv_id", "part", "seq", "codes", "late").mapInArrow(lambda batches: _emitted(mark(batches), schema), ddl),
        "conversation-codes",
    )


def _stitched(maps: DataFrame, name: str, first: int, forwards: bool) -> DataFrame:
    """Follow the small maps (``to``) of each conversation's chunks from one to the next; ``name`` is what arrives at each chunk."""
    order = [F.col("conv_id"), *(F.col(c).asc() if forwards else F.col(c).desc() for c in ("part", "seq"))]
    ddl = f"part int, seq long, {name} int"
    schema = _arrow(ddl)

    def follow(batches):
        known, value, begun = None, first, False
        for batch in batches:
            for conv, part, seq, to in _cells(batch):
                if not begun or conv != known:
                    known, value, begun = conv, first, True
                yield 0, (part, seq, value)
                value = to[value]

    laid = maps.select("conv_id", "part", "seq", "to").repartition("conv_id").sortWithinPartitions(*order)
    return laid.mapInArrow(lambda batches: _emitted(follow(batches), schema), ddl)


def _mapped(rows: DataFrame, work) -> DataFrame:
    """``conv_id, part, seq`` and the small map ``to`` that ``work`` makes of the other columns."""
    ddl = "conv_id long, part int, seq long, to binary"
    schema = _arrow(ddl)

    def run(batches):
        for batch in batches:
            for conv, part, seq, *values in _cells(batch):
                yield 0, (conv, part, seq, work(*values))

    return rows.mapInArrow(lambda batches: _emitted(run(batches), schema), ddl)


def repaired(conversations: DataFrame) -> DataFrame:
    """Chunks of repaired conversations: counts of faults, cost and letters of the edits, roles and texts of the turns that result."""
    held = chunks(conversations)
    codes = _repeats_marked(held)
    ends = materialize(_stitched(_mapped(codes, start_classes), "at_end", END, forwards=False), "conversation-ends")
    known = codes.join(ends, ["part", "seq"]).select("conv_id", "part", "seq", "codes", "at_end")
    begins = _stitched(_mapped(known, end_states), "state", START, forwards=True)
    # Whether the conversation goes on decides where the last inserts go.
    last = codes.groupBy("conv_id").agg(F.max(F.struct("part", "seq")).alias("place")).select("place.part", "place.seq", F.lit(True).alias("last"))
    placed = known.drop("conv_id").join(begins, ["part", "seq"]).join(last, ["part", "seq"], "left")
    opened = held.where("open").drop("codes").join(placed, ["part", "seq"])
    columns = ["conv_id", "part", "seq", "open", "turns", "roles", "texts", "codes", "at_end", "state", "last"]
    closed = held.where("not open").withColumns({"at_end": F.lit(END), "state": F.lit(START), "last": F.lit(True)})
    work = closed.select(columns).unionByName(opened.select(columns))
    schema = _arrow(REPAIRED)

    def repair(batches):
        for batch in batches:
            for row in _cells(batch):
                yield _repaired_row(*row)

    return work.mapInArrow(lambda batches: _emitted(repair(batches), schema), REPAIRED)


def _repaired_row(conv, part, seq, is_open, turns, roles, texts, codes, at_end, state, last):
    letters, cost, end = traced(codes, backward(codes, at_end), state)
    if last:
        letters.append(ENDINGS[end])
        cost += INSERT * len(ENDINGS[end])
    new_roles, new_texts = [], []
    for k, edits in enumerate(letters):
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K":
                state = KEPT[state, codes[k] % 4]
                new_roles.append(roles[k])
            else:
                state, role = FITTED[state]
                new_roles.append(role)
            new_texts.append("" if edit == "I" else texts[k])
    faults = [code >> 2 for code in codes]
    kinds = [code & 3 for code in codes]
    known = [t for t in turns if t is not None]
    return sum(map(len, new_texts)) + len(codes) * 8, (
        conv, part, seq, is_open, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
        sum(pair not in LEGAL_PAIRS for pair in zip(kinds, kinds[1:])), kinds[0], kinds[-1],
        known[0] if known else None, known[-1] if known else None, len(set(known)), cost, "".join(letters), new_roles, new_texts,
    )


def repaired_turns(found: DataFrame) -> DataFrame:
    """The turns of ``repaired`` as rows: ``conv_id``, ``part, seq, at`` (in order of the conversation), ``role``, ``text``."""
    pairs = F.arrays_zip("roles", "texts")
    return found.select("conv_id", "part", "seq", F.posexplode(pairs).alias("at", "pair")).select(
        "conv_id", "part", "seq", "at", F.col("pair.roles").alias("role"), F.col("pair.texts").alias("text"),
    )


AUDIT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def audits(found: DataFrame) -> DataFrame:
    """One row per conversation: gaps between turns, faults, cost, letters of the edits and a digest of the repaired turns."""
    lines = "transform(arrays_zip(roles, texts), x -> concat(x.roles, ':', x.texts))"
    whole = found.where("not open").selectExpr(
        "conv_id", "coalesce(last_turn - first_turn + 1 - n_turns, 0) AS gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        f"sha2(array_join({lines}, '\\n'), 256) AS repaired_sha256",
    )
    schema = _arrow(AUDIT)
    laid = found.where("open").drop("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def join(batches):
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                if total is None or total.conv != row["conv_id"]:
                    if total is not None:
                        yield total.row()
                    total = _Total(row["conv_id"])
                total.add(row)
        if total is not None:
            yield total.row()

    parts = laid.mapInArrow(lambda batches: _emitted(join(batches), schema), AUDIT)
    return whole.unionByName(parts)


class _Total:
    """Sums over the chunks of one conversation as they stream by."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self, conv):
        self.conv, self.counts, self.letters, self.sha = conv, dict.fromkeys(self.COUNTS, 0), [], hashlib.sha256()
        self.begun = False
        self.letter = self.first = self.last = None
        self.n_turns = 0

    def add(self, row):
        for name in self.COUNTS:
            self.counts[name] += row[name]
        if self.letter is not None:
            self.counts["illegal"] += (self.letter, row["first_letter"]) not in LEGAL_PAIRS
        self.letter = row["last_letter"]
        self.n_turns += row["n_turns"] - (self.last is not None and self.last == row["first_turn"])
        if row["first_turn"] is not None:
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]
        self.letters.append(row["audit"])
        for role, text in zip(row["roles"], row["texts"]):
            self.sha.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
            self.begun = True

    def row(self):
        gaps = self.last - self.first + 1 - self.n_turns if self.first is not None else 0
        faults = [self.counts[name] for name in self.COUNTS]
        return sum(map(len, self.letters)), (self.conv, gaps, *faults, "".join(self.letters), self.sha.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, one of twenty kinds by a hash of the turn's address; most stay as they are."""
    space = F.lit(" ")
    address = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(address.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")
