"""Shards of near equal size by histogram sort.

Rows have the order of (hash of the text, id), so equal texts stand side by side. Splitters are found by counting: candidate
boundaries are laid through the interval in which each splitter must lie, one pass adds up the exact bytes and rows below
each of them over all partitions, and the intervals shrink around the targets until the bytes below a boundary are
within ``tolerance`` of a shard's share. The hash decides as long as it can; only where one hash alone holds more than the
tolerance, as with a very large group of copies, is the group cut, by probing ids in the same way. Then rows are exchanged once.

A histogram is a fixed number of cells per splitter, whatever the input, so the driver holds counts of cells, never rows. Every
shard is cut into ``parts`` of about ``PART_BYTES`` (at most ``MAX_PARTS`` in all) by the same splitters; a part's first
slot follows from the counts below it, so slots are gapless without any task that sees a whole shard.

Defined results: the size is the UTF-8 length of the text (null: 0) plus 1; rows with equal text and id go the same way together
and get slots of their own; a null id counts as the least; other columns are kept by ``assigned`` and may have any names but the
ones it adds, which are lengthened if taken; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import materialize

SHARDS = 16
TOLERANCE = 0.002
PROBES = 32
PART_BYTES = 16 << 20
MAX_PARTS = 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Search:
    """The interval of one splitter: boundaries ``low`` and ``high`` with the (bytes, rows) below each."""

    target: int
    low: int
    high: int
    below_low: tuple[int, int]
    below_high: tuple[int, int]
    done: bool = False

    def probes(self) -> list[int]:
        width = self.high - self.low
        return sorted({self.low + width * k // (PROBES + 1) for k in range(1, PROBES + 1)} - {self.low, self.high})

    def best(self) -> tuple[int, tuple[int, int]]:
        near_low = abs(self.below_low[0] - self.target) <= abs(self.below_high[0] - self.target)
        return (self.low, self.below_low) if near_low else (self.high, self.below_high)

    def refine(self, places: list[int], below: list[tuple[int, int]], slack: float) -> None:
        known = [(self.low, self.below_low), *zip(places, below), (self.high, self.below_high)]
        k = bisect.bisect_right([b[0] for _, b in known], self.target)
        k = min(max(k, 1), len(known) - 1)
        (self.low, self.below_low), (self.high, self.below_high) = known[k - 1], known[k]
        self.done = self.high - self.low <= 1 or abs(self.best()[1][0] - self.target) <= slack


def _counted(keys: DataFrame, column: str, places: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows with ``column`` below each of ``places``."""
    cuts = np.array(places, np.int64)

    def count(batches):
        size, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            cell = np.searchsorted(cuts, batch.column(column).to_numpy(), "right")
            rows += np.bincount(cell, minlength=len(rows))
            np.add.at(size, cell, batch.column("size").to_numpy())
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], ["cell", "size", "rows"])

    cells = (
        keys.select(column, "size").mapInArrow(count, "cell long, size long, rows long")
        .groupBy("cell").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    )
    size, rows = [0] * (len(places) + 1), [0] * (len(places) + 1)
    for c in cells:
        size[c["cell"]], rows[c["cell"]] = c["size"], c["rows"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))


def _searched(keys: DataFrame, column: str, searches: list[Search], slack: float) -> None:
    """Refines all searches together, one pass over the keys per round."""
    while open_ones := [s for s in searches if not s.done]:
        wanted = [s.probes() for s in open_ones]
        places = sorted({p for w in wanted for p in w})
        known = dict(zip(places, _counted(keys, column, places)))
        for s, w in zip(open_ones, wanted):
            s.refine(w, [known[p] for p in w], slack)


def splitters(keys: DataFrame, total: tuple[int, int], parts: int, slack: float) -> list[tuple[int, int, int]]:
    """Boundaries (hash, id, rows below) between ``parts`` parts of near equal bytes. A row belongs before a boundary if its
    (hash, id) is less."""
    searches = [Search(total[0] * k // parts, LEAST, MOST, (0, 0), total) for k in range(1, parts)]
    _searched(keys, "key", searches, slack)
    found = []
    for s in searches:
        if abs(s.best()[1][0] - s.target) <= slack or s.below_high[1] - s.below_low[1] <= 1:
            place, below = s.best()
            found.append((place, LEAST, below[1]))
            continue
        # Between s.low and s.high lies one hash, s.low, whose rows alone exceed the tolerance.
        group = keys.where(F.col("key") == s.low).select("id", "size")
        least, most = group.agg(F.min("id"), F.max("id")).first()
        whole = tuple(b - a for a, b in zip(s.below_low, s.below_high))
        inner = Search(s.target - s.below_low[0], least, most + 1, (0, 0), whole)
        found.append((s.low, group, inner, s.below_low[1]))
    # Splitters within one group are searched together.
    for hashed in {f[0] for f in found if len(f) == 4}:
        same = [f for f in found if len(f) == 4 and f[0] == hashed]
        _searched(same[0][1], "id", [f[2] for f in same], slack)
    return sorted(f if len(f) == 3 else (f[0], f[2].best()[0], f[3] + f[2].best()[1][1]) for f in found)


def assigned(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``."""
    names = {}
    for name in ("size", "shard", "slot", "key", "id", "part"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = {
        names["key"]: F.least(F.xxhash64(text), F.lit(MOST - 1)),
        names["id"]: F.least(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), F.lit(MOST - 1)),
        names["size"]: F.octet_length(text).cast("long") + 1,
    }
    keyed = docs.withColumns(order)
    keys = materialize(keyed.select(*(F.col(names[n]).alias(n) for n in ("key", "id", "size"))), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    total = (total[0], total[1])
    per_shard = min(max(1, -(-total[0] // (shards * PART_BYTES))), max(1, MAX_PARTS // shards))
    parts = per_shard * shards
    bounds = splitters(keys, total, parts, tolerance * total[0] / shards)

    key, rid, part = F.col(names["key"]), F.col(names["id"]), names["part"]
    starts = [0, *(b[2] for b in bounds)]
    placed = keyed.withColumn(part, _part_of(key, rid, bounds))
    first = F.element_at(F.array(*map(F.lit, starts)), F.col(part) + 1) - F.element_at(
        F.array(*(F.lit(starts[s * per_shard]) for s in range(shards))), F.floor(F.col(part) / per_shard).cast("int") + 1,
    )
    inside = F.row_number().over(Window.partitionBy(part).orderBy(names["key"], names["id"])) - 1
    return placed.withColumn(names["shard"], F.floor(F.col(part) / per_shard).cast("int")).withColumn(
        names["slot"], (first + inside).cast("long"),
    ).drop(part, names["key"], names["id"])


def _part_of(key, rid, bounds):
    """How many boundaries lie at or below (key, id): a balanced tree of comparisons."""

    def among(lo, hi):
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        hashed, cut, _ = bounds[middle]
        before = (key < hashed) | ((key == hashed) & (rid < cut))
        return F.when(before, among(lo, middle)).otherwise(among(middle + 1, hi))

    return among(0, len(bounds))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes whole documents, one folder per shard, in slot order within each file."""
    placed = assigned(docs, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
