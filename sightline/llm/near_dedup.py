"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

A document is the set of its distinct ``shingle``-word sequences. Equal sets collapse to one class first, so thousands of copies
are one row from there on. Each class has ``TREES`` orders of ``DEPTH`` MinHash values. In an order, classes that share their
first ``START`` values form a region, and those next to each other share the longest common prefix.

1. Neighbours in the first orders are confirmed on their sets and joined to components: nearly all links.
2. In every order, every region that still holds several components is screened whole, whatever its size: members of the
   smaller components are held against all members by signature, and components that may be linked are joined to families.
   Deeper values only order the neighbours of step 1; they never keep a pair from being screened.
3. In every family, all pairs across components are decided on full sets, as products of incidence matrices.

Joins of tables that grow with the corpus are merge joins at every size; none of them has a bound for a broadcast.
Large regions and families are cut into blocks over many tasks, and a task returns one link for each two components it joins, so
that no step emits the pairs of a group. Nothing is capped or sampled. The price is step 2 on many pages that share a template
without being linked: n members of a region outside its largest component are n * n comparisons of signatures.

A pair at exactly 0.8 shares a region with probability 1 - (1 - 0.8**3)**16 = 0.99999, in a family of any size. Screening asks
for 82 equal values of 128, which such a pair misses with probability 0.000009; both together find it with 0.99998, and a pair
at 0.82 with 0.999997. Chains and step 1 only add to that. Confirmation compares full sets of hashes of 128 bits.

Defined results: null, empty and blank texts have no shingles and stay alone; texts shorter than a shingle are one shingle; very
long texts go through slices of words like any other; each row of one id is judged by its own text; a null id gets no component and is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import wordarrays as wa
from sightline.llm.components import components
from sightline.llm.tables import fresh, id_and_text, signed
from sightline.session import materialize

TREES, DEPTH, START = 16, 8, 3
FIRST_TREES = 3
MINOR = 4096
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 21
COLUMNS = 2048
SCREEN = 0.64

_draw = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, (2, TREES * DEPTH), dtype=np.int64).view(np.uint64)
FLIPS, FACTORS = _draw[0], _draw[1] * np.uint64(2) + np.uint64(1)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``."""
    plain = id_and_text(docs, id_col, text_col)
    scanned = materialize(_signatures(plain, shingle), "signatures")
    full = scanned.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"))
    placed = scanned.join(classes.hint("merge"), ["s1", "s2", "n_shingles"], "left")
    heads = placed.where("doc_id = node").select("node", "signature")

    members = materialize(_members(heads), "forest")
    nodes = members.select("node").distinct()
    sets = materialize(
        _sets(plain.join(nodes.hint("merge"), plain.doc_id == nodes.node, "left_semi"), shingle)
        .join(heads.groupBy("node").agg(F.first("signature").alias("signature")).hint("merge"), "node"), "shingle-sets",
    )
    tried = materialize(_neighbours(members.where(F.col("tree") < FIRST_TREES)), "neighbours")
    labels = materialize(components(_confirmed(tried, sets, percent)), "components")
    maybe = _across(members, labels, sets.select("node", "signature"))
    families = materialize(components(labels.toDF("a", "b").unionByName(maybe)), "families")
    links = _completed(families.withColumnRenamed("component", "family"), labels, sets, percent)
    labels = components(labels.toDF("a", "b").unionByName(links))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.join(labels.hint("merge"), "node", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)),
    )


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the least id. Rows of one id and text collapse to one row; different texts
    under one id stay beside each other if the id stays. Columns of any further names are kept."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = fresh(docs, "kept_id")
    verdicts = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    once = docs.where(F.col(id_col).isNotNull()).join(verdicts.hint("merge"), F.col(id_col) == F.col(kept), "left_semi")
    return once.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))


def _shingles(data, offsets, size):
    """Two hashes per shingle, and the offsets of the rows among them."""
    words = wa.Words(data, offsets, wa.LOWER)
    at, found = words.windows(size)
    rows = words.rows[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        place = np.searchsorted(rows, short)
        starts, ends = words.offsets[short], words.offsets[short + 1]
        whole = [wa.run_hashes(h, starts, ends, (base,))[0] for h, base in zip(words.hashes, wa.WORD_BASES)]
        found = [np.insert(h, place, wa.mixed(w)) for h, w in zip(found, whole)]
        rows = np.insert(rows, place, short)
    return found, rows


def _signatures(plain, size):
    def sign(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                (first, second), rows = _shingles(data, offsets, size)
                new = ~wa.later_copies(first, rows)
                first, second, rows = first[new], second[new], rows[new]
                bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
                full = np.flatnonzero(np.diff(bounds))
                sums = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                least = np.zeros((len(full), TREES * DEPTH), ">u4")
                if len(full):
                    cuts = bounds[full]
                    for out, h in zip(sums, (first, second)):
                        out[full] = np.add.reduceat(wa.mixed(h), cuts)
                    for k, (flip, factor) in enumerate(zip(FLIPS, FACTORS)):
                        least[:, k] = np.minimum.reduceat((first ^ flip) * factor, cuts) >> np.uint64(32)
                width = TREES * DEPTH * 4
                ends = np.append(0, np.cumsum(np.diff(bounds) > 0)) * width
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(bounds).astype(np.int64)),
                     *map(signed, sums), _binary(least.tobytes(), ends)],
                    ["doc_id", "n_shingles", "s1", "s2", "signature"],
                )

    return plain.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n_shingles long, s1 long, s2 long, signature binary",
    )


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)],
    )


def _members(heads):
    """Places of classes in the orders, for regions that hold several."""
    regions = heads.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "node", "tree", F.expr(f"substring(signature, tree * {DEPTH * 4} + 1, {DEPTH * 4})").alias("key"),
    ).withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * START)))
    shared = (
        regions.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("region")
    )
    return regions.join(shared.hint("merge"), "region").select("tree", "key", "node", "region")


def _neighbours(members):
    """Each class with the one before it in every order, if they share a region."""

    def pair(batches):
        last = (None, None)
        for batch in batches:
            node, region = (batch.column(c).to_numpy() for c in ("node", "region"))
            if not len(node):
                continue
            if last[0] is not None:
                node, region = np.append(last[0], node), np.append(last[1], region)
            near = (region[1:] == region[:-1]) & (node[1:] != node[:-1])
            a, b = node[:-1][near], node[1:][near]
            last = node[-1:], region[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    order = ["tree", "key", "node"]
    return (
        members.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "region")
        .mapInArrow(pair, "a long, b long").distinct()
    )


def _sets(plain, size):
    def gather(batches):
        for batch in batches:
            for lo, hi, data, offsets in wa.slices(batch.column("text")):
                (first, _), rows = _shingles(data, offsets, size)
                order = np.lexsort((first, rows))
                first, rows = first[order], rows[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (rows[1:] != rows[:-1])
                ends = np.searchsorted(rows[new], np.arange(hi - lo + 1)) * 8
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), _binary(first[new].tobytes(), ends)], ["node", "shingles"],
                )

    return plain.select("doc_id", "text").mapInArrow(gather, "node long, shingles binary")


def _confirmed(pairs, sets, percent):
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def confirm(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            good = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def _across(members, labels, signatures):
    """Pairs of one region and different components that their signatures do not rule out."""
    rows = members.join(labels, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
    stats = parts.groupBy("region").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", F.col("component").alias("id"))).alias("most"),
    ).where("parts > 1").select(
        "region", "n", F.col("most.id").alias("major"), (F.col("n") - F.col("most.n")).alias("minor"),
    )
    return _screened(materialize(rows.join(stats, "region"), "regions"), signatures).distinct()


def _cells(rows, group, blocks, probes):
    """Rows dealt to cells of ``group``: every row outside the largest component meets every row in some cell."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("probes", probes.cast("int"))
    held = rows.select(
        F.col(group).alias("group"), F.pmod(F.hash("node"), "blocks").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("probe"), "node", "component", F.lit(False).alias("minor"),
    )
    asked = rows.where("component != major").select(
        F.col(group).alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.hash("node", F.lit(1)), "probes").alias("probe"), "node", "component", F.lit(True).alias("minor"),
    )
    return held.unionByName(asked)


def _by_cell(cells, data, compare):
    """Links from ``compare(rows of a cell)``; a task holds one batch and one cell."""

    def run(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            group = [table.column(c).to_numpy() for c in CELL]
            cuts = np.flatnonzero(np.any([g[1:] != g[:-1] for g in group], axis=0)) + 1 if table.num_rows else []
            cuts = [0, *map(int, cuts)]
            yield _links(compare, table, cuts)
            kept = table.slice(cuts[-1])
        if kept is not None:
            yield _links(compare, kept, [0, kept.num_rows])

    placed = cells.join(data.hint("merge"), "node").repartition(*CELL).sortWithinPartitions(*CELL)
    return placed.mapInArrow(run, "a long, b long").distinct()


CELL = ["group", "block", "probe"]


def _links(compare, table, cuts):
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            found += compare(table.slice(lo, hi - lo))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def _split(table):
    node, part, minor = (table.column(c).to_numpy() for c in ("node", "component", "minor"))
    return node, part, np.flatnonzero(minor), np.flatnonzero(~minor)


def _joining(node, part, ask, own, close):
    """One of the close pairs for each two components that they join; ``close``: row of ``ask``, row of ``own``."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    x, y = ask[close[0]], own[close[1]]
    both = np.stack([part[x], part[y]], axis=1)
    apart = np.flatnonzero(both[:, 0] != both[:, 1])
    if len(apart):
        _, first = np.unique(both[apart], axis=0, return_index=True)
        for k in apart[first]:
            a, b = root(int(part[x[k]])), root(int(part[y[k]]))
            if a != b:
                parent[b] = a
                out.append((int(node[x[k]]), int(node[y[k]])))
    return out


def _screened(rows, signatures):
    """Members outside a region's largest component against all its members, by signature."""

    def compare(table):
        node, part, ask, own = _split(table)
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
        found = []
        for n, k in enumerate(ask):
            near = np.flatnonzero(part[own] != part[k])
            near = near[np.mean(signs[own[near]] == signs[k], axis=1) >= SCREEN]
            found.append(np.stack([np.full(len(near), n), near]))
        return _joining(node, part, ask, own, np.concatenate(found, axis=1)) if found else []

    return _by_cell(_cells(rows, "region", F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("minor") / MINOR)), signatures, compare)


def _completed(families, labels, sets, percent):
    """Links across the components of each family, decided on full sets."""
    rows = families.join(labels, "node", "left").select("family", "node", F.coalesce("component", "node").alias("component"))
    sized = rows.join(sets.select("node", F.octet_length("shingles").alias("held")), "node")
    parts = sized.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    stats = parts.groupBy("family").agg(
        F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("*").alias("parts"),
        F.max(F.struct("n", F.col("component").alias("id"))).alias("most"),
    ).where("parts > 1").select("family", "n", "held", F.col("most.id").alias("major"), (F.col("n") - F.col("most.n")).alias("minor"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("held") / (8 * BLOCK_SHINGLES)))
    probes = F.ceil(F.greatest(F.col("minor") / BLOCK_ROWS, F.col("held") / F.col("n") * F.col("minor") / (8 * BLOCK_SHINGLES)))

    def compare(table):
        node, part, ask, own = _split(table)
        held = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
        size = np.array([len(h) for h in held])
        both = _common([held[k] for k in ask], [held[k] for k in own])
        union = size[ask][:, None] + size[own][None, :] - both
        return _joining(node, part, ask, own, np.nonzero(100 * both >= percent * union))

    return _by_cell(_cells(rows.join(stats, "family"), "family", blocks, probes), sets.select("node", "shingles"), compare)


def _common(left, right):
    """Sizes of the intersections of every set of ``left`` with every set of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    shared = np.intersect1d(*flat)
    column = []
    for k in range(2):
        at = np.minimum(np.searchsorted(shared, flat[k]), max(len(shared) - 1, 0))
        real = shared[at] == flat[k] if len(shared) else np.zeros(len(flat[k]), bool)
        at, rows[k] = at[real], rows[k][real]
        order = np.argsort(at, kind="stable")
        column.append(at[order])
        rows[k] = rows[k][order]
    for lo in range(0, len(shared), COLUMNS):
        part = []
        for k, n in ((0, len(left)), (1, len(right))):
            a, b = np.searchsorted(column[k], (lo, lo + COLUMNS))
            dense = np.zeros((n, min(COLUMNS, len(shared) - lo)), np.float32)
            dense[rows[k][a:b], column[k][a:b] - lo] = 1
            part.append(dense)
        out += np.rint(part[0] @ part[1].T).astype(np.int64)
    return out
