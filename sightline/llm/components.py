"""Connected components as alternating star steps on an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize

CHUNK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node of ``links`` (``a``, ``b``).

    Each round first replaces the edges of every chunk of ``CHUNK`` by stars around the least node that the chunk alone
    connects, then joins every node's larger neighbours, then its smaller ones, to the least node around. The table of edges
    never grows, rounds are logarithmic in practice, and each is written to the shared folder. A node with very many
    links is handled by partial minima and a split join, never as one list.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    while True:
        near = edges.mapInArrow(_stars, "u long, v long")
        least = (
            near.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
            .groupBy(F.col("e.u").alias("v")).agg(F.min("e.v").alias("least"))
            .select("v", F.least("v", "least").alias("least"))
        )
        large = near.join(least, "v").select("u", F.col("least").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        pairs = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")),
        )).alias("e")).select("e.*")
        edges = materialize(pairs.where("u > v").distinct(), "edges")
        if _only_stars(edges):
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.toDF("node", "component").unionByName(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and none that others hang on hangs on another itself."""
    rows, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return rows == nodes and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def _stars(batches):
    """The edges of each chunk as stars around the least node they connect."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield _star(held)
            held, rows = [], 0
    if held:
        yield _star(held)


def _star(held):
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in held:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    pairs = [(x, root(x)) for x in parent]
    pairs = [(x, top) for x, top in pairs if x != top]
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in pairs], pa.int64()), pa.array([top for _, top in pairs], pa.int64())], ["u", "v"],
    )
