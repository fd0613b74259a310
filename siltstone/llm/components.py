"""Problem 1: consolidating pairwise matches into groups.

Union-find runs inside edge partitions and keeps only a spanning forest of each; the forests of all partitions are
merged level by level through partitions of bounded size. Between levels the graph is contracted to the trees' roots,
and a root is the member with the smallest hash, so that every level removes a constant share of the vertices on any
graph, long chains included, while a hub meets at most one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialise

_FOREST = "node long, root long, prio long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers: the priority of an id, different at each level."""
    z = x.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def spanning_stars(u: np.ndarray, v: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, priority of root) for every id in ``u`` or ``v``; root: the member of lowest priority of its tree."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    prio = _mix(ids, seed)
    order = np.argsort(prio, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b = rank[at[: len(u)]], rank[at[len(u) :]]
    parent = np.arange(len(ids))
    while len(a):
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    root = order[parent[rank]]
    return ids, ids[root], prio[root]


def _local_forest(seed: int, bound: int):
    """Arrow batches of (u, v) -> the spanning stars of the partition, given out whenever ``bound`` vertices are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kept, new = 0, 0

        def out(n: np.ndarray, r: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(n), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(n[s]), pa.array(r[s]), pa.array(p[s])], ["node", "root", "prio"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            new += batch.num_rows
            if new >= max(kept, 500_000):
                n, r, p = spanning_stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), seed)
                if len(n) >= bound:
                    yield from out(n, r, p)
                    held, kept = [], 0
                else:
                    held, kept = [(n, r)], len(n)
                new = 0
        if held:
            yield from out(*spanning_stars(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), seed))

    return run


def _contract(edges: DataFrame, bound: int, level: int) -> DataFrame:
    """(node, comp) for every id of ``edges`` (u, v without nulls); comp: any one member of the component."""
    forest = edges.mapInArrow(_local_forest(level, bound), _FOREST)
    best = F.min(F.struct("prio", "root")).over(Window.partitionBy("node"))
    met = materialise(forest.withColumn("m", best["root"]).select("node", "root", "m"))
    labels = met.groupBy("node").agg(F.min("m").alias("m"))
    links = met.filter("root <> m").select(F.col("root").alias("u"), F.col("m").alias("v")).distinct()
    n = links.count()
    if not n:
        return labels.withColumnRenamed("m", "comp")
    if n <= bound:
        above = links.repartition(1).mapInArrow(_local_forest(level + 1, 1 << 62), _FOREST).select("node", F.col("root").alias("comp"))
    else:
        parts = -(-n // bound)
        above = _contract(links.repartition(int(parts), "v"), bound, level + 1)
    return lookup(labels, "m", above.select(F.col("node").alias("key"), "comp")).select("node", F.coalesce("comp", "m").alias("comp"))


def lookup(df: DataFrame, column: str, mapping: DataFrame, hot_share: int = 10_000) -> DataFrame:
    """Left join of ``df.column`` with ``mapping.key`` (unique). Keys with more than 1/``hot_share`` of all rows, of which
    there can be no more than ``hot_share``, are broadcast, so that a hot key never fills one partition."""
    counts = materialise(df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    hot_keys = counts.filter(F.col("n_rows") > max(10_000, total // hot_share)).select(F.col(column).alias("key"))
    if not hot_keys.head(1):
        return df.join(mapping.withColumnRenamed("key", column), column, "left")
    hot = F.broadcast(mapping.join(F.broadcast(hot_keys), "key").withColumnRenamed("key", column).withColumn("is_hot", F.lit(True)))
    # the cold rows carry null keys out of the shuffle join only through the anti join below
    flagged = F.broadcast(hot_keys.withColumnRenamed("key", column))
    warm = df.join(flagged, column, "left_semi").join(hot.drop("is_hot"), column, "left")
    cold = df.join(flagged, column, "left_anti").join(mapping.withColumnRenamed("key", column), column, "left")
    return warm.unionByName(cold)


def connected_groups(edges: DataFrame, u: str | Column = "u", v: str | Column = "v", bound: int = 4_000_000) -> DataFrame:
    """One row (record_id, group_id) for every id found in ``u`` or ``v``; group_id: the smallest id of its connected set.

    Repeated, reversed and self matches change nothing. A row with one null partner names a record that may stand alone;
    a row with two nulls says nothing. An empty table gives no rows. Other columns of ``edges`` are never read.
    ``bound``: the most links that one task merges at a time (about 200 bytes each).
    """
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    pairs = edges.select(F.coalesce(col(u), col(v)).alias("u"), F.coalesce(col(v), col(u)).alias("v")).filter("u is not null")
    comp = materialise(_contract(pairs, bound, 0))
    least = comp.groupBy("comp").agg(F.min("node").alias("group_id"))
    return lookup(comp, "comp", least.withColumnRenamed("comp", "key")).select(F.col("node").alias("record_id"), "group_id")
