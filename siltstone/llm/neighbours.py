"""Problem 4: the k most similar vectors of every vector.

A block matrix join (siltstone.operators.blocks). Every tile of two blocks is a product of int8 codes, which gives each
cosine within a known quantisation error; only cells that can still be among the best k of their row or column, at or above
the threshold, are computed again from the vectors' numbers. A task keeps bounded heaps for the rows of both its groups;
the heaps of all tasks are merged by a row number with a limit before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import lookup
from siltstone.operators.blocks import GROUP_BYTES, Side, block_join, block_pairs, cosines, product
from siltstone.session import materialise

ROWS_AT_ONCE = 512  # rows of a tile held as one product
SMALL = 100_000  # classes or members that are broadcast, at most some tens of MB


def usable_vectors(df: DataFrame, uuid: str, embedding: str, dim: int | None) -> tuple[DataFrame, int]:
    """((uuid, key, vec), length): rows with a vector of the right length, without null or non-finite numbers, not all zero.

    ``dim`` None: the commonest length. vec: its float32 numbers; key: the order of its first four numbers and its MD5."""
    rows = df.select(F.col(uuid).cast("string").alias("uuid"), F.col(embedding).cast("array<float>").alias("vec")).filter("uuid is not null and size(vec) > 0")
    if dim is None:
        top = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = top["d"] if top else 1

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)  # no -0
            fine = np.flatnonzero((np.abs(v) < 3e38).all(1) & (v != 0).any(1))
            v = v[fine]
            bits = v[:, :4].copy().view(np.uint32)
            head = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(">u4")
            raw = [x.tobytes() for x in v]
            key = [h.tobytes() + hashlib.md5(x).digest() for h, x in zip(head, raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine)), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["uuid", "key", "vec"])

    return rows.filter(F.size("vec") == dim).mapInArrow(as_bytes, "uuid string, key binary, vec binary"), dim


class Heaps:
    """The best k partners of each row of a side, over any number of tiles. Partners are numbers in the order of their ids."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.sim = np.full((n, k), -2.0)
        self.who = np.full((n, k), -1, np.int64)
        self.floor = np.full(n, -2.0)

    def push(self, rows: np.ndarray, who: np.ndarray, sim: np.ndarray) -> None:
        """Merge candidates into the rows' heaps; ties go to the smaller id."""
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.k), rows])
        w = np.concatenate([self.who[touched].ravel(), who])
        s = np.concatenate([self.sim[touched].ravel(), sim])
        order = np.lexsort((w, -s, r))
        r, w, s = r[order], w[order], s[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        top = place < self.k
        self.sim[r[top], place[top]], self.who[r[top], place[top]] = s[top], w[top]
        self.floor[touched] = self.sim[touched, -1]


def _open(near: np.ndarray, low: np.ndarray, err: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a tile that can be among the best k of their row and reach ``low``."""
    if near.shape[1] > k:  # at most what reaches the k-th surest of the row
        low = np.maximum(low, np.partition(near, -k, axis=1)[:, -k] - err)
    return np.nonzero(near >= (low - err)[:, None])


def tile(a: Side, x: slice, b: Side, y: slice, own: np.ndarray, other: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the cells of two blocks that can be among the best k of their row (floors ``own``) or of their
    column (floors ``other``) and reach ``least``."""
    near, err = product(a, x, b, y)
    low, high = np.maximum(own, least), np.maximum(other, least)
    r, c = np.nonzero(near >= min(low.min(), high.min()) - err.max())
    if len(r) > 4 * k * sum(near.shape):  # many cells pass: keep those that can reach the k-th surest of their row or column
        flat = np.union1d(*(np.ravel_multi_index(at, near.shape) for at in (_open(near, low, err, k), _open(near.T, high, np.full(near.shape[1], err.max(), err.dtype), k)[::-1])))
        r, c = np.unravel_index(flat, near.shape)
    good = near[r, c] >= np.minimum(low[r], high[c]) - err[r]
    r, c = r[good] + x.start, c[good] + y.start
    sim = cosines(a, r, b, c)
    good = sim >= np.minimum(low[r - x.start], high[c - y.start])
    return r[good], c[good], sim[good]


def knn_classes(classes: DataFrame, dim: int, k: int, least: float, sample: int, seed: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(cid, other, sim): of every vector of ``classes`` (id, vec) the best k others (itself left out) with a cosine of at least
    ``least`` within each task; the best k of all are among them."""

    def work(a: Side, b: Side, same: bool, near) -> pd.DataFrame:
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        order = np.argsort(ids.astype(str), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at_b = place if same else place[len(a.ids) :]
        ha = Heaps(len(a.ids), k)
        hb = ha if same else Heaps(len(b.ids), k)
        for x, y, diagonal in sorted(block_pairs(a, b, same, near), key=lambda t: not t[2]):  # near blocks first: they raise the floors
            for s in range(x.start, x.stop, ROWS_AT_ONCE):
                cut = slice(s, min(s + ROWS_AT_ONCE, x.stop))
                r, c, sim = tile(a, cut, b, y, ha.floor[cut], hb.floor[y], k + 1, least)
                if same:
                    r, c, sim = (z[r != c] for z in (r, c, sim))
                if len(r):
                    ha.push(r, at_b[c], sim)
                    if not diagonal:  # a block with itself holds both ways already
                        hb.push(c, place[: len(a.ids)][r], sim)
        named = ids[order]
        out = []
        for h, own in ((ha, a.ids), (hb, b.ids))[: 1 if same else 2]:
            r, c = np.nonzero(h.sim >= max(least, -1.5))
            out.append(pd.DataFrame({"cid": own[r], "other": named[h.who[r, c]], "sim": h.sim[r, c].astype(np.float32)}))
        return pd.concat(out)

    angle = float(np.arccos(min(1.0, max(-1.0, least))))
    return block_join(classes.select("id", "vec"), dim, angle, work, "cid string, other string, sim float", sample, seed, group_bytes)


def most_similar(
    df: DataFrame,
    uuid: str = "uuid",
    embedding: str = "embedding",
    k: int = 5,
    least: float = -1.0,
    dim: int | None = None,
    sample: int = 20_000,
    seed: int = 7,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row (uuid, other, sim, rank) for each of the ``k`` most similar other vectors, at ``least`` cosine or more.

    Exact: no row or partner is dropped or sampled; only the centres, which group rows into blocks, are fitted on
    ``sample`` rows. Null, empty, all-zero, non-finite vectors and vectors of another length than ``dim`` (None: the
    commonest) take no part. Equal vectors under several ids are joined once, as a class; each class shows its k + 1
    smallest ids, of which every other row can need no more. Ties go to the smaller id. A repeated row counts once; of
    different vectors under one id the one with the smallest first numbers counts. ``group_bytes``: of the vectors that
    one side of a task holds.
    """
    rows, dim = usable_vectors(df, uuid, embedding, dim)
    rows = materialise(rows)
    members = materialise(rows.select("uuid", "key").groupBy("uuid").agg(F.min("key").alias("key")))
    named = members.groupBy("key").agg(F.min("uuid").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = materialise(rows.groupBy("key").agg(F.first("vec").alias("vec")).join(named, "key"))
    near = knn_classes(classes, dim, k, least, sample, seed, group_bytes)

    many = materialise(classes.filter("n > 1").select("key", F.col("id").alias("cid")))  # classes of several ids
    few = many.count() <= SMALL
    inside = members.join(F.broadcast(many), "key").select("uuid", "cid") if few else lookup(members, "key", many).filter("cid is not null").select("uuid", "cid")
    inside = materialise(inside)
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("uuid"))
    shown = inside.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    lists = materialise(shown.groupBy("cid").agg(F.array_sort(F.collect_list("uuid")).alias("all")))  # k + 1 ids at most
    sized = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    theirs = near.join(sized(lists.withColumnRenamed("cid", "other")), "other", "left").select("cid", F.explode(F.coalesce("all", F.array("other"))).alias("other"), "sim", F.lit(1).alias("away"))
    own = lists.select("cid", F.explode("all").alias("other"), F.lit(1.0).cast("float").alias("sim"), F.lit(0).alias("away"))
    order = F.row_number().over(Window.partitionBy("cid").orderBy("away", F.desc("sim"), "other"))
    ranked = own.unionByName(theirs).withColumn("rank", order).filter(F.col("rank") <= k + 1)
    best = ranked.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "sim"))).alias("best"))  # k + 1 entries
    if few and inside.count() <= SMALL:
        out = best.join(F.broadcast(inside), "cid", "left").select(F.coalesce("uuid", "cid").alias("uuid"), "best")
    else:
        best = materialise(best)
        single = best.join(lists.select("cid"), "cid", "left_anti").select(F.col("cid").alias("uuid"), "best")
        out = single.unionByName(lookup(inside, "cid", best.withColumnRenamed("cid", "key")).select("uuid", "best"))
    out = out.withColumn("best", F.slice(F.filter("best", lambda x: x["other"] != F.col("uuid")), 1, k))
    out = out.select("uuid", F.posexplode("best").alias("at", "b"))
    return out.select("uuid", F.col("b.other").alias("other"), F.col("b.sim").alias("sim"), (F.col("at") + 1).alias("rank")).filter(F.col("sim") >= least)


def similar_pairs(df: DataFrame, uuid: str = "uuid", embedding: str = "embedding", k: int = 5, least: float = 0.86) -> DataFrame:
    """Pairs (uuid_a < uuid_b) with a cosine of ``least`` or more in which one is among the ``k`` most similar of the other."""
    near = most_similar(df, uuid, embedding, k, least)
    return near.select(F.least("uuid", "other").alias("uuid_a"), F.greatest("uuid", "other").alias("uuid_b")).distinct()
