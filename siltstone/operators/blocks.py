"""A join of unit vectors with themselves, block by block.

Vectors are placed at the nearest of some centres and cut into groups of bounded bytes, whole clusters side by side. Every
two groups (and each with itself) are one task, so that a vector travels once for every group, not for every block; pairs of
groups, and inside a task pairs of clusters, whose centres are farther apart than their radii and the angle sought allow
are left out, which loses nothing. What travels is an int8 code of each vector, its scale and a 16-bit remainder, from
which the numbers come back to within 2e-8 each. The product of two codes is exact: whole numbers up to 127^2 * dim, below
2^24 up to 1040 dimensions, multiplied as float32, which is where numpy has a fast product; it gives every cosine within a
known error, and only what that error leaves open is computed again from the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 48 << 20  # of codes and remainders of a group; a task holds two, and the codes once more as float32
ROWS = 2_048  # of a cluster that are one block of a product
MOST_CENTRES = 2_048
REMAINDER = 65_534.0


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    v = v.astype(np.float64)
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-300)  # so that squares neither vanish nor overflow
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def coarse_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means over a sample of unit vectors; only the cost of the join depends on it, never its result."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    centres = sample[rng.choice(len(sample), 1)]
    best = sample @ centres[0]
    while len(centres) < k:  # far points first, so that small groups get a centre too
        p = np.maximum(1 - best, 0) ** 2 + 1e-9
        nxt = sample[rng.choice(len(sample), max(1, k // 16), p=p / p.sum())]
        centres = np.concatenate([centres, nxt])[:k]
        best = np.maximum(best, (sample @ nxt.T).max(1))
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    start, left = 0, np.ones(len(centres), bool)
    path = []
    while left.any():  # neighbours side by side, so that groups are made of near clusters
        path.append(start)
        left[start] = False
        if left.any():
            start = int(np.where(left, centres @ centres[start], -2).argmax())
    return centres[path]


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, int16 remainders, scales) of unit vectors: scale * (code + remainder / REMAINDER)."""
    scale = np.maximum(np.abs(v).max(1), 1e-30) / 127
    exact = v / scale[:, None]
    codes = np.rint(exact)
    rest = np.clip(np.rint((exact - codes) * REMAINDER), -32_767, 32_767)
    return codes.astype(np.int8), rest.astype(np.int16), scale


class Side:
    """The vectors of one group in a task, sorted by cluster: codes, remainders, scales, and how far codes can be off."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        pdf = pdf.sort_values(["part"], kind="stable")
        self.ids = np.concatenate([np.asarray(x, object) for x in pdf["ids"]])
        self.codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(-1, dim)
        self.rest = np.frombuffer(b"".join(pdf["rest"]), np.int16).reshape(-1, dim)
        self.scale = np.frombuffer(b"".join(pdf["scale"]), np.float64)
        self.number = self.codes.astype(np.float32)
        off = self.rest.astype(np.float32) / np.float32(REMAINDER)
        # the length of what the codes leave out, with more than what rounding adds
        self.off = (np.sqrt(np.einsum("ij,ij->i", off, off)) * self.scale + 1e-6).astype(np.float32)
        sizes = np.array([len(x) for x in pdf["ids"]])
        part = np.repeat(pdf["part"].to_numpy(), sizes)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        self.blocks = [(int(part[a]), s, min(s + ROWS, b)) for a, b in zip(cut, cut[1:]) for s in range(a, b, ROWS)]

    def vectors(self, at: np.ndarray) -> np.ndarray:
        return (self.codes[at] + self.rest[at] / REMAINDER) * self.scale[at][:, None]


def product(a: Side, x: slice, b: Side, y: slice) -> tuple[np.ndarray, np.ndarray]:
    """(cosines of the codes of two blocks, how far each row of them can be off): at most e_a + (1 + e_a) e_b."""
    near = a.number[x] @ b.number[y].T
    near *= a.scale[x].astype(np.float32)[:, None]
    near *= b.scale[y].astype(np.float32)[None]
    e = a.off[x] + (1 + a.off[x]) * b.off[y].max() + np.float32(1e-5)
    return near, e


def cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """The cosines of the pairs (i, j), from the vectors' numbers."""
    out = np.empty(len(i))
    for s in range(0, len(i), 100_000):
        c = slice(s, s + 100_000)
        out[c] = np.einsum("ij,ij->i", a.vectors(i[c]), b.vectors(j[c]))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


Work = Callable[[Side, Side, bool, Callable[[int, int], bool]], pd.DataFrame]


def block_join(rows: DataFrame, dim: int, angle: float, work: Work, schema: str, sample: int = 20_000, seed: int = 7, group_bytes: int = GROUP_BYTES, centres: int | None = None) -> DataFrame:
    """``work`` over all pairs of groups of ``rows`` (id, vec: binary of ``dim`` float32) that can hold vectors at most ``angle``
    apart. ``rows`` is read three times, so it should be materialised; ids are distinct.

    work(a, b, same, near): two sides, whether they are one and the same, and a test of two clusters; what it gives for
    all tasks is the result. It must treat a pair of different sides both ways, as no other task sees it."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.count()
    drawn = rows.select("vec").sample(min(1.0, 1.2 * sample / max(total, 1)), seed).limit(sample).toPandas() if total > sample else rows.select("vec").toPandas()
    if not len(drawn):
        drawn = rows.select("vec").limit(1).toPandas()
    if not total or not len(drawn):
        return spark.createDataFrame([], schema)
    fitted = coarse_centres(unit(np.frombuffer(b"".join(map(bytes, drawn["vec"])), np.float32).reshape(-1, dim)), min(MOST_CENTRES, centres or -(-total // ROWS)), seed=seed)
    shared = spark.sparkContext.broadcast(fitted)  # at most MOST_CENTRES vectors

    def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, cos = np.empty(len(v), np.int64), np.empty(len(v))
        for s in range(0, len(v), 4096):
            c = v[s : s + 4096] @ shared.value.T
            part[s : s + 4096] = c.argmax(1)
            cos[s : s + 4096] = c.max(1)
        return part, np.arccos(np.clip(cos, -1, 1))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value))
        for batch in batches:
            if batch.num_rows:
                part, off = nearest(unit(_matrix(batch.column(0), dim)))
                n += np.bincount(part, minlength=len(n))
                np.maximum.at(far, part, off)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(far[at])], ["part", "n", "radius"])

    found = rows.select("vec").mapInArrow(survey, "part long, n long, radius double").groupBy("part").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("part").toPandas()  # a row a centre
    part, n, radius = (found[c].to_numpy() for c in ("part", "n", "radius"))
    # two vectors are at least this far apart; 0.002 covers the rounding of arccos near 1
    gap = np.arccos(np.clip(fitted[part] @ fitted[part].T, -1, 1)) - radius[:, None] - radius[None] - 0.002
    ok = np.zeros((len(fitted), len(fitted)), bool)
    ok[np.ix_(part, part)] = gap <= angle
    cores = spark.sparkContext.defaultParallelism
    least = int(np.ceil((np.sqrt(1 + 12 * cores) - 1) / 2))  # groups whose pairs are half as many again as the cores
    groups = int(max(-(-total * (3 * dim + 8) // group_bytes), min(least, -(-total // ROWS))))
    size = -(-total // groups)
    start = np.r_[0, n.cumsum()[:-1]]
    first, last = start // size, (start + n - 1) // size
    table = np.zeros((len(fitted), 3), np.int64)  # of each centre its first group, how many, where in the first it begins
    table[part] = np.stack([first, start, n], 1)
    meets = np.zeros((groups, groups), bool)
    for k in range(len(part)):
        for m in np.flatnonzero(ok[part[k], part]):
            meets[first[k] : last[k] + 1, first[m] : last[m] + 1] = True
    pairs = np.argwhere(np.triu(meets | meets.T))
    ways = spark.sparkContext.broadcast((ok, table, size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, where, step = ways.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(_matrix(batch.column(1), dim))
            p, _ = nearest(v)
            # a cluster wider than a group is spread over its groups, by a hash of the id, so that a task run again does the same
            share = pd.util.hash_array(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64) / 2.0**64
            g = (where[p, 1] + np.minimum((share * where[p, 2]).astype(np.int64), where[p, 2] - 1)) // step
            codes, rest, scale = quantise(v)
            order = np.lexsort((p, g))
            cut = np.flatnonzero(np.r_[True, (np.diff(p[order]) != 0) | (np.diff(g[order]) != 0), True])
            out = [(int(g[order[a]]), int(p[order[a]]), batch.column(0).take(pa.array(order[a:b])).to_pylist(), codes[order[a:b]].tobytes(), rest[order[a:b]].tobytes(), scale[order[a:b]].tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(batch.column(0).type), pa.binary(), pa.binary(), pa.binary()))], ["g", "part", "ids", "codes", "rest", "scale"])

    packed = rows.select("id", "vec").mapInArrow(pack, f"g long, part long, ids array<{kind}>, codes binary, rest binary, scale binary")
    both = np.concatenate([np.c_[pairs[:, :1], pairs], np.c_[pairs[:, 1:], pairs][pairs[:, 0] != pairs[:, 1]]])
    tasks = spark.createDataFrame(pd.DataFrame(both, columns=["g", "i", "j"]))
    sent = packed.join(F.broadcast(tasks) if len(both) <= 1_000_000 else tasks, "g")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = Side(pdf[pdf["g"] == i], dim) if (pdf["g"] == i).any() else None
        b = a if i == j else Side(pdf[pdf["g"] == j], dim) if (pdf["g"] == j).any() else None
        if a is None or b is None:
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})
        return work(a, b, i == j, lambda x, y: bool(ways.value[0][x, y]))

    # more partitions than tasks, so that few tasks share one
    return sent.repartition(4 * len(pairs), "i", "j").groupBy("i", "j").applyInPandas(run, schema)


def block_pairs(a: Side, b: Side, same: bool, near: Callable[[int, int], bool]) -> Iterator[tuple[slice, slice, bool]]:
    """(rows of a, rows of b, whether they are the same block) of the blocks that can hold near vectors, each two once."""
    for x, (p, s, e) in enumerate(a.blocks):
        for y, (q, t, f) in enumerate(b.blocks):
            if (not same or y >= x) and near(p, q):
                yield slice(s, e), slice(t, f), same and x == y
