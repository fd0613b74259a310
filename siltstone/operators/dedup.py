"""Duplicates: first rows by URL, text or line; MinHash-LSH groups; near vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators.blocks import Side, block_join, block_pairs, coarse_centres, cosines, product, unit
from siltstone.session import Stages, materialise, spread

# ---- exact, in the order of a column: the first row wins

SMALL = 1_000_000  # rows of (order) that are broadcast, at most some tens of MB


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``gone`` (materialised, one column). What goes is usually far less than
    what stays: up to SMALL counted rows are broadcast, so that the texts aren't shuffled; beyond that Spark shuffles."""
    return df.join(F.broadcast(gone) if gone.count() <= SMALL else gone, key, "left_anti")


class FirstByKey:
    """The first row of each key in ``order`` (unique); rows with a null key all stay, rows with a null order go.

    Only digests (MD5, 128 bits) and order values are shuffled, not the keys, which may be whole texts; the first row is
    found by an aggregate that combines before the shuffle, so that a hot key costs one row a partition.

    ``base``: a frame of which ``df`` is some rows, by row filters alone. The result is then taken from it, which leaves
    out evaluating the filters once more."""

    def __init__(self, key: str, order: str, name: str):
        self.key, self.order, self.name = key, order, name

    def digest(self) -> Column:
        return F.coalesce(F.unhex(F.md5(F.col(self.key).cast("binary"))), F.concat(F.lit("null "), F.col(self.order).cast("string")).cast("binary"))

    def __call__(self, df: DataFrame, base: DataFrame | None = None) -> DataFrame:
        return DeduplicationStage([self])(df, base)


def URLDeduplicator(order: str, url_column: str = "url") -> FirstByKey:
    return FirstByKey(url_column, order, "URLDeduplicator")


def DocumentDeduplicator(order: str, input_column: str = "text") -> FirstByKey:
    return FirstByKey(input_column, order, "DocumentDeduplicator")


class ParagraphDeduplicator:
    """Keeps of every line its first occurrence in the corpus, in the order of ``order`` (unique) and of the lines; rows
    without a line left are dropped, null texts and orders too. The empty line is a line like others. Lines are compared by
    their MD5; the shuffle carries digests and places, not lines."""

    def __init__(self, order: str, input_column: str = "text"):
        self.order, self.input_column, self.name = order, input_column, "ParagraphDeduplicator"

    def places(self, df: DataFrame) -> DataFrame:
        """(order, _places): the sorted places, from 0, of the lines of each row that stay."""
        digests = F.transform(F.split(F.col(self.input_column), "\n", -1), lambda x: F.unhex(F.md5(x.cast("binary"))))
        lines = df.select(F.col(self.order).alias("_o"), F.posexplode(digests).alias("_p", "_d")).filter("_o is not null")
        firsts = lines.groupBy("_d").agg(F.min(F.struct("_o", "_p")).alias("_f")).select(F.col("_f._o").alias(self.order), "_f._p")
        return firsts.groupBy(self.order).agg(F.array_sort(F.collect_list("_p")).alias("_places"))  # a row's own lines

    def edit(self, df: DataFrame, places: DataFrame) -> DataFrame:
        """``df`` with the lines at their places only. One pass over the lines: a mask is laid beside them."""
        before = F.concat(F.array(F.lit(-1)), F.slice("_places", 1, F.size("_places") - 1))
        mask = F.flatten(F.zip_with("_places", before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True)))))
        both = F.arrays_zip(F.split(F.col(self.input_column), "\n", -1).alias("line"), mask.alias("stays"))
        kept = F.transform(F.filter(both, lambda x: F.coalesce(x["stays"], F.lit(False))), lambda x: x["line"])
        return df.join(places, self.order).withColumn(self.input_column, F.array_join(kept, "\n")).select(df.columns)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.edit(df, self.places(df))


class DeduplicationStage:
    """Deduplicators one after the other: each sees the rows that the ones before it have left.

    The stages are decided on narrow frames: neighbouring FirstByKey stages (of one order column) read the digests of all
    their keys in one pass and hand on the surviving rows' digests, not a join with the texts; a ParagraphDeduplicator reads
    line digests in one pass. Each decision is materialised, so that the plan of the result, and every pass, scans the input
    once however many stages there are. Any other callable is applied as it is."""

    def __init__(self, deduplicators: Sequence, name: str = "DeduplicationStage"):
        self.deduplicators, self.name = list(deduplicators), name

    def __call__(self, df: DataFrame, base: DataFrame | None = None) -> DataFrame:
        todo, base = list(self.deduplicators), df if base is None else base
        while todo:
            first = todo[0]
            if isinstance(first, FirstByKey):
                run = [first]
                while len(run) < len(todo) and isinstance(todo[len(run)], FirstByKey) and todo[len(run)].order == first.order:
                    run.append(todo[len(run)])
                del todo[: len(run)]
                df, base = self._firsts(run, df, base)
            elif isinstance(first, ParagraphDeduplicator):
                del todo[0]
                df = base = first.edit(base, materialise(first.places(df)))
            else:
                del todo[0]
                df = base = first(df)
        return df

    @staticmethod
    def _firsts(run: list[FirstByKey], df: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        order = run[0].order
        names = [f"_d{i}" for i in range(len(run))]
        rows = materialise(df.select(order, *(d.digest().alias(n) for d, n in zip(run, names))).filter(F.col(order).isNotNull()))
        left = rows
        for i, n in enumerate(names):
            rest = names[i + 1 :]
            if rest:
                left = left.groupBy(n).agg(F.min(F.struct(order, *rest)).alias("_f")).select(f"_f.{order}", *(f"_f.{r}" for r in rest))
            else:
                left = left.groupBy(n).agg(F.min(order).alias(order)).select(order)
        if base is not df:  # rows that filters have taken out of ``base`` are no part of it: what stays is asked for
            stay = materialise(left)
            out = base.join(F.broadcast(stay) if stay.count() <= SMALL else stay, order, "left_semi")
        else:
            out = without(df.filter(F.col(order).isNotNull()), materialise(rows.select(order).join(left, order, "left_anti")), order)
        return out, out


# ---- connected components by star contraction


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of ``edges`` (u, v); root: the least node of its component. Rows with a null end say
    nothing; self links and repeats change nothing.

    Two steps alternate until nothing moves: all larger neighbours of a node point to its least neighbour, then all smaller
    ones do. Each step joins with a minimum by key instead of collecting neighbours, so that hubs don't pile up. The number
    of rounds grows with the logarithm of the longest path; there is no last round but the one that changes nothing, and
    every round but that one lessens the sum of all links' ends, so that there is one."""
    e = edges.filter("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialise(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select("u", "v", "m")
        e = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = materialise(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots).distinct()


# ---- MinHash-LSH

PRIME = (1 << 31) - 1
_TOKEN = regex.compile(X.TOKEN)


def hash_family(num_hashes: int, seed: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in zip(rng.integers(1, PRIME, num_hashes), rng.integers(0, PRIME, num_hashes))]


def shingles(text: str, n: int) -> set[str]:
    """The word n-grams of the tokens; a shorter text is one shingle, a text without tokens has none."""
    t = _TOKEN.findall(text.lower())
    return {" ".join(t[i : i + n]) for i in range(len(t) - n + 1)} if len(t) >= n else {" ".join(t)} if t else set()


def _minima(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of a * h + b mod p for each hash of the family; h: 32-bit hashes of a text's shingles."""
    p = np.uint64(PRIME)
    v, best = h.astype(np.uint64) % p, np.full(len(a), PRIME, np.uint64)
    for i in range(0, len(v), 4096):  # long texts in parts, so that memory has a bound
        best = np.minimum(best, ((a * v[None, i : i + 4096] + b) % p).min(1))
    return best.astype(np.int64)


def _columns(num_hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    family = hash_family(num_hashes, seed)
    return tuple(np.array([x[i] for x in family], np.uint64)[:, None] for i in (0, 1))


def minhash_signature(c: Column, num_hashes: int = 112, ngram: int = 5, seed: int = 42) -> Column:
    """array<bigint> of minima of a * h + b mod p over the shingles, h: the first 32 bits of the shingle's MD5, modulo p,
    which is the same number in every engine. Null for null texts and texts without tokens."""

    @F.pandas_udf("array<bigint>")
    def minima(text: pd.Series) -> pd.Series:
        a, b = _columns(num_hashes, seed)

        def one(t: str | None):
            s = shingles(t, ngram) if t else None
            if not s:
                return None
            return _minima(np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:4] for x in s), ">u4"), a, b)

        return text.map(one, na_action=None)

    return minima.asNondeterministic()(c)  # else a filter on the signature computes it twice


def shingle_keys(c: Column, ngram: int = 5) -> Column:
    """array<bigint>: the first 64 bits of the MD5 of each shingle, sorted. Null where a text has no shingle."""

    @F.pandas_udf("array<bigint>")
    def keys(text: pd.Series) -> pd.Series:
        def one(t: str | None):
            s = shingles(t, ngram) if t else None
            return np.unique(np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8] for x in s), ">i8").astype(np.int64)) if s else None

        return text.map(one, na_action=None)

    return keys.asNondeterministic()(c)


def _signature_of_keys(c: Column, num_hashes: int, seed: int) -> Column:
    """The signature that ``minhash_signature`` gives for the text of these keys."""

    @F.pandas_udf("array<bigint>")
    def minima(keys: pd.Series) -> pd.Series:
        a, b = _columns(num_hashes, seed)
        return keys.map(lambda k: _minima(np.asarray(k, np.int64).view(np.uint64) >> np.uint64(32), a, b))

    return minima(c)


def lsh_edges(signatures: DataFrame, key: str, b: int, r: int) -> DataFrame:
    """Star edges (u, v): in every bucket of a band each key is linked to the least, however large the bucket."""
    parts = F.array(*(F.md5(F.array_join(F.slice("sig", i * r + 1, r), ",").cast("binary")) for i in range(b)))
    # read twice below; made once, as digests
    bands = materialise(signatures.select(F.col(key).alias("u"), parts.alias("parts"))).select("u", F.posexplode("parts").alias("band", "bucket"))
    least = bands.groupBy("band", "bucket").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "bucket", "v")
    return bands.join(least, ["band", "bucket"]).filter("u <> v").select("u", "v").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """Those (u, v) of ``pairs`` whose shingles have a Jaccard similarity of ``threshold`` or more. Only the shingles of rows that
    are in a pair are moved; up to SMALL counted pairs pick them out where they are."""
    pairs = materialise(pairs)
    if pairs.count() <= SMALL:
        ids = pairs.select(F.explode(F.array("u", "v")).alias(key)).distinct()
        sets = sets.join(F.broadcast(ids), key, "left_semi")
    both = pairs.join(sets.select(F.col(key).alias("u"), F.col("keys").alias("a")), "u").join(sets.select(F.col(key).alias("v"), F.col("keys").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.filter(same >= threshold * (F.size("a") + F.size("b") - same)).select("u", "v")


def fuzzy_groups(df: DataFrame, key: str = "doc_id", text: str = "paragraph_text", num_hashes: int = 112, ngram: int = 5, seed: int = 42, b: int = 28, r: int = 4, threshold: float = 0.8, folder: str | None = None) -> DataFrame:
    """(key, root): rows that are to go, with the row that stays for them: the least key of their group.

    A group is linked by pairs whose shingles have a Jaccard similarity of ``threshold`` or more. Candidates are the keys
    that share a bucket of a band: 28 bands of 4 rows miss a pair at 0.8 with probability (1 - 0.8^4)^28 = 4e-7. Each bucket's
    keys are compared with its least first, then with those of its keys that aren't in their group yet, so that a hot
    bucket of one group costs no square. Equal shingles are one row before banding. Null and token-less texts have no
    shingles and stay. ``folder``: keep the stages there and go on from those that an earlier run has finished."""
    if b * r != num_hashes:
        raise ValueError("b * r must be num_hashes")
    stage = Stages(df.sparkSession, folder)
    rows = stage("shingles", spread(df.select(key, text)).select(F.col(key), shingle_keys(F.col(text), ngram).alias("keys")).filter("keys is not null"))
    digests = rows.select(key, F.md5(F.array_join("keys", ",").cast("binary")).alias("_d"))
    exact = stage("exact", digests.groupBy("_d").agg(F.min(key).alias("_first")))
    same = stage("same", digests.join(exact, "_d").filter(F.col(key) != F.col("_first")).select(F.col(key).alias("u"), F.col("_first").alias("v")))
    sets = without(rows, same.select(F.col("u").alias(key)), key)  # one row of equal ones
    sigs = sets.select(F.col(key).alias("u"), _signature_of_keys(F.col("keys"), num_hashes, seed).alias("sig"))
    bands = sigs.select("u", F.explode(F.array(*(F.xxhash64(F.lit(i), F.slice("sig", i * r + 1, r)) for i in range(b)))).alias("bucket"))
    bands = stage("bands", bands)  # read twice
    full = stage("full", bands.groupBy("bucket").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "v"))
    held = stage("buckets", bands.join(F.broadcast(full) if full.count() <= SMALL else full, "bucket"))
    stars = stage("stars", _similar(held.filter("u <> v").select("u", "v").distinct(), sets, key, threshold))
    grouped = held.select("u", "bucket").join(components(stars).withColumnRenamed("node", "u"), "u", "left").select("bucket", "u", F.coalesce("root", "u").alias("root"))
    grouped = stage("grouped", grouped)
    others = grouped.select("bucket", F.col("u").alias("v"), F.col("root").alias("other"))
    rest = _similar(grouped.join(others, "bucket").filter("root < other").select("u", "v").distinct(), sets, key, threshold)
    links = stage("links", stars.unionByName(rest).unionByName(same))
    found = stage("groups", components(links))
    return found.filter("node <> root").select(F.col("node").alias(key), "root")


def fuzzy_dedupe(df: DataFrame, key: str = "doc_id", text: str = "paragraph_text", **options) -> DataFrame:
    """``df`` without the rows whose text is nearly that of a row with a smaller key."""
    return df.join(fuzzy_groups(df, key, text, **options).select(key), key, "left_anti")


# ---- vectors


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Parents (each the least of its tree) after linking u with v."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
    return parent


class SemanticDedup:
    """Drops vectors with a cosine of ``threshold`` or more to one that stays.

    Exact: a block join compares all groups of at most ``tile`` vectors whose clusters can hold a pair at the threshold. Pairs
    of all tasks form one graph; the least id of each component stays. ``k``: centres that the vectors are placed by (None: by
    their number), which only the cost depends on. Null, empty, all-zero vectors, those with null or NaN numbers and those of
    another length than the commonest take no part and stay."""

    def __init__(self, k: int | None = None, threshold: float = 0.95, tile: int = 200_000, rounds: int = 25, sample: int = 20_000, seed: int = 1, id_column: str = "uuid", embedding: str = "embedding"):
        self.k, self.threshold, self.tile, self.rounds, self.sample, self.seed = k, threshold, tile, rounds, sample, seed
        self.id_column, self.embedding = id_column, embedding

    def _usable(self, df: DataFrame) -> DataFrame:
        e = F.col(self.embedding).cast("array<float>")
        rows = df.select(F.col(self.id_column).alias("id"), e.alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0))
        return rows.groupBy("id").agg(F.min("vec").alias("vec"))

    def train(self, rows: DataFrame) -> np.ndarray:
        """Unit centres by spherical k-means over at most ``sample`` of the rows' vectors."""
        drawn = rows.select("vec").sample(min(1.0, 1.2 * self.sample / max(1, rows.count())), self.seed).limit(self.sample).toPandas()
        if not len(drawn):
            return np.zeros((0, 1), np.float32)
        size = drawn["vec"].map(len).mode()[0]
        x = unit(np.stack([v for v in drawn["vec"] if len(v) == size]))
        return coarse_centres(x, min(self.k or 100, len(x)), self.rounds, self.seed).astype(np.float32)

    def assign(self, rows: DataFrame, centres: np.ndarray, spill: float = 1.0) -> DataFrame:
        """(id, vec, part, second): for an inverted file, the nearest centre and a second one that makes up for its error: the
        one with the least |r'|^2 + spill * (r' along r)^2, where r and r' are what the two centres leave of the vector."""
        shared = rows.sparkSession.sparkContext.broadcast(centres)  # k vectors

        @F.pandas_udf("array<int>")
        def parts(vec: pd.Series) -> pd.Series:
            if not len(vec):
                return pd.Series([], dtype=object)
            c = shared.value
            x = unit(np.stack(vec.to_numpy()))
            cos = x @ c.T
            first = cos.argmax(1)
            left = x - c[first]
            left /= np.maximum(np.linalg.norm(left, axis=1, keepdims=True), 1e-12)
            along = np.einsum("ij,ij->i", x, left)[:, None] - left @ c.T
            loss = 2 - 2 * cos + spill * along**2
            loss[np.arange(len(x)), first] = np.inf
            second = loss.argmin(1) if len(c) > 1 else first
            return pd.Series(np.stack([first, second], 1).tolist())

        p = parts("vec")
        return rows.filter(F.size("vec") == centres.shape[1]).select("id", "vec", p.alias("p")).select("id", "vec", F.col("p")[0].alias("part"), F.col("p")[1].alias("second"))

    def pairs(self, df: DataFrame) -> DataFrame:
        """(u, v), u > v: of every task of the block join a spanning forest of the pairs at or above the threshold, never all
        pairs of a dense group. A vector travels once for every group of ``tile`` rows, however many rows its part has."""
        rows, kind, threshold = self._usable(df), df.schema[self.id_column].dataType.simpleString(), self.threshold
        size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if size is None:
            return rows.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
        dim = size["d"]

        def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "vec"])

        vectors = materialise(rows.filter(F.size("vec") == dim).select("id", "vec").mapInArrow(as_bytes, f"id {kind}, vec binary"))

        def work(a: Side, b: Side, same: bool, near) -> pd.DataFrame:
            ids = a.ids if same else np.concatenate([a.ids, b.ids])
            ids, at = np.unique(ids, return_inverse=True)
            beside = 0 if same else len(a.ids)
            parent = np.arange(len(ids))
            for x, y, _ in block_pairs(a, b, same, near):
                for s in range(x.start, x.stop, 512):
                    cut = slice(s, min(s + 512, x.stop))
                    cos, e = product(a, cut, b, y)
                    r, c = np.nonzero(cos >= (threshold - e)[:, None])
                    if not len(r):
                        continue
                    sure = cos[r, c] >= threshold + e[r]
                    r, c = r + s, c + y.start
                    parent = _joined(parent, at[r[sure]], at[c[sure] + beside])
                    r, c = r[~sure], c[~sure]
                    open_ = parent[at[r]] != parent[at[c + beside]]
                    r, c = r[open_], c[open_]
                    true = cosines(a, r, b, c) >= threshold
                    parent = _joined(parent, at[r[true]], at[c[true] + beside])
            moved = np.flatnonzero(parent != np.arange(len(ids)))
            return pd.DataFrame({"u": ids[moved], "v": ids[parent[moved]]})

        angle = float(np.arccos(np.clip(threshold, -1, 1)))
        return block_join(vectors, dim, angle, work, f"u {kind}, v {kind}", self.sample, self.seed, self.tile * (3 * dim + 8), self.k).distinct()

    def dropped(self, df: DataFrame) -> DataFrame:
        return components(self.pairs(df)).filter("node <> root").select(F.col("node").alias(self.id_column))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.join(self.dropped(df), self.id_column, "left_anti")

