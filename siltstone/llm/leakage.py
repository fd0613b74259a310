"""Problem 8: evaluation texts leaking into training text.

Word n-grams of the test items are the seeds. For verbatim copies every window of ``run`` words of an item is covered by
its n-gram that fewest documents hold, so that none can be missed while phrases shared by everyone start few alignments.
For edited copies every n-gram is a seed, however many documents hold it: a copy edited in one way may lack just the
n-grams that are rare because few copies are edited in another. A document that holds a seed is aligned with the seed's
item by Smith-Waterman over words, which scores edited copies too; the longest verbatim run comes from the same pass.
All passes are maps over the documents: only n-gram counts are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialise, spread

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the NFKC form in lower case."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower()))


class Items:
    """Word numbers, n-gram keys and their places of a bounded slice of the test items."""

    def __init__(self, rows: list[tuple[int, str]], n: int, run: int):
        self.n, self.run = n, run
        self.ids = [i for i, _ in rows]
        texts = [words(t) for _, t in rows]
        self.vocab = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.texts = [np.array([self.vocab[w] for w in t], np.int64) for t in texts]
        self.grams = [self.keys(t) for t in self.texts]
        self.all = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))

    def keys(self, t: np.ndarray) -> np.ndarray:
        """A 64-bit key for each n-gram of word numbers; 0 where a word is in no item."""
        if len(t) < self.n:
            return np.zeros(0, np.uint64)
        key, known = np.zeros(len(t) - self.n + 1, np.uint64), np.ones(len(t) - self.n + 1, bool)
        for i in range(self.n):
            part = t[i : len(key) + i]
            key = (key + part.astype(np.uint64) + np.uint64(1)) * _BASE
            key ^= key >> np.uint64(29)
            known &= part >= 0
        return np.where(known, key | np.uint64(1), np.uint64(0))

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are those of an n-gram of an item."""
        if not len(keys) or not len(self.all):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.all, keys), len(self.all) - 1)
        return (self.all[at] == keys) & (keys != 0)

    def may_run(self, t: np.ndarray) -> bool:
        """Whether as many of the text's n-grams in a row as a run of ``run`` words has are all in items."""
        known, need = self.holds(self.keys(t)), max(1, self.run - self.n + 1)
        if known.sum() < need:
            return False
        gaps = np.flatnonzero(np.concatenate([[True], ~known, [True]]))
        return bool((np.diff(gaps) > need).any())

    def seeds(self, df_of: dict[int, int], edited: bool = True) -> dict[int, list[tuple[int, int]]]:
        """Key -> (item, place) of the n-grams at which alignments start. With ``edited``: every n-gram that documents hold.
        Else, for verbatim copies only: the rarest of every window of ``run`` words (of the whole item, if shorter) all of
        whose n-grams are held, as a document can hold no other window."""
        out: dict[int, set[tuple[int, int]]] = {}
        for i, g in enumerate(self.grams):
            if not len(g):
                continue
            count = np.array([df_of.get(int(k), 0) for k in g])
            if edited:
                places = np.flatnonzero(count).tolist()
            else:
                span = max(1, min(len(g), self.run - self.n + 1))
                places = [s + int(count[s : s + span].argmin()) for s in range(len(g) - span + 1) if count[s : s + span].all()]
            for at in places:
                out.setdefault(int(g[at]), set()).add((i, at))
        return {k: sorted(v) for k, v in out.items()}


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman over word numbers: the best local score, and the longest verbatim run. b: the shorter text."""
    best = longest = 0
    h, runs = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    ramp = np.arange(len(a) + 1) * gap
    for w in b:
        same = a == w
        diag = h[:-1] + np.where(same, match, miss)
        new = np.maximum(0, np.concatenate([[0], np.maximum(diag, h[1:] + gap)]))
        new = np.maximum(new, np.maximum.accumulate(new - ramp) + ramp)
        runs = np.concatenate([[0], np.where(same, runs[:-1] + 1, 0)])
        h = new
        best, longest = max(best, int(h.max())), max(longest, int(runs.max()))
    return best, longest


def _scan(items: Items, seeds: dict[int, list[tuple[int, int]]], t: np.ndarray, share: float = 0.0) -> Iterator[tuple[int, int, int, int]]:
    """(item number, score, longest run, length of the item) of every item that has a seed in the text. Places that have too
    few of the item's words for ``share`` of its own score and for a verbatim run aren't aligned."""
    keys = items.keys(t)
    hits: dict[int, list[int]] = {}
    for at in np.flatnonzero(keys):
        for item, _ in seeds.get(int(keys[at]), ()):
            hits.setdefault(item, []).append(int(at))
    for item, at in sorted(hits.items()):
        b, best, longest, done = items.texts[item], 0, 0, -1
        reach = 2 * len(b) + items.n
        least = min(share * len(b), items.run)  # equal words, each 2 of the score, without which there is neither
        uses = np.bincount(b)
        for p in at:  # places near each other share one window; together the windows hold every seed
            if p <= done:
                continue
            last = max(q for q in at if q - p <= reach)
            done, near = last, t[max(0, p - reach) : last + reach]
            if least > 0 and np.minimum(np.bincount(near[(near >= 0) & (near < len(uses))], minlength=len(uses)), uses).sum() < least:
                continue
            score, run = align(near, b)
            best, longest = max(best, score), max(longest, run)
        if best:
            yield item, best, longest, len(b)


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    n: int = 5,
    run: int = 12,
    slice_words: int = 2_000_000,
    edited: bool = True,
    share: float = 0.0,
) -> DataFrame:
    """(doc_id, item_id, score, longest_run, item_words) for each document that shares an n-gram with an item.

    score: Smith-Waterman over words, 2 a match, -1 a change or gap; longest_run: most consecutive equal words.
    ``edited`` False: only rows with a verbatim run of ``run`` words are there for sure, and the texts are read once instead
    of twice. ``share``: rows that reach
    neither this share of the item's own score nor such a run may be left out, which saves most alignments.
    Items are worked through in slices of at most ``slice_words`` words, so that what a worker holds has a bound
    however many items there are; no item is dropped. Null ids and null, blank or wordless texts give no rows;
    repeated rows of a document or item give one. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    d = spread(d)
    out = None
    for part in _slices(items, item_id, item_text, slice_words):
        held = spark.sparkContext.broadcast(Items(part, n, run))  # at most slice_words words

        def count(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            items, seen = held.value, Counter()
            for pdf in batches:
                for w in pdf["words"] if "words" in pdf else map(items.numbers, pdf["text"]):
                    k = items.keys(np.asarray(w, np.int64))
                    seen.update(set(k[items.holds(k)].tolist()))
            yield pd.DataFrame({"key": np.fromiter(seen.keys(), np.uint64, len(seen)).view(np.int64), "n": np.fromiter(seen.values(), np.int64, len(seen))})

        def runs(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            items = held.value
            for pdf in batches:
                words = [items.numbers(t) for t in pdf["text"]]
                kept = [i for i, w in enumerate(words) if items.may_run(w)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[kept].to_numpy(), "words": pd.Series([words[i].astype(np.int32) for i in kept], dtype=object)})

        # verbatim: the texts are read once, and only documents that may hold a run go on, as word numbers
        read = d if edited else materialise(d.mapInPandas(runs, "doc_id long, words array<int>"))
        held_in = read.mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # keys of the slice only
        seeds = spark.sparkContext.broadcast(held.value.seeds({r["key"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in held_in}, edited))

        def find(batches: Iterator[pd.DataFrame], held=held, seeds=seeds) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                numbers = pdf["words"] if "words" in pdf else map(held.value.numbers, pdf["text"])
                rows = [(i, held.value.ids[k], s, r, w) for i, t in zip(pdf["doc_id"], numbers) for k, s, r, w in _scan(held.value, seeds.value, np.asarray(t, np.int64), share)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "longest_run", "item_words"])

        found = read.mapInPandas(find, "doc_id long, item_id long, score int, longest_run int, item_words int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score int, longest_run int, item_words int")
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "longest_run", "item_words")))


def _slices(items: DataFrame, item_id: str, item_text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of (id, text) of at most ``most`` words each (or one item), fetched one partition at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.distinct().toLocalIterator():
        w = r["t"].count(" ") + 1
        if part and size + w > most:
            yield part
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += w
    if part:
        yield part


def leaked_documents(docs: DataFrame, items: DataFrame, run: int = 12, **names) -> DataFrame:
    """(doc_id, item_id) where the document holds at least ``run`` consecutive words of the item."""
    return leaked_passages(docs, items, run=run, edited=False, **names).filter(F.col("longest_run") >= run).select("doc_id", "item_id")


def leaked_items(docs: DataFrame, items: DataFrame, share: float = 0.6, run: int = 12, **names) -> DataFrame:
    """(item_id, verbatim_docs, edited_docs): how often each item leaked. Edited: no verbatim run of ``run`` words, but an
    alignment that scores at least ``share`` of the item's own score."""
    hits = leaked_passages(docs, items, run=run, share=share, **names)
    whole = F.col("longest_run") >= run
    edited = ~whole & (F.col("score") >= share * 2 * F.col("item_words"))
    return hits.groupBy("item_id").agg(F.count_if(whole).alias("verbatim_docs"), F.count_if(edited).alias("edited_docs")).filter("verbatim_docs + edited_docs > 0")
