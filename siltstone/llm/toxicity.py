"""Problem 6: abusive, hateful or sexual content.

A factorization machine over the hashed terms of a sentence: besides a weight for every term it learns a vector, and
the products of the vectors weigh pairs of terms, such as an insult with a word of report or with a harmless object. A
text scores as its worst sentence does, and is trained that way: of a text labelled abusive the worst sentence must
score high, of the others every sentence must score low. Common disguises (foreign look-alike letters, stretched,
split or masked words) are undone first.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import spread

BITS = 18
FEW = 20  # labelled texts of a kind below which nothing can be learned from them
LONGEST = 48  # terms of a sentence that are read together; a longer one is cut into several

# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("авекмнорстухіјѕԁԛԝɡοαερτυνικ", "abekmhopctyxijsdqwgoaeptuvik")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_INVISIBLE = re.compile(r"[­​-‏⁠-⁤﻿͏]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[\r\n]+")
_PART = re.compile(r"\?[^\W\d_]\d+[^\W\d_]?|[^\W_]+|[\"“”«»„]|(?<!\w)['’‘]|['’](?!\w)")
_QUOTES = frozenset("\"'“”«»„’‘")
_ALIKE, _LATIN = re.compile("[Ͱ-ӿ]"), re.compile("[a-z]")
_LEET_INSIDE, _MASK_SIGN = re.compile(r"[a-z][0-9@$!€]+[a-z]"), re.compile(r"[*#_·•]|[-.]{2}")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_LEETED = re.compile(r"(?<!\w)(?=[\w@$!€]*[a-z][0-9@$!€]+[a-z])[a-z][\w@$!€]*(?!\w)")
_SPLIT = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){2,}[^\W\d_](?!\w)")
_MASK = re.compile(r"(?<!\w)([^\W\d_]+)[*#_·•]{1,}([^\W\d_]*)(?!\w)|(?<!\w)([^\W\d_])[-.]{2,}([^\W\d_])(?!\w)")


def undisguise(text: str) -> str:
    """The text in lower case without invisible letters, look-alikes in Latin words, stretched and split words."""
    plain = text.isascii()
    t = text if plain else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    t = _SPLIT.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), t)
    low = t.lower()
    if not plain and _ALIKE.search(low) and _LATIN.search(low):
        words = re.split(r"(\W+)", low)
        latin = sum(bool(_LATIN.search(w)) for w in words) >= 0.5 * sum(bool(re.search(r"\w", w)) for w in words)
        low = "".join(w.translate(_LOOKALIKE) if latin or _LATIN.search(w) else w for w in words)
    low = _STRETCHED.sub(r"\1", low)
    return _LEETED.sub(lambda m: m[0].translate(_LEET), low) if _LEET_INSIDE.search(low) else low


def _unmasked(t: str) -> str:
    if not _MASK_SIGN.search(t):
        return t
    return _MASK.sub(lambda m: f" ?{(m[1] or m[3])[0]}{len(m[0])}{(m[2] or m[4] or '')[-1:]} ", t)


def terms(sentence: str) -> list[str]:
    """Words, quotation marks and masked words ('m***n' as '?m5n') of a sentence."""
    return _PART.findall(_unmasked(undisguise(sentence)))


def pieces(text: str | None) -> list[list[str]]:
    """The terms of every sentence of a text, numbers as one term; long sentences in several parts that overlap by half."""
    out = []
    for s in _SENTENCE.split(_unmasked(undisguise(text or ""))):
        w = [x if "a" <= x[0] <= "z" else "#" if x[0].isdigit() else "'" if x in _QUOTES else x for x in _PART.findall(s)]
        if len(w) <= LONGEST:
            out += [w] if w else []
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


@lru_cache(400_000)
def _key(term: str) -> int:
    return 1 + zlib.crc32(term.encode()) % ((1 << BITS) - 1)


class Machine:
    """Weights and vectors of hashed terms; 0 is padding. Terms that too few labelled texts hold say nothing."""

    def __init__(self, known: set[str], factors: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.known = known
        self.bias = -3.0
        self.w = np.zeros(1 << BITS, np.float32)
        self.v = rng.normal(0, 0.05, (1 << BITS, factors)).astype(np.float32)
        self.v[0] = 0
        self.single: dict[str, int] = {}
        self.follow: dict[str, dict[str, int]] = {}
        for t in sorted(known):
            a, pair, b = t.partition(" ")
            if pair:
                self.follow.setdefault(a, {})[b] = _key(t)
            else:
                self.single[t] = _key(t)
        self.by_shape: dict[tuple, list[str]] = {}
        for t in sorted(known):
            if t.isalpha() and len(t) > 2 and " " not in t:
                self.by_shape.setdefault((t[0], len(t), t[-1]), []).append(t)
        self.cut = 0.5

    def resolve(self, mask: str) -> str | None:
        """The known word of the mask's first letter, length and last letter that weighs most."""
        m = re.fullmatch(r"\?([^\W\d_])(\d+)([^\W\d_]?)", mask)
        if not m:
            return None
        n = int(m[2])
        found = [t for (a, size, z), ts in self.by_shape.items() if a == m[1] and abs(size - n) <= (0 if m[3] else 2) and (not m[3] or z == m[3]) for t in ts]
        return max(found, key=lambda t: (self.w[_key(t)], t), default=None)

    def rows(self, sentences: list[list[str]]) -> np.ndarray:
        """Hashed terms and neighbouring pairs of known terms, padded to one width."""
        out = np.zeros((len(sentences), 2 * LONGEST), np.int32)
        single, follow = self.single, self.follow
        for i, s in enumerate(sentences):
            if "?" in {x[0] for x in s}:
                s = [(self.resolve(x) or "?") if x[0] == "?" else x for x in s]
            k = [single[x] for x in s if x in single]
            k += [follow[a][b] for a, b in zip(s, s[1:]) if a in follow and b in follow[a]]
            k = list(dict.fromkeys(k))[: 2 * LONGEST]
            out[i, : len(k)] = k
        return out

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.float32)
        size = (rows > 0).sum(1)
        order = np.argsort(size, kind="stable")  # sentences of like length together, so that little padding is read
        for i in range(0, len(rows), 4096):
            at = order[i : i + 4096]
            r = rows[at, : max(1, size[at[-1]])]
            x = 1.0 / np.sqrt(np.maximum(4, size[at])).astype(np.float32)
            v = self.v[r]
            s = v.sum(1)
            out[at] = self.bias + 2 * x * self.w[r].sum(1) + 2 * x**2 * ((s * s).sum(1) - (v * v).sum((1, 2)))
        return out

    def fit(self, rows: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 12, weight: float = 2.0, seed: int = 3) -> Machine:
        """Adagrad on the worst sentence of every text and one more of each harmless text, chosen anew in every round."""
        rng = np.random.default_rng(seed)
        gw, gv = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        texts = owner[start]
        size = (rows > 0).sum(1)
        ends = np.r_[start[1:], len(owner)]
        for _ in range(rounds):
            score = self.raw(rows)
            order = np.lexsort((-score, owner))
            worst = order[start]
            extra = (start + rng.integers(0, ends - start))[label[texts] == 0]
            pick = rng.permutation(np.concatenate([worst, extra]))
            pick = pick[np.argsort(size[pick], kind="stable")]
            for i in rng.permutation(np.arange(0, len(pick), 512)):
                r = rows[pick[i : i + 512], : max(1, size[pick[min(len(pick), i + 512) - 1]])]
                y = label[owner[pick[i : i + 512]]].astype(np.float32)
                x = 1.0 / np.sqrt(np.maximum(4, (r > 0).sum(1, keepdims=True))).astype(np.float32)
                v = self.v[r]
                s = v.sum(1)
                z = self.bias + 2 * x[:, 0] * self.w[r].sum(1) + 2 * x[:, 0] ** 2 * ((s * s).sum(1) - (v * v).sum((1, 2)))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, weight, 1.0) / 512
                on = (r > 0).astype(np.float32)
                dw = (g * 2 * x[:, 0])[:, None] * on
                dv = (4 * g * x[:, 0] ** 2)[:, None, None] * (s[:, None, :] - v) * on[:, :, None]
                ids, at = np.unique(r, return_inverse=True)
                at = at.reshape(-1)
                sw = np.bincount(at, dw.reshape(-1), len(ids)).astype(np.float32) + 2e-5 * self.w[ids]
                flat = dv.reshape(-1, dv.shape[2])
                sv = np.stack([np.bincount(at, flat[:, f], len(ids)) for f in range(flat.shape[1])], 1).astype(np.float32) + 1e-4 * self.v[ids]
                gw[ids] += sw * sw
                gv[ids] += sv * sv
                self.w[ids] -= 0.25 * sw / np.sqrt(gw[ids])
                self.v[ids] -= 0.05 * sv / np.sqrt(gv[ids])
                self.w[0], self.v[0] = 0, 0
                self.bias -= 0.5 * float(g.sum())
        return self

    def score(self, text: str | None) -> float:
        """The probability that the text's worst sentence is abusive; 0 for a text without words."""
        p = pieces(text)
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.rows(p)).max(), -30, 30)))) if p else 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        parts = [pieces(t) for t in texts]
        n = np.array([len(p) for p in parts])
        out = np.zeros(len(texts))
        if n.sum():
            z = self.raw(self.rows([s for p in parts for s in p]))
            at = np.r_[0, n.cumsum()[:-1]]
            full = n > 0
            out[full] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, at[full]), -30, 30)))
        return out


def _truths(labels: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What each label is worth as a count of true cases. Labels are wrong now and then: how often a harmless text is labelled
    abusive shows in the lower half of the scores, where next to none is; as often the other way is assumed."""
    wrong = min(0.4, float(labels[held <= np.median(held)].mean()))
    return (labels - wrong) / (1 - 2 * wrong)


def train(texts: list[str], labels: list[int], least: int = 2, folds: int = 3, rounds: int = 12) -> Machine:
    """A machine from labelled texts.

    Texts are scored by machines fitted without them. Those labelled harmless that rank in the upper half of the likely number
    of true cases are left out of the last fit: their labels are probably wrong. The cut has the best F1 over texts left out
    of the fit, with wrong labels allowed for; of cuts about as good the highest.

    With fewer than FEW labels of either kind there is nothing to learn from: a warning says so, and the machine finds
    next to nothing (or all, if every label says so)."""
    parts = [pieces(t) for t in texts]
    keep = [i for i, p in enumerate(parts) if p]
    parts, label = [parts[i] for i in keep], np.array([labels[i] for i in keep], int)
    seen = Counter(t for p in parts for t in {x for s in p for x in s} | {f"{a} {b}" for s in p for a, b in zip(s, s[1:])})
    known = {t for t, n in seen.items() if n >= least + (" " in t) and t[0] != "?"}
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sentences = [s for p in parts for s in p]
    first = Machine(known)
    if not len(parts) or min(label.sum(), len(label) - label.sum()) < FEW:
        warnings.warn(f"{int(label.sum())} abusive texts of {len(label)} labelled: at least {FEW} of each kind are needed to tell them apart", stacklevel=2)
    if not len(parts) or label.sum() < 2 or label.sum() == len(label):
        first.bias = 5.0 if len(label) and label.sum() == len(label) else -5.0
        return first
    rows = first.rows(sentences)
    fold = np.random.default_rng(1).integers(0, folds, len(parts))

    def left_out(use: np.ndarray, times: int) -> np.ndarray:
        """Scores of all texts by machines fitted on those in ``use`` of the other folds."""
        held = np.zeros(len(parts))
        for f in range(folds):
            inside, outside = (fold[owner] != f) & use[owner], fold[owner] == f
            if outside.any() and inside.any():
                z = Machine(known).fit(rows[inside], owner[inside], label, times).raw(rows[outside])
                o = owner[outside]
                at = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                held[o[at]] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(z, at), -30, 30)))
        return held

    use = np.ones(len(parts), bool)
    if label.sum() >= FEW:
        held = left_out(use, max(4, rounds // 2))
        likely = max(1.0, _truths(label, held).sum())
        place = np.empty(len(held), int)
        place[np.argsort(-held, kind="stable")] = np.arange(len(held))
        use = (label == 1) | (place >= likely / 2)
    inside = use[owner]
    full = Machine(known).fit(rows[inside], owner[inside], label, rounds)
    masked = [i for i, s in enumerate(sentences) if any(x[0] == "?" for x in s)]
    if masked:  # what the masks stand for is known only once the words have weights
        rows[masked] = full.rows([sentences[i] for i in masked])
        full = Machine(known).fit(rows[inside], owner[inside], label, rounds)
    if label.sum() >= FEW:
        held = left_out(use, rounds)
        worth, cuts = _truths(label, held), np.linspace(0.1, 0.9, 41)
        f1 = np.array([2 * worth[held >= c].sum() / max(1.0, (held >= c).sum() + worth.sum()) for c in cuts])
        full.cut = float(cuts[f1 >= f1.max() - 0.01].max())
    return full


def fit(texts: DataFrame, labels: DataFrame, record_id: str = "record_id", text: str = "text", label: str = "toxic", sample: int = 20_000) -> Machine:
    """The machine from at most ``sample`` labelled records, chosen by a hash of their id; null labels say nothing."""
    said = labels.select(F.col(record_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    chosen = said.orderBy(F.xxhash64("i"), "i").limit(sample)
    got = texts.select(F.col(record_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.max("t").alias("t")).orderBy("i").toPandas()  # sample rows
    return train(got["t"].tolist(), got["y"].astype(int).tolist())


def score_texts(df: DataFrame, model: Machine, record_id: str = "record_id", text: str = "text", source: str = "source") -> DataFrame:
    """(record_id, source, score, toxic) of every record; null and blank texts score 0. Records delivered again with the
    same text and source count once; rows with a null id are left out. Whole texts are read, however long."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^18 hashed terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.concatenate([shared.value.scores(pdf["text"].iloc[i : i + 256].tolist()) for i in range(0, len(pdf), 256)]) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"record_id": pdf["record_id"], "source": pdf["source"], "score": s.round(6), "toxic": s >= shared.value.cut})

    rows = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return spread(rows.filter("record_id is not null")).mapInPandas(run, "record_id long, source string, score double, toxic boolean").distinct()


def toxic_records(df: DataFrame, model: Machine, **names) -> DataFrame:
    return score_texts(df, model, **names).filter("toxic").select("record_id").distinct()


def rates_by_source(df: DataFrame, model: Machine, **names) -> DataFrame:
    """(source, records, toxic_records, rate, mean_score); a null source is a source of its own."""
    one = score_texts(df, model, **names).groupBy("record_id").agg(F.max(F.struct("score", "toxic", "source")).alias("r")).select("r.*")
    return one.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if("toxic").alias("toxic_records"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn("rate", F.round(F.col("toxic_records") / F.col("records"), 6))
