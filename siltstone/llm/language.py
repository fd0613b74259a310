"""Problem 10: the languages of documents and of their parts.

One unigram model a language over the pieces of a fixed public vocabulary. The score of a word is the sum over all ways
to cut it into pieces, got by a forward pass; a text's score is the sum over its words, as pieces don't cross words.
Piece probabilities come from expectation-maximisation with forward and backward passes over a bounded sample of
labelled documents; one round of self-labelling by sentence takes the wrong labels out of the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import tokenizer_file
from siltstone.session import spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
# ISO 639 codes of the languages, by their two-letter code.
CODES = {
    "de": ("de", "deu", "ger"),
    "en": ("en", "eng"),
    "es": ("es", "spa"),
    "fr": ("fr", "fra", "fre"),
    "it": ("it", "ita"),
    "nl": ("nl", "nld", "dut"),
    "pt": ("pt", "por"),
    "ru": ("ru", "rus"),
}
# Labels that say nothing.
MEANINGLESS = ("", "-", "?", "??", "und", "unk", "unknown", "none", "null", "n/a", "na", "xx", "zxx", "mul", "mis")

MARGIN = 1.2  # how far below the sample's least likely sentences a text is still in a known language
OTHER = "other"  # the language of what is in none of those the model knows

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|[\r\n]+")
_RUN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# what isn't prose: links, code, formulas, tags, citation marks, words grown together with signs of code
_SPAN = re.compile(r"https?://\S+|www\.\S+|`[^`]*`|\$[^$\n]*\$|\[\d+\]|<[^<>\n]*>|\w+\([^\s)]*\)?\S*|\S*[{}\[\]=<>_\\|@#^~+]\S*|[$*]")
_CODE_LINE = re.compile(r"^ {4}|^\t|[;{}]\s*$|\)\s*:\s*$|^[QA]:\s*$|^\s*(?:#|//|\$ |>>> )")
_CODE = re.compile(r"[{}\[\]=<>_\\|@#$^~*+]|\w\(|\)\s*[:;]\s*$|;\s*$|^ {4}|^\t|https?://|^[QA]:\s*$")


def label_language(label: Column) -> Column:
    """The two-letter code that a label means: '' if it says nothing, the label's own base if it is of another language.

    Capitals, three letters, regions (en-GB), scripts (eng_Latn) and a __label__ prefix make no difference."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")))), "^__label__", "")
    head = F.regexp_extract(base, "^([^-_ ]*)", 1)
    known = F.create_map(*(F.lit(x) for code, names in CODES.items() for n in names for x in (n, code)))
    blank = base.isin(*MEANINGLESS) | ~head.rlike(r"^\p{L}{2,3}$")
    return F.when(blank, F.lit("")).otherwise(F.coalesce(F.element_at(known, head), head))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences: text ends one at . ! ? … before white space, and at every line end."""
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > start and text[start : m.start()].strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


class PieceModel:
    """Log probabilities (pieces x languages) and the forward pass over the cuts of a word."""

    def __init__(self, pieces: dict[str, int], log_p: np.ndarray, languages: tuple[str, ...], longest: int):
        self.pieces, self.log_p, self.languages, self.longest = pieces, log_p, languages, longest
        self.unknown = np.full(log_p.shape[1], float(log_p.min()) - 1.0)
        self.held: dict[str, np.ndarray] = {}
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, log_p.shape[1] + 2))
        self.floor = -np.inf  # the least log probability a letter of text in a known language

    def __getstate__(self):
        return self.__dict__ | {"held": {}, "row": {}, "table": np.zeros((1024, self.log_p.shape[1] + 2))}

    def cuts(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) of every vocabulary piece in the word; one unknown (-1) for a letter without any."""
        w = "▁" + word
        out = []
        for j in range(1, len(w) + 1):
            found = [(i, j, self.pieces[w[i:j]]) for i in range(max(0, j - self.longest), j) if w[i:j] in self.pieces]
            if not any(i == j - 1 for i, _, _ in found):
                found.append((j - 1, j, -1))
            out += found
        return out

    def word(self, word: str) -> np.ndarray:
        """The log probability of a word in each language, over all cuts."""
        got = self.held.get(word)
        if got is None:
            n = len(word) + 1
            a = np.full((n + 1, self.log_p.shape[1]), -np.inf)
            a[0] = 0
            for i, j, p in self.cuts(word):
                a[j] = np.logaddexp(a[j], a[i] + (self.log_p[p] if p >= 0 else self.unknown))
            got = a[n]
            if len(self.held) > 400_000:
                self.held.clear()
            self.held[word] = got
        return got

    def places(self, words: list[str]) -> list[int]:
        """The words' rows of the table: what a word says for each language against its best, at least -6, so that one name
        can't decide; then the log probability in the best language, and the letters. A full table starts anew."""
        if len(self.row) + len(words) > 400_000:
            self.row, self.table = {}, self.table[:1024]
        at = []
        for w in words:
            i = self.row.get(w)
            if i is None:
                i = self.row[w] = len(self.row)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                x = self.word(w)
                self.table[i, :-2] = np.maximum(x - x.max(), -6.0)
                self.table[i, -2:] = x.max(), len(w) + 1
                self.held.pop(w, None)
            at.append(i)
        return at

    def sums(self, words: list[str]) -> np.ndarray:
        """The rows of a list of words, added up."""
        at = self.places(words)  # may make a new table
        return self.table[at].sum(0)

    def score(self, words: list[str]) -> np.ndarray:
        return self.sums(words)[:-2]

    def likeness(self, words: list[str]) -> float:
        """Log probability a letter when each word is in its best language: far below ``floor`` for text in none of them."""
        top, size = self.sums(words)[-2:]
        return float(top / size) if size else 0.0

    def expect(self, counts: dict[str, np.ndarray], size: int) -> np.ndarray:
        """Expected uses of each piece in each language, from words with their counts in each language."""
        total = np.zeros((size, self.log_p.shape[1]))
        for word, c in counts.items():
            cuts, n = self.cuts(word), len(word) + 1
            lp = [self.log_p[p] if p >= 0 else self.unknown for _, _, p in cuts]
            a, b = np.full((n + 1, len(c)), -np.inf), np.full((n + 1, len(c)), -np.inf)
            a[0], b[n] = 0, 0
            for (i, j, _), x in zip(cuts, lp):
                a[j] = np.logaddexp(a[j], a[i] + x)
            for (i, j, _), x in zip(reversed(cuts), reversed(lp)):
                b[i] = np.logaddexp(b[i], b[j] + x)
            for (i, j, p), x in zip(cuts, lp):
                if p >= 0:
                    total[p] += c * np.exp(a[i] + x + b[j] - a[n])
        return total


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _RUN.findall(text)]


def vocabulary(path: str) -> dict[str, int]:
    """The lower-case pieces of the vocabulary that hold letters, and their numbers here."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {p.lower() for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i) for p in [sp.id_to_piece(i)]}
    return {p: i for i, p in enumerate(sorted(p for p in kept if re.fullmatch(r"▁?[^\W\d_]*(?:['’])?[^\W\d_]*", p) and len(p) <= 16))}


def train(texts: list[str], labels: list[str], path: str, languages: tuple[str, ...] = LANGUAGES, rounds: int = 2) -> PieceModel:
    """EM over labelled texts: first by document label, then by what the first model says of each sentence."""
    pieces = vocabulary(path)
    at = {code: i for i, code in enumerate(languages)}
    longest = max(map(len, pieces), default=1)
    spans = [(t[a:b], at[label]) for t, label in zip(texts, labels) for a, b in sentences(t) if not _CODE.search(t[a:b])]
    model = PieceModel(pieces, np.full((len(pieces), len(languages)), -np.log(max(1, len(pieces)))), languages, longest)
    for again in range(2):
        counts: dict[str, np.ndarray] = {}
        for s, lang in spans:
            words = tokens(s)
            if again:
                best = judge(model, words)
                if best[1] < 0.9:
                    continue
                lang = best[0]
            for w in words:
                counts.setdefault(w, np.zeros(len(languages)))[lang] += 1
        # words in one language's texts only now and then, names above all, say little; damped counts keep them from deciding
        for _ in range(rounds):
            use = model.expect(counts, len(pieces))
            smooth = use + 0.02
            model = PieceModel(pieces, np.log(smooth / smooth.sum(0)), languages, longest)
    like = [model.likeness(w) for w in (tokens(s) for s, _ in spans) if len(w) >= 6]
    model.floor = float(np.quantile(like, 0.001)) - MARGIN if like else -np.inf
    return model


def judge(model: PieceModel, words: list[str]) -> tuple[int, float, np.ndarray]:
    """(best language, its posterior, log scores) of a list of words."""
    s = model.score(words)
    if not words:
        return 0, 0.0, s
    return verdict(s)


def judge_all(model: PieceModel, lists: list[list[str]]) -> list[tuple[int, float]]:
    """(best language, its posterior) of every list of words that has any, as by ``judge``."""
    lists = [words for words in lists if words]
    if not lists:
        return []
    at = model.places([w for words in lists for w in words])
    s = np.add.reduceat(model.table[at], np.cumsum([0, *map(len, lists[:-1])]))[:, :-2]
    return list(zip(s.argmax(1).tolist(), (1.0 / np.exp(s - s.max(1, keepdims=True)).sum(1)).tolist()))


def verdict(s: np.ndarray) -> tuple[int, float, np.ndarray]:
    best = int(s.argmax())
    return best, float(1.0 / np.exp(s - s[best]).sum()), s


def spoken(sentence: str) -> list[str]:
    """The words of a sentence that are prose; none of a line of code, or where code, links and signs are most of it."""
    w = tokens(sentence)
    rest, least = sentence, 1
    if _CODE.search(sentence):
        if _CODE_LINE.search(sentence):
            return []
        rest = _SPAN.sub(" ", sentence)
        before, w, least = len(w), [x for x in tokens(rest) if len(x) > 1], 5
        least = max(least, 0.6 * before)
    return w if len(w) >= least and sum(map(len, w)) >= 0.55 * (len(rest) - rest.count(" ")) else []


def analyse(model: PieceModel, text: str | None, least_words: int = 3) -> tuple[list[tuple[int, int, str, float]], str, float]:
    """(segments, language, confidence). A segment is a run of sentences of one language: (start, end, language, confidence)."""
    t = unicodedata.normalize("NFC", text or "").replace("﻿", " ")
    parts, strange = [], []
    for a, b in sentences(t):
        w = spoken(t[a:b])
        if w:
            got = model.sums(w)
            far = got[-2] / got[-1] - model.floor if got[-1] >= 16 else 0.0
            (strange if far < 0 else parts).append((a, b, w, verdict(got[:-2]), far))
    if not parts and not strange:
        w = tokens(t)
        lang, p, _ = judge(model, w)
        return ([], model.languages[lang], p) if w else ([], "", 0.0)
    total = sum((j[2] for *_, j, _ in parts), np.zeros(len(model.languages)))
    main = int(np.argmax(total))
    p = np.exp(total - total.max())
    whole = float(p[main] / p.sum()) if parts else 0.0
    out: list[tuple[int, int, str, float]] = []
    for a, b, w, (lang, post, score), far in sorted(parts + strange):
        name = model.languages[lang]
        if far < 0:
            name, post = OTHER, 1 - float(np.exp(4 * far)) / 2
        # a sentence stands against the document's language only with clear evidence of its own
        elif lang != main and (len(w) < least_words or post < 0.9 or score[lang] - score[main] < 4.0 + 0.25 * len(w)):
            name, post = model.languages[main], 1.0 - post
        if out and out[-1][2] == name:
            out[-1] = (out[-1][0], b, name, max(out[-1][3], post))
        else:
            out.append((a, b, name, post))
    letters = lambda rows: sum(len(x) for _, _, w, *_ in rows for x in w)
    if letters(strange) > letters(parts):
        return out, OTHER, max(c for *_, name, c in out if name == OTHER)
    return out, model.languages[main], whole


def fit(df: DataFrame, doc_id: str, text: str, lang: str, per_language: int = 250, path: str | None = None) -> PieceModel:
    """The model from at most ``per_language`` labelled documents of each language, chosen by a hash of their id from those
    of 41 to 20,000 characters."""
    rows = df.select(F.col(doc_id).alias("i"), label_language(F.col(lang)).alias("l"), F.length(text).alias("n")).filter(F.col("l").isin(*LANGUAGES) & F.col("n").between(41, 20_000))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    chosen = rows.withColumn("r", nth).filter(F.col("r") <= per_language).select("i", "l")
    got = df.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "i").toPandas()  # per_language rows a language
    return train(got["t"].tolist(), got["l"].tolist(), path or tokenizer_file("piece_bpe_32k.model"))


_SCHEMA = "doc_id long, label string, language string, confidence double, segments array<struct<start:int,end:int,language:string,confidence:double>>"


def identify_languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: PieceModel | None = None, per_language: int = 250, path: str | None = None) -> DataFrame:
    """(doc_id, label, language, confidence, segments) of every document.

    language: one of the model's, or 'other' where the text is far less likely than any text of those. label: the code its label means, '' for none. segments: runs of sentences of one language, with offsets in the NFC
    form; code, formulas and bare symbols belong to none. Null or blank texts get language '' and no segments; so do
    texts without a letter. A document with null id is left out. ``per_language``: labelled documents to fit on."""
    model = model or fit(df, doc_id, text, lang, per_language, path)
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces of a fixed vocabulary x languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = [analyse(m, t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "label": pdf["label"],
                    "language": [x for _, x, _ in out],
                    "confidence": [round(c, 6) for *_, c in out],
                    "segments": [[{"start": a, "end": b, "language": x, "confidence": round(c, 6)} for a, b, x, c in s] for s, *_ in out],
                }
            )

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), label_language(F.col(lang)).alias("label"), F.col(text).cast("string").alias("text"))
    return spread(rows.filter("doc_id is not null")).mapInPandas(run, _SCHEMA)


def language_cases(df: DataFrame, **names) -> DataFrame:
    """(doc_id, found_lang): documents without a meaningful label, with a wrong one or in several languages; a row for each of
    the languages that the model knows."""
    got = identify_languages(df, **names)
    found = F.when(F.size("segments") > 0, F.array_distinct(F.transform("segments", lambda s: s["language"]))).otherwise(F.array("language"))
    rows = got.filter("language <> ''").select("doc_id", "label", F.array_remove(found, OTHER).alias("found"))
    wrong = (F.col("label") == "") | (F.size("found") > 1) | ~F.array_contains("found", F.col("label"))
    return rows.filter(wrong).select("doc_id", F.explode("found").alias("found_lang")).distinct()
