"""Problem 5: per-document text quality statistics, and prose told from lists, tables and junk by combined rules."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import spread

# Common function words of the corpus' languages.
COMMON = frozenset(
    (
        "the be to of and a in that have it for not on with as you do at this but his by from they we say her she or an will my one all would there their is was are has had been which when who "
        "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce il elle on ne se sont par plus mais comme ou cette nous vous "
        "der die das und ist nicht ein eine zu den dem des mit auf für von im sich auch es an als dass wie wir sie hat aus bei nach nur oder über schon so "
        "el los las y en del al no es una por con para su lo como más pero sus sin sobre este ha hay se que "
        "il lo gli di che è non una per con sono della dei nel alla da ma anche più ci si nella delle "
        "o os as um uma do da dos das em no na não com por mais foi ao ele muito há pelo também já "
        "het een van dat niet op te zijn met voor er maar om hij ook dan naar bij uit al wordt "
        "и в не на что с по как это но из у за от для же он она мы вы они так ещё уже или есть"
    ).split()
)
_MARK = re.compile(r"^\s*(?:[-*+•‣◦▪·–—>○●→⇒✓✔☐☑■□]|o(?= )|(?:No|Nr|Nº|N°)\.? ?\d+[.:)]?|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|[ivxIVX]{1,4}[.)]|\[[ x]\]|#\d+)\s+\S")
_CELLS = re.compile(r"[|\t;]| & |\S {2,}\S")
_BORDER = re.compile(r"^[\s|+:=_-]+$")
_STOP = re.compile(r"[.!?…](?=[\"'”’»)\]]*(?:\s|$))|[。！？؟۔।॥።]")
_ALPHA = re.compile(r"[^\W\d_]+")
_HARD = re.compile(r"[^\W\d_aeiouyäöüáàâãéèêëíìîïóòôõúùûåæøœаеёиоуыэюяAEIOUYÄÖÜÁÀÂÃÉÈÊËÍÌÎÏÓÒÔÕÚÙÛАЕЁИОУЫЭЮЯ]{4,}")
_VOWEL = re.compile("[aeiouyäöüáàâãéèêëíìîïóòôõúùûåæøœаеёиоуыэюя]")
_BROKEN = re.compile("[ÂÃâ€¤�ï»¿™œ¢£¥¦§¨©«¬®¯±²³´¶·¸¹º¼½¾ð]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_LINE_END = re.compile(r"[.!?…:;。！？：；؟۔।॥።][\"'”’»)\]」』]*$")
_ELSEWHERE = re.compile(r"[^\W\d_\u0000-\u024F\u0400-\u052F\u1E00-\u1EFF]")  # letters neither Latin nor Cyrillic
_UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")
_SPLITS = (("·•|/>»→", re.compile(r"\s+[·•|/>»→]+\s+")), (";", re.compile(r";\s+")), (",", re.compile(r",\s+")), ("-–—", re.compile(r"\s+[-–—]\s+")))
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$")
# Articles by language, and words that can't come after one of them.
_AFTER_ARTICLE = (
    ("the a an", "the a an of and to is was were with that in for it who has had been by from at"),
    ("der die das ein eine", "der das und dass mit auf ein eine nicht man muss aber nach von weil"),
    ("le la les un une", "le la les un une de des et est que dans pas mais"),
    ("el la los las un una", "el la los las de y en con es un una pero como"),
    ("il lo la gli un una", "il la gli di e per un una con da ma"),
    ("o os uma", "os um uma de e em com por mas"),
    ("het een", "het een en is van dat in op met voor maar niet"),
)
NEVER_NEXT = {a: frozenset(w for names, words in _AFTER_ARTICLE if a in names.split() for w in words.split()) for names, _ in _AFTER_ARTICLE for a in names.split()}


def _cells(line: str) -> int:
    """The most cells that one separator cuts the line into: bars, tabs, semicolons or wide gaps."""
    s = line.strip().strip("|")
    best = max(s.count("|"), s.count("\t"), s.count(";"), s.count(" & "), len(re.findall(r"(?<=\S) {2,}(?=\S)", s))) + 1
    return best


def _comma_rows(lines: list[str]) -> float:
    """Share of lines with the same number (two or more) of commas and short cells."""
    n = Counter(x.count(",") for x in lines)
    n.pop(0, None)
    n.pop(1, None)
    if not n:
        return 0.0
    commas, _ = n.most_common(1)[0]
    rows = [x for x in lines if x.count(",") == commas]
    short = sum(len(x.split()) <= 3 * (commas + 1) and not _STOP.search(x) for x in rows)
    return short / len(lines)


def _top_ngram(words: list[str], chars: int) -> float:
    """The largest share of characters that one repeated n-gram of 2 to 4 words covers."""
    best = 0.0
    for n in (2, 3, 4):
        all_of = list(zip(*(words[i:] for i in range(n))))
        if len(set(all_of)) == len(all_of):  # none repeats, so no longer one does
            break
        grams = Counter(all_of)
        c = max(grams.values())
        g = max(k for k, v in grams.items() if v == c)  # of several that are as common the greatest
        best = max(best, c * (sum(map(len, g)) + n - 1) / max(1, chars))
    return min(1.0, best)


def measure(text: str | None) -> dict:
    """The statistics of one text. Every share is 0 where there is nothing to share."""
    t = unicodedata.normalize("NFC", text or "").replace("﻿", "")
    lines = [x for x in (y.strip() for y in re.split(r"\r\n|\r|\n", t)) if x]
    paras = [x for x in (y.strip() for y in re.split(r"(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)", t)) if x]
    words = t.split()
    lower = t.lower()
    alpha = _ALPHA.findall(lower)
    solid = sum(map(len, words))
    letters = sum(map(len, alpha))
    unmarked = not re.search(r"(?m)^\s*(?:[^\w\s\"'“”«¿¡]|\w{1,4}[.)]|o |n[or°º]|[ivx]+[.)]|\[)", t, re.I)
    share = lambda a, b: a / b if b else 0.0
    body = [x for x in lines if not _BORDER.match(x)]
    low = lower.split()
    common = share(sum(w in COMMON for w in alpha), len(alpha))
    symbols, n_words, elsewhere = len(_SYMBOL.findall(t)), len(words), 0.0
    if not t.isascii() and _ELSEWHERE.search(t):
        elsewhere = share(len(_ELSEWHERE.findall(t)), letters)
        marks = sum(unicodedata.category(c)[0] == "M" for c in t)  # vowel signs and the like are part of words
        letters, symbols = letters + marks, symbols - marks
        unspaced = len(_UNSPACED.findall(t))
        n_words += unspaced // 2 if unspaced > len(words) else 0  # scripts without spaces: about two letters a word
    odd = " ".join(alpha) if common < 0.1 and elsewhere <= 0.5 else ""  # only texts without common words are looked at for odd ones
    return {
        "words": n_words,
        "mean_word_length": share(solid, n_words),
        "elsewhere": elsewhere,
        "symbol_ratio": share(symbols, len(t)),
        "letter_ratio": share(letters, solid),
        "line_punct": share(sum(bool(_LINE_END.search(x, max(0, len(x) - 6))) for x in lines), len(lines)),
        "common_words": common,
        "dup_lines": 1 - share(len(set(lines)), len(lines)) if lines else 0.0,
        "dup_paragraphs": 1 - share(len(set(paras)), len(paras)) if paras else 0.0,
        "top_ngram": _top_ngram(low, len(t)),
        "distinct_words": share(len(set(low)), len(words)),
        "stops": len(_STOP.findall(t)),
        "lines": len(lines),
        "marked_lines": share(sum(bool(_MARK.match(x)) for x in lines), len(lines)) if not unmarked else 0.0,
        "cell_rows": max(share(sum(_cells(x) >= 3 for x in body), len(body)) if _CELLS.search(t) else 0.0, _comma_rows(body)) if len(body) > 1 else 0.0,
        "short_lines": share(sum(len(x.split()) <= 7 and not _STOP.search(x) for x in lines), len(lines)),
        "enumeration": _enumerated(lines),
        "broken_chars": share(len(_BROKEN.findall(t)), solid) if not t.isascii() else 0.0,
        "hard_words": share(sum(bool(_HARD.search(w)) for w in alpha), len(alpha)) if odd and _HARD.search(odd) else 0.0,
        "vowels": share(len(_VOWEL.findall(odd)), letters) if odd else 1.0,
        "leaders": share(sum(bool(_LEADER.search(x)) for x in lines), len(lines)) if ".." in t or ". ." in t else 0.0,
        "jumbled": _jumbled(alpha),
        "single_letters": share(sum(len(w) == 1 for w in words), len(words)),
        "longest_word": max(map(len, words), default=0),
    }


def _jumbled(words: list[str]) -> float:
    """Share of articles with a word after them that can't follow one; in word salad every third or so."""
    after = [b in NEVER_NEXT[a] for a, b in zip(words, words[1:]) if a in NEVER_NEXT]
    return sum(after) / len(after) if len(after) >= 3 else 0.0


def _enumerated(lines: list[str]) -> float:
    """How far the text is one enumeration: the share of its characters in short parts between separators, after at most
    one sentence. 0 where that is less than six parts."""
    t = " ".join(lines)
    if not t:
        return 0.0
    lead = re.match(r"^[^.!?:]*[.!?:]\s+", t)
    best = 0.0
    for s in {t, t[lead.end() :] if lead else t}:
        for signs, cut in _SPLITS:
            if sum(map(s.count, signs)) < 5:
                continue
            parts = [p for p in cut.split(s) if p.strip()]
            if len(parts) < 6:
                continue
            short = [p for p in parts if len(p.split()) <= 4 and not _STOP.search(p[:-1])]
            best = max(best, sum(map(len, short)) / sum(map(len, parts)))
    return best


def form_of(m: dict) -> str:
    """prose, list, table, junk or empty, from the statistics. Where most letters are neither Latin nor Cyrillic, what rests on
    common words, vowels and the length of words says nothing and isn't asked."""
    if not m["words"]:
        return "empty"
    w, known = m["words"], m["elsewhere"] <= 0.5
    if m["lines"] >= 2 and m["leaders"] > 0.5:
        return "list"
    if m["lines"] >= 2 and m["cell_rows"] > 0.5 and m["dup_lines"] < 0.5 and m["symbol_ratio"] < 0.6:
        return "table"
    if w >= 10 and (m["single_letters"] > 0.7 or m["jumbled"] > (0.16 if m["stops"] else 0.05)):
        return "junk"
    if m["broken_chars"] > 0.2 or m["letter_ratio"] < 0.2 and m["symbol_ratio"] > 0.3 or m["letter_ratio"] < 0.4 and m["cell_rows"] < 0.5 and m["marked_lines"] < 0.5 and m["enumeration"] < 0.7:
        return "junk"
    if m["lines"] >= 4 and m["dup_lines"] > 0.5:
        return "junk"
    if known and m["mean_word_length"] > 18 and m["longest_word"] > 40:
        return "junk"
    if w >= 8 and m["vowels"] < 0.3 and m["hard_words"] > 0.3 and m["common_words"] < 0.1:
        return "junk"
    sentences = m["stops"] / w
    if w >= 12 and (known or m["mean_word_length"] > 2.5) and m["distinct_words"] < 0.25 and m["stops"] <= 1 and m["marked_lines"] < 0.5:
        return "junk"
    if w >= 16 and m["top_ngram"] > 0.35 and sentences < 0.03 and m["marked_lines"] < 0.5:
        return "junk"
    if m["lines"] >= 3 and m["marked_lines"] > 0.5:
        return "list"
    if m["lines"] >= 4 and m["short_lines"] > 0.5 and (known or m["mean_word_length"] < 12) and m["stops"] <= 0.15 * m["lines"] + 1:
        return "list"
    if m["enumeration"] > 0.7 and m["common_words"] < 0.3:
        return "list"
    if known and w >= 20 and m["common_words"] < 0.06 and m["stops"] <= 1:
        return "junk"
    return "prose"


_KEPT = {
    "words": "int", "mean_word_length": "double", "symbol_ratio": "double", "letter_ratio": "double", "line_punct": "double", "common_words": "double", "dup_lines": "double",
    "dup_paragraphs": "double", "top_ngram": "double", "distinct_words": "double", "marked_lines": "double", "cell_rows": "double", "short_lines": "double", "enumeration": "double",
}


def quality_statistics(df: DataFrame, record_id: str = "record_id", text: str = "text") -> DataFrame:
    """(record_id, form, statistics...) of every record: word count, mean word length, shares of symbols, letters, lines that
    end in punctuation, common words, repeated lines and paragraphs, the characters that the dominant n-gram covers, and
    the form: prose, list, table, junk or empty (null or blank text, with statistics of 0).

    Records with the same id and text count once; rows with a null id are left out. Very long texts are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = [measure(t) for t in pdf["text"]]
            out = {"record_id": pdf["record_id"], "form": [form_of(x) for x in m]}
            yield pd.DataFrame(out | {k: [round(x[k], 9) if t == "double" else x[k] for x in m] for k, t in _KEPT.items()})

    schema = "record_id long, form string, " + ", ".join(f"{k} {t}" for k, t in _KEPT.items())
    # the map goes before the shuffle, which then carries numbers instead of texts
    return _rows(df, record_id, text).mapInPandas(run, schema).distinct()


def _rows(df: DataFrame, record_id: str, text: str) -> DataFrame:
    return spread(df.select(F.col(record_id).cast("long").alias("record_id"), F.col(text).cast("string").alias("text")).filter("record_id is not null"))


def not_prose(df: DataFrame, record_id: str = "record_id", text: str = "text") -> DataFrame:
    """(record_id, form) of the records that are a list, a table or junk, by the same statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms = [form_of(measure(t)) for t in pdf["text"]]
            kept = [f not in ("prose", "empty") for f in forms]
            yield pd.DataFrame({"record_id": pdf["record_id"], "form": forms})[kept]

    return _rows(df, record_id, text).mapInPandas(run, "record_id long, form string").distinct()
