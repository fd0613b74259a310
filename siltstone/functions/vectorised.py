"""Arrow functions for what Spark has no built-in for."""

from __future__ import annotations

import gzip
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F


def gzip_ratio(text: str | None) -> float | None:
    """Compressed by uncompressed bytes; 0 for an empty text, null for null."""
    if text is None:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    return len(gzip.compress(raw)) / len(raw) if raw else 0.0


def top_ngram_share(text: str | None, n: int) -> float | None:
    """The share of characters in occurrences, one after the other, of the commonest word n-gram (of several, the first
    seen), spaces within it included. 1 without any n-gram."""
    if text is None:
        return None
    w = text.split()
    places: dict[tuple[str, ...], list[int]] = {}
    for i, gram in enumerate(zip(*(w[k:] for k in range(n)))):
        places.setdefault(gram, []).append(i)
    if not places:
        return 1.0
    gram, found = max(places.items(), key=lambda x: (len(x[1]), -x[1][0]))
    used = free = 0
    for i in found:  # occurrences that overlap the one before don't count
        if i >= free:
            used, free = used + 1, i + n
    return used * (sum(map(len, gram)) + n - 1) / len(text)


def repeated_ngram_share(text: str | None, n: int) -> float | None:
    """The share of characters in word n-grams seen before. A word counts once, each new word of a repeat with the space
    that joins it to the repeat's part before it. 1 without any n-gram."""
    if text is None:
        return None
    w = text.split()
    if len(w) < n:
        return 1.0
    seen: set[tuple[str, ...]] = set()
    covered = 0  # words before this place are counted already
    chars = 0
    for at in range(len(w) - n + 1):
        gram = tuple(w[at : at + n])
        if gram in seen:
            new = w[max(at, covered) : at + n]
            chars += sum(map(len, new)) + min(len(new), n - 1)
            covered = at + n
        seen.add(gram)
    return chars / len(text)


def per_text(function, kind: str, *args):
    """An Arrow function that applies ``function(text, *args)`` to each value."""

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: function(t, *args), na_action=None)

    return run


def nfd_key(line: str) -> str:
    """A line's key: decomposed, lower case, every run of other than letters and marks one space."""
    t = unicodedata.normalize("NFD", line.lower())
    return "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t)


def line_keys(text: str | None) -> list[str]:
    return [" ".join(nfd_key(x).split()) for x in (text or "").split("\n")]


_BROKEN = re.compile("[ÂÃâðÐÑ][\x80-¿–—‘’“”€™œ•…†‡‰‹›Œ˜šžŸŽŠƒ¡-¿]")


def fix_mojibake(text: str | None) -> str | None:
    """Text that was read in cp1252 or latin-1 instead of UTF-8, read again; only where that leaves fewer broken pairs."""
    if text is None or not _BROKEN.search(text):
        return text
    best = text
    for _ in range(2):  # some texts were misread twice
        for code in ("cp1252", "latin-1"):
            try:
                again = best.encode(code).decode("utf-8")
            except UnicodeError:
                continue
            if len(_BROKEN.findall(again)) < len(_BROKEN.findall(best)):
                best = again
                break
        else:
            break
    if best == text:  # whole texts can hold both; then repair run by run
        best = re.sub(r"[^\x00-\x7f]{2,}", lambda m: _reread(m[0]), text)
    return best


def _reread(run: str) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return run.encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return run


def trim_repeats(text: str | None, least: int = 8000, longest: int = 200, times: int = 5, chars: int = 100) -> str | None:
    """A text of ``least`` characters or more whose end repeats a unit of up to ``longest`` characters at least ``times``
    times over at least ``chars`` characters, with one unit and what follows the last whole one kept."""
    if text is None or len(text) < least:
        return text
    n = len(text)
    for period in range(1, longest + 1):
        run = 0
        while run < n - period and text[n - 1 - run] == text[n - 1 - run - period]:
            run += 1
        length = run + period
        if length >= max(chars, times * period):
            start = n - length
            rest = length % period
            return text[: start + period] + (text[start : start + rest] if rest else "")
    return text
