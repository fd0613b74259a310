"""Column builders for text: stripped lines, paragraphs, words, tokens and shares of them. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out so that every regular expression engine means the same by it.
SPACE = r"\t\n\x0B\f\r\x{85}\p{Z}"
WORD = f"[^{SPACE}]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _parts(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator, -1), strip), lambda x: F.length(x) > 0)


def lines(c: Column) -> Column:
    """The non-empty stripped lines, cut at line feeds."""
    return _parts(c, "\n")


def paragraphs(c: Column) -> Column:
    """The non-empty stripped blocks between double line feeds."""
    return _parts(c, "\n\n")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, marks, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where there is nothing to share."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share_of(items: Column, test: Callable[[Column], Column]) -> Column:
    """The share of array elements that pass the test; null for an empty array."""
    return share(F.size(F.filter(items, test)), F.size(items))


def token_hits(c: Column, vocabulary: list[str]) -> Column:
    """How many tokens are in the vocabulary, repeats included."""
    known = F.array(*(F.lit(w.lower()) for w in vocabulary))
    return F.size(F.filter(tokens(c), lambda t: F.array_contains(known, t)))


def host(url: Column) -> Column:
    """The lower-case host of a URL without user and port; '' for a null or one without scheme."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1)), F.lit(""))
