"""Row filters: each is one measure of the text and the range that it has to lie in. Null measures drop the row.

A filter is a function DataFrame -> DataFrame; ``measure`` gives its Column, so that several can be computed in one pass
(``measure_all``) instead of evaluating shared parts once a filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.vectorised import gzip_ratio, per_text, repeated_ngram_share, top_ngram_share

# Fixed values.
STOPWORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
TERMINAL = r"[.!?\"'”’]$"
ELLIPSIS_END = r"(?i)(?:\.\.\.|\(\.\.\.\)|\[\.\.\.\]|…|\[…\]|-»|read more(?:\.\.)?)[\t\n\x0B\f\r\x{85}\p{Z}]*$"
ELLIPSIS = r"\.{3}|…"
OTHER_THAN_PLAIN = r"[^a-zA-Z0-9\n?!,.]"
BULLET = r"^[•‣⁃⁌⁍∙○●◘◦⦾⦿]"
TABULAR = r"^\|[^\n]*\|$|\t[^\n]*\t|<t(?:able|r|d|h)\b"
NOTICES = [
    "terms of use",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "privacy overview",
    "use of cookies",
    "use cookies",
    "privacy & cookies policy",
    "privacy and cookies policy",
    "this website uses cookies to improve your experience while you navigate through the website. out of these cookies, the cookies that are categorized as necessary are stored on your browser as they are essential for the working of basic functionalities of the website. we also use third-party cookies that help us analyze and understand how you use this website. these cookies will be stored in your browser only with your consent. you also have the option to opt-out of these cookies. but opting out of some of these cookies may have an effect on your browsing experience.",
    "necessary cookies are absolutely essential for the website to function properly. this category only includes cookies that ensures basic functionalities and security features of the website. these cookies do not store any personal information.",
    "any cookies that may not be particularly necessary for the website to function and is used specifically to collect user personal data via analytics, ads, other embedded contents are termed as non-necessary cookies. it is mandatory to procure user consent prior to running these cookies on your website.",
    "this site uses cookies, including for analytics, personalization, and advertising purposes. for more information or to change your cookie settings, click here.",
    "if you continue to browse this site without changing your cookie settings, you agree to this use. acceptread more",
]


@dataclass(frozen=True)
class RowFilter:
    """Keeps rows whose measure lies in [low, high], or in ]low, high[ if ``strict``."""

    name: str
    measure: Column
    low: float | None = None
    high: float | None = None
    strict: bool = False

    def keep(self) -> Column:
        if self.low is not None and self.high is not None and not self.strict:
            return F.coalesce(self.measure.between(self.low, self.high), F.lit(False))  # evaluates the measure once
        tests = []
        if self.low is not None:
            tests.append(self.measure > self.low if self.strict else self.measure >= self.low)
        if self.high is not None:
            tests.append(self.measure < self.high if self.strict else self.measure <= self.high)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.filter(self.keep())

    def __repr__(self) -> str:
        return self.name


def measure_all(df: DataFrame, filters: Sequence[RowFilter], prefix: str = "m_") -> DataFrame:
    """``df`` with a column for every filter's measure."""
    return df.select("*", *(f.measure.alias(f"{prefix}{f.name}") for f in filters))


def _text(column: str) -> Column:
    return F.col(column)


def LoremIpsumFilter(input_column: str = "text", name: str = "LoremIpsumFilter") -> RowFilter:
    return RowFilter(name, F.contains(F.lower(_text(input_column)), F.lit("lorem ipsum")).cast("int"), high=0)


def CurlyBraceFilter(input_column: str = "text", name: str = "CurlyBraceFilter") -> RowFilter:
    return RowFilter(name, F.contains(_text(input_column), F.lit("{")).cast("int"), high=0)


def MinLinesFilter(min_lines: int = 3, input_column: str = "text", name: str = "MinLinesFilter") -> RowFilter:
    return RowFilter(name, F.size(X.lines(_text(input_column))), low=min_lines)


def LengthFilter(max_len: int = 10_000, min_len: int = 0, input_column: str = "text", name: str = "LengthFilter") -> RowFilter:
    """Length in code points between the bounds, which are themselves outside."""
    return RowFilter(name, F.length(_text(input_column)), min_len, max_len, strict=True)


def PunctuationFilter(max_ratio: float = 0.85, input_column: str = "text", name: str = "PunctuationFilter") -> RowFilter:
    """Share of lines without terminal punctuation."""
    return RowFilter(name, X.share_of(X.lines(_text(input_column)), lambda x: ~x.rlike(TERMINAL)), high=max_ratio)


def BadWordsFilter(badwords: Sequence[str] | str | Path, input_column: str = "text", name: str = "BadWordsFilter") -> RowFilter:
    """No entry as whole words, in any case. ``badwords``: a list, or a file with one entry a line.

    Entries of letters and digits are sought among the text's tokens, single ones as a set, phrases as runs of tokens;
    others (signs, emoji) anywhere in the text."""
    if isinstance(badwords, (str, Path)):
        badwords = Path(badwords).read_text(encoding="utf-8").splitlines()
    entries = [w.strip().lower() for w in badwords if w.strip()]
    import re

    cut = {e: re.findall(r"[\w]+", e) for e in entries}
    single = sorted({t[0] for e, t in cut.items() if len(t) == 1 and t[0] == e})
    phrases = sorted({" ".join(t) for e, t in cut.items() if len(t) > 1})
    signs = sorted({e for e, t in cut.items() if not t or (len(t) == 1 and t[0] != e)})
    c = _text(input_column)
    hits = F.lit(False)
    if single:
        hits = hits | F.arrays_overlap(X.tokens(c), F.array(*map(F.lit, single)))
    if phrases:
        joined = F.concat(F.lit(" "), F.array_join(X.tokens(c), " "), F.lit(" "))
        hits = hits | F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(joined, F.concat(F.lit(" "), p, F.lit(" "))))
    for s in signs:
        hits = hits | F.contains(F.lower(c), F.lit(s))
    return RowFilter(name, F.when(c.isNotNull(), hits.cast("int")), high=0)


def GzipCompressionFilter(min_ratio: float = 0.3, max_ratio: float = 0.9, input_column: str = "text", name: str = "GzipCompressionFilter") -> RowFilter:
    return RowFilter(name, per_text(gzip_ratio, "double")(_text(input_column)), min_ratio, max_ratio)


def DigitRatioFilter(max_ratio: float = 0.15, input_column: str = "text", name: str = "DigitRatioFilter") -> RowFilter:
    c = _text(input_column)
    return RowFilter(name, X.share(F.regexp_count(c, F.lit("[0-9]")), F.length(c)), high=max_ratio)


def NonAlphaNumericFilter(max_ratio: float = 0.25, input_column: str = "text", name: str = "NonAlphaNumericFilter") -> RowFilter:
    c = _text(input_column)
    return RowFilter(name, X.share(F.regexp_count(c, F.lit(OTHER_THAN_PLAIN)), F.length(c)), high=max_ratio)


def EllipsisFilter(max_ratio: float = 0.3, input_column: str = "text", name: str = "EllipsisFilter") -> RowFilter:
    return RowFilter(name, X.share_of(X.lines(_text(input_column)), lambda x: x.rlike(ELLIPSIS_END)), high=max_ratio)


def WordCountFilter(min_words: int = 50, max_words: int = 100_000, input_column: str = "text", name: str = "WordCountFilter") -> RowFilter:
    return RowFilter(name, X.word_count(_text(input_column)), min_words, max_words)


def _distinct_share(items: Column) -> Column:
    return X.share(F.size(F.array_distinct(items)), F.size(items))


def _distinct_chars(items: Column) -> Column:
    return X.share(F.length(F.array_join(F.array_distinct(items), "")), F.length(F.array_join(items, "")))


def RepeatedParagraphsFilter(ratio: float = 0.7, input_column: str = "text", name: str = "RepeatedParagraphsFilter") -> RowFilter:
    return RowFilter(name, _distinct_share(X.paragraphs(_text(input_column))), low=ratio)


def RepeatedLinesFilter(ratio: float = 0.7, input_column: str = "text", name: str = "RepeatedLinesFilter") -> RowFilter:
    return RowFilter(name, _distinct_share(X.lines(_text(input_column))), low=ratio)


def RepeatedLinesByCharFilter(ratio: float = 0.8, input_column: str = "text", name: str = "RepeatedLinesByCharFilter") -> RowFilter:
    return RowFilter(name, _distinct_chars(X.lines(_text(input_column))), low=ratio)


def RepeatedParagraphsByCharFilter(ratio: float = 0.8, input_column: str = "text", name: str = "RepeatedParagraphsByCharFilter") -> RowFilter:
    return RowFilter(name, _distinct_chars(X.paragraphs(_text(input_column))), low=ratio)


def StopWordDensityFilter(min_density: float = 0.06, stopwords: Sequence[str] = STOPWORDS, input_column: str = "text", name: str = "StopWordDensityFilter") -> RowFilter:
    c = _text(input_column)
    return RowFilter(name, X.share(X.token_hits(c, list(stopwords)), X.word_count(c)), low=min_density)


def StopWordFilter(min_hits: int = 2, stopwords: Sequence[str] = STOPWORDS, input_column: str = "text", name: str = "StopWordFilter") -> RowFilter:
    return RowFilter(name, X.token_hits(_text(input_column), list(stopwords)), low=min_hits)


def TableRatioFilter(max_ratio: float = 0.5, input_column: str = "text", name: str = "TableRatioFilter") -> RowFilter:
    return RowFilter(name, X.share_of(X.lines(_text(input_column)), lambda x: x.rlike(TABULAR)), high=max_ratio)


def AlphabeticWordsFilter(min_ratio: float = 0.8, input_column: str = "text", name: str = "AlphabeticWordsFilter") -> RowFilter:
    c = _text(input_column)
    alpha = F.regexp_count(c, F.lit(f"[^{X.SPACE}A-Za-z]*[A-Za-z][^{X.SPACE}]*"))
    return RowFilter(name, X.share(alpha, X.word_count(c)), low=min_ratio)


def BulletsFilter(max_ratio: float = 0.9, input_column: str = "text", name: str = "BulletsFilter") -> RowFilter:
    return RowFilter(name, X.share_of(X.lines(_text(input_column)), lambda x: x.rlike(BULLET)), high=max_ratio)


def SymbolsToWordsFilter(max_ratio: float = 0.1, input_column: str = "text", name: str = "SymbolsToWordsFilter") -> RowFilter:
    """The larger of hash signs and ellipses by words."""
    c = _text(input_column)
    most = F.greatest(F.regexp_count(c, F.lit("#")), F.regexp_count(c, F.lit(ELLIPSIS)))
    return RowFilter(name, X.share(most, X.word_count(c)), high=max_ratio)


def RepeatingTopNGramsFilter(n: int = 2, max_ratio: float = 0.2, input_column: str = "text", name: str = "RepeatingTopNGramsFilter") -> RowFilter:
    return RowFilter(name, per_text(top_ngram_share, "double", n)(_text(input_column)), high=max_ratio)


def RepeatingDuplicateNGramsFilter(n: int = 2, max_ratio: float = 0.2, input_column: str = "text", name: str = "RepeatingDuplicateNGramsFilter") -> RowFilter:
    return RowFilter(name, per_text(repeated_ngram_share, "double", n)(_text(input_column)), high=max_ratio)


def MeanWordLengthFilter(min_length: float = 3, max_length: float = 10, input_column: str = "text", name: str = "MeanWordLengthFilter") -> RowFilter:
    """Words keep their punctuation."""
    c = _text(input_column)
    chars = F.length(F.regexp_replace(c, f"[{X.SPACE}]+", ""))
    return RowFilter(name, X.share(chars, X.word_count(c)), min_length, max_length)


def _has_notice(x: Column) -> Column:
    low = F.lower(x)
    return F.exists(F.array(*map(F.lit, NOTICES)), lambda n: F.contains(low, n))


def BoilerPlateStringFilter(max_ratio: float = 0.4, input_column: str = "text", name: str = "BoilerPlateStringFilter") -> RowFilter:
    """Share of paragraphs with a policy notice; 1 with any lorem ipsum."""
    c = _text(input_column)
    placeholder = F.contains(F.lower(c), F.lit("lorem ipsum"))
    return RowFilter(name, F.when(placeholder, F.lit(1.0)).otherwise(X.share_of(X.paragraphs(c), _has_notice)), high=max_ratio)


# ---- line editors: the row stays, its text is rewritten


@dataclass(frozen=True)
class LineEditor:
    name: str
    column: str
    text: Column

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, self.text)

    def __repr__(self) -> str:
        return self.name


def _kept_lines(c: Column, test) -> Column:
    return F.array_join(F.filter(X.lines(c), test), "\n")


def TerminalPunctuationLineFilter(input_column: str = "text", name: str = "TerminalPunctuationLineFilter") -> LineEditor:
    return LineEditor(name, input_column, _kept_lines(_text(input_column), lambda x: x.rlike(TERMINAL)))


def MinWordsLineFilter(min_words: int = 5, input_column: str = "text", name: str = "MinWordsLineFilter") -> LineEditor:
    return LineEditor(name, input_column, _kept_lines(_text(input_column), lambda x: X.word_count(x) >= min_words))


def JavascriptLineFilter(input_column: str = "text", name: str = "JavascriptLineFilter") -> LineEditor:
    return LineEditor(name, input_column, _kept_lines(_text(input_column), lambda x: ~F.contains(F.lower(x), F.lit("javascript"))))


def BoilerPlateLineFilter(input_column: str = "text", name: str = "BoilerPlateLineFilter") -> LineEditor:
    """Drops lines with a policy notice; other lines stay as they are, blank ones too."""
    c = _text(input_column)
    return LineEditor(name, input_column, F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~_has_notice(x)), "\n"))
