"""From HTML to text, encodings, tokens and personal data."""

from __future__ import annotations

import html
import re
import shutil
import subprocess
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vectorised import fix_mojibake, per_text
from siltstone.session import spread

# Elements by what they mean for text.
_SILENT = frozenset("script style noscript template svg iframe object head".split())
_FURNITURE = frozenset("nav footer aside form button menu".split())
_RAW = frozenset("script style".split())  # hold no tags
_BLOCK = frozenset("address article blockquote body br center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table tbody td tfoot th thead tr ul".split())
_APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure article section".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)


def tags(page: str, silent: frozenset[str]) -> Iterator[tuple[str, str, bool, bool]]:
    """(text before, tag name, closing, whole tag) of a page in order, in one pass, without comments and without what lies in
    elements of ``silent``, however deep they are nested; at the end the rest with the name ''."""
    at, inside, depth = 0, "", 0
    m = _MARKUP.search(page)
    while m:
        before, name, closing = page[at : m.start()], (m[2] or "").lower(), m[1] == "/"
        at = m.end()
        if inside:
            if name == inside:
                depth += -1 if closing else 0 if m[3].endswith("/") else 1
                if not depth:
                    inside = ""
        elif name in silent and not closing and not m[3].endswith("/"):
            yield before, "", False, ""
            inside, depth = name, 1
        else:
            yield before, name if name not in silent else "", closing, m[0] if name and name not in silent else ""
        if inside in _RAW:  # no tags in it: on to its end
            end = re.compile(rf"</{inside}\s*>", re.I).search(page, at)
            at, inside = (end.end() if end else len(page)), ""
        m = _MARKUP.search(page, at)
    if not inside:
        yield page[at:], "", False, ""


def clean_html(page: str) -> str:
    """The page without what is never main content: scripts, styles, navigation, footers, sidebars and forms."""
    return "".join(text + tag for text, _, _, tag in tags(page, _SILENT | _FURNITURE))


def html_to_text(page: str | None, main_content: bool = True) -> str | None:
    """Plain text with a line for every block, '- ' before items and preformatted text as it stands."""
    if page is None:
        return None
    out: list[str] = []  # runs of text, line ends, and preformatted text behind a mark
    pre = 0
    for text, name, closing, _ in tags(page, _SILENT | _FURNITURE if main_content else _SILENT):
        if text:
            text = html.unescape(text)
            out.append("\x00" + text if pre else re.sub(r"\s+", " ", text))
        if name == "pre":
            pre = max(0, pre + (-1 if closing else 1))
        if name == "li":
            out.append("" if closing else "\n- ")
        elif name in _APART:
            out.append("\n\n")
        elif name in _BLOCK:
            out.append("\n")
    kept: list[str] = []
    pieces: list[str] = []
    for x in out:
        if x[:1] == "\x00":
            if not (pieces and pieces[-1][:1] == "\x00"):
                kept.append("")
                pieces.append(f"\x00{len(kept) - 1}\x00")
            kept[-1] += x[1:]
        else:
            pieces.append(x)
    t = "".join(pieces)
    t = "\n".join(re.sub(r"[ \t]+", " ", line).strip() for line in t.split("\n"))
    t = re.sub(r"(?m)^-\s*\n+(?=\S)", "- ", re.sub(r"\n{3,}", "\n\n", t))
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])].strip("\n"), t).strip()


def _longest_run(page: str | None) -> str | None:
    """Main content as the densest run of lines: link texts count against a block."""
    text = html_to_text(page)
    if not text:
        return text
    blocks = [b for b in text.split("\n\n") if b.strip()]
    links, depth = [], 0
    for before, name, closing, _ in tags(page or "", _SILENT):
        if depth:
            links.append(before)
        if name == "a":
            depth = 0 if closing else 1
            links.append(" ")
    linked = " ".join(html.unescape("".join(links)).split())
    good = [i for i, b in enumerate(blocks) if len(b) >= 60 and b not in linked]
    return "\n\n".join(b for i, b in enumerate(blocks[good[0] : good[-1] + 1]) if b not in linked) if good else text


def browser_dump(command: list[str], timeout: float = 10.0) -> Callable[[str | None], str | None]:
    """Text by a text-mode browser that reads HTML on its input; null where it takes too long or isn't installed."""

    def run(page: str | None) -> str | None:
        if page is None or shutil.which(command[0]) is None:
            return None
        try:
            done = subprocess.run(command, input=page.encode("utf-8", "replace"), capture_output=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return None
        return done.stdout.decode("utf-8", "replace").strip()

    return run


# The first three are this library's own heuristics: blocks as they stand, the densest run of them, and the cleaned page. The
# names of packages that do the like are kept as aliases; none of those packages is used.
EXTRACTORS: dict[str, Callable[[], Callable[[str | None], str | None]]] = {
    "blocks": lambda: html_to_text,
    "densest": lambda: _longest_run,
    "cleaned": lambda: lambda page: None if page is None else clean_html(page),
    "lynx": lambda: browser_dump(["lynx", "-stdin", "-dump", "-nolist"]),
    "w3m": lambda: browser_dump(["w3m", "-T", "text/html", "-dump"]),
    "elinks": lambda: browser_dump(["elinks", "-dump", "-no-references"]),
}


EXTRACTORS |= {alias: EXTRACTORS[name] for alias, name in (("resiliparse", "blocks"), ("trafilatura", "densest"), ("magic-html", "cleaned"))}


class ExtractHTML:
    """Adds the text of a page by one of EXTRACTORS; ``clean`` takes furniture out first."""

    def __init__(self, extractor_type: str = "blocks", clean: bool = False, input_column: str = "html", output_column: str = "text"):
        if extractor_type not in EXTRACTORS:
            raise ValueError(f"Extractor not available: {extractor_type}")
        self.kind, self.clean, self.input_column, self.output_column, self.name = extractor_type, clean, input_column, output_column, "ExtractHTML"

    def __call__(self, df: DataFrame) -> DataFrame:
        kind, clean = self.kind, self.clean

        def one(page: str | None) -> str | None:
            f = EXTRACTORS[kind]()
            return f(clean_html(page) if clean and page is not None else page)

        return spread(df).withColumn(self.output_column, per_text(one, "string").asNondeterministic()(F.col(self.input_column)))


class FixEncoding:
    """Repairs text that was decoded with the wrong table."""

    def __init__(self, input_column: str = "text", output_column: str | None = None):
        self.input_column, self.output_column, self.name = input_column, output_column or input_column, "FixEncoding"

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.output_column, per_text(fix_mojibake, "string")(F.col(self.input_column)))


def decode_page(raw: bytes | None) -> str | None:
    """Bytes as UTF-8, else by the table that the page names, else as cp1252 if no control byte speaks against text; else null."""
    if raw is None:
        return None
    named = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", raw[:2048])
    text = not re.search(rb"[\x00-\x08\x0e-\x1f\x7f]", raw)
    for code in ["utf-8", *([named[1].decode("ascii")] if named else []), *(["cp1252"] if text else [])]:
        try:
            return raw.decode(code)
        except (UnicodeDecodeError, LookupError):
            continue
    return None


# ---- tokens

_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer as Fast

        t = Fast.from_file(path)
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _encoded(path: str, kind: str, pick: Callable, names: bool = False):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _tokenizer(path)
        for s in batches:
            texts = ["" if x is None else x for x in s]
            out = []
            for i in range(0, len(texts), 256):
                encode = t.encode_batch if names else t.encode_batch_fast  # the fast way gives ids only
                out += [pick(e) for e in encode(texts[i : i + 256], add_special_tokens=False)]
            yield pd.Series(out, dtype=object)

    return run


class Tokenize:
    """Adds array<int> token ids by a public tokenizer file; null counts as ''."""

    def __init__(self, path: str = "/opt/tokenizers/byte_bpe_50k.json", input_column: str = "text", output_column: str = "input_ids"):
        self.path, self.input_column, self.output_column, self.name = path, input_column, output_column, "Tokenize"

    def __call__(self, df: DataFrame) -> DataFrame:
        return spread(df).withColumn(self.output_column, _encoded(self.path, "array<int>", lambda e: list(e.ids))(F.col(self.input_column)))


class TokenCounter:
    """Adds the number of tokens of every text."""

    def __init__(self, path: str = "/opt/tokenizers/byte_bpe_50k.json", input_column: str = "text", output_column: str = "num_tokens"):
        self.path, self.input_column, self.output_column, self.name = path, input_column, output_column, "TokenCounter"

    def __call__(self, df: DataFrame) -> DataFrame:
        return spread(df).withColumn(self.output_column, _encoded(self.path, "bigint", lambda e: len(e.ids))(F.col(self.input_column)))


def plain_form(text: str | None) -> str | None:
    """Lower case without accents, blank lines at most one at a time."""
    if text is None:
        return None
    t = unicodedata.normalize("NFD", re.sub(r"\n{3,}", "\n\n", text).lower())
    return "".join(c for c in t if unicodedata.category(c) != "Mn")


class FastTextTokenize:
    """Adds the tokens of the plain form, joined by single spaces."""

    def __init__(self, path: str = "/opt/tokenizers/byte_bpe_50k.json", input_column: str = "text", output_column: str = "tokens"):
        self.path, self.input_column, self.output_column, self.name = path, input_column, output_column, "FastTextTokenize"

    def __call__(self, df: DataFrame) -> DataFrame:
        plain = per_text(plain_form, "string")(F.col(self.input_column))
        return df.withColumn(self.output_column, _encoded(self.path, "string", lambda e: " ".join(e.tokens), names=True)(plain))


# ---- personal data

# Our own patterns; each stands in Java's and in RE2's dialect.
PII_PATTERNS = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("URL", r"https?://[^\s<>\"')\]]+"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CREDIT_CARD", r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE_NUMBER", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,8}){1,4}"),
)


def mask_pii(c: Column) -> Column:
    for name, pattern in PII_PATTERNS:
        c = F.regexp_replace(c, pattern, f"<{name}>")
    return c


class PIIAnonymizer:
    """Replaces personal data in place; ``extra``: a function on texts for what patterns can't find (names, places)."""

    def __init__(self, input_column: str = "text", extra: Callable[[str | None], str | None] | None = None):
        self.input_column, self.extra, self.name = input_column, extra, "PIIAnonymizer"

    def __call__(self, df: DataFrame) -> DataFrame:
        df = df.withColumn(self.input_column, mask_pii(F.col(self.input_column)))
        return df if self.extra is None else df.withColumn(self.input_column, per_text(self.extra, "string")(F.col(self.input_column)))
