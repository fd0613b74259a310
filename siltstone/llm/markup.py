"""Problem 3: markup residue in text documents.

A text is a tree. Its root is the document; below it are lines, and in them the signs that may be markup. An element that is
opened and closed is a node above what it holds: the signs behind its tag on the line, the lines that begin inside it, and
its end tag; so elements nest as in the DOM. Every node has a hidden state: the document clean, of one markup or mixed; a
line clean, code or of one markup; a sign, element tags among them, content, part of code or residue of one markup.
Parent-child potentials tie document to line, element to line, line to sign and element to sign; sum-product messages go up
and down once and give the marginals of every sign. The potentials are counted on labelled pages made from the raw bodies,
whose signs are markup where they stand, and content once the body is converted. Signs taken for residue are then turned
into plain text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import spread

LARGEST = 50_000  # characters of the longest body to train on; texts are judged whole, however long
KINDS = ("html", "markdown", "wiki", "latex")
DOC = ("clean", *KINDS, "mixed")
LINE = ("clean", "code", *KINDS)
SIGN = ("content", "code", *KINDS)

# Names of HTML elements that pages and posts use.
_TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()

# name, markup it belongs to (of several: whichever the context shows), pattern
_SIGNS = (
    ("md_fence", "markdown", r"^(?:```|~~~)[^\n]*$"),
    ("comment", "html", r"<!--.*?-->"),
    ("tag", "html", r"</?(?:" + "|".join(_TAGS) + r")(?:\s[^<>]*)?/?>"),
    ("angle", "", r"</?[A-Za-z][^<>\n]{0,60}>"),
    ("entity", "html", r"&(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"),
    ("dollars", "markdown latex", r"\$\$[^$]+\$\$"),
    ("formula", "", r"\$[^$\n]+\$"),
    ("wiki_template", "wiki", r"\{\{(?:[^{}]|\{[^{}]*\})*\}\}"),
    ("wiki_table", "wiki", r"^(?:\{\|[^\n]*|\|\}|\|-[^-|\n]*|[|!][^\n]*(?:\|\||!!)[^\n]*)$"),
    ("wiki_head", "wiki", r"^={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$"),
    ("wiki_quote", "wiki", r"'{2,5}(?=[^\s'])[^\n]+?(?<=[^\s'])'{2,5}(?!')"),
    ("index", "", r"(?<=[\w\])])(?:\[\[[^\[\]\n]*\]\]|\[[^\[\]\n]*\](?:\[[^\[\]\n]*\])+)"),
    ("wiki_link", "wiki", r"\[\[[^\[\]\n]+\]\]"),
    ("wiki_url", "wiki", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t][^\]\n]*)?\]"),
    ("md_link", "markdown", r"!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)"),
    ("md_reference", "markdown", r"(?<!\w)\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^\[[^\]\n]+\]:[ \t]+\S+[^\n]*$"),
    ("tex_environment", "latex", r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\{[^{}\n]*\}|\[[^\]\n]*\])*"),
    ("tex_display", "latex", r"\\[\[\]()]"),
    ("tex_group", "latex", r"\{\\[a-zA-Z]+\s[^{}\n]*\}"),
    ("tex_command", "latex", r"(?<![\w:\\])~?\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*|~?\\[a-zA-Z]+\*?(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})+"),
    ("tex_break", "latex", r"\\\\(?=\s|$)"),
    ("escape", "markdown latex", r"\\[_*\#&%$`{}.!+>~^-]"),
    ("md_emphasis", "markdown", r"(?<![\w*])(?P<star>\*{1,3})(?=[^\s*])[^*\n]*?(?<=[^\s*])(?P=star)(?![\w*])"),
    ("star_name", "", r"(?<![\w*])\*{1,2}\w+"),
    ("md_underline", "markdown", r"(?<!\w)(?P<bar>_{2,3})(?=[^\s_])[^\n]*?(?<=[^\s_])(?P=bar)(?!\w)"),
    ("md_strike", "markdown", r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    ("md_tick", "markdown", r"(?<!`)`[^`\n]+`(?!`)"),
    ("md_head", "markdown", r"^\#{2,6}[ \t]+(?=\S)"),
    ("hash_line", "markdown wiki", r"^\#{1,3}[ \t]+(?=\S)"),
    ("md_quote", "markdown", r"^(?:>[ \t]?)+(?=\S)"),
    ("md_row", "markdown", r"^\|[^\n]*\|[ \t]*$|^[ \t]*:?-{3,}:?(?:[ \t]*\|[ \t]*:?-{3,}:?)+[ \t]*$"),
    ("star_line", "markdown wiki", r"^[*+]{1,3}[ \t]+(?=\S)"),
    ("wiki_indent", "wiki", r"^[:;]+[ \t]*(?=\w)"),
)
_LEXER = re.compile("|".join(f"(?P<{n}>{p})" for n, _, p in _SIGNS), re.M | re.S | re.I)
_CLASSES = [n for n, _, _ in _SIGNS]
_OF = {n: tuple(k.split()) for n, k, _ in _SIGNS}
_AT = {n: i for i, n in enumerate(_CLASSES)}
#: Characters without which no sign can be found.
_ANY = re.compile(r"[<&*_~`#\[{$|\\>]|''|==|^[+:;]", re.M)
_CODEY = re.compile(r"^\s*(?:def|for|if|elif|else|while|return|import|from|class|assert|print|try|except|with|function|var|let|const)\b[^.]*[:(\[\])=]|^(?![^\n]*(?:\\|\{\{|\}\}))[^\n]*[;{}]\s*$|^\s*[\w.\[\]]+\s*(?:[-+*/]?=|<-|&lt;-)\s*\S|^\s*(?:#|//)\s*\w+_\w+|^\s*(?:List|Map|Set|int|void)\b\S*\s+\w+\s*=|^\w+\(.*\)\s*$")
_LINES = ("plain", "codey", "fenced", "list")


def lex(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Of each line that has signs, its class and its signs (start, end, class). Lines indented by four spaces are code,
    whatever they show, and a formula between single $ is text: neither has signs."""
    out: list[tuple[str, list[tuple[int, int, int]]]] = []
    if not _ANY.search(text):
        return out
    line_start, line_end, cls, fenced = 0, -1, "plain", False
    current: list[tuple[int, int, int]] = []
    for m in _LEXER.finditer(text):
        name = m.lastgroup if m.lastgroup not in ("star", "bar") else "md_emphasis" if m["star"] else "md_underline"
        at = m.start()
        if at > line_end:
            if current:
                out.append((cls, current))
            current = []
            line_start = text.rfind("\n", 0, at) + 1
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
            line = text[line_start:line_end]
            cls = "indent" if line[:4] == "    " or line[:1] == "\t" else "fenced" if fenced else "codey" if _CODEY.search(line) else "list" if line[:2] == "- " or line[:1].isdigit() else "plain"
        if cls == "indent" or name == "formula":
            continue
        if name == "md_fence":
            fenced = not fenced
        elif name == "tag" and text[at + 1 : at + 5].lower().strip("/")[:3] == "pre" or name == "tex_environment" and "{verbatim}" in m[0]:
            fenced = text[at + 1] != "/" and not m[0].startswith("\\end")
        current.append((at, m.end(), _AT[name]))
    if current:
        out.append((cls, current))
    return out


_TAG_NAME = re.compile(r"<(/?)\s*([a-z0-9]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """A line (kind: its look) or an element's opening tag (kind: its class): ``leaves`` are the signs right below it that hold
    nothing, by class; ``kids`` the elements and lines below it; ``number`` that of the line, or of the tag among all signs."""

    __slots__ = ("line", "kind", "number", "leaves", "kids", "own")

    def __init__(self, line: bool, kind: int, number: int):
        self.line, self.kind, self.number, self.leaves, self.kids = line, kind, number, {}, []

    def key(self) -> tuple:
        """What the marginals below it depend on."""
        return self.line, self.kind, tuple((c, len(x)) for c, x in sorted(self.leaves.items())), tuple(k.key() for k in self.kids)


def nest(text: str, lines: list[tuple[str, list[tuple[int, int, int]]]]) -> list[Node]:
    """The lines right below the document, with all that is below them; signs are numbered in order."""
    closes: dict[int, int] = {}  # end tag -> its start tag
    tag, open_, k = _AT["tag"], [], 0
    for _, signs in lines:
        for a, b, c in signs:
            if c == tag:
                m = _TAG_NAME.match(text, a)
                name = m[2].lower() if m else ""
                if m and m[1]:
                    for i in range(len(open_) - 1, -1, -1):
                        if open_[i][0] == name:
                            closes[k] = open_[i][1]
                            del open_[i:]
                            break
                elif name not in _VOID and text[b - 2] != "/":
                    open_.append((name, k))
            k += 1
    starts = set(closes.values())
    roots: list[Node] = []
    up: list[tuple[int, Node, int]] = []  # open elements: number of the start tag, node, line
    k = 0
    for n, (look, signs) in enumerate(lines):
        line = Node(True, _LINES.index(look), n)
        (up[-1][1].kids if up else roots).append(line)
        for *_, c in signs:
            here = up[-1][1] if up and up[-1][2] == n else line
            if k in closes:
                while up and up[-1][0] != closes[k]:
                    up.pop()
                if up:
                    up[-1][1].leaves.setdefault(c, []).append(k)
                    up.pop()
                else:
                    line.leaves.setdefault(c, []).append(k)
            elif k in starts:
                node = Node(False, c, k)
                here.kids.append(node)
                up.append((k, node, n))
            else:
                here.leaves.setdefault(c, []).append(k)
            k += 1
    return roots


def _log_mean(own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log(table @ exp(own)), and log(exp(own) @ table.T), without underflow."""
    top = own.max()
    return np.log(table @ np.exp(own - top)) + top


class Potentials:
    """Counts of parent and child states and of what lines and signs look like, and inference with them."""

    def __init__(self):
        self.doc = np.full(len(DOC), 1.0)
        self.line = np.full((len(DOC), len(LINE)), 0.02)
        self.line[:, :2] += 0.5  # any document may have clean lines and code
        self.within = np.full((len(SIGN), len(LINE)), 0.02)  # a line that begins inside an element
        self.within[:, :2] += 0.5
        self.sign = np.full((len(LINE), len(SIGN)), 0.02)
        self.sign[2:, 2:] += 4.0  # a line of one markup may hold a sign of another
        self.inside = np.full((len(SIGN), len(SIGN)), 0.02)  # a sign inside an element on its line, and its end tag
        self.inside[2:, 2:] += 1.0
        self.inside += np.eye(len(SIGN))
        self.look = np.full((len(LINE), len(_LINES)), 0.5)
        self.shape = np.full((len(SIGN), len(_CLASSES)), 0.002)
        for n, kinds in _OF.items():  # a sign is residue of its own markups only, and seldom content until pages show it
            for k, s in enumerate(SIGN):
                self.shape[k, _AT[n]] = 0.05 if s == "code" else (0.5 if s in kinds else 1e-9) if s != "content" else 0.5 if not kinds else 0.004
        self.seen: dict = {}

    def add(self, doc: str, text: str, states: list[tuple[str, list[str | None]]], weight: float = 1.0) -> None:
        """A labelled page: its state, and of each of its lines with signs the state and those of the signs (None: not said)."""
        said = [s for _, signs in states for s in signs]

        def count(line: bool, kind: int, label: str | None, table: np.ndarray | None, parent: int | None) -> int | None:
            if label is None:
                return None
            state = (LINE if line else SIGN).index(label)
            (self.look if line else self.shape)[state, kind] += weight
            if table is not None:
                table[parent, state] += weight
            return state

        def visit(node: Node, table: np.ndarray | None, parent: int | None) -> None:
            state = count(node.line, node.kind, states[node.number][0] if node.line else said[node.number], table, parent)
            below = None if state is None else self.sign if node.line else self.inside
            for c, numbers in node.leaves.items():
                for k in numbers:
                    count(False, c, said[k], below, state)
            for kid in node.kids:
                visit(kid, self.within if kid.line and below is not None else below, state)

        self.doc[DOC.index(doc)] += weight
        for root in nest(text, lex(text)):
            visit(root, self.line, DOC.index(doc))

    def ready(self) -> Potentials:
        norm = lambda a: a / a.sum(-1, keepdims=True)
        self.p_doc, self.p_look, self.p_shape = map(norm, (self.doc, self.look, self.shape))
        self.edge = {(True, "doc"): norm(self.line), (True, False): norm(self.within), (False, True): norm(self.sign), (False, False): norm(self.inside)}
        self.leaf = {line: np.log(self.edge[False, line] @ self.p_shape) for line in (True, False)}  # parent state x class
        self.log_look, self.log_shape = np.log(self.p_look), np.log(self.p_shape)
        return self

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def _up(self, node: Node) -> None:
        """What the node's looks and all below it say of its state, kept in ``own``."""
        own = (self.log_look if node.line else self.log_shape)[:, node.kind].copy()
        leaf = self.leaf[node.line]
        for c, numbers in node.leaves.items():
            own += len(numbers) * leaf[:, c]
        for kid in node.kids:
            self._up(kid)
            own += _log_mean(kid.own, self.edge[kid.line, node.line])
        node.own = own

    def _down(self, node: Node, prior: np.ndarray, out: list[int]) -> None:
        """``prior``: what all else says of the node's state. Adds the likeliest state of each class of leaves, then of kids."""
        belief = prior + node.own
        if not node.line:
            out.append(int(belief.argmax()))
        leaf, table = self.leaf[node.line], self.edge[False, node.line]
        for c in sorted(node.leaves):
            cavity = belief - leaf[:, c]
            out.append(int((np.log(np.exp(cavity - cavity.max()) @ table) + self.log_shape[:, c]).argmax()))
        for kid in node.kids:
            edge = self.edge[kid.line, node.line]
            cavity = belief - _log_mean(kid.own, edge)
            self._down(kid, np.log(np.exp(cavity - cavity.max()) @ edge), out)

    def states(self, roots: list[Node]) -> list[int]:
        """The states with the largest marginals: of elements and classes of leaves, depth first."""
        key = tuple(r.key() for r in roots)
        got = self.seen.get(key)
        if got is not None:
            return got
        edge, doc, messages = self.edge[True, "doc"], np.log(self.p_doc), []
        for r in roots:
            self._up(r)
            messages.append(_log_mean(r.own, edge))
        doc = doc + sum(messages)
        out: list[int] = []
        for r, m in zip(roots, messages):
            cavity = doc - m
            self._down(r, np.log(np.exp(cavity - cavity.max()) @ edge), out)
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[key] = out
        return out

    def judge(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """Signs taken for residue: (start, end, class, markup)."""
        lines = lex(text or "")
        if not lines:
            return []
        roots = nest(text, lines)
        states, of = iter(self.states(roots)), {}

        def name(node: Node) -> None:
            if not node.line:
                of[node.number] = next(states)
            for c in sorted(node.leaves):
                state = next(states)
                of.update((k, state) for k in node.leaves[c])
            for kid in node.kids:
                name(kid)

        for r in roots:
            name(r)
        signs = (x for _, line in lines for x in line)
        return [(a, b, c, SIGN[of[k]]) for k, (a, b, c) in enumerate(signs) if of[k] > 1]


def dialect(body: str) -> str:
    """The markup that a raw body is written in by its unambiguous signs outside code; 'clean' without any, '' if mixed."""
    count = Counter()
    for look, signs in lex(body):
        for *_, c in signs:
            kinds = _OF[_CLASSES[c]]
            if len(kinds) == 1 and look in ("plain", "list"):
                count[kinds[0]] += 1
    if not count:
        return "clean"
    (k, n), *rest = count.most_common()
    return k if n > 4 * sum(x for _, x in rest) else ""


def _labelled(text: str, state: str) -> list[tuple[str, list[str | None]]]:
    """Of each line with signs its state and those of its signs, if all that can be of markup ``state`` is."""
    out: list[tuple[str, list[str | None]]] = []
    for look, signs in lex(text):
        code = look in ("codey", "fenced")
        own = [state if state in _OF[_CLASSES[c]] and (not code or _CLASSES[c] in ("tag", "entity", "comment", "md_fence", "tex_environment")) else "code" if code else "content" for *_, c in signs]
        out.append(("code" if code and all(s == "code" for s in own) else state, own))
    return out


def train(bodies: list[str], seed: int = 5) -> Potentials:
    """Potentials from raw bodies: as they are (all of their own signs are markup), converted (what is left is content),
    and converted with single signs of other bodies put back in (mixed)."""
    p, rng = Potentials(), np.random.default_rng(seed)
    pages, spare = [], []
    for b in bodies:
        d = dialect(b)
        if not d:
            continue
        signs = [(s, e, c, d) for _, x in lex(b) for s, e, c in x if d in _OF[_CLASSES[c]]] if d != "clean" else []
        plain = convert(b, signs)
        spare += [(b[s:e], d) for s, e, c, _ in signs if e - s < 60 and "\n" not in b[s:e] and len(_OF[_CLASSES[c]]) == 1]
        pages.append((b, d, plain))
    for b, d, plain in pages:
        if d != "clean":
            p.add(d, b, _labelled(b, d))
        for _ in range(3):  # signs within signs
            if d != "clean":
                plain = convert(plain, [(s, e, c, d) for look, x in lex(plain) for s, e, c in x if d in _OF[_CLASSES[c]] and look in ("plain", "list")])
        left = zip(lex(plain), _labelled(plain, "clean"))
        p.add("clean", plain, [(line, [s if look not in ("plain", "list") or not _OF[_CLASSES[c]] else None for (*_, c), s in zip(x, own)]) for (look, x), (line, own) in left], 3.0)
        if spare and rng.random() < 0.3:
            words = plain.split(" ")
            kinds = {}
            for _ in range(int(rng.integers(1, 5))):
                s, k = spare[int(rng.integers(len(spare)))]
                words.insert(int(rng.integers(len(words) + 1)), s)
                kinds[s] = k
            text = " ".join(words)
            lines: list[tuple[str, list[str | None]]] = []
            for look, signs in lex(text):
                own: list[str | None] = []
                for s, e, c in signs:
                    k = kinds.get(text[s:e])
                    if k is None and _OF[_CLASSES[c]] and look in ("plain", "list"):
                        own.append(None)  # left over or grown together: not labelled
                    else:
                        own.append(k if k and k in _OF[_CLASSES[c]] else "code" if look in ("codey", "fenced") else "content")
                found = [s for s in own if s in KINDS]
                lines.append((found[0] if found else "code" if look in ("codey", "fenced") else "clean", own))
            if any(s in KINDS for _, own in lines for s in own):
                p.add("mixed", text, lines)
    return p.ready()


_BLOCK_END = re.compile(r"</(?:p|div|ul|ol|table|blockquote|pre|section|article|header|footer|h[1-6])\s*>|<(?:p|div|blockquote|pre|h[1-6]|ul|ol|table)[\s>]", re.I)


def convert(text: str, signs: list[tuple[int, int, int, str]]) -> str:
    """The text with the given signs turned into plain structure: headings as lines of their own, items as '- ' or
    numbers, code indented by four spaces, formulas between single $, links and emphasis as their words."""
    if not signs:
        return text
    out, at, number, ordered, code = [], 0, 0, [], 0
    for a, b, c, kind in sorted(signs):
        if a < at:
            continue
        between = text[at:a]
        out.append(_indent(between) if code else between)
        s, name = text[a:b], _CLASSES[c]
        low = s.lower()
        put = ""
        if name in ("tag", "comment"):
            tag = re.match(r"</?\s*([a-z0-9]+)", low)
            tag = tag[1] if tag else ""
            if tag in ("ol", "ul") and low[1] != "/":
                ordered.append([tag == "ol", 0])
            elif tag in ("ol", "ul"):
                ordered = ordered[:-1]
                put = "\n"
            if tag == "pre":
                code += -1 if low[1] == "/" and code else 1 if low[1] != "/" else 0
                put = "\n    " if low[1] != "/" else "\n"
            elif tag == "li" and low[1] != "/":
                if ordered and ordered[-1][0]:
                    ordered[-1][1] += 1
                    put = f"\n{ordered[-1][1]}. "
                else:
                    put = "\n- "
            elif tag == "br":
                put = "\n"
            elif tag in ("td", "th") and low[1] == "/":
                put = "\t"
            elif tag == "tr" and low[1] == "/":
                put = "\n"
            elif _BLOCK_END.match(s):
                put = "\n\n"
        elif name == "entity":
            put = html.unescape(s)
        elif name == "dollars":
            put = "$" + s[2:-2].strip() + "$"
        elif name == "md_fence":
            code = 0 if code else 1
        elif name == "wiki_template":
            parts = s[2:-2].split("|")
            put = f"${parts[-1].strip()}$" if parts[0].strip() == "math" else parts[-1].strip() if len(parts) > 1 and parts[0].strip() in ("lang", "code", "quote", "nowrap", "em") else ""
        elif name == "wiki_table":
            put = "" if s.startswith(("{|", "|}", "|-")) else "\t".join(x.strip() for x in re.split(r"\|\||!!", s.lstrip("|! ")))
        elif name == "wiki_head":
            put = s.strip("= \t")
        elif name == "wiki_quote":
            put = s.strip("'")
        elif name == "wiki_link":
            inner = s[2:-2]
            put = "" if re.match(r"(?i)(?:file|image|category|datei|bild|fichier|archivo):", inner) else inner.split("|")[-1]
        elif name == "wiki_url":
            put = s[1:-1].partition(" ")[2]
        elif name == "md_link":
            put = "" if s.startswith("!") else s[1 : s.index("](")]
        elif name == "md_reference":
            put = "" if re.match(r"\[[^\]]+\]:", s) else s[1 : s.index("]")]
        elif name == "tex_environment":
            env = s[s.index("{") + 1 : s.index("}")].rstrip("*")
            begin = s.startswith("\\begin")
            if env in ("verbatim", "lstlisting"):
                code = 1 if begin else 0
            elif env in ("enumerate", "itemize"):
                number = 0 if begin and env == "enumerate" else -1
        elif name == "tex_display":
            put = "$"
        elif name == "tex_group":
            put = s[1:-1].partition(" ")[2]
        elif name == "tex_command":
            cmd = re.match(r"~?\\([a-zA-Z]+)", s)[1]
            args = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", s)
            if cmd == "item":
                if number >= 0:
                    number += 1
                put = f"{number}." if number > 0 else "-"
            elif cmd not in ("cite", "ref", "label", "footnote", "vspace", "hspace", "noindent", "centering"):
                put = args[-1] if args else ""
        elif name == "tex_break":
            put = ""
        elif name == "escape":
            put = s[1:]
        elif name in ("md_emphasis", "md_underline", "md_strike", "md_tick"):
            put = s.strip(s[0])
        elif name == "hash_line" and kind == "wiki":
            number = max(0, number) + 1
            put = f"{number}. "
        elif name == "star_line":
            put = "- "
        elif name == "md_row":
            put = "" if re.fullmatch(r"[\s|:-]+", s) else "\t".join(x.strip() for x in s.strip().strip("|").split("|"))
        out.append(put)
        at = b
    out.append(_indent(text[at:]) if code else text[at:])
    lines = [re.sub(r"(?<=\S)[ \t]{2,}", " ", x) if x[:4] != "    " else x for x in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip("\n")


def _indent(code: str) -> str:
    return code.replace("\n", "\n    ")


def fit(df: DataFrame, post_id: str = "id", body: str = "body", sample: int = 1500) -> Potentials:
    """Potentials from at most ``sample`` bodies of up to LARGEST characters, chosen by a hash of the id."""
    ids = df.select(F.col(post_id).alias("i")).filter("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = df.select(F.col(post_id).alias("i"), F.col(body).cast("string").alias("b")).filter(f"b is not null and length(b) between 1 and {LARGEST}")
    got = rows.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("b").alias("b")).orderBy("i").select("b").toPandas()  # sample rows
    return train(got["b"].tolist())


def _judged(df: DataFrame, model: Potentials | None, post_id: str, text: str, body: str, sample: int, schema: str, row) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, post_id, body, sample))  # tables of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = [r for i, t in zip(pdf["id"], pdf["text"]) for r in row(i, t, shared.value.judge(t))]
            yield pd.DataFrame(rows, columns=names)

    rows = df.select(F.col(post_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    return spread(rows).mapInPandas(run, schema)


def residue(df: DataFrame, model: Potentials | None = None, post_id: str = "id", text: str = "text", body: str = "body", sample: int = 1500) -> DataFrame:
    """(id, markup): one row for each kind of markup of which the text holds residue: html, markdown, wiki or latex.

    Null and empty texts have none; posts delivered again count once; a null id is left out."""
    return _judged(df, model, post_id, text, body, sample, "id long, markup string", lambda i, t, s: [(i, k) for k in sorted({x[3] for x in s})]).distinct()


def clean_text(df: DataFrame, model: Potentials | None = None, post_id: str = "id", text: str = "text", body: str = "body", sample: int = 1500) -> DataFrame:
    """(id, text): every post's text with its residue turned into plain structure; null stays out, '' stays ''.

    Posts delivered again give one row where id and text are the same."""
    return _judged(df, model, post_id, text, body, sample, "id long, text string", lambda i, t, s: [(i, convert(t, s))]).distinct()
