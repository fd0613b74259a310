"""Flags: code, mathematics and machine-written text. No row is dropped; null gives false."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.vectorised import per_text

# Patterns of code and of machine-written text.
CODE_PATTERN = (
    r"\b(?:if|else|for|while|def|class|include|switch|case|default|const|static|try|catch|exception|continue|open|close|import|var|None|null|true|True|false|False|print|return|sudo|apt-get|wget|\+|-|\*|/|=)\b"
    r"|[{};]|\w+\s*\(.*\)|\w+\s*=\s*\w+"
)
_AI_PHRASES = [
    r"(?:as an?|i(?: am|['’]m) an?) (?:(?:ai(?: language)? model|large language model|language model|ai assistant|ai chatbot)\b|ai(?:[,.!]| i\b))",
    r"i(?: am|['’]m) chatgpt\b",
    r"i (?:was|have been) (?:trained|developed|created) by (?:openai|anthropic|google)\b",
    r"(?:as of my |my )(?:last |latest )?(?:knowledge|training)(?: data)? (?:update|cut[- ]?off)\b",
    r"my training data (?:only )?(?:goes up to|includes information up to)\b",
    r"i (?:don['’]t|do not) have (?:access to )?real[- ]time (?:data|information|access)\b",
    r"i (?:don['’]t|do not) have personal (?:opinions|beliefs|experiences|feelings|preferences)\b",
    r"i (?:don['’]t|do not) have (?:a physical body|consciousness|emotions)\b",
    r"(?:i(?: am|['’]m) sorry|i apologize),? but i (?:cannot|can['’]t|am unable to|am not able to) (?:provide|generate|create|write|fulfill|comply with|predict|browse|access)\b",
    r"i (?:cannot|can['’]t|am unable to) (?:fulfill|assist with|comply with) (?:this|that|your) request\b",
    r"(?:certainly[!,]?|sure!)\s+here(?:['’]s| is| are)\b",
    r"here(?:['’]s| is) (?:a revised|an updated|a rewritten|an improved) version of your\b",
    r"regenerate response[ \t]*$",
]
_AI_STYLE = [
    r"it(?: is|['’]s) (?:important|worth|essential) to (?:note|remember|understand)\b",
    r"it(?: is|['’]s) worth noting\b",
    r"in today['’]s (?:fast[- ]paced|ever[- ]evolving|digital) world\b",
    r"in the (?:ever[- ]evolving|ever[- ]changing|rapidly evolving) (?:landscape|world) of\b",
    r"navigat(?:e|es|ing) the (?:complexities|intricacies|landscape) of\b",
    r"let['’]s (?:dive|delve) (?:right )?into\b",
    r"delv(?:e|es|ing) into\b",
    r"without further ado\b",
    r"in the realm of\b",
    r"a (?:rich |vibrant |intricate )?tapestry of\b",
    r"a testament to\b",
    r"at the heart of\b",
    r"unlock (?:the |your )?(?:full )?potential\b",
    r"harness the power of\b",
    r"pave the way for\b",
    r"plays? a (?:crucial|pivotal|vital) role in\b",
    r"embark on (?:a|this|your) journey\b",
    r"a game[- ]changer\b",
    r"a (?:beacon of|journey of discovery)\b",
    r"the possibilities are endless\b",
    r"only time will tell\b",
]
AI_PHRASE_PATTERN = r"(?:^|[.!?]\s+)[ \t]*(?:" + "|".join(_AI_PHRASES) + ")"
AI_STYLE_PATTERN = r"\b(?:" + "|".join(_AI_STYLE) + ")"
AI_TRACE_PATTERN = (
    r"utm_source(?:=|%3D)(?:chatgpt|openai|perplexity|copilot|claude|gemini|grok|deepseek|mistral)"
    r"|data-message-(?:model-slug|author-role|id)="
    r'|data-testid="conversation-turn'
    r'|data-start="\d+"[^>]*data-end="\d+"'
    r"|data-is-(?:last|only)-node"
)
_CODE = re.compile(CODE_PATTERN)


def ai_phrase(c: Column) -> Column:
    """Whether a sentence begins with a phrase that only a chat model says of itself."""
    return F.coalesce(c.rlike("(?imd)" + AI_PHRASE_PATTERN), F.lit(False))


def ai_style_hits(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?i)" + AI_STYLE_PATTERN))


def ai_style(c: Column, min_hits: int = 3, min_per_kchar: float = 0.5) -> Column:
    """At least so many stock phrases, and so many in a thousand characters."""
    hits = ai_style_hits(c)
    return F.coalesce((hits >= min_hits) & (F.try_divide(hits * 1000, F.length(c)) >= min_per_kchar), F.lit(False))


def ai_trace(c: Column) -> Column:
    """Whether HTML carries what chat interfaces leave in copied markup or links."""
    return F.coalesce(c.rlike("(?i)" + AI_TRACE_PATTERN), F.lit(False))


class _CodeBlocks(HTMLParser):
    """Text of every block that holds a code element: the table body around, or the pre or table body right above it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str]]] = []
        self.blocks: dict[int, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link", "wbr"):
            return
        above = self.stack[-1] if self.stack else None
        if tag == "code" and above and above[0] in ("pre", "tbody"):
            block = above[1]
            if above[0] == "pre":
                block = next((text for t, text in reversed(self.stack) if t == "tbody"), block)
            self.blocks[id(block)] = block
        self.stack.append((tag, []))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        for _, text in self.stack:
            text.append(data)


def html_has_code(page: str | None) -> bool:
    if not page or "<code" not in page.lower():
        return False
    p = _CodeBlocks()
    p.feed(page)
    p.close()
    return any(_CODE.search("".join(b)) for b in p.blocks.values())


# Elements of MathML.
_MATHML = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml none mprescripts".split()
)


class _Formulas(HTMLParser):
    """Formulas of a page in order: LaTeX texts, and MathML as (False or True: only known elements, with content)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, object]] = []
        self.open: list[dict] = []
        self.kept: list[str] | None = None
        self.kept_tag, self.depth = "", 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.kept is not None and tag == self.kept_tag:
            self.depth += 1
        if tag == "math" and not self.open:
            self.open.append({"known": True, "content": False, "tex": None})
        elif self.open:
            top = self.open[-1]
            top["known"] &= tag in _MATHML
            if tag == "annotation" and a.get("encoding") == "application/x-tex" and top["tex"] is None:
                self._keep(tag)
        elif self.kept is None:
            if (tag == "annotation" and a.get("encoding") == "application/x-tex") or (tag == "span" and "math-formula" in a.get("class", "").split()):
                self._keep(tag)
            elif tag == "script" and a.get("type") in ("math/tex", "math/latex", "math/asciimath", "math/mml"):
                self._keep(tag, a["type"])

    def _keep(self, tag, kind=""):
        self.kept, self.kept_tag, self.depth, self.kind = [], tag, 1, kind

    def handle_endtag(self, tag):
        if self.kept is not None and tag == self.kept_tag:
            self.depth -= 1
            if not self.depth:
                text, self.kept = "".join(self.kept), None
                if self.open:
                    self.open[-1]["tex"] = text
                elif self.kind == "math/mml":
                    inner = _Formulas()
                    inner.feed(text)
                    inner.close()
                    self.found += [x for x in inner.found[:1] if text.lstrip().lower().startswith("<math")]
                else:
                    self.found.append(("tex", text))
                return
        if tag == "math" and self.open:
            m = self.open.pop()
            self.found.append(("tex", m["tex"]) if m["tex"] is not None else ("mathml", m["known"] and m["content"]))

    def handle_data(self, data):
        if self.kept is not None:
            self.kept.append(data)
        elif self.open and data.strip():
            self.open[-1]["content"] = True


def latex_parses(tex: str) -> bool:
    """Strict as far as structure goes: braces, environments and \\left ... \\right balance, macros have their arguments."""
    stack: list[str] = []
    at = 0
    while at < len(tex):
        c = tex[at]
        if c == "\\":
            m = re.match(r"\\(?:([a-zA-Z]+)\*?|.|$)", tex[at:], re.S)
            name = m[1] or ""
            at += len(m[0])
            if len(m[0]) == 1:
                return False
            if name in ("begin", "end"):
                e = re.match(r"\s*\{([^{}]*)\}", tex[at:])
                if not e:
                    return False
                at += len(e[0])
                if name == "begin":
                    stack.append("env:" + e[1])
                elif not stack or stack.pop() != "env:" + e[1]:
                    return False
            elif name in ("frac", "dfrac", "tfrac", "binom", "sqrt", "text", "mathrm", "mathbf", "mathbb", "mathcal", "hat", "bar", "vec", "overline", "underline"):
                rest = tex[at:].lstrip()
                if name == "sqrt" and rest.startswith("["):
                    rest = rest.partition("]")[2].lstrip()
                if not rest or rest[0] in "}&":
                    return False
            continue
        if c == "{":
            stack.append("{")
        elif c == "}" and (not stack or stack.pop() != "{"):
            return False
        elif c == "%":
            at = tex.find("\n", at)
            if at < 0:
                break
        at += 1
    return not stack


def html_has_math(page: str | None) -> bool:
    """Whether a page has a formula, and every LaTeX formula in it parses."""
    if not page or not re.search(r"<math|math-formula|math/|x-tex", page, re.I):
        return False
    p = _Formulas()
    p.feed(page)
    p.close()
    found = False
    for kind, value in p.found:
        if kind == "mathml":
            found |= bool(value)
        elif value.strip():
            if not latex_parses(value.strip()):
                return False
            found = True
    return found


class Flag:
    """A stage that adds a boolean column."""

    def __init__(self, column: Column, output: str):
        self.column, self.name = column, output

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, self.column)

    def __repr__(self) -> str:
        return self.name


def Code(input_column: str = "html", output_column: str = "has_code") -> Flag:
    return Flag(per_text(html_has_code, "boolean")(F.col(input_column)), output_column)


def Math(input_column: str = "html", output_column: str = "has_math") -> Flag:
    return Flag(per_text(html_has_math, "boolean")(F.col(input_column)), output_column)


def AIPhrase(input_column: str = "text", output_column: str = "has_ai_phrase") -> Flag:
    return Flag(ai_phrase(F.col(input_column)), output_column)


def AIStyle(input_column: str = "text", output_column: str = "has_ai_style", min_hits: int = 3, min_per_kchar: float = 0.5) -> Flag:
    return Flag(ai_style(F.col(input_column), min_hits, min_per_kchar), output_column)


def AITrace(input_column: str = "html", output_column: str = "has_ai_trace") -> Flag:
    return Flag(ai_trace(F.col(input_column)), output_column)
