"""Problem 7: broken prompt and response pairs.

For every kind of defect several labelling functions vote yes, no or nothing. A label model (naive Bayes with a hidden
truth, fitted by expectation-maximisation on the counts of vote patterns over all pairs) turns each pattern into a
probability; a defect is kept where that passes a cutoff validated on all sound pairs, broken on purpose. A pair may keep
several defects. Only counts of patterns, of which there is a fixed number, reach the driver.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.language import PieceModel, judge, judge_all, sentences, tokens
from siltstone.llm.quality import COMMON, NEVER_NEXT
from siltstone.session import materialise, spread

DEFECTS = ("empty", "truncated", "refusal", "copied", "other_language")
# What stands for no answer.
PLACEHOLDERS = frozenset(
    "n/a na n.a. tbd tba todo none null nil nan undefined - -- --- . .. ... … ? ?? ??? ! x xx xxx empty blank deleted removed pending placeholder test (no answer) no answer noanswer [deleted] [removed] [empty] (none) (empty) (blank) answer your answer here sin respuesta keine antwort pas de réponse".split(" ")
) | {"(no answer)", "no answer", "your answer here", "sin respuesta", "keine antwort", "pas de réponse", "lorem ipsum", "coming soon", "to be done", "to do", "to be answered", "not available", "no comment"}

_DECLINE = re.compile(
    r"\b(?:can(?:no|')t|can not|could not|couldn't|unable to|not able to|won't be able to|will not|not going to|must decline|have to decline|decline to|refuse to|have to refuse|have to pass|must pass|pass on this"
    r"|(?:do|does|did)(?: no|n')t (?:allow|permit|give|offer|provide|answer)|not allowed|not permitted|against (?:my|our|the) (?:guidelines|rules|policy|policies|instructions|principles)|not (?:be )?(?:appropriate|comfortable)"
    r"|no puedo|no podemos|no me es posible|debo rechazar|tengo que rechazar|no estoy autorizad[oa]|me niego"
    r"|ne (?:peux|pouvons|puis|saurais) pas|dois refuser|dois décliner|refuse de|pas en mesure|pas autorisée?"
    r"|kann ich (?:\w+ ){0,3}nicht|nicht (?:beantworten|helfen|weiterhelfen)|keine auskunft|muss ich (?:\w+ ){0,2}ablehnen|lehne ich|darf ich (?:\w+ ){0,3}(?:keine|nicht)"
    r"|non posso|non possiamo|devo rifiutare|não posso|não podemos|tenho de recusar|devo recusar|kan ik (?:\w+ ){0,3}niet|moet ik (?:\w+ ){0,2}weigeren|не могу|вынужден отказать|отказываюсь)"
)
_ABOUT = re.compile(
    r"\b(?:help|assist|answer|respond|reply|provide|give|comment|advice|information|request|this one|topic|question|appropriate|fulfil|fulfill|comply|discuss|decline|pass"
    r"|ayudar\w*|responder|solicitud|petición|pregunta|información|aider|répondre|demande|question|renseignement\w*|frage|helfen|weiterhelfen|auskunft|anfrage|beantworten|bitte"
    r"|aiutar\w*|rispondere|richiesta|domanda|ajudar\w*|pedido|pergunta|helpen|beantwoorden|verzoek|vraag|помочь|ответить|запрос\w*|вопрос\w*)\b"
)
_POLITE = re.compile(
    r"\b(?:feel free|ask me|something (?:else|different)|hope you understand|thank(?:s| you)|sorry|apolog\w+|unfortunately|lo siento|gracias|désolée?s?|merci|tut mir leid|leider|danke|mi dispiace|grazie|desculp\w+|obrigad[oa]|helaas|bedankt|извините|спасибо)\b"
)
_GREETING = re.compile(r"^(?:[-–—~]\s*)?(?:thanks?|thank you|cheers|regards|best(?: wishes| regards)?|kind regards|good luck|hth|hope (?:this|that|it) helps?|bye|greetings|sincerely|have (?:a nice|fun)|gruß|grüße|viele grüße|mfg|viel erfolg|danke|lg|liebe grüße|saludos|gracias|suerte|un saludo|merci|cordialement|bonne chance|à bientôt|salut|grazie|saluti|ciao|obrigad[oa]|abraço|groet\w*|succes|bedankt|удачи|спасибо)\b", re.I)
_CODEY = re.compile(r"^(?: {4}|\t)|[{};]\s*$|[\w\])]\s*[-+*/]?=\s*\S|\w\(.*\)|^\s*(?:#|//|\$ |>>> )|`\s*$|<-|\[\[?\w|^\s*(?:def|for|if|while|return|import|class|assert|print)\b.*[:(\]\w]\s*$")
_AFTER_CODE = re.compile(r"[):;\]}\d]\s+([¿¡]?[^\W\d_a-zß-ÿа-яё][^\n]*)$")
_FORMULA = re.compile(r"(?:\$[^$]+\$|\\\)|\\\]|\\end\{\w+\*?\})\s*$")
_LINK = re.compile(r"(?:https?://|www\.)\S+$|\]\([^)]*\)$")
_SMILEY = re.compile(r"(?:[:;]-?[)(DP]|\^\^|<3|[\U0001F300-\U0001FAFF☀-➿])\s*$")
_ENDED = re.compile(r"[.!?…。！？]['\"”’»)\]*_]*$")
_CYRILLIC = re.compile(r"[а-яё]", re.I)
_WORD = re.compile(r"[^\W_]+")
# a line with none of these, no // and no such beginning isn't _CODEY
_SIGN = re.compile(r"[{};=()\[\]#`$<>]")
_LEAD = re.compile(r" {4}|\t|\s*(?:def|for|if|while|return|import|class|assert|print)\b")
_LEADS = re.compile(r"^(?: {4}|\t|\s*(?:def|for|if|while|return|import|class|assert|print)\b)", re.M)
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s+")


def _plain(text: str | None) -> str:
    t = html.unescape(re.sub(r"<[a-zA-Z/!][^<>]*>", " ", text or ""))
    t = unicodedata.normalize("NFKC", t).replace("’", "'")
    return re.sub(r"[​-‏⁠﻿\xad]", "", t).strip()


def _say(*xs: object) -> str:
    return "".join("0" if x is None else "y" if x else "n" for x in xs)


def _script(words: list[str]) -> bool:
    return bool(_CYRILLIC.search(" ".join(words))) and sum(bool(_CYRILLIC.search(w)) for w in words) > 0.5 * len(words)


class _Asked:
    """What the votes take from a question, got when first needed."""

    def __init__(self, title: str | None, question: str | None, model: PieceModel):
        self.title, self.question, self.model = title, question, model

    @cached_property
    def plain(self) -> str:
        return _plain(self.question)

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(f"{_plain(self.title)} {self.plain}".lower())

    @cached_property
    def joined(self) -> str:
        return " ".join(self.words)

    @cached_property
    def bag(self) -> Counter:
        return Counter(self.words)

    @cached_property
    def twos(self) -> set:
        return set(zip(self.words, self.words[1:]))

    @cached_property
    def threes(self) -> set:
        return set(zip(self.words, self.words[1:], self.words[2:])) | {tuple(self.words)}

    @cached_property
    def prose(self) -> list[str]:
        return _prose_words(self.question) or _prose_words(self.title)

    @cached_property
    def tongue(self) -> tuple[int, float, np.ndarray]:
        return judge(self.model, self.prose)

    @cached_property
    def signs(self) -> tuple[bool, bool, bool]:
        """Is its language sure, does it hold Cyrillic, is most of it Cyrillic."""
        return self.tongue[1] > 0.95, bool(_CYRILLIC.search(self.plain)), _script(self.prose)


class _Said:
    """What the votes take from an answer, got when first needed."""

    def __init__(self, answer: str | None, model: PieceModel):
        self.answer, self.model = answer, model
        self.plain = _plain(answer)
        self.low = self.plain.lower()
        self.words = _WORD.findall(self.low)

    @cached_property
    def prose(self) -> list[str]:
        return _prose_words(self.answer)

    @cached_property
    def tongue(self) -> tuple[int, float, np.ndarray]:
        return judge(self.model, self.prose)

    @cached_property
    def parts(self) -> list[int]:
        """The languages of its sentences, of those where one is sure."""
        per = judge_all(self.model, [_prose_words(self.plain[x:y]) for x, y in sentences(self.plain)])
        return [lang for lang, post in per if post > 0.9]

    def signs(self, lq: int) -> tuple[bool, bool, bool | None, bool, bool]:
        """Against a question in language ``lq``: is its own language sure, does it lead clearly, are most sentences in
        others, does it hold Cyrillic, is most of it Cyrillic."""
        la, pa, sa = self.tongue
        most: bool | None = False
        if la != lq:
            most = sum(p != lq for p in self.parts) > 0.6 * len(self.parts) if self.parts else None
        return pa > 0.95, bool(sa[la] - sa[lq] > 6), most, self._cyrillic, self._mostly

    @cached_property
    def _cyrillic(self) -> bool:
        return bool(_CYRILLIC.search(self.plain))

    @cached_property
    def _mostly(self) -> bool:
        return _script(self.prose)


def _tongues(other: bool, asked: Iterable[bool], said: Iterable[bool | None]) -> str:
    """The votes on language, of the signs of a question and of an answer; ``other``: are their languages different."""
    (sure_q, cyrillic_q, mostly_q), (sure, lead, most, cyrillic, mostly) = asked, said
    return _say(other and sure and sure_q, lead, most, (cyrillic or cyrillic_q) and mostly != mostly_q or None)


def votes(title: str | None, question: str | None, answer: str | None, model: PieceModel, of: tuple[str, ...] = DEFECTS, asked: _Asked | None = None, said: _Said | None = None) -> dict[str, str]:
    """For every defect in ``of`` a word of y, n and 0: the votes of its labelling functions, in a fixed order.

    ``asked``, ``said``: question and answer as they were read before."""
    asked, said = asked or _Asked(title, question, model), said or _Said(answer, model)
    a, low, wa = said.plain, said.low, said.words
    held = low.strip(" \t\r\n\"'*_`") in PLACEHOLDERS
    blank = not wa
    out: dict[str, str] = {}
    if "empty" in of:
        letters = sum(map(len, wa))
        out["empty"] = _say((not (answer or "").strip()) or None, blank or None, blank or held, letters < 10 and not any(c.isdigit() for c in a) and " ".join(wa) not in asked.joined)
    if blank or held:  # nothing else can be said of it
        return out | {d: "nnnn"[: _WIDTH[d]] for d in of if d != "empty"}
    if "truncated" in of:
        out["truncated"] = _truncated(answer, a, wa)
    if "refusal" in of:
        out["refusal"] = _refusal(low, wa, asked)
    if "copied" in of:
        out["copied"] = _copied(low, wa, asked)
    if "other_language" in of:  # piece model, function words and script of the answer against those of the question
        enough = len(said.prose) >= 3 and len(asked.prose) >= 3
        lq = asked.tongue[0] if enough else 0
        out["other_language"] = _tongues(said.tongue[0] != lq, asked.signs, said.signs(lq)) if enough else "n000"
    return out


def _truncated(answer: str | None, a: str, wa: list[str]) -> str:
    """How the last line ends."""
    raw = re.sub(r"[​-‏⁠﻿]", "", answer or "").rstrip()
    last = raw.splitlines()[-1] if raw else ""
    tail = unicodedata.normalize("NFKC", last).strip().replace("’", "'")
    if _ENDED.search(tail):
        return "n0nn"
    spans = sentences(tail)
    end = tail[spans[-1][0] :] if spans else tail
    end_words = re.findall(r"[^\W_]+", end.lower())
    code = last[:4] in ("    ", "\t") or len(spans) <= 1 and (last[:1] in " \t#" or not re.search(r"(?:\s[^\W\d_]+[,;]?){4}$", tail))
    code = code and _codey(last)
    after = _AFTER_CODE.search(tail) if code else None
    code = code and not (after and len(after[1].split()) >= 3 and not re.search(r"[=<>{}\[\];]", after[1]))  # prose goes on behind it
    if code or _FORMULA.search(tail) or _SMILEY.search(tail[-3:]) or (_GREETING.search(tail) and len(end_words) <= 8) or (("http" in tail or "www." in tail or "](" in tail) and _LINK.search(tail)):
        return "n0nn"
    item = bool(_ITEM.match(last)) and len(end_words) <= 4 and (not end_words or end_words[-1] not in COMMON and (end_words[0] not in COMMON or end_words[0] in NEVER_NEXT))
    items = [x for x in raw.splitlines() if _ITEM.match(x)] if item else []
    item = item and not (len(items) >= 2 and all(_ENDED.search(x.rstrip()) for x in items[:-1]))  # the items before are sentences
    short = len(wa) <= 4 and (end_words[-1:] and end_words[-1] not in COMMON) and not (len(wa) >= 2 and wa[0] in COMMON and len(wa) == len(end_words) and wa[0] in {"there", "according", "il", "quand", "según"})
    return _say(not item and not (short and re.fullmatch(r"[\d.,%\s]+\w*", a)), (end_words[-1:] and end_words[-1] in COMMON or tail.endswith((",", "-", "(", ":"))) or None, False if item else len(spans) > 1 or None, False if item else None)


def _refusal(low: str, wa: list[str], asked: _Asked) -> str:
    """Does any sentence decline, and is there anything else."""
    if not _DECLINE.search(low):
        return "nnn0"
    parts = [low[x:y] for x, y in sentences(low)]
    declines = [bool(_DECLINE.search(p) and _ABOUT.search(p)) for p in parts]
    polite = [bool(_POLITE.search(p)) and len(p.split()) <= 14 for p in parts]
    only = any(declines) and all(d or p for d, p in zip(declines, polite))
    content = {w for w in wa if len(w) >= 5 and w not in COMMON}
    shared = len(content.intersection(asked.words)) / max(1, len(content))
    return _say(any(declines), only, len(wa) <= 45 if any(declines) else False, (shared <= 0.2) if any(declines) else None)


def _copied(low: str, wa: list[str], asked: _Asked) -> str:
    """How much of the answer's word sequence the question has."""
    spoken = _WORD.findall(re.sub(r"(?m)^\s*>.*$", "", low)) if ">" in low else wa
    wa = spoken if len(spoken) >= 2 else wa  # what is said after a quote counts, not the quote
    bag, have = Counter(wa), asked.bag
    both = [(n, have[w]) for w, n in bag.items() if w in have]
    words = sum(min(x) for x in both) / len(wa)
    cover, inside, runs = 0.0, False, 0.0
    if sum(n for n, _ in both) >= 0.4 * len(wa):  # with fewer words of the question the shares below can't be reached
        tri = list(zip(wa, wa[1:], wa[2:])) or [tuple(wa)]
        cover = sum(map(asked.threes.__contains__, tri)) / len(tri)
        inside = " ".join(wa) in asked.joined and len(wa) >= 4
        runs = sum(map(asked.twos.__contains__, zip(wa, wa[1:]))) / max(1, len(wa) - 1)
    return _say(cover >= 0.6 and len(wa) >= 4, words >= 0.85 and len(wa) >= 4, inside or None, runs >= 0.7 and len(wa) >= 4)


_WIDTH = {"empty": 4, "truncated": 4, "refusal": 4, "copied": 4, "other_language": 4}


def _codey(line: str) -> bool:
    return bool((_SIGN.search(line) or "//" in line or _LEAD.match(line)) and _CODEY.search(line))


def _prose_words(text: str | None) -> list[str]:
    """The words of a text's lines without code and formulas."""
    t = text or ""
    if "$" in t or "`" in t or "<" in t or "http" in t:
        t = re.sub(r"\$[^$]*\$|`[^`]*`|https?://\S+|<[^<>]+>", " ", t)
    if not (_SIGN.search(t) or "//" in t or _LEADS.search(t)):
        return tokens(t)
    return [w for line in t.splitlines() if not _codey(line) for w in tokens(line)]


class LabelModel:
    """P(vote | truth) of every labelling function and P(truth), by EM on counts of vote patterns."""

    def __init__(self, counts: dict[str, int], made: dict[str, float] | None = None, rounds: int = 50, prior: float = 0.05, strength: float = 20.0):
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], float)
        k = len(self.patterns[0]) if self.patterns else 0
        at = {"y": 0, "n": 1, "0": 2}
        v = np.array([[at[c] for c in p] for p in self.patterns]).reshape(len(n), k)
        one = np.eye(3)[v]  # pattern x function x vote
        # what a useful function is expected to do, worth ``strength`` pairs
        guess = np.array([[0.75, 0.05, 0.20], [0.03, 0.67, 0.30]])
        theta = np.repeat(guess[:, None, :], k, 1)
        pi = prior
        for _ in range(rounds):
            ll = np.einsum("pfv,yfv->py", one, np.log(theta)) + np.log([pi, 1 - pi])
            post = np.exp(ll - ll.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            w = post * n[:, None]
            theta = np.einsum("py,pfv->yfv", w, one) + strength * guess[:, None, :]
            theta /= theta.sum(2, keepdims=True)
            pi = (w[:, 0].sum() + strength * prior) / (n.sum() + strength)
        self.posterior = dict(zip(self.patterns, post[:, 0])) if k else {}
        self.cutoff = self._best_cutoff(n, made or {})

    def _best_cutoff(self, n: np.ndarray, made: dict[str, float]) -> float:
        """The posterior, at least a half, with the best F1 when everything from it on is kept.

        ``made``: vote patterns of pairs that were broken on purpose, on which the recall of every cutoff is validated; without
        any it is what the posteriors expect, as the precision is."""
        p = np.array([self.posterior[x] for x in self.patterns]) if self.patterns else np.zeros(0)
        best, cut = -1.0, 0.5
        for c in sorted({0.5, *p[p >= 0.5].tolist()}):
            kept = p >= c
            hit = (p * n)[kept].sum()
            precision = hit / max(1e-9, n[kept].sum())
            found = sum(k for x, k in made.items() if self.posterior.get(x, 0.0) >= c)
            recall = found / sum(made.values()) if made else hit / max(1e-9, (p * n).sum())
            f1 = 2 * precision * recall / max(1e-9, precision + recall)
            if f1 > best + 1e-12:
                best, cut = f1, c
        return float(cut)


def broken(question: str | None, answer: str | None, foreign: str | None, at: float) -> dict[str, tuple[str | None, str | None]]:
    """A sound pair broken in each way that can be made by rule, as (question, answer) by defect; ``foreign``: an answer in
    another language, ``at``: where between 0 and 1 to break. Refusals can't be made from a sound pair."""
    q, words = question or "", (answer or "").split()
    out: dict[str, tuple[str | None, str | None]] = {"empty": (question, ("", " ", "-", "n/a")[int(at * 4)])}
    inner = [i for i in range(3, len(words)) if words[i - 1][-1:].isalpha() and words[i - 1] == words[i - 1].lower()]
    if inner:
        out["truncated"] = (question, " ".join(words[: inner[int(at * len(inner))]]))
    said = q.split()
    if len(said) >= 6:
        gone = int(at * len(said))
        out["copied"] = (question, " ".join(said[:gone] + said[gone + 1 :]))
    if foreign:
        out["other_language"] = (question, foreign)
    return out


def tallies(pair: int, title: str | None, question: str | None, answer: str | None, model: PieceModel) -> tuple[dict[str, str], list[str]]:
    """The votes on a pair and, of a sound one, what it counts for when it is broken: 'made DEFECT VOTES' for every way that a
    rule can make, at a place drawn from its id, and where question and answer are in one language 'asked' and 'given' with
    the language of a question and the signs that question and answer show there. Votes on an answer in another language
    rest on those alone, so that the question can be put to all of them (``foreign_answers``)."""
    asked, said = _Asked(title, question, model), _Said(answer, model)
    v = votes(title, question, answer, model, DEFECTS, asked, said)
    if any("y" in x for x in v.values()):
        return v, []
    at = zlib.crc32(str(pair).encode()) / 2**32
    out = [f"made {d} {votes(title, q, a, model, (d,), asked)[d]}" for d, (q, a) in broken(question, answer, None, at).items()]
    own = said.tongue[0]
    if own == asked.tongue[0] and len(said.prose) >= 3 and len(asked.prose) >= 3:
        out.append(f"asked {own} {_say(*asked.signs)}")
        out += [f"given {lang} {_say(*said.signs(lang))}" for lang in range(len(model.languages)) if lang != own]
    return v, out


def foreign_answers(asked: dict[tuple[str, str], int], given: dict[tuple[str, str], int]) -> dict[str, float]:
    """Vote patterns of all sound questions with all sound answers in other languages, from counts by language and signs; every
    question that has any counts once."""
    meant = {"y": True, "n": False, "0": None}
    out: dict[str, float] = {}
    for (lang, q), n in sorted(asked.items()):
        theirs = [(a, k) for (to, a), k in sorted(given.items()) if to == lang]
        for a, k in theirs:
            x = _tongues(True, [meant[c] for c in q], [meant[c] for c in a])
            out[x] = out.get(x, 0.0) + n * k / sum(k for _, k in theirs)
    return out


def defects(df: DataFrame, model: PieceModel, pair_id: str = "pair_id", title: str = "title", question: str = "question", answer: str = "answer") -> DataFrame:
    """(pair_id, defect, probability): every defect of a pair whose posterior reaches its cutoff.

    Cutoffs are validated on all sound pairs, each broken on purpose once in every way that a rule can make (blank, cut off,
    copied, answered in another language; see ``tallies``).

    A null question leaves only what the answer itself shows; a null or blank answer is 'empty'. Pairs delivered again
    count once; a null id is left out. ``model``: the languages to tell apart (siltstone.llm.language.fit)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # pieces of a fixed vocabulary x languages

    text = lambda c: F.col(c).cast("string")
    rows = df.select(F.col(pair_id).cast("long").alias("pair_id"), text(title).alias("title"), text(question).alias("question"), text(answer).alias("answer")).filter("pair_id is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *tallies(i, t, q, a, shared.value)) for i, t, q, a in zip(pdf["pair_id"], pdf["title"], pdf["question"], pdf["answer"])]
            yield pd.DataFrame([(i, *(v[d] for d in DEFECTS), made) for i, v, made in out], columns=["pair_id", *DEFECTS, "made"])

    voted = spread(rows).mapInPandas(run, "pair_id long, " + ", ".join(f"{d} string" for d in DEFECTS) + ", made array<string>")
    voted = materialise(voted.groupBy("pair_id", *DEFECTS).agg(F.min("made").alias("made")))
    counted: dict[str, dict[str, dict[str, int]]] = {"all": {}, "made": {}, "asked": {}, "given": {}}
    words = F.concat(F.array(*(F.concat(F.lit(f"all {d} "), F.col(d)) for d in DEFECTS)), F.col("made"))
    for r in voted.select(F.explode(words).alias("x")).groupBy("x").count().collect():  # at most 3^4 patterns a defect, and signs
        kind, of, x = r["x"].split(" ")
        counted[kind].setdefault(of, {})[x] = r["count"]
    flat = lambda kind: {(of, x): n for of, c in counted[kind].items() for x, n in c.items()}
    made = counted["made"] | {"other_language": foreign_answers(flat("asked"), flat("given"))}
    kept = []
    for d, counts in counted["all"].items():
        m = LabelModel(counts, made.get(d))
        kept += [(d, p, float(x)) for p, x in m.posterior.items() if x >= m.cutoff and "y" in p]
    kept_df = df.sparkSession.createDataFrame(kept, "defect string, votes string, probability double")
    voted = voted.select("pair_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS))).alias("x")).select("pair_id", "x.defect", "x.votes")
    return voted.join(F.broadcast(kept_df), ["defect", "votes"]).groupBy("pair_id", "defect").agg(F.round(F.max("probability"), 6).alias("probability"))


def main_defect(df: DataFrame, model: PieceModel, **names) -> DataFrame:
    """(pair_id, defect): of each defective pair the likeliest defect; ties in the order empty, refusal, copied, other_language, truncated."""
    rank = F.create_map(*(F.lit(x) for i, d in enumerate(("empty", "refusal", "copied", "other_language", "truncated")) for x in (d, i)))
    best = F.min_by("defect", F.struct(F.round(-F.col("probability"), 2), F.element_at(rank, F.col("defect"))))
    return defects(df, model, **names).groupBy("pair_id").agg(best.alias("defect"))
