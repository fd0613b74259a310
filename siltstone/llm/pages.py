"""Problem 2: the main body of web pages.

A page is the sequence of its text blocks. A bidirectional LSTM in numpy reads of every block the words, hashed, the
tags and classes on its path, hashed, and a few shares (link text, length, likeness to the page's title), and labels
each block with the whole page in view. It is trained on a bounded sample of pages whose blocks a teacher has labelled
from what pages have in common: furniture repeats from page to page and is made of links, the body begins at the
headline that the title names and stays inside one element.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import spread

# Tags that don't end a block, elements without an end tag, elements without text.
INLINE = frozenset("a abbr b br code em font i img span strong".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|$)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|$)|<![^>]*>|<\?[^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W_]+")
_ENDED = re.compile(r"[.!?…][\"'”’»)\]]*$")
_DIGIT = re.compile(r"\d")


_NONE: frozenset = frozenset()
_CLOSES_ITSELF = frozenset(("li", "tr", "td", "dd", "dt", "option"))


class Block:
    __slots__ = ("text", "path", "ids", "link", "tags")

    def __init__(self, text: str, path: tuple[str, ...], ids: tuple[int, ...], link: float, tags: frozenset):
        self.text, self.path, self.ids, self.link, self.tags = text, path, ids, link, tags


@lru_cache(50_000)
def _named(tag: str, attributes: str) -> str:
    names = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes))
    return f"{tag}.{names}" if names else tag


def blocks(page: str | None) -> tuple[str, list[Block]]:
    """(title, blocks) of a page: runs of text between block tags, entities decoded, white space made single."""
    page = page or ""
    title = _TITLE.search(page)
    title = " ".join(html.unescape(title[1]).split()) if title else ""
    out: list[Block] = []
    names_up: list[str] = []  # of the open elements, outermost first: tag and names, tag, number
    tags_up: list[str] = []
    ids_up: list[int] = []
    runs: list[str] = []
    linked = at = 0
    depth_a, inner, serial = 0, set(), 0

    def end() -> None:
        nonlocal linked
        if runs:
            raw = "".join(runs)
            if raw and not raw.isspace():
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    out.append(Block(text, tuple(names_up), tuple(ids_up), linked / len(raw), frozenset(inner) if inner else _NONE))
            runs.clear()
            inner.clear()
            linked = 0

    for m in _TOKEN.finditer(page):
        begin, after = m.span()
        if begin > at:
            text = page[at:begin]
            if runs or not text.isspace():
                runs.append(text)
                if depth_a:
                    linked += begin - at
        at = after
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = page[begin + 1] == "/"
        if tag in INLINE:
            if tag == "br":
                runs.append(" ")
            elif tag == "a":
                depth_a = 0 if closing else 1
            if not closing:
                inner.add(tag)
            continue
        if runs:
            end()
        depth_a = 0
        if closing:
            if tag in tags_up:
                k = len(tags_up) - 1 - tags_up[::-1].index(tag)
                del names_up[k:], tags_up[k:], ids_up[k:]
        elif tag not in VOID:
            while tags_up and (tags_up[-1] == "p" or (tag == tags_up[-1] and tag in _CLOSES_ITSELF)):
                del names_up[-1], tags_up[-1], ids_up[-1]
            serial += 1
            attributes = m[3]
            names_up.append(_named(tag, attributes) if "=" in attributes else tag)
            tags_up.append(tag)
            ids_up.append(serial)
    if at < len(page):
        runs.append(page[at:])
        linked += (len(page) - at) * bool(depth_a)
    end()
    return title, out


def block_md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _numberless(text: str) -> str:
    return re.sub(r"\d[\d.,]*", "#", text)


def _shape(text: str) -> str:
    """The text without numbers and names, under which furniture of different pages is the same."""
    return re.sub(r"\b[A-ZÀ-Þ][\w’'-]*", "N", re.sub(r"\d[\d.,]*", "#", text[:1].lower() + text[1:]))


class Teacher:
    """Labels from what a sample of pages has in common: furniture is what several addresses of one host show, or pages of
    several hosts. ``places``: the host and the address of each page; fetches of one address count once."""

    def __init__(self, pages: list[tuple[str, list[Block]]], places: list[tuple[str, str]] | None = None):
        self.places = places or [("", str(i)) for i in range(len(pages))]
        same, alike = defaultdict(set), defaultdict(set)  # pages by text, in all hosts and in each
        own, addresses = defaultdict(set), defaultdict(set)
        for i, (title, bs) in enumerate(pages):
            host, address = self.places[i]
            addresses[host].add(address)
            for b in bs:
                if b.text != title:
                    key = _numberless(b.text)
                    same[key].add(self.places[i])
                    own[host, key].add(address)
                    alike[_shape(b.text)].add(self.places[i])
        n = max(1, sum(map(len, addresses.values())))
        self.same = {t: len(p) / n for t, p in same.items() if len(p) >= max(3, 0.004 * n)}
        self.alike = {t: len(p) / n for t, p in alike.items() if len(p) >= max(4, 0.01 * n) and t.count("N") <= 0.2 * len(t.split())}
        self.own = {k: len(p) / len(addresses[k[0]]) for k, p in own.items() if k[0] and len(p) >= 3}

    def common(self, b: Block, host: str = "") -> bool:
        """Whether the block is on many pages; items and cells, which are short, have to be on more."""
        key = _numberless(b.text)
        share = max(self.same.get(key, 0), self.alike.get(_shape(b.text), 0))
        short = b.link < 0.5 and len(b.text.split()) <= 6 and b.path and b.path[-1].partition(".")[0] in ("li", "td", "th", "tr", "dd", "dt")
        return share > (0.05 if short else 0) or self.own.get((host, key), 0) >= (0.5 if short else 0.2)

    def label(self, title: str, bs: list[Block], host: str = "") -> np.ndarray:
        y = np.zeros(len(bs), np.int8)
        heads = [i for i, b in enumerate(bs) if title and b.text == title and b.link < 0.5]
        if not heads:
            heads = [i for i, b in enumerate(bs) if b.path and b.path[-1].split(".")[0] in ("h1", "h2") and not self.common(b, host) and b.link < 0.5][:1]
        if not heads:
            return y
        # of several places with the headline, the one with most plain text after it in the same element
        best, start, scope = 0, -1, 0
        for h in heads:
            for depth in range(len(bs[h].ids) - 1, -1, -1):
                e = bs[h].ids[depth]
                inside = [j for j in range(h + 1, len(bs)) if e in bs[j].ids]
                size = sum(len(bs[j].text) for j in inside if bs[j].link < 0.5 and not self.common(bs[j], host))
                if size >= 40:
                    if size > best or start < 0:
                        best, start, scope = size, h, e
                    break
        if start < 0:
            return y
        y[start] = 1
        skip = 0  # the element of a comment list or another block of furniture
        for j in range(start + 1, len(bs)):
            b = bs[j]
            if scope not in b.ids:
                break
            if skip and skip in b.ids:
                continue
            skip = 0
            if self.common(b, host):
                if b.path and b.path[-1].split(".")[0] in _HEADS and len(b.ids) >= 2 and b.ids[-2] != scope and b.ids[-2] not in bs[start].ids:
                    skip = b.ids[-2]
                continue
            if b.link >= 0.8:
                continue
            y[j] = 1
        return y


WORDS, TAGS, DENSE = 4096, 1024, 10
EMB, EMT, HIDDEN = 24, 16, 32
LONGEST, LARGEST = 600, 500_000  # blocks and characters of the longest page to train on; all pages are labelled


def _hash(x: str, size: int) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % size


@lru_cache(200_000)
def _word_key(w: str) -> int:
    return _hash(w, WORDS)


def _text(text: str) -> tuple[float, np.ndarray, frozenset, bool, float]:
    """Share of 40 words, keys of words and of pairs of words, distinct words, whether it ends as a sentence, share of digits."""
    w = _WORD.findall(text.lower())
    in_order = list(map(_word_key, w))
    keys = set(in_order)
    keys.update([(a * 1_009 + b * 9_176 + 77) % WORDS for a, b in zip(in_order, in_order[1:])])
    keys.add(_word_key("first:" + w[0]) if w else 0)
    ended = bool(_ENDED.search(text, max(0, len(text) - 4)))
    return min(1.0, len(w) / 40), np.fromiter(keys, np.int32, len(keys)), frozenset(w), ended, min(1.0, len(_DIGIT.findall(text)) / len(text) * 4)


_short = lru_cache(100_000)(_text)  # menus and link lists say the same on page after page


@lru_cache(100_000)
def _step_keys(step: str, up: int) -> tuple[int, ...]:
    """Keys of an element of a path ``up`` steps above the text: its tag at that height, its classes and ids at any."""
    tag, _, names = step.partition(".")
    return (_hash(f"{up}:{tag}", TAGS), *(_hash(f"c:{x}", TAGS) for x in names.lower().split()))


@lru_cache(100_000)
def _tag_keys(path: tuple[str, ...], inner: frozenset) -> np.ndarray:
    """Keys of the whole path, of the last three tags together and of the tags within the text."""
    t = {k for up, step in enumerate(reversed(path), 1) for k in _step_keys(step, up)}
    t |= {_hash("in:" + x, TAGS) for x in inner} | {_hash(">".join(x.partition(".")[0] for x in path[-3:]), TAGS)}
    return np.fromiter(t, np.int32)


def features(title: str, bs: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of every block its hashed words, its hashed tags, classes and path, and its shares."""
    ws, ts, dense = [], [], []
    in_title = set(_WORD.findall(title.lower()))
    n, before = max(1, len(bs)), None
    for i, b in enumerate(bs):
        path, size = b.path, len(b.text)
        w, keys, own, ended, digits = _short(b.text) if size <= 120 else _text(b.text)
        ws.append(keys)
        ts.append(_tag_keys(path, b.tags))
        like = len(own & in_title) / len(own) if own else 0.0
        dense.append((b.link, w, min(1.0, size / 400), b.text == title, like, i / n, len(path) / 12, ended, path == before, digits))
        before = path
    return ws, ts, np.array(dense, np.float32).reshape(len(bs), DENSE)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, one LSTM each way, and a logistic layer; trained with Adam on padded batches of pages."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = EMB + EMT + DENSE
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"ew": rng.normal(0, 0.1, (WORDS, EMB)).astype(np.float32), "et": rng.normal(0, 0.1, (TAGS, EMT)).astype(np.float32), "o": init(2 * HIDDEN + n, 1), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(n, 4 * HIDDEN), f"u{d}": init(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _inputs(self, batch: list, keep: bool = True) -> tuple:
        """(inputs, mask, flat word and tag indices with their block and weight)."""
        size, steps = len(batch), max(len(x[2]) for x in batch)
        x = np.zeros((size, steps, EMB + EMT + DENSE), np.float32)
        mask = np.zeros((size, steps), bool)
        gather = []
        for name, which, lo, dim in (("ew", 0, 0, EMB), ("et", 1, EMB, EMT)):
            if not keep:  # blocks that are the same on many pages are looked up once
                place = np.concatenate([r * steps + np.arange(len(b[2])) for r, b in enumerate(batch)])
                own: dict[int, int] = {}
                which_of = [own.setdefault(id(k), len(own)) for b in batch for k in b[which]]
                kinds = {id(k): k for b in batch for k in b[which]}
                arrays = [kinds[i] for i in own]
                n = np.array([len(k) for k in arrays])
                v = np.add.reduceat(self.p[name][np.concatenate(arrays)], np.r_[0, n.cumsum()[:-1]], axis=0) / np.sqrt(n)[:, None].astype(np.float32)
                x.reshape(-1, x.shape[2])[place, lo : lo + dim] = v[which_of]
                continue
            idx = np.concatenate([k for b in batch for k in b[which]])
            n = np.array([len(k) for b in batch for k in b[which]])
            place = np.concatenate([r * steps + np.arange(len(b[2])) for r, b in enumerate(batch)])
            rows = np.repeat(np.arange(len(n)), n)
            wt = np.repeat(1 / np.sqrt(n), n).astype(np.float32)
            flat = x.reshape(-1, x.shape[2])
            v = self.p[name][idx] * wt[:, None]
            flat[place, lo : lo + dim] = np.add.reduceat(v, np.r_[0, n.cumsum()[:-1]], axis=0)
            gather.append((name, idx, place[rows], wt, lo, dim))
        for r, b in enumerate(batch):
            x[r, : len(b[2]), EMB + EMT :] = b[2]
            mask[r, : len(b[2])] = True
        return x, mask, gather

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        size, steps, _ = x.shape
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        out, tape = np.zeros((size, steps, HIDDEN), np.float32), []
        pre = x @ self.p["w" + d] + self.p["b" + d]
        u, whole = self.p["u" + d], mask.all(0).tolist()
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN])  # the logistic function, without overflow
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            nc = f * c + i * g
            if not whole[t]:
                nc = np.where(m, nc, c)
            th = np.tanh(nc)
            nh = o * th if whole[t] else np.where(m, o * th, h)
            if keep:
                tape.append((t, i, f, o, g, c, h, th, m))
            h, c = nh, nc
            out[:, t] = h
        return out, tape

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        hf, tf = self._pass(x, mask, "f", keep)
        hb, tb = self._pass(x, mask, "b", keep)
        top = np.concatenate([hf, hb, x], 2)
        return _sig((top @ self.p["o"])[:, :, 0] + self.p["ob"]), top, tf, tb

    def _step(self, batch: list, y: np.ndarray) -> tuple[dict, float]:
        x, mask, gather = self._inputs(batch)
        p, top, tf, tb = self._forward(x, mask, True)
        n = mask.sum()
        dz = np.where(mask, p - y, 0).astype(np.float32) / n
        g = {"o": (top * dz[:, :, None]).sum((0, 1))[:, None], "ob": np.array([dz.sum()], np.float32)}
        dtop = dz[:, :, None] * self.p["o"][:, 0]
        dx = dtop[:, :, 2 * HIDDEN :].copy()
        for d, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
            dh = np.zeros((len(batch), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(self.p["u" + d])
            for t, i, f, o, gg, c0, h0, th, m in reversed(tape):
                dh = dh + dtop[:, t, lo : lo + HIDDEN]
                dhm = np.where(m, dh, 0)
                dct = np.where(m, dc + dhm * o * (1 - th * th), 0)
                dzs = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), dhm * th * o * (1 - o), dct * i * (1 - gg * gg)], 1)
                dpre[:, t] = dzs
                du += h0.T @ dzs
                dh = np.where(m, dzs @ self.p["u" + d].T, dh)
                dc = np.where(m, dct * f, dc)
            g["u" + d], g["b" + d] = du, dpre.sum((0, 1))
            g["w" + d] = np.tensordot(x, dpre, ((0, 1), (0, 1)))
            dx += dpre @ self.p["w" + d].T
        flat = dx.reshape(-1, dx.shape[2])
        for name, idx, place, wt, lo, dim in gather:
            out = np.zeros_like(self.p[name])
            order = np.argsort(idx, kind="stable")
            key = idx[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            out[key[start]] = np.add.reduceat(flat[place[order], lo : lo + dim] * wt[order][:, None], start, axis=0)
            g[name] = out
        q = np.clip(p, 1e-6, 1 - 1e-6)
        return g, float(-(np.where(mask, y * np.log(q) + (1 - y) * np.log(1 - q), 0)).sum() / n)

    def fit(self, pages: list, labels: list[np.ndarray], rounds: int = 10, size: int = 64, rate: float = 0.006, seed: int = 2) -> Labeller:
        rng = np.random.default_rng(seed)
        keep = [i for i, x in enumerate(pages) if 0 < len(x[2]) <= LONGEST]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for r in range(rounds):
            order = sorted(keep, key=lambda i: (len(pages[i][2]) + rng.integers(0, 8)))
            batches = [order[i : i + size] for i in range(0, len(order), size)]
            lr = rate * (1.0 if r < rounds * 0.6 else 0.3)
            for b in rng.permutation(len(batches)):
                ids = batches[b]
                y = np.zeros((len(ids), max(len(pages[i][2]) for i in ids)), np.float32)
                for k, i in enumerate(ids):
                    y[k, : len(labels[i])] = labels[i]
                g, _ = self._step([pages[i] for i in ids], y)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                for k, v in g.items():
                    v = v * min(1.0, 2.0 / (norm + 1e-9))
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def predict(self, pages: list, size: int = 128) -> list[np.ndarray]:
        """The probability of every block to be main body; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x[2])), key=lambda i: len(pages[i][2]))
        i = 0
        while i < len(order):
            longest = len(pages[order[min(len(order), i + size) - 1]][2])
            ids = order[i : i + max(1, min(size, 20_000 // longest))]
            x, mask, _ = self._inputs([pages[j] for j in ids], keep=False)
            p = self._forward(x, mask)[0]
            for r, j in enumerate(ids):
                out[j] = p[r, : len(pages[j][2])]
            i += len(ids)
        return out


def train(pages: list[str], places: list[tuple[str, str]] | None = None) -> Labeller:
    """The labeller from sample pages, by way of the teacher. ``places``: their hosts and addresses."""
    first = {x: i for i, x in reversed(list(enumerate(pages)))}
    kept = sorted(first.values())
    parsed = [blocks(pages[i]) for i in kept]
    teacher = Teacher(parsed, [places[i] for i in kept] if places else None)
    return Labeller().fit([features(*x) for x in parsed], [teacher.label(*x, host) for x, (host, _) in zip(parsed, teacher.places)])


def sample_pages(df: DataFrame, record_id: str, page: str, uri: str, sample: int, each: int = 8) -> pd.DataFrame:
    """(i, h, host, u): at most ``sample`` pages for training, of hosts chosen by a hash: ``each`` pages of sample / each hosts,
    and more of the same hosts where there aren't as many. The pages' text is read for those alone that are chosen."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(uri).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1))
    rows = df.select(F.col(record_id).cast("string").alias("i"), host.alias("host"), F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("u")).filter("i is not null")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("host"), "host").limit(sample).toPandas()  # at most ``sample`` hosts
    enough, most = int((hosts["n"].clip(upper=each).cumsum() < sample).sum()) + 1, max(each, sample)
    hosts = hosts.iloc[:enough]
    while len(hosts) and hosts["n"].clip(upper=most - 1).sum() >= sample and most > each:  # no more of a host than it takes
        most = max(each, min(most - 1, int(most * 0.9)))
    known = rows.join(F.broadcast(df.sparkSession.createDataFrame([(h,) for h in hosts["host"]], "host string")), "host")
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("i"), "i"))
    near = known.withColumn("nth", nth).filter(F.col("nth") <= 2 * most)  # records delivered again are in it twice
    chosen = near.groupBy("i").agg(F.min("host").alias("host"), F.min("u").alias("u"), F.min("nth").alias("nth"))
    chosen = chosen.orderBy(F.floor((F.col("nth") - 1) / each), F.xxhash64("host"), "host", "nth").limit(sample)
    text = df.select(F.col(record_id).cast("string").alias("i"), F.col(page).cast("string").alias("h")).filter(f"h is not null and length(h) between 1 and {LARGEST}")
    return text.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("h").alias("h"), F.min("host").alias("host"), F.min("u").alias("u")).orderBy("i").toPandas()  # sample rows


def fit(df: DataFrame, record_id: str = "warc_record_id", page: str = "html", uri: str = "warc_target_uri", sample: int = 1200) -> Labeller:
    """The labeller from at most ``sample`` pages, several of each of some hosts. Pages of more than LARGEST characters or
    LONGEST blocks aren't trained on."""
    got = sample_pages(df, record_id, page, uri, sample)
    return train(got["h"].tolist(), list(zip(got["host"], got["u"])))


def _labelled(df: DataFrame, model: Labeller | None, record_id: str, page: str, uri: str, sample: int, schema: str, rows_of) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, record_id, page, uri, sample))  # weights of fixed size
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    types = [pa.float64() if k == "double" else pa.string() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, page = (c.slice(i, 256).to_pylist() for c in batch.columns)
                parsed = [blocks(h) for h in page]
                p = shared.value.predict([features(*x) for x in parsed])
                out = list(zip(*(r for k, (_, bs), q in zip(ids, parsed, p) for r in rows_of(k, bs, q)))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], list(names))

    rows = df.select(F.col(record_id).cast("string").alias("id"), F.col(page).cast("string").alias("html")).filter("id is not null and html is not null")
    return spread(rows).mapInArrow(run, schema)


def main_blocks(df: DataFrame, model: Labeller | None = None, record_id: str = "warc_record_id", page: str = "html", uri: str = "warc_target_uri", sample: int = 1200) -> DataFrame:
    """(warc_record_id, block_md5) of every block of a page's main body, each once.

    Null or empty pages, pages without text and pages without a main body give no rows; records delivered again count
    once; a null id is left out. Whole pages are read. ``sample``: pages that the labeller is trained on."""
    rows_of = lambda k, bs, q: [(k, block_md5(b.text)) for b, x in zip(bs, q) if x >= 0.5]
    return _labelled(df, model, record_id, page, uri, sample, "warc_record_id string, block_md5 string", rows_of).distinct()


def main_text(df: DataFrame, model: Labeller | None = None, record_id: str = "warc_record_id", page: str = "html", uri: str = "warc_target_uri", sample: int = 1200) -> DataFrame:
    """(warc_record_id, text, confidence): the main body of each page, a line a block; '' for a page without one."""
    rows_of = lambda k, bs, q: [(k, "\n".join(b.text for b, x in zip(bs, q) if x >= 0.5), round(float(np.abs(q - 0.5).mean() * 2), 6) if len(q) else 0.0)]
    return _labelled(df, model, record_id, page, uri, sample, "warc_record_id string, text string, confidence double", rows_of).distinct()
