"""Stages that score or write text with a model. The model is a plain object given by the caller, loaded once a worker;
what comes with the library needs no network: a trainable classifier of hashed character grams, a profile of common words for
languages where nothing is labelled, a hashed embedder, linear probes."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
import zlib
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

Batch = Callable[[list[str]], list]
_LOADED: OrderedDict[str, Batch] = OrderedDict()  # of this worker process, by stage
MOST_LOADED = 4


class Loader(Protocol):
    """Called once in a worker; gives the function from a list of texts to a list of results."""

    def __call__(self) -> Batch: ...


def loaded(key: str, load: Loader) -> Batch:
    """What ``load()`` gave in this worker process; a process keeps the MOST_LOADED models used last."""
    if key not in _LOADED:
        _LOADED[key] = load()
        while len(_LOADED) > MOST_LOADED:
            _LOADED.popitem(last=False)
    _LOADED.move_to_end(key)
    return _LOADED[key]


class ModelStage:
    """Adds ``output_column``: ``load()`` applied to the input column in batches. Null is handed over as ''.

    A worker process loads a stage's model once, for all its tasks. ``profile``: a ResourceProfile (GPUs, memory) for the
    executors that run the model, where the cluster manager supports one."""

    def __init__(
        self,
        load: Loader,
        kind: str,
        input_column: str = "text",
        output_column: str = "output",
        batch_size: int = 64,
        name: str = "ModelStage",
        empty=None,
        prepare: Callable[[str], str] | None = None,
        profile: ResourceProfile | None = None,
    ):
        self.load, self.kind, self.input_column, self.output_column, self.batch_size, self.name, self.empty, self.prepare = load, kind, input_column, output_column, batch_size, name, empty, prepare
        self.key, self.profile = f"{name}-{uuid.uuid4()}", profile

    def _results(self) -> Callable[[pd.Series], pd.Series]:
        load, size, empty, prepare, key = self.load, self.batch_size, self.empty, self.prepare, self.key

        def results(s: pd.Series) -> pd.Series:
            model = loaded(key, load)
            texts = ["" if t is None else t for t in s]
            if prepare is not None:
                texts = [prepare(t) for t in texts]
            out: list = [empty] * len(texts)
            todo = [i for i, t in enumerate(texts) if empty is None or t.strip()]
            for k in range(0, len(todo), size):
                part = todo[k : k + size]
                for i, r in zip(part, model([texts[i] for i in part])):
                    out[i] = r
            return pd.Series(out, dtype=object)

        return results

    def __call__(self, df: DataFrame) -> DataFrame:
        results, column, output = self._results(), self.input_column, self.output_column
        if self.profile is not None:
            fields = [f for f in df.schema.fields if f.name != output]
            kind = spark_type(self.kind)

            def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in parts:
                    yield pdf.drop(columns=[output], errors="ignore").assign(**{output: results(pdf[column]).to_numpy()})

            return df.mapInPandas(batches, StructType([*fields, StructField(output, kind)]), profile=self.profile)

        @F.pandas_udf(self.kind)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from map(results, series)

        # non-deterministic, so that the planner doesn't evaluate the model again for every use of its column
        return df.withColumn(self.output_column, run.asNondeterministic()(F.col(self.input_column)))

    def __repr__(self) -> str:
        return self.name


def spark_type(kind: str) -> DataType:
    return StructType.fromDDL(f"x {kind}")["x"].dataType


class HashedClassifier:
    """A softmax over hashed character 1- to 4-grams of words and over words, trained by Adagrad in numpy on a bounded sample."""

    def __init__(self, labels: Sequence[str], bits: int = 16):
        self.labels, self.size = list(labels), 1 << bits
        self.w = np.zeros((self.size, len(self.labels)), np.float32)
        self.b = np.zeros(len(self.labels), np.float32)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights): every different piece of the text, weighed by the root of how often it is there."""
        grams: Counter[str] = Counter()
        for w, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
            padded = f" {w} "
            for size in (1, 2, 3, 4):
                for i in range(len(padded) - size + 1):
                    grams[padded[i : i + size]] += n
            grams[f"={w}"] += n
        at = np.fromiter((zlib.crc32(g.encode()) % self.size for g in grams), np.int64, len(grams))
        weight = np.sqrt(np.fromiter(grams.values(), np.float32, len(grams)))
        return at, weight / max(1e-6, float(np.linalg.norm(weight)))

    def fit(self, texts: Sequence[str], labels: Sequence[str], rounds: int = 8, rate: float = 1.0, seed: int = 1) -> HashedClassifier:
        rng, place = np.random.default_rng(seed), {x: i for i, x in enumerate(self.labels)}
        rows = [(*self.features(t), place[y]) for t, y in zip(texts, labels) if y in place]
        seen, seen_b = np.full_like(self.w, 1e-2), np.full_like(self.b, 1e-2)
        for _ in range(rounds):
            for k in rng.permutation(len(rows)):
                at, x, y = rows[k]
                z = x @ self.w[at] + self.b
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y] -= 1
                grad = x[:, None] * g
                seen[at] += grad * grad
                seen_b += g * g
                self.w[at] -= rate * grad / np.sqrt(seen[at])
                self.b -= rate * g / np.sqrt(seen_b)
        return self

    def probabilities(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        z = x @ self.w[at] + self.b if len(at) else self.b
        e = np.exp(z - z.max())
        return e / e.sum()

    def best(self, texts: list[str]) -> list[str]:
        return [self.labels[int(self.probabilities(t).argmax())] for t in texts]

    def chance(self, label: str) -> Callable[[list[str]], list[float]]:
        at = self.labels.index(label)
        return lambda texts: [float(self.probabilities(t)[at]) for t in texts]


def fit_classifier(df: DataFrame, text: str, label: str, sample: int = 4_000) -> HashedClassifier:
    """A classifier from at most ``sample`` labelled rows, chosen by a hash of their text. Null texts and labels say nothing."""
    rows = df.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y")).filter("t is not null and y is not null")
    got = rows.orderBy(F.xxhash64("t"), "y").limit(sample).toPandas()  # sample rows
    return HashedClassifier(sorted(set(got["y"]))).fit(got["t"].tolist(), got["y"].tolist())


# Common words by ISO 639-3 code.
PROFILES = {
    "eng": "the and of to in is that it was for with as on are this be have from not by you we",
    "deu": "der die das und ist nicht ein eine zu den mit von dass auf für sich im des wir auch",
    "fra": "le la les des et est que une un dans pour pas qui sur au avec ce il nous vous",
    "spa": "el la los las de y que en un una es por con para no se del lo como más",
    "ita": "il lo la gli che di e un una per non è sono con del della nel si come più",
    "por": "o os as um uma de e que em não para com por se do da no na como mais",
    "nld": "de het een en van is dat niet op te zijn met voor er maar om hij ook aan",
    "rus": "и в не на что с по как это из у за от для же он она мы вы они",
}
_PROFILE_SETS = {k: frozenset(v.split()) for k, v in PROFILES.items()}


def common_word_language(texts: list[str]) -> list[str]:
    """The language with most common words in the text; 'eng' for a text without any."""
    out = []
    for t in texts:
        w = re.findall(r"[^\W\d_]+", t.lower())
        best = max(PROFILES, key=lambda k: sum(x in _PROFILE_SETS[k] for x in w))
        out.append(best if w else "eng")
    return out


_SCRIPT = {"rus": "Cyrl"}


def Whichlang(input_column: str = "text", output_column: str = "language", load: Loader = lambda: common_word_language) -> ModelStage:
    """ISO 639-3 code of every text; null counts as '', which gives 'eng'."""
    return ModelStage(load, "string", input_column, output_column, 4096, "Whichlang")


def _labels() -> Batch:
    return lambda texts: [f"__label__{c}_{_SCRIPT.get(c, 'Latn')}" for c in common_word_language(texts)]


def LanguageID(input_column: str = "text", output_column: str = "language", load: Loader = _labels) -> ModelStage:
    """Labels like __label__eng_Latn; line breaks count as spaces."""
    return ModelStage(load, "string", input_column, output_column, 4096, "LanguageID", prepare=lambda t: re.sub(r"[\r\n]+", " ", t).strip())


def trained(model: HashedClassifier, label: str | None = None) -> Loader:
    """A loader for a fitted classifier: the likeliest label of a text, or the probability of one."""
    return lambda: model.best if label is None else model.chance(label)


def NSFW(load: Loader, input_column: str = "text", output_column: str = "nsfw_score") -> ModelStage:
    """The probability of unsafe content, from the model given, such as ``trained(fit_classifier(...), "1")``; 0 for null and
    blank texts."""
    return ModelStage(load, "double", input_column, output_column, 256, "NSFW", empty=0.0)


def AIContentScorer(load: Loader, ai_label: str = "ai", input_column: str = "text", output_column: str = "ai_score") -> ModelStage:
    """The probability of ``ai_label`` (case makes no difference) among a classifier's {label: logit}; 0 for blank texts."""

    def start() -> Batch:
        model = load()

        def score(texts: list[str]) -> list[float]:
            out = []
            for logits in model(texts):
                top = max(logits.values())
                e = {k.casefold(): math.exp(v - top) for k, v in logits.items()}
                out.append(e.get(ai_label.casefold(), 0.0) / sum(e.values()))
            return out

        return score

    return ModelStage(start, "double", input_column, output_column, 64, "AIContentScorer", empty=0.0)


def hashing_embedder(dim: int = 768) -> Loader:
    """Unit vectors of signed hashed words and word pairs: the same everywhere, without a download."""

    def load() -> Batch:
        def embed(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                w = re.findall(r"\w+", t.lower())
                for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
                    h = int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big")
                    out[i, h % dim] += 1 if h & (1 << 31) else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norm > 0, norm, 1)).tolist()

        return embed

    return load


def EmbedText(load: Loader | None = None, dim: int = 768, truncate_dim: int | None = None, input_column: str = "text", output_column: str = "embedding") -> ModelStage:
    """A unit vector of every text; with ``truncate_dim`` cut to that and made unit again."""
    inner = load or hashing_embedder(dim)

    def start() -> Batch:
        model = inner()

        def embed(texts: list[str]) -> list[list[float]]:
            v = np.asarray(model(texts), np.float32)
            if not truncate_dim:
                return v.tolist()
            v = v[:, :truncate_dim]
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return (v / np.where(n > 0, n, 1)).tolist()

        return embed

    return ModelStage(start, "array<float>", input_column, output_column, 64, "EmbedText")


def linear_probe(embedding: Column, weights: Sequence[Sequence[float]], bias: Sequence[float], task: str, index: int) -> Column:
    """The probability of label ``index`` by a linear layer on an embedding; task: binary (one row of weights, two labels),
    multiclass or multilabel. Null where the embedding is null or of another length. Stays in the JVM."""
    if task not in ("binary", "multiclass", "multilabel"):
        raise ValueError(f"Unknown task: {task}")

    def logit(w: Sequence[float], b: float) -> Column:
        row = F.array(*(F.lit(float(x)) for x in w))
        products = F.zip_with(embedding, row, lambda x, y: x.cast("double") * y)
        return F.aggregate(products, F.lit(float(b)), lambda s, x: s + x)

    if task == "multiclass":
        z = F.array(*(logit(w, b) for w, b in zip(weights, bias)))
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        p = F.get(e, F.lit(index)) / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    else:
        one = logit(weights[0 if task == "binary" else index], bias[0 if task == "binary" else index])
        p = 1 / (1 + F.exp(-one))
        p = 1 - p if task == "binary" and index == 0 else p
    return F.when(F.size(embedding) == len(weights[0]), p)


class AttributeModel:
    """Adds the probability of ``label`` by a linear probe. ``source``: a dict, or a JSON file, with weights, bias, task and labels."""

    def __init__(self, source: dict | str, label: str, input_column: str = "embedding", output_column: str | None = None):
        self.spec = source if isinstance(source, dict) else json.loads(open(source, encoding="utf-8").read())
        self.label, self.input_column, self.output_column = label, input_column, output_column or f"{label}_score"
        self.name = "AttributeModel"

    def __call__(self, df: DataFrame) -> DataFrame:
        s = self.spec
        return df.withColumn(self.output_column, linear_probe(F.col(self.input_column), s["weights"], s["bias"], s["task"], s["labels"].index(self.label)))


def clip_prompt(text: str, truncate_to: int | None, count: Callable[[str], int] | None = None, context: int = 8192, max_new: int = 256, overhead: int = 0) -> str:
    """At most ``truncate_to`` characters, and at most as many tokens as the context leaves for the prompt."""
    t = text[:truncate_to] if truncate_to else text
    room = context - max_new - overhead
    if count is None or count(t) <= room:
        return t
    low, high = 0, len(t)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(t[:mid]) <= room else (low, mid - 1)
    return t[:low]


def GenerateText(load: Loader, instruction: str = "", input_column: str = "text", output_column: str = "response", truncate_to: int | None = None, count: Callable[[str], int] | None = None, context: int = 8192, max_new_tokens: int = 256, batch_size: int = 64) -> ModelStage:
    """What a language model answers to the instruction and the text. ``load()`` takes chat turns as
    [{'role': ..., 'content': ...}, ...] in JSON."""
    overhead = count(instruction) if count else 0

    def prepare(t: str) -> str:
        turns = [{"role": "system", "content": instruction}] if instruction else []
        return json.dumps([*turns, {"role": "user", "content": clip_prompt(t, truncate_to, count, context, max_new_tokens, overhead)}])

    return ModelStage(load, "string", input_column, output_column, batch_size, "GenerateText", prepare=prepare)


# Output contracts of the scoring prompts.
QUALITY_SCHEMA = "reasoning string, score int"
MATH_LEVEL_SCHEMA = "level int"
MATH_TOPICS_SCHEMA = "topics array<string>"
MATH_TOPICS = (
    "arithmetic algebra geometry number_theory combinatorics probability statistics calculus differential_equations analysis linear_algebra abstract_algebra topology_geometry logic_foundations "
    "optimization computation applied other"
).split()

# Our own prompts for the usual tasks.
PROMPTS = {
    "math_grade_level": "Judge which school level the mathematics in the text needs, from 0 (none) over 1 (first grades) to 7 (research). Answer with JSON: {\"level\": n}.",
    "math_topic": "Name up to three topics of mathematics that the text is about. Answer with JSON: {\"topics\": [...]}; an empty list if it is about none.",
    "math_edu_score": "Judge how well the text teaches mathematics, from 0 to 5. Answer with JSON: {\"reasoning\": at most 400 characters, \"score\": n}.",
    "webpage_edu_score": "Give the page a point for each: it has some useful facts; it is about a school subject; it explains; it suits a course; it is fit for a textbook. Answer with JSON: {\"reasoning\": ..., \"score\": n}.",
    "textbook_extraction": "Copy the parts of the text that teach, word for word, and leave out everything else.",
    "math_extraction": "Copy the parts of the text that are mathematics, word for word. Answer NO_MATH if there are none.",
    "page_cleaning": "Copy the main text of the page, word for word, without menus, notices and advertising.",
}


def parsed_quality(response: Column) -> Column:
    """struct<reasoning, score> of an answer that keeps the contract (score 0 to 5, reasoning of at most 400 characters), else null."""
    s = F.from_json(response, QUALITY_SCHEMA)
    return F.when(s["score"].between(0, 5) & (F.length(s["reasoning"]) <= 400), s)


def parsed_level(response: Column) -> Column:
    """The school level, 0 to 7, of an answer that keeps the contract, else null."""
    level = F.from_json(response, MATH_LEVEL_SCHEMA)["level"]
    return F.when(level.between(0, 7), level)


def parsed_topics(response: Column) -> Column:
    """The topics of an answer that keeps the contract (at most three, different, all of MATH_TOPICS; perhaps none), else null."""
    t = F.from_json(response, MATH_TOPICS_SCHEMA)["topics"]
    known = F.array(*map(F.lit, MATH_TOPICS))
    fine = (F.size(t) <= 3) & (F.size(F.array_distinct(t)) == F.size(t)) & F.forall(t, lambda x: F.coalesce(F.array_contains(known, x), F.lit(False)))
    return F.when(fine, t)


def OCRText(load: Callable, input_column: str = "image", output_column: str = "text", batch_size: int = 16):
    """Text of images (binary): blocks that only stand for pictures are left out, a degenerate repeated end is cut."""
    from siltstone.functions.vectorised import trim_repeats

    class Stage:
        name = "OCRText"
        key = f"OCRText-{uuid.uuid4()}"

        def __call__(self, df: DataFrame) -> DataFrame:
            key = self.key

            @F.pandas_udf("string")
            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                model = loaded(key, load)
                for s in batches:
                    out = [None] * len(s)
                    todo = [i for i, b in enumerate(s) if b is not None]
                    for k in range(0, len(todo), batch_size):
                        part = todo[k : k + batch_size]
                        for i, t in zip(part, model([s.iloc[i] for i in part])):
                            out[i] = trim_repeats(without_picture_blocks(t))
                    yield pd.Series(out, dtype=object)

            return df.withColumn(output_column, run.asNondeterministic()(F.col(input_column)))

    return Stage()


def without_picture_blocks(text: str) -> str:
    return "\n\n".join(b for b in text.split("\n\n") if not b.lstrip().startswith('<img src="images/bbox_'))
