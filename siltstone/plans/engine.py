"""Composition of stages, jobs, and the two ready-made pipelines."""

from __future__ import annotations

import argparse
import json
import logging
import os
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectorised import per_text
from siltstone.operators.dedup import DeduplicationStage, FirstByKey, fuzzy_dedupe
from siltstone.operators.extract import html_to_text
from siltstone.operators.filters import RowFilter
from siltstone.operators.models import PROMPTS, GenerateText, Loader, parsed_quality
from siltstone.session import build_session
from siltstone.sources.storage import list_files

Stage = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


class DataEngine:
    """Stages one after the other; an engine is itself a stage.

    A deduplicator after row filters takes its result from the frame before them, so that they are evaluated once."""

    def __init__(self, components: Sequence[Stage] = (), name: str = "DataEngine"):
        self.components, self.name = list(components), name

    def add(self, stage: Stage) -> DataEngine:
        self.components.append(stage)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        base = df  # of which row filters alone have made df
        for stage in self._stages():
            if isinstance(stage, (FirstByKey, DeduplicationStage)):
                df = base = stage(df, base)
            elif isinstance(stage, RowFilter):
                df = df.transform(stage)
            else:
                df = base = df.transform(stage)
        return df

    def _stages(self) -> list[Stage]:
        """The stages, those of engines within this one too."""
        return [s for c in self.components for s in (c._stages() if isinstance(c, DataEngine) else [c])]

    __call__ = run

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(getattr(c, 'name', type(c).__name__) for c in self.components)})"


def json_arg(value: str):
    """A JSON value given as such or as the name of a file."""
    if os.path.exists(value):
        with open(value, encoding="utf-8") as f:
            return json.load(f)
    return json.loads(value)


class JobRunner:
    """Runs a pipeline over parquet files as one Spark job. ``task_id`` of ``num_tasks``: only every num_tasks-th input
    file, largest first, for schedulers that start independent tasks; without them Spark spreads the files itself."""

    def __init__(self, input_path: str, output_path: str, task_id: int | None = None, num_tasks: int = 1):
        self.input_path, self.output_path, self.task_id, self.num_tasks = input_path, output_path, task_id, num_tasks

    @classmethod
    def from_args(cls, args: Sequence[str] | None = None) -> JobRunner:
        p = argparse.ArgumentParser()
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--task-id", type=int)
        p.add_argument("--num-tasks", type=int, default=1)
        a = p.parse_args(args)
        return cls(a.input, a.output, a.task_id, a.num_tasks)

    def files(self) -> list[str]:
        found = [p for p, _ in sorted(list_files(self.input_path, (".parquet",)), key=lambda x: (-x[1], x[0]))]
        return found[self.task_id :: self.num_tasks] if self.task_id is not None else found

    def run(self, spark: SparkSession, pipeline: Stage) -> str | None:
        if self.task_id is None:
            source, out = [self.input_path], self.output_path
        else:
            source, out = self.files(), os.path.join(self.output_path, f"task_{self.task_id:05d}")
            if not source:
                return None
        began = time.time()
        reader = spark.read.option("recursiveFileLookup", "true")
        pipeline(reader.parquet(*source)).write.mode("overwrite").parquet(out)
        log.info("%s: %.1f s", out, time.time() - began)
        return out


# ---- forum posts


def fuzzy_job(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """Near duplicates of parquet files out, as one job: --input, --output, --work (stages are kept there and not run again
    after a failure), --key, --text, --threshold. Command line: python -m siltstone.plans.fuzzy_job ..."""
    p = argparse.ArgumentParser()
    for name in ("--input", "--output", "--work"):
        p.add_argument(name, required=True)
    p.add_argument("--key", default="doc_id")
    p.add_argument("--text", default="paragraph_text")
    p.add_argument("--threshold", type=float, default=0.8)
    a = p.parse_args(args)
    spark = spark or build_session("fuzzy_job")
    kept = fuzzy_dedupe(spark.read.parquet(a.input), a.key, a.text, threshold=a.threshold, folder=a.work)
    kept.write.mode("overwrite").parquet(a.output)
    return a.output


def posts_to_text(posts: DataFrame, min_length: int = 0, max_length: int = 10_000_000) -> DataFrame:
    """Posts with ``text`` in place of ``html``; only texts longer than the one and shorter than the other bound."""
    wrapped = F.concat(F.lit("<html><body>"), F.col("html"), F.lit("</body></html>"))
    out = posts.withColumn("text", per_text(html_to_text, "string").asNondeterministic()(wrapped)).drop("html")
    return out.filter((F.length("text") > min_length) & (F.length("text") < max_length))


def qa_pairs(posts: DataFrame, min_score: int = 5) -> DataFrame:
    """Answers with their questions: questions of ``min_score`` or more, answers of ``min_score`` or more or accepted."""
    q = posts.filter((F.col("post_type_id") == 1) & (F.col("score") >= min_score)).select(F.col("id").alias("question_id"), "title", F.col("text").alias("question"), F.col("score").alias("question_score"), "accepted_answer_id")
    a = posts.filter(F.col("post_type_id") == 2).select(F.col("id").alias("answer_id"), F.col("parent_id").alias("question_id"), F.col("text").alias("answer"), F.col("score").alias("answer_score"))
    accepted = F.col("answer_id") == F.col("accepted_answer_id")
    return a.join(q, "question_id").filter((F.col("answer_score") >= min_score) | accepted).withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("accepted_answer_id")


# ---- personas


def find_personas(personas: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Rows whose occupation holds one of the keywords; none without keywords."""
    test: Column = F.lit(False)
    for k in keywords:
        test = test | F.contains(F.lower("occupation"), F.lit(k.lower()))
    return personas.filter(F.coalesce(test, F.lit(False)))


def persona_prompts(docs: DataFrame, personas: Sequence[str], doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Adds ``persona``, chosen by a hash of the id, and ``prompt``, the request for a search query in that person's words."""
    if not personas:
        raise ValueError("no personas")
    chosen = F.get(F.array(*map(F.lit, personas)), F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(len(personas))).cast("int"))
    docs = docs.withColumn("persona", chosen)
    return docs.withColumn("prompt", F.concat(F.lit("You are: "), "persona", F.lit('\nWrite one search query that the text below answers, as JSON {"query": ...}.\n\n'), F.coalesce(F.col(text), F.lit(""))))


def generate_queries(docs: DataFrame, personas: Sequence[str], load: Loader, doc_id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with ``persona``, the model's ``response`` to the prompt and the ``query`` in it (null where it isn't JSON with one)."""
    asked = GenerateText(load, input_column="prompt", output_column="response")(persona_prompts(docs, personas, doc_id, text, seed))
    return asked.withColumn("query", query_of(F.col("response"))).drop("prompt")


def edu_scores(docs: DataFrame, load: Loader, prompt: str = "webpage_edu_score", text: str = "text", truncate_to: int | None = None) -> DataFrame:
    """``docs`` with ``response`` and what it says by the contract: ``reasoning`` and ``score`` (both null where it breaks it)."""
    asked = GenerateText(load, PROMPTS[prompt], text, "response", truncate_to)(docs)
    said = parsed_quality(F.col("response"))
    return asked.withColumn("reasoning", said["reasoning"]).withColumn("score", said["score"])


def query_of(response: Column) -> Column:
    return F.get_json_object(response, "$.query")
