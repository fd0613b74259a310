"""Fitted models on shared storage, so that they are fitted once and used by many runs.

The models of problems 2, 3, 6, 7 and 10 (Labeller, Potentials, Machine, PieceModel) are plain Python objects of numpy arrays
and dictionaries. Every operator that fits one takes it as ``model`` instead, and then reads no row for training. A file is
one row of parquet with the class's name and the object as pickle: load only files that you have written."""

from __future__ import annotations

import pickle

from pyspark.sql import SparkSession

from siltstone.llm.language import PieceModel
from siltstone.llm.markup import Potentials
from siltstone.llm.pages import Labeller
from siltstone.llm.toxicity import Machine

KINDS = {k.__name__: k for k in (Labeller, Potentials, Machine, PieceModel)}


def save(spark: SparkSession, model: object, path: str) -> None:
    """Write ``model`` to ``path``, in place of what is there."""
    name = type(model).__name__
    if name not in KINDS:
        raise TypeError(f"not a model of this package: {name}")
    spark.createDataFrame([(name, bytearray(pickle.dumps(model)))], "kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str):
    """The model that ``save`` wrote to ``path``."""
    row = spark.read.parquet(path).first()
    model = pickle.loads(bytes(row["model"]))
    if type(model) is not KINDS.get(row["kind"]):
        raise TypeError(f"{path} holds no model of this package")
    return model
