"""Token counts and pieces of the public tokenizers, whose folder is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
_HELD: dict[str, object] = {}


def tokenizer_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or FOLDER, name)


def _loaded(path: str):
    """The tokenizer, once a worker process."""
    if path not in _HELD:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _HELD[path] = t
    return _HELD[path]


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with ``tokens``: its length in tokens (0 for null or empty text)."""
    file = path or tokenizer_file("byte_bpe_50k.json")
    keep = [f for f in df.schema.fields if f.name not in (text, "tokens")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _loaded(file)
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            n: list[int] = []
            for i in range(0, len(texts), 256):
                n += [len(e.ids) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pdf[[f.name for f in keep]].assign(tokens=n)

    return df.select(*(f"`{f.name}`" for f in keep), f"`{text}`").mapInPandas(run, schema)
