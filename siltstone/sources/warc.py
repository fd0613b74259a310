"""WARC files as a data source, and the pages in them."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.operators.extract import decode_page
from siltstone.sources.storage import list_files, open_file

COLUMNS = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date")


def records(path: str) -> Iterator[tuple]:
    """The records of a file, plain or gzip (a member a record): the headers of COLUMNS, the payload, the path. A payload
    is read by its length, one record in memory at a time."""
    with open_file(path) as raw, (gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)) as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            for line in iter(f.readline, b""):
                if line in (b"\r\n", b"\n"):
                    break
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip().lower()] = v.strip()
            body = f.read(int(head.get("content-length", 0)))
            yield (*(head.get(c.lower()) for c in COLUMNS), body, path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, paths: str | None = None):
        self.path, self.paths = path, paths

    def partitions(self) -> list[_File]:
        if self.paths is not None:
            return [_File(p) for p in self.paths.split("\n")]
        return [_File(p) for p, _ in list_files(self.path, (".warc", ".warc.gz"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            yield from records(partition.path)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``: a partition a file, on any storage that Arrow opens and every executor sees. A
    file is a stream of gzip members, which can't be entered in the middle, so it is read by one task, a record at a time.
    ``paths`` (option, one a line): these files instead of a listing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in COLUMNS) + ", warc_content binary, source_path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("paths"))


def read_warc(spark: SparkSession, path: str, file_path_column_name: str | None = None, paths: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    df = (reader if paths is None else reader.option("paths", "\n".join(paths))).load(path)
    return df.withColumnRenamed("source_path", file_path_column_name) if file_path_column_name else df.drop("source_path")


class WarcProcessor:
    """Keeps responses and gives their pages: record id, address, date and decoded html (null where it can't be decoded)."""

    name = "WarcProcessor"

    def __call__(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def page(raw: pd.Series) -> pd.Series:
            def one(b: bytes | None) -> str | None:
                if b is not None and b[:5] == b"HTTP/":
                    b = b.partition(b"\r\n\r\n")[2]
                return decode_page(b)

            return raw.map(one, na_action=None)

        return df.filter(F.col("`WARC-Type`") == "response").select("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", page("warc_content").alias("html"))
