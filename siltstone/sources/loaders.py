"""Readers by format, with resumable reading: files that a run has finished aren't read again."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.session import exists
from siltstone.sources.storage import list_files
from siltstone.sources.warc import read_warc

POST_COLUMNS = "id bigint, post_type_id int, parent_id bigint, score int, accepted_answer_id bigint, title string, html string"


class DataLoader:
    """Reads files of one format.

    ``checkpoint_path``: a folder in which finished keys are kept; what has been finished is left out. The keys of a run count
    as finished when ``commit`` is called, after its results are written. ``checkpoint_on``: a key column, whose finished
    values are taken out after reading; by default the file's path, and finished files aren't opened at all.
    ``file_path_column_name``: keep the path in the result under this name."""

    format = ""
    suffixes: tuple[str, ...] = ("",)

    def __init__(self, checkpoint_path: str | None = None, checkpoint_on: str = "source_path", file_path_column_name: str | None = None, schema: StructType | str | None = None, **options):
        if checkpoint_on != "source_path" and not checkpoint_path:
            raise ValueError("checkpoint_on needs checkpoint_path")
        self.checkpoint_path, self.checkpoint_on, self.path_column, self.schema, self.options = checkpoint_path, checkpoint_on, file_path_column_name, schema, options
        self._read: DataFrame | None = None

    def _load(self, spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
        r = spark.read.format(self.format).options(recursiveFileLookup="true", **self.options)
        if self.schema is not None:
            r = r.schema(self.schema)
        return r.load(path if paths is None else paths).withColumn("source_path", F.col("_metadata.file_path"))

    def read_data(self, spark: SparkSession, path: str) -> DataFrame:
        done = spark.read.parquet(self.checkpoint_path) if self.checkpoint_path and exists(spark, self.checkpoint_path) else None
        if self.checkpoint_path and self.checkpoint_on == "source_path":
            found = [p for p, _ in list_files(path, self.suffixes) if not posixpath.basename(p).startswith(("_", "."))]
            files = spark.createDataFrame([(p,) for p in found], "key string")
            if done is not None:
                files = files.join(done, "key", "left_anti")
            todo = sorted(r["key"] for r in files.collect())  # names of files, which the driver lists for any scan
            df = self._load(spark, path, todo) if todo else self._load(spark, path).limit(0)
            self._read = spark.createDataFrame([(p,) for p in todo], "key string")
        else:
            df = self._load(spark, path)
            if self.checkpoint_path:
                if done is not None:
                    df = df.join(done.select(F.col("key").alias(self.checkpoint_on)), self.checkpoint_on, "left_anti")
                self._read = df.select(F.col(self.checkpoint_on).cast("string").alias("key")).distinct()
        return df.withColumnRenamed("source_path", self.path_column) if self.path_column else df.drop("source_path")

    def commit(self) -> None:
        """Marks what the last ``read_data`` read as finished. By files nothing is read again; by a key column the keys are."""
        if self._read is not None:
            self._read.write.mode("append").parquet(self.checkpoint_path)
            self._read = None


class ParquetLoader(DataLoader):
    format, suffixes = "parquet", (".parquet",)


class JsonLoader(DataLoader):
    format = "json"


class CsvLoader(DataLoader):
    """With a header; types are inferred unless a schema is given, which saves a pass over the data."""

    format = "csv"

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **({"header": "true", "inferSchema": "true"} | kwargs))


class WarcLoader(DataLoader):
    suffixes = (".warc", ".warc.gz")

    def _load(self, spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
        return read_warc(spark, path, "source_path", paths)


class LanceLoader(DataLoader):
    """Needs a Lance connector on the session's class path."""

    format = "lance"

    def _load(self, spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
        try:
            return spark.read.format(self.format).load(path).withColumn("source_path", F.lit(path))
        except Exception as e:
            raise RuntimeError("reading Lance needs its Spark connector on the class path") from e


class HuggingFaceLoader(DataLoader):
    """Needs a network and the hub's library, whose parquet files it hands to Spark. ``folder``: where they are kept, on
    storage that every executor sees; it may be left out on one machine only."""

    def __init__(self, *args, folder: str | None = None, **kwargs):
        super().__init__(*args, **kwargs)
        self.folder = folder

    def _load(self, spark: SparkSession, path: str, paths: list[str] | None = None) -> DataFrame:
        try:
            from huggingface_hub import snapshot_download
        except ImportError as e:
            raise RuntimeError("reading from a hub needs huggingface_hub and a network") from e
        if self.folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share")
        got = snapshot_download(path, repo_type="dataset", local_dir=self.folder and f"{self.folder}/{path}")
        return spark.read.option("recursiveFileLookup", "true").parquet(got).withColumn("source_path", F.lit(path))


LOADERS = {"parquet": ParquetLoader, "json": JsonLoader, "csv": CsvLoader, "warc": WarcLoader, "lance": LanceLoader, "huggingface": HuggingFaceLoader}


def read_posts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers of a forum dump (rows as <row Id=... Body=.../>), with the body as html."""
    wanted = {"Id": "bigint", "PostTypeId": "int", "ParentId": "bigint", "Score": "int", "AcceptedAnswerId": "bigint", "Title": "string", "Body": "string"}
    raw = spark.read.format("xml").option("rowTag", "row").schema(", ".join(f"_{k} {v}" for k, v in wanted.items())).load(path)
    names = [x.split()[0] for x in POST_COLUMNS.split(", ")]
    return raw.filter(F.col("_PostTypeId").isin(1, 2)).select(*(F.col(f"_{k}").alias(n) for k, n in zip(wanted, names)))


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
