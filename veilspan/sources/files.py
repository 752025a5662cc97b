"""Sources: folders of documents, Markdown files, manifests, settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_folder(spark: SparkSession, path: str, case_sensitive: bool = False) -> DataFrame:
    """path, content of the PDF files right in a folder, with `name`; sort by it for the reference order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf" if case_sensitive else "*.[pP][dD][fF]").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def explicit(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, ord, in the order given."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord int")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """model, base_url, name, bytes, sha256 of each file of a model manifest."""
    file = "array<struct<name:string,bytes:bigint,sha256:string>>"
    schema = f"models array<struct<name:string,description:string,approx_size_mb:double,base_url:string,files:{file}>>"
    models = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("models").alias("m"))
    return models.select(F.col("m.name").alias("model"), F.col("m.base_url").alias("base_url"), F.explode("m.files").alias("f")).select("model", "base_url", "f.*")


def convert(files: DataFrame, make: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """path, text, error: each file's content made Markdown by a converter that is built once for each task.

    What a file raises becomes its error; what the building raises ends the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = make()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, converter(bytes(content)), None))
                except Exception as e:  # one file's failure is its own
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")
