"""Sinks: redacted documents, events, and the marker of a verified run."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(redacted: DataFrame, path: str) -> None:
    """The usual sink: a Parquet table, put in place of a run before."""
    redacted.write.mode("overwrite").parquet(path)


def write_files(redacted: DataFrame, folder: str) -> DataFrame:
    """One <name>.md for each row (name, text), written by tasks; gives (name, bytes).  A file is replaced whole, so that a
    task that runs again leaves the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(root)
        for b in batches:
            sizes = []
            for name, text in zip(b["name"], b["text"], strict=True):
                data = (text or "").encode()
                with fs.open_output_stream(f"{root}/{name}.md") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"name": b["name"], "bytes": sizes})

    return redacted.select("name", "text").mapInPandas(run, "name string, bytes long")


def marker(runs: DataFrame, path: str) -> None:
    """{status, inputs, outputs} of a verified run (path, output, ok) as JSON; a run's list of files, made in one task."""
    out = runs.agg(F.when(F.bool_and("ok"), "ok").otherwise("failed").alias("status"), F.array_sort(F.collect_list("path")).alias("inputs"), F.array_sort(F.collect_list("output")).alias("outputs"))
    out.write.mode("overwrite").json(path)
