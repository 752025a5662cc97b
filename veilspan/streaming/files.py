"""Streaming: new files through the pipeline, and the state of each file from its events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.pipeline import redact_documents

EVENTS = "seq long, path string, stage string, counts map<string,bigint>, error string"
STATE = "status string, seq long, counts map<string,bigint>, counts_seq long, error string"


def redact_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, text: Callable[[DataFrame], DataFrame] | None = None):
    """Every new Markdown file of a folder, redacted, into a Parquet table; gives the query.

    text: what makes (doc_id, text) of the new files (path, content); by default they are decoded.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(folder)
    docs = text(files) if text else files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        redact_documents(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


class Latest(StatefulProcessor):
    """Keeps each path's latest state; events that come late change nothing that is newer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, seq, counts, counts_seq, error = self.state.get() if self.state.exists() else (None, -1, None, -1, None)
        for b in rows:
            for r in b.itertuples():
                if r.seq >= seq:
                    status, seq, error = r.stage, r.seq, r.error
                if r.counts and r.seq >= counts_seq:
                    counts, counts_seq = dict(r.counts), r.seq
        self.state.update((status, int(seq), counts, int(counts_seq), error))
        yield pd.DataFrame([{"path": key[0], "status": status, "counts": counts, "error": error}])

    def close(self) -> None:
        pass


#: State of this kind needs the store that keeps it on disk.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def queue_stream(events: DataFrame) -> DataFrame:
    """The latest state of each path, in update mode, from a stream of events; sets the session's state store to ROCKS."""
    events.sparkSession.conf.set(STORE, ROCKS)
    return events.groupBy("path").transformWithStateInPandas(Latest(), "path string, status string, counts map<string,bigint>, error string", "update", "none")
