"""The whole redaction of a document, as one projection without a shuffle: in Python by batches, or as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_table_rows
from ..operators.detect import spans_of
from ..operators.ner import cleaned, cleaned_of
from ..operators.scan import resolved
from ..operators.spans import counts, ids_near_names, merged, redacted


def redact_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, redacted_text, label_counts, n_spans, spans from patterns alone; a null text stays null, without spans.

    Texts go through scan.resolved(), what it leaves out through finish(), as nulls do.
    """
    base = docs.select(key, "text", resolved(F.col("text"), rows=True, put=True).alias("done"))
    base = base.select(key, "done", collapse_table_rows(F.when(F.col("done").isNull(), F.col("text"))).alias("text"))
    return finish(base.withColumn("found", spans_of(F.col("text"))), key)


def finish(found: DataFrame, key: str) -> DataFrame:
    """Each step is a projection of its own behind a column that Catalyst may not fold into the next one twice; done: as
    scan.resolved() gives it, what is done already."""
    text = F.col("text")
    step = found.select(key, "text", "done", F.inline_outer(F.array(F.struct(merged(F.col("found")).alias("first")))))
    last = F.coalesce("done.spans", merged(F.concat("first", ids_near_names(text, F.col("first")))))
    step = step.select(key, "text", "done", F.inline_outer(F.array(F.struct(last.alias("spans")))))
    new = F.coalesce("done.text", redacted(text, F.col("spans")))
    return step.select(key, new.alias("redacted_text"), counts(F.col("spans")).alias("label_counts"), F.size("spans").alias("n_spans"), "spans")


def redact_with_model(docs: DataFrame, make, key: str = "doc_id") -> DataFrame:
    """redact_documents() with a model's spans: they come first, cleaned against the patterns' spans."""
    base = docs.select(key, "text", resolved(F.col("text"), True, True, cleaned(make)).alias("done"))
    base = base.select(key, "done", collapse_table_rows(F.when(F.col("done").isNull(), F.col("text"))).alias("text"))
    base = base.select(key, "done", "text", F.inline_outer(F.array(F.struct(spans_of(F.col("text")).alias("regex")))))
    base = base.withColumn("model", cleaned_of(F.col("text"), F.col("regex"), make))
    return finish(base.withColumn("found", F.concat("model", "regex")), key)
