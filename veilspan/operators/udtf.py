"""SQL: pii_spans(text), a table function with the spans that redaction replaces in a text.

For queries in SQL alone.  It reads texts by batches; those that aren't alike are searched one by one, by the regex module.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .detect import FULL_SPAN
from .scan import Scanner, Span, groups, lists, merge, scanner


def compiled(pattern: str):
    import regex

    flags = re.match(r"\(\?(i?)[uU]\)", pattern)
    return regex.compile(("(?i)" if flags[1] else "") + pattern[flags.end() :] if flags else pattern, regex.V0)


@functools.cache
def careful() -> Scanner:
    return Scanner(compiled=compiled)


class PiiSpans:
    def of(self, texts: list[str | None]) -> list[list[Span] | None]:
        """Of each text its spans; None for None."""
        out: list[list[Span] | None] = [None] * len(texts)
        for some in groups(texts):
            self.put(scanner(None), texts, some, out)
        for i, t in enumerate(texts):
            if t is not None and out[i] is None:
                self.put(careful(), texts, [i], out)
        return out

    def put(self, scan: Scanner, texts: list[str | None], some: list[int], out: list[list[Span] | None]) -> None:
        own = [texts[i] for i in some]
        first = [merge(s) for s in scan.found(own)]
        for i, a, b in zip(some, first, scan.near(own, first), strict=True):
            out[i] = merge(a + b) if b else a

    def eval(self, text: str | None) -> Iterator[tuple]:
        for a, b, _, label, found, _ in self.of([text])[0] or ():
            yield a, b, label, found


def span_lists(texts: pa.Array) -> pa.Array:
    return lists(PiiSpans().of(texts.to_pylist()))


def register(spark: SparkSession) -> None:
    """Make pii_spans(text) known to the session's SQL: SELECT doc_id, s.* FROM docs, LATERAL pii_spans(text) s

    A Python table function would be called for each row, so it is one of SQL over an Arrow function.
    """
    spark.udf.register("pii_span_lists", F.arrow_udf(span_lists, FULL_SPAN))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(text STRING) RETURNS TABLE (start INT, end INT, label STRING, text STRING) RETURN SELECT s.start, s.end, s.label, s.text FROM inline(pii_span_lists(text)) AS s")
