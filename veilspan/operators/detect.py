"""Detectors: personal data in text as spans.  All twenty patterns are evaluated in one projection, without a shuffle.

A span that lies in one found before needs no test of its own: merging drops it without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import in_pieces, let
from ..functions.patterns import BIRTH_CONTEXT, DETECTORS, INSTITUTION, NEEDS, TAJ_BEFORE
from ..functions.text import before, find_all, line_before

FULL_SPAN = "array<struct<start:int,end:int,label:string,text:string,score:double,ord:int>>"
#: Shortest names: with a field label, and with a title or the like.
LEAST = {"name_field": 4, "name_table": 4, "name_dr_prefix": 2, "name_dr_suffix": 2, "name_title": 2, "name_reszere": 2}
WEIGHTS = (3, 7, 3, 7, 3, 7, 3, 7)


def checksum(number: Column) -> Column:
    """Whether nine digits end in their check digit; False for digits that are no ASCII digits."""
    digits = F.regexp_replace(number, r"[-\s ]", "")
    digit = lambda i: F.substring(digits, i + 1, 1).try_cast("int")
    total = sum((digit(i) * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    return F.coalesce((total % 10 == digit(8)) & (F.length(digits) == 9), F.lit(False))


def is_birth(pieces: Column, at: Column) -> Column:
    """A birth word on the line before; or else, without another field's colon there, in the 80 characters before."""
    line = line_before(pieces, at)
    return line.rlike(BIRTH_CONTEXT) | (~line.contains(":") & before(pieces, at, 80).rlike(BIRTH_CONTEXT))


RULES = ("taj", "dob_numeric", "dob_text")


def keep(name: str, pieces: Column, span: Column) -> Column:
    """What a match of the detector has to meet besides its pattern."""
    if name == "taj":
        known = checksum(span["text"]) | before(pieces, span["start"], 60).rlike(TAJ_BEFORE)
        return known & ~before(pieces, span["start"], 12).rlike(INSTITUTION)
    return is_birth(pieces, span["start"])


def spans_of(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """Spans of the detectors (or of those named) as one array: start, end, label, text, score (null), ord."""
    parts = [one(text, rank, *d) for rank, d in enumerate(DETECTORS) if not only or d[0] in only]
    return F.coalesce(F.concat(*parts) if len(parts) > 1 else parts[0], F.array()).cast(FULL_SPAN)


def one(text: Column, rank: int, name: str, label: str, where: str, pattern: str) -> Column:
    """A detector's spans.  Its pattern is tried only on texts that have what it needs."""
    needed = F.lit(True)
    for need in NEEDS[name]:
        needed = needed & (text.contains(need) if need.isalnum() or need == "@" else text.rlike(need))
    spans = find_all(text, pattern, where)
    if name in RULES:
        some = lambda ss: F.when(F.size(ss) > 0, let(in_pieces(text), lambda ps: F.filter(ss, lambda s: keep(name, ps, s)))).otherwise(ss)
        spans = let(spans, some)
    elif name in LEAST:
        spans = F.filter(spans, lambda s: F.length(s["text"]) >= LEAST[name])
    order = lambda i: (F.lit((rank + 1) * 1_000_000) + i).alias("ord")
    full = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"), s["text"].alias("text"), F.lit(None).cast("double").alias("score"), order(i))
    return F.when(needed, F.transform(spans, full)).otherwise(F.array().cast(FULL_SPAN))


def detect(docs: DataFrame, only: tuple[str, ...] | None = None, key: str = "doc_id") -> DataFrame:
    """One row for each span of each document; a null text has none."""
    from .scan import found  # which needs this module

    return docs.select(key, F.inline(found(F.col("text"), only)))
