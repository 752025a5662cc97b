"""Span algebra, in two forms: on the array of a document's spans (no shuffle), and on tables of spans (windows).

Spans are (start, end, label, text, score, ord): code points, the end exclusive; ord keeps the order in which they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import before_each, between, in_pieces, let, numbers
from ..functions.patterns import BARE_STAMP, PLACEHOLDERS, SUFFIXES
from ..functions.text import find_all
from .detect import FULL_SPAN

WORD = r"^[\p{L}\p{N}]$"


def in_order(spans: Column) -> Column:
    """By start, longest first, then as they came."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def merged(spans: Column) -> Column:
    """Overlapping spans become one with the first one's label and text; touching ones stay apart."""

    def islands(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: s["end"])
        reach = before_each(ends, F.lit(-1), lambda a, b: F.greatest(a, b))
        fresh = let(reach, lambda r: F.filter(numbers(F.size(ss)), lambda i: F.get(ss, i)["start"] >= F.get(r, i)))
        return let(ends, lambda es: let(fresh, lambda fs: F.transform(fs, lambda f, k: one(ss, es, f, F.coalesce(F.get(fs, k + 1), F.size(ss))))))

    def one(ss: Column, ends: Column, first: Column, after: Column) -> Column:
        s, end = F.get(ss, first), F.array_max(F.slice(ends, first + 1, after - first))
        score = F.when(end == s["end"], s["score"])
        return F.struct(s["start"].alias("start"), end.alias("end"), s["label"].alias("label"), s["text"].alias("text"), score.alias("score"), s["ord"].alias("ord"))

    return let(in_order(spans), islands).cast(FULL_SPAN)


def ids_near_names(text: Column, spans: Column, window: int = 60) -> Column:
    """Short numbers within `window` of a NAME span, unless a span covers them, as DOCTOR_ID spans."""
    names = F.filter(spans, lambda s: s["label"] == "NAME")
    near = lambda m: F.exists(names, lambda s: (s["start"] - window <= m["end"]) & (m["start"] <= s["end"] + window))
    covered = lambda m: F.exists(spans, lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"]))
    found = F.filter(find_all(text, BARE_STAMP), lambda m: near(m) & ~covered(m))
    found = F.transform(found, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("DOCTOR_ID").alias("label"), m["text"].alias("text"), F.lit(None).cast("double").alias("score"), (F.lit(90_000_000) + i).alias("ord")))
    return F.when(F.size(names) > 0, found).otherwise(F.array()).cast(FULL_SPAN)


def placeholder(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, label), F.concat(F.lit("[REDACTED_"), label, F.lit("]")))


def redacted(text: Column, spans: Column) -> Column:
    """text with each of the spans, disjoint and in order, replaced by its placeholder."""

    def put(pieces: Column, ss: Column) -> Column:
        end = lambda i: F.coalesce(F.get(ss, i)["end"], F.lit(0))
        filled = F.transform(ss, lambda s, i: F.concat(between(pieces, end(i - 1), s["start"] - end(i - 1)), placeholder(s["label"])))
        last = end(F.size(ss) - 1)
        return F.array_join(F.concat(filled, F.array(between(pieces, last, F.length(text) - last))), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(in_pieces(text), lambda ps: let(spans, lambda ss: put(ps, ss))))


def counts(spans: Column) -> Column:
    """map of label to number of spans."""
    labels = F.transform(spans, lambda s: s["label"])
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x)))))


def ordered_counts(spans: Column) -> Column:
    """array<struct<n, label>>: most frequent first, ties as they first appear."""
    labels = F.transform(spans, lambda s: s["label"])
    each = F.transform(F.array_distinct(labels), lambda x, i: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("m"), i.alias("i"), x.alias("label")))
    return F.transform(F.array_sort(each), lambda x: F.struct((-x["m"]).alias("n"), x["label"].alias("label")))


def merge_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """merged(), on a table of spans: one shuffle on the document, gaps and islands in a window."""
    order = [F.col("start"), (F.col("start") - F.col("end")), F.col("ord")]
    w = Window.partitionBy(key).orderBy(*order)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    island = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    first = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    one = island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", first).alias("label"), F.min_by("text", first).alias("text"), F.count("*").alias("n_spans"))
    return one.drop("_island")


def components(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans with the number of their component: neighbours of one label that touch or overlap.

    A span is compared with the last component only, so spans of another label between two split them.
    """
    w = Window.partitionBy(key).orderBy("start", "end", "ord")
    run = spans.withColumn("_turn", F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)).withColumn("_run", F.sum("_turn").over(w))
    inside = Window.partitionBy(key, "_run").orderBy("start", "end", "ord")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    new = run.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return new.withColumn("component", F.sum("_new").over(w)).drop("_turn", "_run", "_new")


def drop_midword(docs: DataFrame, ner: DataFrame, regex: DataFrame, key: str = "doc_id") -> DataFrame:
    """Model spans without those that end inside a word, unless they are inflected or pieces of a longer name.

    Spans of components that end at words stay as they are.  A component that ends inside a word goes if a regex span
    covers it; a NAME or LOCATION of which only a case suffix is missing, and a NAME of several words, grow to whole
    words; all others go.  Joins have the document as key and the range as a residual condition.
    """
    parts = components(ner, key)
    whole = parts.groupBy(key, "component").agg(F.min("start").alias("c_start"), F.max("end").alias("c_end"), F.min_by("label", F.struct("start", "end", "ord")).alias("c_label"), F.max(F.coalesce("score", F.lit(0.0))).alias("c_score"), F.min("ord").alias("c_ord"))
    at = lambda p: F.col("doc_text").substr(p + 1, F.lit(1)).rlike(WORD)
    a, b, n = F.col("c_start"), F.col("c_end"), F.length("doc_text")
    left, right = F.col("doc_text").substr(F.lit(1), a), F.col("doc_text").substr(b + 1, n)
    judged = whole.join(docs.select(key, F.col("text").alias("doc_text")), key)
    judged = judged.withColumn("mid_start", (a > 0) & at(a - 1) & at(a)).withColumn("mid_end", (b < n) & at(b - 1) & at(b))
    judged = judged.withColumn("before", F.regexp_extract(left, r"([\p{L}\p{N}]*)\z", 1)).withColumn("after", F.regexp_extract(right, r"^([\p{L}\p{N}]*)", 1))
    judged = judged.withColumn("several", (F.col("c_label") == "NAME") & F.col("doc_text").substr(a + 1, b - a).rlike(r"(?U)\s"))
    inflected = ~F.col("mid_start") & F.lower("after").isin(SUFFIXES) & F.col("c_label").isin("NAME", "LOCATION")
    judged = judged.withColumn("grow", inflected | F.col("several")).withColumn("mid", F.col("mid_start") | F.col("mid_end"))
    clean = parts.join(judged.where("not mid").select(key, "component"), [key, "component"]).select(key, "start", "end", "label", "text", "score", "ord")
    mid = judged.where("mid and grow")
    r = regex.select(F.col(key).alias("_k"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    mid = mid.join(r, (F.col(key) == F.col("_k")) & (F.col("r_start") <= a) & (b <= F.col("r_end")), "left_anti")
    begin, stop = a - F.length("before"), b + F.length("after")
    grown = mid.select(key, begin.cast("int").alias("start"), stop.cast("int").alias("end"), F.col("c_label").alias("label"), F.col("doc_text").substr(begin + 1, stop - begin).alias("text"), F.col("c_score").alias("score"), F.col("c_ord").alias("ord"))
    return clean.unionByName(grown)
