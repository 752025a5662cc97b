"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact length for each source.  A source's budget is filled with whole passes over it, then with
the same share of every length, and what is left of the budget by a bounded-knapsack dynamic program over the lengths.
Which documents of a length are taken is decided by a seeded hash of the id.

Edge cases: a null or empty text has size 0 and is never short of its target (taken 0); a null source is a source of its
own, after all others; repeated rows are documents of their own; an empty table gives an empty result; a source with only
empty documents has target 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table, written

#: Budget left to the dynamic program at most (in words, besides one longest document): its bitset has as many bits.
KNAPSACK = 1 << 16
#: Pieces of a group of equal source and length, by hash, in which ranks are counted separately.
PIECES = 512


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """All words shared by weight, none above cap times its own size; the excess goes to the others by weight."""
    total, targets, left = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    rest = total
    while left:
        whole = sum(weights[i] for i in left)
        full = [i for i in left if rest * weights[i] / whole > cap * sizes[i]]
        if not full:
            for i in left:
                targets[i] = rest * weights[i] / whole
            break
        for i in full:
            targets[i] = cap * sizes[i]
            rest -= targets[i]
        left = [i for i in left if i not in set(full)]
    return targets


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, of at most counts, so that the sum is as close below the budget as can be."""
    taken = np.zeros(len(sizes), np.int64)
    reached, mask, parts = 1, (1 << (budget + 1)) - 1, []
    by = np.zeros(budget + 1, np.int32)
    for i in np.argsort(-sizes, kind="stable"):
        left, step = min(int(counts[i]), budget // int(sizes[i])), 1
        while left > 0 and not reached >> budget & 1:
            k = min(step, left)
            new = (reached << (k * int(sizes[i]))) & mask & ~reached
            if new:
                parts.append((int(i), k))
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(parts)
                reached |= new
            left, step = left - k, step * 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at:
        i, k = parts[by[at] - 1]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come to the budget, or as near below as can be."""
    whole = int((sizes * counts).sum())
    if budget >= whole:
        return counts.copy()
    taken = (counts * (budget / whole)).astype(np.int64)
    left = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= KNAPSACK:
            break
        more = min(int(counts[i] - taken[i]), max(0, left - KNAPSACK) // int(sizes[i]))
        taken[i] += more
        left -= more * int(sizes[i])
    return taken + knapsack(sizes, counts - taken, left)


ADDED = ("size", "source_size", "target", "taken", "repeats")


def sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """What a row is chosen by: doc_id, source, size, h (a hash of the id), piece; and more columns."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *more)
    return base.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))).withColumn("piece", F.pmod("h", F.lit(PIECES)).cast("int"))


def mix(docs: DataFrame, weight: Callable[[int], float] = lambda i: 1 + i % 3, cap: float = 3.0, seed: int = 1, whole: bool = False) -> DataFrame:
    """doc_id, source, and ADDED for every row of docs: its size, its source's size and target, the words that the mix takes
    of it, and how often it takes it.

    whole: all columns of docs, in place of doc_id and source, and ADDED behind them, with underscores where a name is taken.
    weight: of the i-th source by code point, null last.  One row for each source goes to the driver (as many as there
    are mixture weights), nothing that grows with the documents.
    """
    spark = docs.sparkSession
    base = written(sized(docs, seed), "mix")
    totals = {r["source"]: int(r["s"]) for r in base.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    targets = share([totals[s] for s in order], [weight(i) for i in range(len(order))], cap)
    plan = [(s, totals[s], t, int(t // totals[s]) if totals[s] else 0) for s, t in zip(order, targets, strict=True)]
    plan = [(s, n, t, q, round(t) - q * n if n else 0) for s, n, t, q in plan]
    sources = spark.createDataFrame(plan, "src string, source_size long, target double, passes long, budget long")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"src": pdf["source"], "len": pdf["size"], "k": n})

    lengths = base.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(sources, F.col("source").eqNullSafe(F.col("src"))).select("source", "size", "n", "budget")
    chosen = lengths.groupBy("source").applyInPandas(choose, "src string, len long, k long")
    pieces = base.where("size > 0").groupBy("source", "size", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("before", F.coalesce(before, F.lit(0)))
    pieces = pieces.join(chosen, F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("len")))
    pieces = pieces.select("src", "len", F.col("piece").alias("part"), "before", "k")
    if whole:
        base = sized(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "piece").orderBy("h", "doc_id")))
    here = F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("len")) & (F.col("piece") == F.col("part"))
    out = ranked.join(pieces, here, "left").drop("src").join(sources, F.col("source").eqNullSafe(F.col("src")), "left")
    extra = F.when(F.col("before") + F.col("rank") <= F.col("k"), 1).otherwise(0)
    repeats = F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    values = (F.col("size"), F.coalesce("source_size", zero), F.coalesce("target", F.lit(0.0)), F.col("size") * repeats, repeats)
    if not whole:
        return out.select("doc_id", "source", *(v.alias(n) for v, n in zip(values, ADDED, strict=True)))
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ADDED:
        while name in taken:
            name += "_"
        names.append(name)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), *(v.alias(n) for v, n in zip(values, names, strict=True)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
