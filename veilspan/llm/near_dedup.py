"""Near-duplicate detection: DartMinHash signatures, banded joining, exact verification, connected classes.

A text is the set of its shingles of five words (of all its words if it has fewer).  Every element owns a region of the
plane of weight and rank in which darts of a unit Poisson process are thrown by hash; a text keeps the darts below its
weights and below a rank that gives it enough of them, and of these the earliest for each coordinate.  Two texts agree in
a coordinate with the probability of their (weighted) Jaccard similarity.

Equal bands of coordinates make candidates.  Elements that no other candidate has bound a text's similarity from above: in
a bucket where this rules it out, it needs no comparing, and the text with the smallest share of them leads: of edited
copies that is the one nearest to their origin.  Nothing emits all pairs of a large bucket: in every round each bucket
compares its members with one leader, in later rounds with a few, by exact Jaccard similarity; members found to be of one
class need no more comparing, and leaders that have been compared with all others leave.  After the first round, a bucket
in which at most LISTED members aren't of its largest class lists what pairs these have left, so that it has a number of
pairs in proportion to its members.  Rounds go on until every bucket holds one class.  So no candidate is dropped.

A text is a node, numbered by half of its 128-bit digest (by the other half where two texts share the first one); ids
come in only at the end, and may be of any type that has an order.

Edge cases: null text counts as empty; equal texts are one class at once (all empty ones too); texts without words are
linked to equal texts only; a null id takes part, but gives its class no id (null if nobody in its class has one); different
texts under one id are told apart (`label` numbers the classes; class_id alone doesn't); repeated rows are copies of one
another; an empty table gives an empty result; columns of any name pass through deduplicated() as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_of, slices, table, utf8, written
from .hashing import Batch, mix

WIDTH, BANDS, ROWS, SIMILARITY = 5, 30, 5, 0.8
#: Members beside the largest class of a bucket that lists its pairs; texts that are sketched at once (darts cost about 80 KB for each).
LISTED, AT_ONCE = 128, 500
#: Ranks below this are one cell for every element; above, cells double.
FLOOR = 1 / 16
ONE = np.uint64(1)


def shingles(batch: Batch, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, count) of every distinct shingle, by text, then hash."""
    h, doc = batch.words()
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=batch.n)
    first = np.cumsum(n) - n
    at = np.arange(len(h))
    whole = at - first[doc] + width <= n[doc]
    start = np.where(whole | (at == first[doc]) & (n[doc] < width))[0]
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        i = np.minimum(start + k, len(h) - 1)
        inside = (start + k < len(h)) & (doc[i] == doc[start])
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + np.where(inside, h[i], ONE))
    order = np.lexsort((out, doc[start]))
    d, s = doc[start][order], out[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, as far as 64-bit hashes can tell."""
    most = int(mean + 12 * math.sqrt(mean) + 30)
    logs = np.array([k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(most)])
    return np.cumsum(np.exp(logs))


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2**53


def darts(element: np.ndarray, weight: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the element, rank, hash) of all darts with rank below `most` and height below `weight`, an integer.

    The plane above an element is cut into cells of height 1 and of ranks that double from FLOOR on.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    layer = np.repeat(np.arange(len(element)), weight)
    level = np.arange(len(layer)) - np.repeat(np.cumsum(weight) - weight, weight)
    seed = mix(element[layer] + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    low, high, cell = 0.0, FLOOR, 1
    while len(layer):
        h = mix(seed ^ np.uint64(cell * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        n = np.searchsorted(poisson_steps(high - low), unit(h), "right")
        at = np.repeat(np.arange(len(layer)), n)
        if len(at):
            k = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            dart = mix(h[at] + (k + ONE) * np.uint64(0x8EBC6AF09C88C6E3))
            rank = low + (high - low) * unit(dart)
            keep = rank < most[layer[at]]
            found.append((layer[at][keep], rank[keep], mix(dart ^ np.uint64(0x589965CC75374CC3))[keep]))
        more = most[layer] > high
        layer, seed = layer[more], seed[more]
        low, high, cell = high, high * 2, cell + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """k coordinates for each of n texts, 0 where a text has no element."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weight, n)
    todo, wanted = total > 0, k * math.log(k) + 2.0 * k
    while todo.any():
        some = todo[doc]
        own = doc[some]
        at, rank, h = darts(element[some], weight[some], wanted / total[own])
        key = own[at] * k + ((h >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
        # the rank in the high bits decides, the dart's hash in the low ones tells which dart it was
        level = (rank * (total[own[at]] / wanted) * 2**31).astype(np.uint64)
        best = np.full(n * k, np.uint64(2**64 - 1))
        np.minimum.at(best, key, level << np.uint64(33) | h & np.uint64(2**33 - 1))
        best = best.reshape(n, k)
        full = todo & (best != np.uint64(2**64 - 1)).all(axis=1)
        out[full] = (best[full] & np.uint64(2**33 - 1)) + ONE
        todo &= ~full
        wanted *= 2
    return out


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), n_bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + sig[:, r : n_bands * rows : rows])
    return mix(out + np.arange(n_bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def sketches(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, weighted: bool = False) -> DataFrame:
    """doc_id, copy (digest of the text), bands array<long> (empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20, rows=AT_ONCE):
            b = Batch(utf8(batch["text"]))
            doc, s, count = shingles(b, width)
            sig = signatures(doc, s, count if weighted else np.ones_like(count), b.n, n_bands * rows)
            got = bands(sig, n_bands, rows)
            some = sig[:, 0] != 0
            ends = pa.array(np.concatenate([[0], np.cumsum(some * n_bands)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(got[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["copy"], lists], names=["doc_id", "copy", "bands"])
        pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", digest_of("text").alias("copy")).mapInArrow(run, f"doc_id {kind}, copy binary, bands array<bigint>")


def node_of(copy: str, half: int) -> Column:
    """64 bits of a digest: its first half (0) or its second one (1)."""
    return F.conv(F.hex(F.substring(copy, 8 * half + 1, 8)), 16, -10).cast("long")


def numbered(texts: DataFrame) -> DataFrame:
    """texts with `node`, which no two of them share."""
    texts = written(texts.withColumn("node", node_of("copy", 0)), "texts")
    twins = texts.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("twin"))
    if not twins.isEmpty():
        other = texts.join(twins, "node", "left").withColumn("node", F.when(F.col("twin"), node_of("copy", 1)).otherwise(F.col("node")))
        texts = written(other.drop("twin"), "texts")
        if not texts.groupBy("node").count().where("count > 1").isEmpty():
            raise RuntimeError("two texts share both halves of their digests with others")
    return texts


def sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, elements: the shingle hashes (32 bits) of the texts that take part in a comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            doc, s, _ = shingles(Batch(utf8(batch["text"])), width)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(batch)))]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array((s >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["node"], lists], names=["node", "elements"])
        pa.default_memory_pool().release_unused()

    ids = nodes.select(F.col("id"), "node", F.col("copy").alias("digest"))
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    joined = docs.select("doc_id", "text", digest_of("text").alias("own_digest")).join(ids, here).dropDuplicates(["node"])
    return joined.select("node", "text").mapInArrow(run, "node bigint, elements array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (a, b): label is the smallest node of its component.

    Large-star and small-star steps by turns, each a join and an aggregation; what they make is written to the shared
    folder after every turn.  It ends when every node hangs on the smallest of its component, and on no other.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(small, "components")
        if e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def facts(elements: DataFrame) -> DataFrame:
    """node, size, own: how many elements a text has, and how many that no other of the texts has."""
    each = elements.select("node", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    own = each.where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    return elements.select("node", F.size("elements").alias("size")).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def at_most(a: str, b: str) -> Column:
    """A bound on the number of elements that two texts share: none that one has alone, and where both were compared with
    a leader, at most what the one that has less of it has, and as many others as both can have."""
    size, own, met = (lambda x, k=k: F.col(f"{k}{x}") for k in "sow")
    plain = F.least(size(a) - own(a), size(b) - own(b))
    others = F.least(size(a) - own(a) - met(a), size(b) - own(b) - met(b))
    through = F.least(met(a), met(b)) + F.greatest(others, F.lit(0))
    return F.when((met(a) >= 0) & (met(b) >= 0), F.least(plain, through)).otherwise(plain)


def common(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """a, b, sa, sb (sizes), common: how many elements the texts of each pair share."""
    of = lambda node, name: elements.select(F.col("node").alias(node), F.col("elements").alias(name))
    both = pairs.join(of("b", "y"), "b").join(of("a", "x"), "a")
    return both.select("a", "b", F.size("x").alias("sa"), F.size("y").alias("sb"), F.size(F.array_intersect("x", "y")).alias("common"))


def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, label) after the links (a, b) between nodes whose labels were the given ones."""
    if labels is None:
        return written(components(found), "labels")
    ends = found
    for end, other in (("a", "b"), ("b", "a")):
        ends = ends.withColumnRenamed(end, "node").join(labels, "node", "left").select(F.coalesce("label", "node").alias(end), other)
    joined = components(ends).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(joined, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return written(known.unionByName(fresh).distinct(), "labels")


def round_of(members: DataFrame, labels: DataFrame | None, turn: int, least: float, listed: int) -> DataFrame:
    """The members of buckets that hold several classes, with what a round needs: label, leads, leader (the first one),
    other (not of the bucket's largest class), listed (there are few others, whose pairs are listed)."""
    now = members.withColumn("label", F.col("node")) if labels is None else with_labels(members, labels)
    # leaders: the member with the smallest share of elements of its own, in later rounds more, by a threshold of hashes
    h = F.xxhash64(F.lit(turn), F.col("node")).bitwiseAND(F.lit((1 << 40) - 1))
    now = now.withColumn("h", h).withColumn("key", F.struct((F.col("own") / F.col("size")).alias("share"), "h", "node"))
    each = now.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.min("size").alias("small"), F.min("key").alias("first"))
    most = F.max_by("label", F.struct("c", "label")).alias("most")
    small, first = F.min("small").alias("small"), F.min("first").alias("first")
    open_ = each.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("c").alias("n"), F.max("c").alias("c"), most, small, first).where("classes > 1")
    open_ = open_.select("bucket", "n", "small", "most", (F.col("n") - F.col("c")).alias("others"), F.col("first.node").alias("leader"))
    lead = (F.col("node") == F.col("leader")) | (F.col("h") <= (F.lit(1 << 40) / F.col("n") * (8**turn - 1)).cast("long"))
    shared = F.col("size") - F.col("own")
    possible = shared >= (least - 1e-9) * (F.col("size") + F.greatest("small", shared) - shared)
    now = now.join(open_, "bucket").where(possible).withColumn("leads", lead)
    now = now.withColumn("listed", (F.col("others") <= listed) & F.lit(turn > 0)).withColumn("other", F.col("label") != F.col("most"))
    return written(now.select("bucket", "node", "size", "own", "with", "label", "leader", "leads", "listed", "other"), "round")


def candidates(now: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a round: leaders, or in a listed bucket all that aren't of its largest class, with the other members
    of their bucket; of different classes, as far as bounds on what they share allow."""

    def side(x: str, rows: DataFrame, *more: str) -> DataFrame:
        named = {"node": x, "label": f"l{x}", "size": f"s{x}", "own": f"o{x}", "with": f"w{x}"} | {c: f"{c}_{x}" for c in more}
        return rows.select("bucket", *(F.col(k).alias(v) for k, v in named.items()))

    apart = (F.col("la") != F.col("lb")) & (at_most("a", "b") >= (least - 1e-9) * (F.col("sa") + F.col("sb") - at_most("a", "b")))
    open_ = now.where("not listed")
    led = side("a", open_.where("leads")).join(side("b", open_), "bucket").where(apart)
    # a pair is listed once: in the first of the listed buckets that it shares, of which a node has one for each band at most
    listed = now.where("listed")
    listed = listed.join(listed.groupBy("node").agg(F.collect_set("bucket").alias("mine")), "node")
    pairs = side("a", listed.where("other"), "mine").join(side("b", listed, "mine", "other"), "bucket")
    once = F.col("bucket") == F.array_min(F.array_intersect("mine_a", "mine_b"))
    pairs = pairs.where(apart & (~F.col("other_b") | (F.col("a") < F.col("b"))) & once)
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return led.select(*ends).unionByName(pairs.select(*ends)).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, listed: int = LISTED) -> DataFrame:
    """doc_id, copy, class_id (the smallest id of the class), label (the class's own number) for every row of docs."""
    base = written(sketches(docs, n_bands, rows, width), "sketches")
    texts = numbered(base.groupBy("copy").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    members = texts.select("node", F.explode("bands").alias("bucket"))
    many = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(members.join(many, "bucket"), "members")
    elements = written(sets(docs, texts.join(members.select("node").distinct(), "node"), width), "elements")
    # with: elements that a text shares with its bucket's first leader (-1: not compared with it)
    members = written(members.join(facts(elements), "node").withColumn("with", F.lit(-1)), "members")
    labels, turn = None, 0
    while True:
        now = round_of(members, labels, turn, least, listed)
        if now.isEmpty():
            break
        compared = written(common(candidates(now, least), elements), "compared")
        enough = F.col("common") >= (least - 1e-12) * (F.col("sa") + F.col("sb") - F.col("common"))
        labels = merged(labels, compared.where(enough).select("a", "b"))
        members = now.where("not leads and not listed")
        if not turn:
            met = compared.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("common").alias("_c"))
            here = (F.least("node", "leader") == F.col("_a")) & (F.greatest("node", "leader") == F.col("_b"))
            members = members.join(met, here, "left").withColumn("with", F.coalesce("_c", F.lit(-1)))
        members = members.select("node", "bucket", "size", "own", "with")
        turn += 1
    named = texts.withColumn("label", F.col("node")) if labels is None else with_labels(texts, labels)
    ids = named.groupBy("label").agg(F.min("id").alias("class_id"))
    named = named.join(ids, "label").select("copy", "class_id", "label")
    return base.select("doc_id", "copy").join(named, "copy")


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs but one of each class: that with the smallest id stays (one of them, if rows repeat it)."""
    one = classes(docs, least).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("one"))
    kept = one.select(F.col("one.doc_id").alias("kept_id"), F.col("one.copy").alias("kept_copy"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col("doc_id").alias("id"), digest_of("text").alias("digest"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_copy")))
    return rows.dropDuplicates(["kept_id", "kept_copy"]).select("whole.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
