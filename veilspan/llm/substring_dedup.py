"""Removal of byte strings of a given width that occur more than once, by suffix arrays.

Each window of `width` bytes has an anchor: of its 32-byte grams that with the smallest hash, the first of them on ties.
Equal windows have equal anchors, so that only windows of an anchor that occurs again need comparing: those of one
occurrence make a slice of less than twice the width.  Equal slices are counted (each of their windows repeats); different
slices of an anchor go to a shard, whose suffix array is made by induced sorting and whose permuted common prefixes tell
which windows repeat.  Equal texts are one text from the start: any window of such a text occurs again.

Memory: a shard holds the different slices of one anchor, or of many anchors up to SHARD bytes.  An anchor that occurs more
than HOT times (a common line in many surroundings) is split: each of its slices is cut again by other hashes, as the text
was, and a piece's anchor is that of both; up to three times, as often as the number of its occurrences asks for.  Texts
and slices are told apart by 128 bits of hash, anchors by 64 (slices that share one by chance are still told apart).

Edge cases: a null text counts as empty; a text shorter than the width loses bytes to none; overlapping repeats within a
text count; repeated rows are equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_of, slices, table, utf8, written
from .hashing import mix
from .suffixes import repeated

WIDTH, GRAM = 200, 32
#: Bytes of slices that share a suffix array, if they belong to several anchors.
SHARD = 1 << 20
#: Occurrences up to which an anchor isn't split; each further time it is split from 8 times as many on.
HOT = 1024
#: In a 64-bit value that orders grams, the low bits hold the place in the buffer (256 MB), the others the hash.
PLACE = np.uint64((1 << 28) - 1)
#: Longer texts are cut for their anchors.
LONGEST = 1 << 24


def anchors(texts: list[bytes], width: int = WIDTH, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first window, number of windows, hash) for every anchor occurrence; salt: which hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    n, grams = int(sizes.sum()), width - GRAM + 1
    count = np.maximum(sizes - width + 1, 0)
    none = np.zeros(0, np.int64)
    if not count.any():
        return none, none, none, none
    most = min(LONGEST, int(PLACE) + 1)
    if n > most:
        # pieces that overlap by width - 1 bytes hold each window once
        cuts = [(i, k) for i, c in enumerate(count) for k in range(0, int(c), most - width + 1)]
        found = [anchors([texts[i][k : k + most]], width, salt) for i, k in cuts]
        docs, firsts = (np.concatenate([f[x] + c[x] for f, c in zip(found, cuts, strict=True)]) for x in (0, 1))
        return docs, firsts, *(np.concatenate([f[x] for f in found]) for x in (2, 3))
    data = b"".join(texts) + bytes(GRAM)
    word = np.ndarray((n + GRAM - 8,), "<u8", data, strides=(1,))
    h = np.full(n, salt, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ (h >> np.uint64(29)) ^ word[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
    h = mix(h)
    low = h & ~PLACE | np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= grams:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < grams:
        low = np.minimum(low[: len(low) - (grams - step)], low[grams - step :])
    at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    place = (low[at] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    begin, doc = at[new], np.searchsorted(starts, at[new], "right") - 1
    return doc, begin - starts[doc], np.diff(np.append(new, len(at))), mix(h[place[new]] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def anchor_table(docs: DataFrame, width: int) -> DataFrame:
    """id of the text, place (first window << 16 | number of windows), anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            doc, first, n, key = anchors(utf8(batch["text"]), width)
            if len(doc):
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(doc)), pa.array(first << 16 | n), pa.array(key)], names=["id", "place", "anchor"])

    return docs.select("id", "text").mapInArrow(run, "id binary, place long, anchor long")


def pieces(texts: list[bytes], lists: list[list[dict]], width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(number of the text, first window, anchor, slice) of every occurrence listed, those of hot anchors split."""
    hot: list[tuple[int, int, int, bytes, int]] = []
    for i, (text, at) in enumerate(zip(texts, lists, strict=True)):
        for x in at:
            first, n = x["place"] >> 16, x["place"] & 0xFFFF
            piece = text[first : first + n + width - 1]
            if x["splits"]:
                hot.append((i, first, x["anchor"], piece, x["splits"]))
            else:
                yield i, first, x["anchor"], piece
    salt = 0
    while hot:
        salt += 1
        doc, first, n, key = anchors([h[3] for h in hot], width, salt * 0x5851F42D4C957F2D & (1 << 63) - 1)
        whole = mix(np.array([h[2] for h in hot], np.int64).view(np.uint64)[doc] * np.uint64(0x9FB21C651E98DF25) + key.view(np.uint64)).view(np.int64)
        more = []
        for d, f, c, anchor in zip(doc.tolist(), first.tolist(), n.tolist(), whole.tolist(), strict=True):
            i, at, _, piece, left = hot[d]
            piece = piece[f : f + c + width - 1]
            if left > 1:
                more.append((i, at + f, anchor, piece, left - 1))
            else:
                yield i, at + f, anchor, piece
        hot = more


def cut(found: DataFrame, width: int) -> DataFrame:
    """From (id, text, at array<struct<place, anchor, splits>>): anchor, digest, slice, copies; equal ones of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            seen: dict[tuple[int, bytes], int] = {}
            for _, _, anchor, piece in pieces(utf8(batch["text"]), batch["at"].to_pylist(), width):
                seen[anchor, piece] = seen.get((anchor, piece), 0) + 1
            if seen:
                anchor, piece = zip(*seen, strict=True)
                yield pa.record_batch({"anchor": pa.array(anchor, pa.int64()), "digest": pa.array([hashlib.md5(x).digest() for x in piece], pa.binary()), "slice": pa.array(piece, pa.binary()), "copies": pa.array(seen.values(), pa.int64())})

    return found.mapInArrow(run, "anchor long, digest binary, slice binary, copies long")


def cut_places(found: DataFrame, width: int) -> DataFrame:
    """anchor, digest, id, first of each slice, without its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            ids = batch["id"].to_pylist()
            found = pieces(utf8(batch["text"]), batch["at"].to_pylist(), width)
            rows = [(anchor, hashlib.md5(piece).digest(), ids[i], first) for i, first, anchor, piece in found]
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "digest", "id", "first"])

    return found.mapInArrow(run, "anchor long, digest binary, id binary, first int")


def compared(cuts: DataFrame, width: int) -> DataFrame:
    """From (anchor, digest, slice, copies) in whole anchors, sorted: (anchor, digest, low, high), runs of windows that
    occur again."""

    def result(held: dict[int, dict[bytes, list]]) -> pa.RecordBatch:
        rows = []
        several: list[tuple[int, bytes, bytes, int]] = []
        for anchor, group in held.items():
            rows += [(anchor, d, 0, len(x) - width) for d, (x, n) in group.items() if n > 1]
            if len(group) > 1 and any(n == 1 for _, n in group.values()):
                several += [(anchor, d, x, n) for d, (x, n) in group.items()]
        for (anchor, d, _, n), runs in zip(several, repeated([x[2] for x in several], width) if several else (), strict=True):
            if n == 1:
                rows += [(anchor, d, a, b) for a, b in runs]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "digest", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        size = 0
        for batch in batches:
            for anchor, digest, piece, n in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "slice", "copies")), strict=True):
                if anchor not in held:
                    if size >= SHARD:
                        yield result(held)
                        held, size = {}, 0
                    held[anchor] = {}
                if digest in held[anchor]:
                    held[anchor][digest][1] += n
                else:
                    held[anchor][digest] = [piece, n]
                    size += len(piece)
        if held:
            yield result(held)

    return cuts.mapInArrow(run, "anchor long, digest binary, low int, high int")


def trimmed(marked: DataFrame, width: int, keep_text: bool) -> DataFrame:
    """From (id, text, at array<struct<low, high>>): the bytes left when every window from low to high has gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            rows = []
            for i, text, at in zip(batch["id"].to_pylist(), utf8(batch["text"]), batch["at"].to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((x["low"], x["high"] + width) for x in at):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                gaps = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True)
                left = b"".join(text[a:b] for a, b in gaps)
                rows.append((i, len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans], left if keep_text else None))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return marked.mapInArrow(run, "id binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary")


def repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>> in bytes, kept (if keep_text)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select("doc_id", "text", digest_of("text").alias("id"))
    base = written(docs.select("doc_id", "id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole")), "texts")
    # anchors are computed twice: that costs less than to keep them
    found = anchor_table(docs, width)
    splits = F.when(F.col("n") > 64 * HOT, 3).when(F.col("n") > 8 * HOT, 2).when(F.col("n") > HOT, 1).otherwise(0)
    again = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", splits.cast("byte").alias("splits")), "anchors")
    texts = base.groupBy("id").agg(F.min("doc_id").alias("one"), F.count("*").alias("copies"))
    # one occurrence list for each different text, of its anchors that occur again; its length is bounded by the text's
    lists = found.join(again, "anchor").groupBy("id").agg(F.collect_set(F.struct("place", "anchor", "splits")).alias("at"))
    lists = lists.join(texts, "id").select(F.col("id").alias("tid"), "one", "at")
    some = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("one")) & (F.col("id") == F.col("tid"))).select("id", "text", "at")
    some = written(some, "candidates")
    runs = written(compared(cut(some, width).repartition("anchor").sortWithinPartitions("anchor"), width), "runs")
    ends = F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    marks = cut_places(some, width).join(runs, ["anchor", "digest"]).groupBy("id").agg(F.collect_list(ends).alias("at"))
    marked = some.select("id", "text").join(marks, "id")
    gone = trimmed(marked, width, keep_text).dropDuplicates(["id"])
    out = base.join(texts.select("id", "copies"), "id").join(gone, "id", "left")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    pick = lambda whole, name, none: F.when(all_, whole).otherwise(F.coalesce(F.col(name), none)).alias(name)
    zero, spans = F.lit(0).cast("long"), "array<struct<start:bigint,end:bigint>>"
    cols = [pick(F.col("n_bytes"), "n_removed", zero), pick(F.lit(1).cast("long"), "n_spans", zero), pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("whole"))]
    cols.append(pick(F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end"))), "spans", F.array().cast(spans)))
    return out.select("doc_id", "n_bytes", *cols, *([F.when(all_, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same in SQL: every window by its digest, runs of windows that occur again, and what is left between them.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  c AS (SELECT r, p, least(255, n - {WIDTH} - 256 * p) AS most, substr(h, 512 * p + 1, 2 * (255 + {WIDTH})) AS c FROM (SELECT r, h, n, unnest(generate_series(0, (n - {WIDTH}) // 256)) AS p FROM d WHERE n >= {WIDTH})),
  w AS (SELECT r, 256 * p + i AS i, md5(substr(c, 2 * i + 1, 2 * {WIDTH})) AS k FROM (SELECT r, p, c, unnest(generate_series(0, most)) AS i FROM c)),
  g AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
  f AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {WIDTH} THEN 0 ELSE 1 END AS fresh FROM g),
  s AS (SELECT r, min(i) AS a, max(i) + {WIDTH} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM f) GROUP BY r, k),
  o AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM s),
  j AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS body, max(b) AS last, sum(b - a) AS gone, count(*) AS k FROM o JOIN d USING (r) GROUP BY r)
  SELECT doc_id, cast(n AS bigint) AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed, cast(coalesce(k, 0) AS bigint) AS n_spans,
    CASE WHEN k IS NULL THEN sha256(t) ELSE sha256(unhex(body || substr(h, 2 * last + 1))) END AS kept_sha256 FROM d LEFT JOIN j USING (r)"""
