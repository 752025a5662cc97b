"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions.  Every decision has a context tree over the bytes before it; each node of it holds the
Krichevsky-Trofimov estimate of its training counts, and the estimates of all depths are mixed with the weights that
context-tree weighting gives them: half a node's own estimate, half the product of what its children make of it.  The
estimate of counts doesn't depend on their order, so that a tree is made from counts, which Spark adds up.

A child that training never saw says even odds, as its estimate and those below it do.

Texts are gathered in blocks of about BLOCK bytes.  A block asks once for each different gram and word in it.  Grams are
cut into ranges of equal size by quantiles, so that a context however frequent is split over ranges; the few contexts that
lie on a cut (at most DEPTH for each) are summed up on the driver and sent to all, all others are whole in one range.
A range's trees answer what all blocks asked of it, and the answers meet their block's texts, one slice after another.

Edge cases: a null text counts as empty; an empty one is scored as its end alone; a null id counts as empty text for the
split; repeated rows are scored, and learned from, each time; without training rows all probabilities are even; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, split_of_crc32, table, utf8, written
from .hashing import FOLD, Batch

#: Bytes of context.
DEPTH = 5
#: Bytes of text of a block, and of those whose grams are held at once; keys of a row; keys that a range is asked for.
BLOCK, SLICE, CHUNK, RANGE = 1 << 25, 1 << 19, 1 << 13, 1 << 22
#: Bits of a gram's key; cuts are put between contexts of DEPTH - 1 bytes.
BITS, CUT = 8 * (DEPTH + 1), 16
#: Neither in UTF-8: stands before a text, and ends it.
EDGE = 0xFF
#: Key of the end token; words have hashes of their own, whose highest bits deal them out.
END = np.uint64(0x5851F42D4C957F2D)
WORDS, GRAMS, TEXT = 0, 1, 2
WORD_BITS = 6
ONE = np.uint64(1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte, number of the text) for every byte of every text and its end.

    The context's nearest byte stands highest: contexts of one length that share their last bytes are neighbours.
    """
    pad = bytes([EDGE]) * DEPTH
    buf = FOLD[np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = DEPTH + np.cumsum(sizes + DEPTH - 1) - (sizes + DEPTH - 1)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    key = np.zeros(len(buf), np.uint64)
    for d in range(1, DEPTH + 1):
        key[d:] |= buf[:-d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    return (key | buf)[at], doc


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of each word in order, and of each text's end."""
    h, doc = Batch(texts, fold=True).words()
    return np.concatenate([h, np.full(len(texts), END)]), np.concatenate([doc, np.arange(len(texts))])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and the sum of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, the lowest first, without planes that are all zero: they compress well."""
    n = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    planes = np.zeros((8, size), np.uint8)
    if size:
        planes[: len(data) // size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64, copy=False)


def pack_keys(key: np.ndarray) -> bytes:
    """The steps from each of the sorted keys to the next one."""
    return pack(np.diff(key))


def unpack_keys(first: int, data: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.array([first], np.int64).view(np.uint64), unpack(data, size - 1)]), dtype=np.uint64)


def tally(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different grams, sorted, and how many of each are in training texts."""
    s = np.sort(key << ONE | train.astype(np.uint64))
    at = np.flatnonzero(np.concatenate([[True], s[1:] >> ONE != s[:-1] >> ONE])) if len(s) else np.zeros(0, np.int64)
    return s[at] >> ONE, np.add.reduceat((s & ONE).astype(np.int64), at) if len(at) else at


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of three kinds: TEXT, a slice of texts (ids, held_out, sizes, texts compressed, size: that of them all), and what
    their block asks for, CHUNK keys a row: first, size, keys, counts (in the block's training rows).  A block's number is
    random: only rows of tasks that ended well are kept.
    """
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        block, size, id_type = uuid.uuid4().int >> 65, 0, None

        def row(kinds: list[int], **cols) -> pa.RecordBatch:
            n = len(kinds)
            none = {"ids": pa.list_(id_type), "held_out": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "texts": pa.binary(), "first": pa.int64(), "size": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
            filled = {"block": pa.array([block] * n, pa.int64()), "kind": pa.array(kinds, pa.int8())} | {c: cols.get(c, pa.nulls(n, t)) for c, t in none.items()}
            return pa.RecordBatch.from_arrays(list(filled.values()), names=list(filled))

        def asked() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                key, n = added(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for i in range(0, len(key), 64 * CHUNK):
                    some = [(key[j : j + CHUNK], n[j : j + CHUNK]) for j in range(i, min(len(key), i + 64 * CHUNK), CHUNK)]
                    yield row([kind] * len(some), first=pa.array([k[0].view(np.int64) for k, _ in some], pa.int64()), size=pa.array([len(k) for k, _ in some], pa.int64()), keys=pa.array([pack_keys(k) for k, _ in some], pa.binary()), counts=pa.array([pack(m) for _, m in some], pa.binary()))
                parts.clear()
            pa.default_memory_pool().release_unused()

        for batch in slices(batches, most=SLICE):
            texts, train, id_type = utf8(batch["text"]), ~batch["held_out"].to_numpy(zero_copy_only=False), batch["doc_id"].type
            key, doc = words(texts)
            held[WORDS].append(added([(key, train[doc].astype(np.int64))]))
            key, doc = grams(texts)
            held[GRAMS].append(tally(key, train[doc]))
            for parts in held:
                if len(parts) >= 8:
                    parts[:] = [added(parts)]
            whole, one = b"".join(texts), lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield row([TEXT], ids=one(batch["doc_id"]), held_out=one(batch["held_out"]), sizes=one(pa.array([len(t) for t in texts], pa.int64())), texts=pa.array([pa.compress(whole, "zstd", asbytes=True)], pa.binary()), size=pa.array([len(whole)], pa.int64()))
            size += len(whole)
            if size >= BLOCK:
                yield from asked()
                block, size = uuid.uuid4().int >> 65, 0
        if held[GRAMS]:
            yield from asked()

    return docs.mapInArrow(run, f"block long, kind byte, ids array<{kind_of_id}>, held_out array<boolean>, sizes array<bigint>, texts binary, first long, size long, keys binary, counts binary")


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series after a shift by 8."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


class Level:
    """The nodes of one depth and bit: key (context, bits so far), zeros and ones, own and weighted probability."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
        """children: logarithm of the product of the children's weighted probabilities; None at the deepest depth."""
        self.key, self.zeros, self.ones = key, zeros, ones
        own = log_kt(zeros, ones)
        self.lead = np.zeros(len(key)) if children is None else own - children
        self.weighted = own if children is None else np.logaddexp(own, children) - np.log(2)

    def joined(self, top: Level, low: np.uint64, high: np.uint64) -> Level:
        """This level, with what `top` has of the nodes from low to below high in place of its own share of them."""
        a, b = np.searchsorted(top.key, [low, high])
        if a < b:
            some = top.key[a:b]
            own = some[np.minimum(np.searchsorted(some, self.key), len(some) - 1)] != self.key
            order = np.argsort(np.concatenate([self.key[own], some]))
            for name in ("key", "zeros", "ones", "lead", "weighted"):
                setattr(self, name, np.concatenate([getattr(self, name)[own], getattr(top, name)[a:b]])[order])
        return self

    def look(self, key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether training saw the node, its own estimate of the bit, the weight of that)."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.full(len(key), 0.5), np.ones(len(key))
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        seen = self.key[at] == key
        zeros, ones = np.where(seen, self.zeros[at], 0), np.where(seen, self.ones[at], 0)
        return seen, (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0), 1 / (1 + np.exp(-np.clip(self.lead[at], -700, 700)))


def counted(key: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes before the given bit, with zeros and ones, from sorted (context, byte) keys and their counts."""
    node = key >> np.uint64(8 - bit) if bit else key >> np.uint64(8)
    one = (key >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    if not len(at):
        return node, n, n
    ones = np.add.reduceat(np.where(one, n, 0), at)
    return node[at], np.add.reduceat(n, at) - ones, ones


def trees_in_turn(key: np.ndarray, n: np.ndarray, least: int) -> Iterator[list[Level]]:
    """Levels by depth, from `least` to DEPTH, one bit after another; key (sorted) holds training grams, n their counts."""
    by = {DEPTH: (key, n)}
    for d in range(DEPTH - 1, least - 1, -1):
        up, m = by[d + 1]
        # the farthest byte of a context stands right above the byte that it predicts
        by[d] = added([((up >> np.uint64(16) << np.uint64(8)) | up & np.uint64(255), m)])
    for bit in range(8):
        levels: list[Level] = []
        for d in range(DEPTH, least - 1, -1):
            node, zeros, ones = counted(*by[d], bit)
            below = None
            if levels:
                parent = np.searchsorted(node, upward(levels[-1].key, bit))
                below = np.bincount(parent, levels[-1].weighted, len(node))
            levels.append(Level(node, zeros, ones, below))
        yield levels[::-1]


def upward(node: np.ndarray, bit: int) -> np.ndarray:
    """A node's key without the farthest byte of its context."""
    low = np.uint64((1 << bit) - 1)
    return node >> np.uint64(bit + 8) << np.uint64(bit) | node & low


def probabilities(key: np.ndarray, levels: Iterable[list[Level]], most: int = 200_000) -> np.ndarray:
    """log10 of each gram's byte given its context; levels: by bit, from depth 0 on."""
    total = np.zeros(len(key))
    for bit, by_depth in enumerate(levels):
        for i in range(0, len(key), most):
            some = key[i : i + most]
            one = (some >> np.uint64(7 - bit) & ONE).astype(bool)
            node = some >> np.uint64(8 - bit) if bit else some >> np.uint64(8)
            q = np.full(len(some), 0.5)
            for depth in range(DEPTH, -1, -1):
                seen, own, weight = by_depth[depth].look(node, one)
                q = np.where(seen, own if depth == DEPTH else weight * own + (1 - weight) * q, 0.5)
                node = upward(node, bit)
            total[i : i + most] += np.log10(q)
    return total


class Cuts:
    """Cuts of the grams' keys into ranges, and the contexts by depth that lie in more than one of these."""

    def __init__(self, at: np.ndarray):
        at = np.unique(at.astype(np.uint64) >> np.uint64(CUT) << np.uint64(CUT))
        self.at = at[at > 0]
        self.contexts = [np.zeros(1, np.uint64)]
        for d in range(1, DEPTH + 1):
            rest = np.uint64(BITS - 8 * d)
            self.contexts.append(np.unique((self.at >> rest)[self.at & ((ONE << rest) - ONE) != 0]))

    def on(self, node: np.ndarray, bit: int, depth: int) -> np.ndarray:
        """Which nodes of a depth belong to contexts that are cut."""
        c, context = self.contexts[depth], node >> np.uint64(bit)
        return c[np.minimum(np.searchsorted(c, context), len(c) - 1)] == context if len(c) else np.zeros(len(node), bool)


def dealt(asked: DataFrame, cuts: Cuts) -> DataFrame:
    """Rows of grams and words cut to ranges: part, block, kind, first, size, keys, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, kind, first, size, keys, counts in zip(*(batch[c].to_pylist() for c in ("block", "kind", "first", "size", "keys", "counts")), strict=True):
                key, n = unpack_keys(first, keys, size), unpack(counts, size)
                part = np.searchsorted(cuts.at, key, "right") if kind == GRAMS else (len(cuts.at) + 1 + (key >> np.uint64(64 - WORD_BITS)).astype(np.int64))
                edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), size]
                for a, b in zip(edge, edge[1:], strict=False):
                    out.append((int(part[a]), block, kind, int(key[a].view(np.int64)), b - a, pack_keys(key[a:b]), pack(n[a:b])))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "kind", "first", "size", "keys", "counts"])

    return asked.mapInArrow(run, "part int, block long, kind byte, first long, size long, keys binary, counts binary").repartition("part").sortWithinPartitions("part")


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], np.ndarray, np.ndarray]]:
    """(kind, rows (block, first, size, keys), all different keys, training counts) of one range after another."""
    rows: list[tuple] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    now, of = None, 0

    def result() -> tuple[int, list[tuple], np.ndarray, np.ndarray]:
        key, n = added(parts)
        return of, rows, key, n

    for batch in batches:
        for part, block, kind, first, size, keys, counts in zip(*(batch[c].to_pylist() for c in ("part", "block", "kind", "first", "size", "keys", "counts")), strict=True):
            if part != now:
                if rows:
                    yield result()
                rows, parts, now, of = [], [], part, kind
            rows.append((block, first, size, keys))
            parts.append((unpack_keys(first, keys, size), unpack(counts, size).astype(np.int64)))
            if len(parts) >= 256:
                parts = [added(parts)]
    if rows:
        yield result()


def spine(parts: DataFrame, cuts: Cuts) -> DataFrame:
    """bit, depth, node, zeros, ones, below: a range's share of the nodes of contexts that are cut; bit -1: of all words,
    their number (zeros) and that of different ones (ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, _, key, n in whole_parts(batches):
            key, n = key[n > 0], n[n > 0]
            if kind == WORDS:
                yield pa.record_batch({"bit": pa.array([-1], pa.int32()), "depth": pa.array([0], pa.int32()), "node": pa.array([0], pa.int64()), "zeros": pa.array([int(n.sum())], pa.int64()), "ones": pa.array([len(n)], pa.int64()), "below": pa.array([0.0])})
                continue
            for bit, levels in enumerate(trees_in_turn(key, n, 0)):
                for depth in range(DEPTH):
                    level, child = levels[depth], levels[depth + 1]
                    mine = cuts.on(level.key, bit, depth)
                    if not mine.any():
                        continue
                    whole = ~cuts.on(child.key, bit, depth + 1)
                    below = np.bincount(np.searchsorted(level.key, upward(child.key[whole], bit)), child.weighted[whole], len(level.key))
                    m = int(mine.sum())
                    yield pa.record_batch({"bit": np.full(m, bit, np.int32), "depth": np.full(m, depth, np.int32), "node": level.key[mine].view(np.int64), "zeros": level.zeros[mine], "ones": level.ones[mine], "below": below[mine].astype(float)})

    rows = parts.mapInArrow(run, "bit int, depth int, node long, zeros long, ones long, below double")
    return rows.groupBy("bit", "depth", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))


def top_levels(rows) -> list[list[Level]]:
    """By bit and depth, the nodes of contexts that are cut, from a pandas frame of spine()'s rows."""
    out = []
    for bit in range(8):
        levels: list[Level] = []
        for depth in range(DEPTH - 1, -1, -1):
            r = rows[(rows["bit"] == bit) & (rows["depth"] == depth)].sort_values("node")
            key, below = r["node"].to_numpy(np.int64).view(np.uint64), r["below"].to_numpy(float).copy()
            if levels and len(levels[-1].key):
                np.add.at(below, np.searchsorted(key, upward(levels[-1].key, bit)), levels[-1].weighted)
            levels.append(Level(key, r["zeros"].to_numpy(np.int64), r["ones"].to_numpy(np.int64), below))
        out.append(levels[::-1])
    return out


def mended(levels: Iterable[list[Level]], top: list[list[Level]], first: np.uint64, last: np.uint64) -> Iterator[list[Level]]:
    """Levels of the range from key `first` to `last`, in which nodes of contexts that are cut are those of all ranges."""
    for bit, (by_depth, tops) in enumerate(zip(levels, top, strict=True)):
        for depth, (level, above) in enumerate(zip(by_depth, tops, strict=False)):
            rest, b = np.uint64(BITS - 8 * depth), np.uint64(bit)
            level.joined(above, first >> rest << b, (last >> rest) + ONE << b)
        yield by_depth


def answers(parts: DataFrame, top: list[list[Level]]) -> DataFrame:
    """block, kind, first, size, keys, values: a word's training count, or the logarithm of a gram's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, rows, key, n in whole_parts(batches):
            if kind == GRAMS:
                value = probabilities(key, mended(trees_in_turn(key[n > 0], n[n > 0], 0), top, key[0], key[-1])).astype("<f4")
            for i in range(0, len(rows), 64):
                some, found = rows[i : i + 64], []
                for _, first, size, keys in some:
                    at = np.searchsorted(key, unpack_keys(first, keys, size))
                    found.append(value[at].tobytes() if kind == GRAMS else pack(n[at].astype(np.uint64)))
                block, first, size, keys = zip(*some, strict=True)
                yield pa.record_batch({"block": pa.array(block, pa.int64()), "kind": pa.array([kind] * len(some), pa.int8()), "first": pa.array(first, pa.int64()), "size": pa.array(size, pa.int64()), "keys": pa.array(keys, pa.binary()), "values": pa.array(found, pa.binary())})

    return parts.mapInArrow(run, "block long, kind byte, first long, size long, keys binary, values binary")


def looked_up(tables: list[tuple[np.ndarray, np.ndarray]], kind: int, key: np.ndarray) -> np.ndarray:
    """The block's answers for the keys, which are taken in their order: neighbours are found next to each other."""
    known, value = tables[kind]
    order = np.argsort(key)
    at = np.searchsorted(known, key[order])
    if len(key) and (not len(known) or at[-1] >= len(known) or (known[at] != key[order]).any()):
        raise RuntimeError("a block has keys without an answer")
    out = np.empty(len(key))
    out[order] = value[at]
    return out


def rated(rows: DataFrame, n_all: int, n_types: int, id_kind: str) -> DataFrame:
    """From a block's answers, then its texts: the columns of score()."""

    def rate(ids: pa.Array, held_out: pa.Array, sizes: list[int], whole: bytes, tables: list) -> pa.RecordBatch:
        ends = np.cumsum(sizes).tolist()
        texts = [whole[b - a : b] for a, b in zip(sizes, ends, strict=True)]
        n, (key, doc) = len(texts), words(texts)
        c = looked_up(tables, WORDS, key)
        key, of = grams(texts)
        total, size = np.bincount(of, looked_up(tables, GRAMS, key), n), np.array(sizes, np.int64)
        base = np.bincount(doc, np.log10((c + 1) / (n_all + n_types + 1)), n)
        known = np.bincount(doc, c > 0, n).astype(np.int64)
        numbers = (np.bincount(doc, minlength=n).astype(np.int64), known, np.full(n, n_all), base, total, size, -total / np.log10(2) / np.maximum(size, 1))
        return pa.RecordBatch.from_arrays([ids, held_out, *map(pa.array, numbers)], names=["doc_id", "held_out", *NUMBERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, tables = None, [[], []], None
        for batch in batches:
            block, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            text = kind == TEXT
            edge = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (text[1:] != text[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if block[a] != now:
                    now, chunks, tables = block[a], [[], []], None
                part = batch.slice(a, b - a)
                if not text[a]:
                    for k, first, size, keys, values in zip(*(part[c].to_pylist() for c in ("kind", "first", "size", "keys", "values")), strict=True):
                        chunks[k].append((unpack_keys(first, keys, size), np.frombuffer(values, "<f4") if k == GRAMS else unpack(values, size).astype(np.int64)))
                    continue
                if tables is None:
                    tables = []
                    for some in chunks:
                        some.sort(key=lambda c: int(c[0][0]))
                        tables.append(tuple(np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.uint64), np.zeros(0)))
                    chunks = [[], []]
                for i, (whole, size) in enumerate(zip(part["texts"].to_pylist(), part["size"].to_pylist(), strict=True)):
                    yield rate(part["ids"].slice(i, 1).flatten(), part["held_out"].slice(i, 1).flatten(), part["sizes"][i].as_py(), pa.decompress(whole, size, "zstd", asbytes=True), tables)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")


NUMBERS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    Learns from rows with crc32(id) mod 7 other than 2.  Both are logarithms to base 10: base_score of a unigram model of
    words with one added to each count, score of the context trees, over the text's bytes (A-Z lower-cased) and its end.
    Answers to grams travel as 32-bit floats.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (split_of_crc32(F.col("doc_id"), 7) == 2).alias("held_out"))
    rows = written(blocks(docs), "blocks")
    asked = rows.where(F.col("kind") != TEXT).select("block", "kind", "first", "size", "keys", "counts")
    of_grams = rows.where(F.col("kind") == GRAMS)
    total = of_grams.agg(F.sum("size").alias("n")).first()["n"] or 0
    n_cuts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE) - 1
    # as many numbers as there are ranges reach the driver; rows hold CHUNK keys each, or the last ones of a block
    found = of_grams.agg(F.percentile_approx("first", [(i + 1) / (n_cuts + 1) for i in range(n_cuts)], 20 * n_cuts).alias("at")).first()["at"]
    cuts = Cuts(np.array(found or [], np.int64))
    spines = spine(dealt(asked, cuts), cuts).toPandas()
    top, of_words = top_levels(spines), spines[spines["bit"] == -1]
    n_all, n_types = int(of_words["zeros"].sum()), int(of_words["ones"].sum())
    given = answers(dealt(asked, cuts), top)
    texts = rows.where(F.col("kind") == TEXT).select("block", "kind", "size", "ids", "held_out", "sizes", "texts")
    # several partitions for each block, so that few blocks share one
    n_blocks = rows.where(F.col("kind") == TEXT).select("block").distinct().count()
    n_parts = max(4 * n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = given.unionByName(texts, allowMissingColumns=True).repartition(n_parts, "block").sortWithinPartitions("block", "kind")
    return rated(both, n_all, n_types, docs.schema["doc_id"].dataType.simpleString())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
