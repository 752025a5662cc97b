"""Benchmark decontamination: pigeonhole edit matching.

An item that occurs in a document with at most e edits has at least one of any e + 1 pieces unchanged there.  Exact piece
hits are found with one automaton; around each hit the item is verified with Myers' bit-parallel distance.  Text and items
are compared as lower-case words with single spaces, so that layout and punctuation don't count as edits.

Edge cases: null and empty texts and items match nothing; equal items are found under each of their ids, repeated rows in
each row; a document shorter than an item can match it only within the budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, written

WORDS = re.compile(r"[^\W_]+")
#: Share of an item's characters that may be edited.
ERRORS = 0.1
#: Characters of items that one pass over the documents takes (its automaton is sent to every task).
BLOCK = 2_000_000


def normal(text: str) -> str:
    return " ".join(WORDS.findall(text.lower()))


def places(text: str) -> list[tuple[int, int]]:
    """For each character of normal(text), its place in text: (start, end) of it, or of the gap that became its space."""
    out, last = [], 0
    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for m in WORDS.finditer(low):
        if out:
            out.append((last, m.start()))
        out += [(i, i + 1) for i in range(*m.span())]
        last = m.end()
    return out


def myers(pattern: str, text: str, most: int, first: bool = False) -> tuple[int, int] | None:
    """(distance, end in text) of the best approximate occurrence of pattern in text, if within most; the first such end.

    first: stop at the first occurrence within most instead."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if first:
                break
    return best


class Part:
    """Neighbouring pieces of an item.  n of them hold at most n - 1 edits, for some such part on every level of the tree
    whenever the item's e + 1 pieces hold at most e: what fails here for a piece's ancestors need not be looked at again.
    """

    def __init__(self, item: str, start: int, end: int, most: int):
        self.pattern, self.start, self.length, self.most = item[start:end], start, end - start, most

    def near(self, text: str, at: int) -> bool:
        """Whether it occurs where the item would start at `at`, give or take its edits."""
        a = at + self.start - self.most
        return myers(self.pattern, text[max(0, a) : a + self.length + 2 * self.most], self.most, True) is not None


class Piece:
    """A leaf: exact text, its ancestors below the whole item, and what a first look at the nearest of them asks for."""

    def __init__(self, item: str, start: int, end: int, ancestors: list[Part]):
        self.text, self.start, self.ancestors, self.rest = item[start:end], start, ancestors, []
        if ancestors:
            p = ancestors[0]
            for a, b in ((p.start, start), (end, p.start + p.length)):
                n = p.most + 1
                cuts = [a + (b - a) * i // n for i in range(n + 1)]
                self.rest += [item[x:y] for x, y in zip(cuts, cuts[1:], strict=False) if y > x]

    def passes(self, text: str, at: int) -> bool:
        if self.rest:
            p = self.ancestors[0]
            a = at + p.start - p.most
            window = text[max(0, a) : a + p.length + 2 * p.most]
            if not any(r in window for r in self.rest):
                return False
        return all(p.near(text, at) for p in self.ancestors)


def pieces(item: str, errors: float) -> list[Piece]:
    """One more than the item's error budget, as leaves of a binary tree."""
    n = int(len(item) * errors) + 1
    cut = [len(item) * i // n for i in range(n + 1)]
    out = []

    def split(i: int, j: int, above: list[Part]) -> None:
        if j - i == 1:
            out.append(Piece(item, cut[i], cut[j], above[::-1]))
            return
        if j - i < n:
            above = [*above, Part(item, cut[i], cut[j], j - i - 1)]
        split(i, (i + j) // 2, above)
        split((i + j) // 2, j, above)

    split(0, n, [])
    return out


class Finder:
    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        self.items = [(i, normal(t)) for i, t in items]
        self.errors = errors
        where: dict[str, list[tuple[int, Piece]]] = {}
        for k, (_, t) in enumerate(self.items):
            if t:
                for piece in pieces(t, errors):
                    where.setdefault(piece.text, []).append((k, piece))
        self.search = ahocorasick.Automaton()
        for text, at in where.items():
            self.search.add_word(text, (len(text), at))
        if where:
            self.search.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of the best occurrence of each item; offsets in normal(text)."""
        if not len(self.search):
            return []
        text = normal(text)
        diagonals: dict[int, set[int]] = {}
        for last, (n, at) in self.search.iter(text):
            for k, piece in at:
                start = last - n + 1 - piece.start
                if start not in diagonals.get(k, ()) and piece.passes(text, start):
                    diagonals.setdefault(k, set()).add(start)
        out = []
        for k, starts in diagonals.items():
            i, item = self.items[k]
            most = int(len(item) * self.errors)
            best, done = None, None
            for d in sorted(starts):
                if done is not None and d <= done:
                    continue
                # one window for this diagonal and those up to `most` after it
                a, done = max(0, d - most), d + most
                got = myers(item, text[a : done + len(item) + most], most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
                    if not got[0]:
                        break
            if best:
                edits, end = best
                a = max(0, end - len(item) - most)
                back = myers(item[::-1], text[a:end][::-1], most)
                out.append((i, edits, end - (back[1] if back else len(item)), end))
        return out


def in_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK characters (or one longer item), one after another: the driver holds one, and the
    partition that it is read from."""
    block: list[tuple[int, str]] = []
    held = 0
    for r in items.where("text is not null and text <> ''").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r["text"]) > BLOCK:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, edits, start, end (code points of the text): the best occurrence of each item in each document.

    Items go out in blocks of a fixed number of characters.  Each block has a pass of its own, whose result is written if
    there are several, so that one automaton at a time is in a task's memory.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, errors)
            for batch in slices(batches):
                ids, rows = [], []
                for i, text in enumerate(batch["text"].to_pylist()):
                    if text and (found := finder.find(text)):
                        at = places(text)
                        for item, edits, a, b in found:
                            ids.append(i)
                            rows.append((item, edits, at[a][0], at[b - 1][1]))
                if rows:
                    item, edits, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(ids)), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (edits, a, b))], names=["doc_id", "item_id", "edits", "start", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, edits int, start int, end int")

    blocks = in_blocks(items)
    out, more = one(next(blocks, [])), next(blocks, None)
    if more:
        out = written(out, "contamination")
    while more:
        out, more = out.unionByName(written(one(more), "contamination")), next(blocks, None)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs in whose text no item occurs; nothing moves between tasks.

    What a block of items leaves is written before the next one comes, for the same reason.
    """

    def keep(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, errors)
            for batch in slices(batches):
                yield batch.filter(pa.array([not (t and finder.find(t)) for t in batch["text"].to_pylist()]))

        return run

    for i, block in enumerate(in_blocks(items)):
        docs = (written(docs, "decontaminated") if i else docs).mapInArrow(keep(block), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
