"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token's tokens are counted on its own.  A segment tree
over the pre-tokens holds sums of characters and tokens.  An edit starts again two pre-tokens before the place that it
touches (the pattern looks no farther ahead than that) and stops as soon as it meets an old boundary behind the edit: from
there on the old pre-tokens stand.  Only what lies between is encoded again, and sums change on the paths above it.

Edge cases: a null text counts as empty; an edit's places are code points, cut to the text's length; an edit with a null
start or an end before its start is left out; edits of a document apply one after the other, each to the text so far.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

#: Vocabulary file (tiktoken ranks) by default, of the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a leaf; different pre-tokens whose counts a worker remembers.
LEAF, REMEMBERED = 128, 400_000
#: Pre-tokens before an edit that it can change.
BACK = 2


class Tokens:
    """Counts tokens of single pre-tokens; remembers a bounded number of them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("veilspan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = len(self.encoding.encode_ordinary(p))
                if len(p) < 64:
                    known[p] = n
            out.append(n)
        return out


@lru_cache(4)
def tokens(path: str | None = None) -> Tokens:
    import public_tokenizers

    return Tokens(path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def unpacked(data: bytes) -> tuple[list[int], list[int]]:
    n = int.from_bytes(data[:4], "little")
    codes = np.frombuffer(data, np.uint8, n, 4)
    size, count = (codes >> 3).astype(np.int64), (codes & 7).astype(np.int64)
    size[codes == 255], count[codes == 255] = np.frombuffer(data, "<u4", offset=4 + n).reshape(2, -1)
    return size.tolist(), count.tolist()


class Tree:
    """A text's pre-tokens in leaves, and a segment tree of their sums: sums[i] is that of sums[2i] and sums[2i + 1]."""

    def __init__(self, text: str, counter: Tokens, kept: bytes | None = None):
        """kept: what packed() gave for this text; without it, the text is encoded."""
        self.text, self.counter, self.encoded = text, counter, 0
        if kept is None:
            pieces = counter.pattern.findall(text)
            sizes, counts = [len(p) for p in pieces], counter.count(pieces)
            self.encoded = len(pieces)
        else:
            sizes, counts = unpacked(kept)
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.build()

    def packed(self) -> bytes:
        """Sizes and counts of the pre-tokens, a byte for both unless they are large."""
        size, count = (np.array([n for leaf in self.leaves for n in leaf[k]], np.uint32) for k in (0, 1))
        small = (size < 32) & (count < 8) & ((size != 31) | (count != 7))
        codes = np.where(small, size << 3 | count, 255).astype(np.uint8)
        return len(codes).to_bytes(4, "little") + codes.tobytes() + np.stack([size[~small], count[~small]]).astype("<u4").tobytes()

    def build(self) -> None:
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.base)
        for i, (sizes, counts) in enumerate(self.leaves):
            self.sums[self.base + i] = sum(sizes), sum(counts)
        for i in range(self.base - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = a + c, b + d

    @property
    def total(self) -> int:
        return self.sums[1][1]

    def update(self, leaf: int) -> None:
        i = self.base + leaf
        self.sums[i] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        while i := i >> 1:
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = a + c, b + d

    def locate(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its start) of the pre-token that holds character `at`; the last one at the end."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.sums[i][0] and self.sums[i + 1][0]:
                start += self.sums[i][0]
                i += 1
        leaf = i - self.base
        sizes = self.leaves[leaf][0]
        for k, n in enumerate(sizes):
            if at < start + n or k == len(sizes) - 1:
                return leaf, k, start
            start += n
        return leaf, 0, start

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters start to end by new; gives the number of pre-tokens that were encoded again."""
        start, end = min(max(0, start), len(self.text)), min(max(0, end), len(self.text))
        leaf, k, at = self.locate(max(0, start - 1))
        for _ in range(BACK):
            if k:
                k -= 1
                at -= self.leaves[leaf][0][k]
            elif leaf:
                leaf -= 1
                k = len(self.leaves[leaf][0]) - 1
                at -= self.leaves[leaf][0][k]
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # old boundaries behind the edit, walked along with the new pre-tokens
        last, j, old = leaf, k, at
        pieces: list[str] = []
        pos = at
        while True:
            while old + shift < pos or old < end:
                if j == len(self.leaves[last][0]):
                    if last + 1 == len(self.leaves):
                        break
                    last, j = last + 1, 0
                    continue
                old += self.leaves[last][0][j]
                j += 1
            if pos == len(self.text):
                last, j = len(self.leaves) - 1, len(self.leaves[-1][0])
                break
            if old >= end and old + shift == pos:
                break
            m = self.counter.pattern.match(self.text, pos)
            pieces.append(m[0])
            pos = m.end()
        sizes = self.leaves[leaf][0][:k] + [len(p) for p in pieces] + self.leaves[last][0][j:]
        counts = self.leaves[leaf][1][:k] + self.counter.count(pieces) + self.leaves[last][1][j:]
        if leaf == last and 0 < len(sizes) <= 2 * LEAF:
            self.leaves[leaf] = sizes, counts
            self.update(leaf)
        else:
            self.leaves[leaf : last + 1] = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)]
            self.leaves = self.leaves or [([], [])]
            self.build()
        return len(pieces)


def trees(docs: DataFrame, path: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_tokens, n_pretokens, tree binary for every row; and more columns of docs, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens(path)
        for batch in slices(batches):
            made = [Tree(t or "", counter) for t in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["text"], *(pa.array(c, pa.int64()) for c in ([t.total for t in made], [t.encoded for t in made])), pa.array([t.packed() for t in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in more)], names=["doc_id", "text", "n_tokens", "n_pretokens", "tree", *more])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more]
    schema = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "text string", "n_tokens long", "n_pretokens long", "tree binary", *kinds]
    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join(schema))


def edited(kept: DataFrame, edits: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens (before), edited_tokens, reencoded (pre-tokens), edited_text, tree (after) for rows of
    trees() with a column of edits, array<struct<start, end, text>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokens(path)
        for batch in slices(batches):
            rows = []
            for text, tree, changes in zip(*(batch[c].to_pylist() for c in ("text", "tree", edits)), strict=True):
                now, again = Tree(text or "", counter, tree), 0
                for e in changes or ():
                    if e and e["start"] is not None and e["end"] is not None and e["start"] <= e["end"]:
                        again += now.edit(e["start"], e["end"], e["text"] or "")
                rows.append((now.total, again, now.text, now.packed() if again else tree))
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], batch["n_pretokens"], *new], names=["doc_id", "n_tokens", "n_pretokens", "edited_tokens", "reencoded", "edited_text", "tree"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    cut = kept.select("doc_id", "text", "n_tokens", "n_pretokens", "tree", edits)
    return cut.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long, edited_tokens long, reencoded long, edited_text string, tree binary")


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens for every row."""
    return trees(docs, path).drop("text", "tree")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every document, before and after three edits to its kept tree: at a quarter "re-" goes in, at half three
    characters go, at three quarters two characters become " 42"."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda share: F.floor(n * share).cast("int")
    edit = lambda share, gone, new: F.struct(at(share).alias("start"), (at(share) + gone).alias("end"), F.lit(new).alias("text"))
    kept = written(trees(table(spark, sf_dir, "documents")), "trees")
    after = edited(kept.withColumn("edits", F.array(edit(0.25, 0, "re-"), edit(0.5, 3, ""), edit(0.75, 2, " 42"))), "edits")
    return after.select("doc_id", "n_tokens", "n_pretokens", "edited_tokens", "reencoded", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"))
