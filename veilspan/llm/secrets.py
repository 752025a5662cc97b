"""Secret scans: fixed patterns, and a battery of randomness tests on every other long token.

A token's encoding is inferred from its characters (hex, base 32 or 36 of one case, letters and digits, base 64); a token
that no alphabet holds is split at inner "=" and at separators, and its pieces are tokens of their own, as is what the
fixed patterns leave of one.  Their values are tested against uniform random values by chi-squared over equal parts of the
alphabet, a runs test and lag-one serial correlation: a token that these reject isn't random.  Of the others, those are
secrets that can't be ordinary: a token's probability under plain models of ordinary ones (letters by their frequency in
runs of one class, repeats, counting up) over that under its alphabet is a p-value for being ordinary, which falls with
every further random character, so that length counts on an absolute scale, for a single token as well.  The
Benjamini-Hochberg procedure over a document's tokens keeps the expected share of ordinary ones among those reported below
a level.  A document's result depends on its own text only.

Edge cases: a null text counts as empty and has no spans; overlapping spans are all reported, and merged when text is
redacted; repeated rows are scanned alike; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Span kinds in their order.
KINDS = ("assign", "access", "hex", "random")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Alphabets by size; a token's is the first that has all its characters.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base32lower": LOWER + "234567", "base36": LOWER + DIGITS, "base36upper": UPPER + DIGITS}
ALPHABETS |= {"alnum": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_"}
TABLES = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: Pieces between inner "=", and those between separators that base 64, its URL form, or letters and digits alone lack.
INNER = re.compile(r"[^=]+")
SEPARATORS = "+/_=-"
#: How often letters are found in a hundred thousand of ordinary text.
LETTERS = dict(a=8167, b=1492, c=2782, d=4253, e=12702, f=2228, g=2015, h=6094, i=6966, j=153, k=772, l=4025, m=2406, n=6749, o=7507, p=1929, q=95, r=5987, s=6327, t=9056, u=2758, v=978, w=2360, x=150, y=1974, z=74)
LOG_LETTERS = {c: math.log(n / sum(LETTERS.values())) for c, n in LETTERS.items()}
#: Logarithms of a character's probability to be of the same class as the one before, and of one of the three others.
STAY, LEAVE = math.log(0.9), math.log(0.1 / 3)
CUTS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"), re.compile(r"[^+/_-]+"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's cube root."""
    return normal_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def encoding(token: str) -> str | None:
    chars = set(token.rstrip("="))
    return next((k for k, s in SETS.items() if chars <= s), None)


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of what is tested of text[start:end]: all of it if an alphabet has all its characters, or else its pieces."""
    if encoding(text[start:end]):
        return [(start, end)]
    body, out = start + len(text[start:end].rstrip("=")), []
    for m in INNER.finditer(text, start, body):
        a, b = m.start(), end if m.end() == body else m.end()
        out += [(a, b)] if encoding(text[a:b]) else [c.span() for cut in CUTS for c in cut.finditer(text, a, b)]
    return sorted({(a, b) for a, b in out if b - a >= LEAST})


def disjoint(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, in order."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def outside(text: str, start: int, end: int, cover: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of what cover leaves of text[start:end], without separators next to it, if long enough."""
    i = bisect.bisect_right(cover, start, key=lambda c: c[1])
    while start < end:
        a, b = cover[i] if i < len(cover) and cover[i][0] < end else (end, end)
        left = text[start:a]
        if a < end:
            left = left.rstrip(SEPARATORS)
        if i and cover[i - 1][1] == start:
            left, start = left.lstrip(SEPARATORS), start + len(left) - len(left.lstrip(SEPARATORS))
        if len(left) >= LEAST:
            yield start, start + len(left)
        start, i = b, i + 1


def battery(token: str, kind: str) -> float:
    """p-value of the token being uniform random text over its alphabet: three tests, combined by Bonferroni."""
    v = np.array([TABLES[kind][c] for c in token.rstrip("=")])
    n, size = len(v), len(ALPHABETS[kind])
    if n < 8:
        return 1.0
    parts = max(2, min(16, n // 4))
    seen = np.bincount(v * parts // size, minlength=parts)
    expected = n * np.bincount(np.arange(size) * parts // size, minlength=parts) / size
    uniform = chi2_tail(float(((seen - expected) ** 2 / expected).sum()), parts - 1)
    high = v >= size / 2
    up = int(high.sum())
    if up in (0, n):
        return 0.0
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * up * (n - up) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    run = 2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    d = v - v.mean()
    serial = 2 * normal_tail(abs(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n) + 1 / math.sqrt(n)))
    return min(1.0, 3 * min(uniform, run, serial))


def log_ordinary(token: str) -> float:
    """Logarithm of the largest probability that a plain model of ordinary tokens gives the token.

    In each, a character is new or follows the one before: it stays in its class (capitals, small letters, digits,
    separators) nine times of ten; or it is that one again, or the next one by code, every second time.
    """
    spelled = again = 0.0
    last, kind = "", ""
    for c in token:
        now = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "/"
        own = LOG_LETTERS[c.lower()] if now in "aA" else -math.log(10) if now == "0" else -math.log(len(SEPARATORS))
        fresh = own + (STAY if now == kind else LEAVE)
        spelled += fresh
        follows = last and (c == last or ord(c) == ord(last) + 1)
        again += math.log(0.5 * math.exp(fresh) + (0.25 if follows else 0.0))
        last, kind = c, now
    return max(spelled, again)


def ordinary(token: str, kind: str) -> float:
    """p-value of the token being ordinary: Markov's bound on how much likelier its alphabet makes it."""
    token = token.rstrip("=")
    return math.exp(min(0.0, log_ordinary(token) + len(token) * math.log(len(ALPHABETS[kind]))))


def discovered(p: list[float], level: float) -> list[bool]:
    """Benjamini-Hochberg: which hypotheses are rejected."""
    order = sorted(range(len(p)), key=p.__getitem__)
    most = max((k for k, i in enumerate(order, 1) if p[i] <= level * k / len(p)), default=0)
    out = [False] * len(p)
    for i in order[:most]:
        out[i] = True
    return out


def find(text: str, level: float = 0.01, random: float = 0.01, bits: float = 80.0) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind.  level: share of ordinary tokens among random ones reported; random: share of
    random tokens that the battery may reject; bits: least size of a random one."""
    low, spans = text.lower(), []
    if any(k in low for k in KEYS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    cover, tokens = disjoint(spans), []
    for m in TOKEN.finditer(text):
        if not any(c.isdigit() for c in m[0]):
            continue
        for a, b in (p for left in outside(text, *m.span(), cover) for p in parts(text, *left)):
            token = text[a:b]
            if any(c.isdigit() for c in token) and (kind := encoding(token)):
                uniform = len(token) * math.log2(len(ALPHABETS[kind])) >= bits and battery(token, kind) >= random
                tokens.append((a, b, ordinary(token, kind) if uniform else 1.0))
    if tokens:
        spans += [("random", a, b) for (a, b, _), out in zip(tokens, discovered([t[2] for t in tokens], level), strict=True) if out]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[SECRET_{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, secrets array<struct<kind, start, end>>, text redacted, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [find(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f] for f in found], SPAN), pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)])], names=["doc_id", "secrets", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def redact(docs: DataFrame) -> DataFrame:
    """docs, each secret in text replaced by its kind, n_chars (where there is one) following; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            new = [t and redacted(t, find(t)) for t in texts]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                was = batch["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(was, texts, new, strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("secrets").alias("spans"))
