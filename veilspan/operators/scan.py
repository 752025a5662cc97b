"""The detectors, and what redaction makes of their spans, over batches of texts in Python: the same results as
detect.spans_of(), spans.merged(), ids_near_names() and redacted(), many times faster than array expressions.

A pattern runs once over all texts of a batch that have what it needs, joined.  That is done for texts in which Java and
Python agree on every character's class and case (ALIKE); for others the functions give null, and callers take the expressions.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import BARE_STAMP, BIRTH_CONTEXT, DETECTORS, INSTITUTION, NEEDS, PLACEHOLDERS, TAJ_BEFORE
from .detect import FULL_SPAN, LEAST, RULES, WEIGHTS, spans_of

#: Characters that are word, white space, digit and letter of a case to Java and Python alike; marks are not, nor are number
#: signs that are no digits, control characters 1C to 1F, and what Unicode took in late.
ALIKE = (
    "\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u02ff\\u0370-\\u0482\\u048a-\\u0590\\u1e00-\\u200b\\u200e-\\u203e\\u2041-\\u2053\\u2055-\\u206f\\u20a0-\\u20cf"
    "\\u2100-\\u2129\\u212b-\\u214f\\u2190-\\u245f\\u2500-\\u2775\\u2794-\\u2bff\\u3000-\\u3029\\u3030-\\u3098\\u309b-\\u3191\\u3400-\\u4dbf\\u4e00-\\u9fef\\uac00-\\ud7a3\\uff01-\\uff3e"
    "\\uff41-\\uff5a\\ufffd\\U0001f300-\\U0001f64f\\U0001f680-\\U0001f6ff"
)
UNLIKE = re.compile(f"[^{ALIKE}]")
#: Stands between joined texts: no pattern takes it in, and it is neither word nor white space.
BETWEEN = "\x00"
#: Characters that are searched at once.
MOST = 1 << 22
#: Below that many texts, compiling what RE2 looks for costs more than it saves.
FEW = 16
NEAR = 60
LINE_ENDS = r"\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029"
ROW = re.compile(rf"(?:\A|(?<=[{LINE_ENDS}]))\|([^{LINE_ENDS}]*)\|(?=\r?\n|\Z)")
RESULT = f"struct<first:{FULL_SPAN},near:{FULL_SPAN},spans:{FULL_SPAN},text:string>"
SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("ord", pa.int32())])
Span = tuple[int, int, int, str, str, float | None]  # start, end, ord, label, text, score
More = Callable[[str, list[Span]], list[Span]]


def compiled(pattern: str) -> re.Pattern:
    flags = re.match(r"\(\?(i?)[uU]\)", pattern)
    return re.compile(pattern[flags.end() :], re.I if flags[1] else 0) if flags else re.compile(pattern)


def cheap(need: str) -> str:
    """What a text must have, for RE2: without what must not follow."""
    return re.sub(r"^\(\?iu\)", "(?i)", need).replace("(?![A-Za-z])", "")


def alike(text: str) -> bool:
    return not UNLIKE.search(text)


def collapsed(text: str) -> str:
    """collapse_table_rows()"""

    def one(m: re.Match) -> str:
        cells = [c.strip() for c in m[1].split("|")]
        first = cells[0]
        same = len(cells) >= 3 and len(first) >= 12 and cells.count(first) == len(cells) and first.strip("-")
        return f"| {first} |" + " |" * (len(cells) - 1) if same else m[0]

    return ROW.sub(one, text) if "|" in text else text


def merge(spans: list[Span]) -> list[Span]:
    """Overlapping spans become one with the first one's label and text: spans.merged()."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if out and s[0] < out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], *out[-1][2:5], None)
        else:
            out.append(s)
    return out


def redacted(text: str, spans: list[Span]) -> str:
    parts, last = [], 0
    for a, b, _, label, *_ in spans:
        parts += [text[last:a], PLACEHOLDERS.get(label) or f"[REDACTED_{label}]"]
        last = b
    return "".join([*parts, text[last:]])


class Scanner:
    """Spans of the detectors, or of those named; compiled: makes patterns of what Java takes."""

    def __init__(self, only: tuple[str, ...] | None = None, compiled: Callable[[str], re.Pattern] = compiled):
        self.detectors = [(rank, *d[:3], compiled(d[3]), NEEDS[d[0]]) for rank, d in enumerate(DETECTORS) if not only or d[0] in only]
        self.needs = {d[1]: [compiled(n.replace(r"\p{Nd}", r"\d").replace(r"[^\p{L}\d]", r"(?:[\W_]|(?!\d)\w)")) for n in d[5]] for d in self.detectors}
        self.stamp, self.birth, self.taj, self.institution = (compiled(p) for p in (BARE_STAMP, BIRTH_CONTEXT, TAJ_BEFORE, INSTITUTION))

    def kept(self, name: str, text: str, start: int, found: str) -> bool:
        if name == "taj":
            digits = re.sub(r"[-\s\xa0]", "", found, flags=re.A)
            sums = len(digits) == 9 and digits.isascii() and digits.isdigit() and sum(int(c) * w for c, w in zip(digits, WEIGHTS, strict=False)) % 10 == int(digits[8])
            return (sums or bool(self.taj.search(text[max(0, start - 60) : start]))) and not self.institution.search(text[max(0, start - 12) : start])
        if name in RULES:
            line = text[text.rfind("\n", 0, start) + 1 : start]
            return bool(self.birth.search(line) or ":" not in line and self.birth.search(text[max(0, start - 80) : start]))
        return len(found) >= LEAST.get(name, 0)

    def found(self, texts: list[str]) -> list[list[Span]]:
        """Of each text the spans, in the order of the detectors and of their places."""
        out: list[list[Span]] = [[] for _ in texts]
        column, masks = pa.array(texts, pa.string()) if len(texts) >= FEW else None, {}
        for rank, name, label, where, pattern, needs in self.detectors:
            if column is None:
                which = [i for i, t in enumerate(texts) if all(n.search(t) for n in self.needs[name])]
            else:
                for need in needs:
                    if need not in masks:
                        masks[need] = pc.match_substring_regex(column, cheap(need))
                which = pc.indices_nonzero(functools.reduce(pc.and_, [masks[n] for n in needs])).to_pylist()
            for i, group in everywhere(pattern, [texts[i] for i in which], 0 if where == "whole" else 1):
                n, text = 0, texts[which[i]]
                for a, b in group:
                    if self.kept(name, text, a, text[a:b]):
                        out[which[i]].append((a, b, (rank + 1) * 1_000_000 + n, label, text[a:b], None))
                        n += 1
        return out

    def near(self, texts: list[str], first: list[list[Span]]) -> list[list[Span]]:
        """Of each text the short numbers near NAME spans, unless a span covers them: spans.ids_near_names()."""
        out: list[list[Span]] = [[] for _ in texts]
        which = [i for i, spans in enumerate(first) if any(s[3] == "NAME" for s in spans)]
        for i, group in everywhere(self.stamp, [texts[i] for i in which], 0):
            i = which[i]
            names, ends = [s for s in first[i] if s[3] == "NAME"], [s[1] for s in first[i]]
            name_ends = [s[1] for s in names]
            for a, b in group:
                # spans are disjoint and in order: the first that ends late enough decides
                k, c = bisect_right(name_ends, a - NEAR - 1), bisect_right(ends, b - 1)
                if k < len(names) and names[k][0] - NEAR <= b and not (c < len(ends) and first[i][c][0] <= a):
                    out[i].append((a, b, 90_000_000 + len(out[i]), "DOCTOR_ID", texts[i][a:b], None))
        return out


def everywhere(pattern: re.Pattern, texts: list[str], group: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of the text, places of the group) for all texts with matches, from one search of all of them."""
    begins, at = [], 0
    for t in texts:
        begins.append(at)
        at += len(t) + 1
    k, places = -1, []
    for m in pattern.finditer(BETWEEN.join(texts)):
        a, b = m.span(group)
        if k < 0 or a >= begins[k] + len(texts[k]) + 1:
            if places:
                yield k, places
            k, places = bisect_right(begins, a, max(k, 0)) - 1, []
        places.append((a - begins[k], b - begins[k]))
    if places:
        yield k, places


def groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts that are alike, some MOST characters at a time."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if t is not None and alike(t):
            some.append(i)
            size += len(t)
            if size >= MOST:
                yield some
                some, size = [], 0
    if some:
        yield some


def lists(spans: list[list[Span] | None]) -> pa.Array:
    """An array of FULL_SPAN; None is null."""
    flat, offsets = [], [0]
    for s in spans:
        flat += s or ()
        offsets.append(len(flat))
    start, end, order, label, text, score = zip(*flat, strict=True) if flat else ((),) * 6
    values = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(label, pa.string()), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(order, pa.int32())]
    mask = pa.array([s is None for s in spans], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, fields=list(SPAN_TYPE)), mask=mask)


@functools.cache
def scanner(only: tuple[str, ...] | None) -> Scanner:
    return Scanner(only)


def scanned(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """spans_of(), null for null and for texts that aren't alike."""

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        out: list[list[Span] | None] = [None] * len(texts)
        for some in groups(texts):
            for i, spans in zip(some, scanner(only).found([texts[i] for i in some]), strict=True):
                out[i] = spans
        return lists(out)

    return F.arrow_udf(run, FULL_SPAN)(text)


def found(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """spans_of() of every text, by whichever way is open to it."""
    return F.coalesce(scanned(text, only), spans_of(text, only))


def resolved(text: Column, rows: bool = False, put: bool = False, more: Callable[[], More] | None = None) -> Column:
    """Of a text the merged spans (first), the numbers near names (near), both merged (spans) and, if it is put, the text
    with placeholders; rows: of the text with collapsed table rows; more: makes, once in each task, what gives further spans
    of a text and those of its patterns.  Null for null and for texts that aren't alike."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        others = more() if more else None
        for column in batches:
            yield batch(column, others)

    def batch(column: pa.Array, others: More | None) -> pa.Array:
        texts, scan = column.to_pylist(), scanner(None)
        first, near, spans, new = ([None] * len(texts) for _ in range(4))
        for some in groups(texts):
            own = [collapsed(texts[i]) if rows else texts[i] for i in some]
            one = [merge((others(t, s) if others else []) + s) for t, s in zip(own, scan.found(own), strict=True)]
            for i, t, a, b in zip(some, own, one, scan.near(own, one), strict=True):
                first[i], near[i], spans[i] = a, b, merge(a + b) if b else a
                if put:
                    new[i] = redacted(t, spans[i])
        parts = [lists(first), lists(near), lists(spans), pa.array(new, pa.string())]
        return pa.StructArray.from_arrays(parts, ["first", "near", "spans", "text"], mask=pa.array([s is None for s in spans], pa.bool_()))

    return F.arrow_udf(run, RESULT)(text)
