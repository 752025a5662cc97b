"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import before_each, between, let, numbers

SPAN = "array<struct<start:int,end:int,text:string>>"


#: Not characters, by the Unicode standard: they mark matches in a text, from which they are taken out before.
MARK, GROUP, NEITHER = "\ufdd0", "\ufdd1", "\ufdd2"


def find_all(text: Column, pattern: str, where: str = "whole") -> Column:
    """All leftmost, non-overlapping matches as array<struct<start, end, text>>, in code points.

    One pass of the pattern puts marks around matches, and behind them the group that is asked for; places come from the
    lengths of the pieces between marks (regexp_instr would count UTF-16 units).  where: as in patterns.DETECTORS.
    """
    marked = text.contains(MARK) | text.contains(GROUP)
    clean = F.when(marked, F.translate(text, MARK + GROUP, NEITHER * 2)).otherwise(text)
    put = MARK + "$0" + (GROUP + "$1" if where != "whole" else "") + MARK
    pieces = F.split(F.regexp_replace(clean, pattern, put), MARK, -1)
    whole = lambda piece: piece if where == "whole" else F.substring_index(piece, GROUP, 1)

    def found(ps: Column) -> Column:
        sizes = F.transform(ps, lambda x: F.length(whole(x)))
        return let(before_each(sizes, F.lit(0), lambda a, n: a + n), lambda at: F.transform(numbers(F.shiftright(F.size(ps), 1)), lambda i: span(F.get(ps, 2 * i + 1), F.get(at, 2 * i + 1))))

    def span(piece: Column, begin: Column) -> Column:
        m, s = whole(piece), piece if where == "whole" else F.substring_index(piece, GROUP, -1)
        end = begin + F.length(m)
        if where == "tail":
            first, last = end - F.length(s), end
        elif where == "middle":
            last = end - F.length(F.regexp_extract(m, r"(?U)(\s*.)$", 1))
            first = last - F.length(s)
        elif where == "head":
            first, last = begin, begin + F.length(s)
        else:
            first, last = begin, end
        return F.struct(first.alias("start"), last.alias("end"), s.alias("text"))

    none = F.array().cast(SPAN)
    spans = let(pieces, lambda ps: F.when(F.size(ps) > 1, found(ps)).otherwise(none))
    own = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), text.substr(s["start"] + 1, s["end"] - s["start"]).alias("text"))
    return F.coalesce(F.when(marked, F.transform(spans, own)).otherwise(spans), none)


def before(pieces: Column, at: Column, n: int) -> Column:
    """The n characters before place `at`, or as many as there are; pieces: the text as in_pieces() cuts it."""
    return between(pieces, F.greatest(at - n, F.lit(0)), F.least(at, F.lit(n)))


def line_before(pieces: Column, at: Column) -> Column:
    """What stands before place `at` in its line."""
    near = before(pieces, at, 2000)
    return F.substring_index(F.when(near.contains("\n") | (at <= 2000), near).otherwise(between(pieces, F.lit(0), at)), "\n", -1)


def collapse_table_rows(text: Column) -> Column:
    """A table row whose cells are all the same long note keeps it once; line ends stay as they are."""
    lines = F.split(text, r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\u000b\f\u001c-\u001e\u0085  ])", -1)

    def one(line: Column) -> Column:
        ending = F.regexp_extract(line, r"(\r?\n|)$", 1)
        body = F.substring(line, F.lit(1), F.length(line) - F.length(ending))
        cells = F.transform(F.split(body.substr(F.lit(2), F.length(body) - 2), r"\|", -1), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
        first = cells[0]
        same = F.forall(cells, lambda c: c == first) & (F.size(cells) >= 3) & (F.length(first) >= 12) & ~first.rlike("^-+$")
        row = body.startswith("|") & body.endswith("|") & (F.length(body) >= 2)
        return F.when(row & same, F.concat(F.lit("| "), first, F.lit(" |"), F.repeat(F.lit(" |"), F.size(cells) - 1), ending)).otherwise(line)

    return F.array_join(F.transform(lines, one), "")


#: Vowels that stand for each other.
VOWEL_GROUPS = ("aá", "eé", "ií", "oóöő", "uúüű")


def accent_pattern(literal: str) -> str:
    """A pattern that matches the literal with any accents on its vowels."""
    groups = {c: f"[{g}]" for g in VOWEL_GROUPS for c in g}
    return "".join(groups.get(c.lower()) or re.sub(r"([^\w\s])", r"\\\1", c) for c in literal)


def parts_of(value: str) -> list[str]:
    return [p for p in re.split(r"[\s\-–—.]+", value.strip()) if p]


def any_order(parts: list[str], joint: str, name: str) -> str:
    """A pattern that matches the parts in any order with joints between: as many parts as there are, and after each an
    empty group of its own, all of which must be set in the end.
    """
    each = [accent_pattern(p) for p in parts]

    def step(k: str) -> str:
        # of equal parts, the earlier ones are taken first
        before = [next((j for j in reversed(range(i)) if each[j].lower() == p.lower()), None) for i, p in enumerate(each)]
        return "|".join((rf"\k<{name}{k}{j}>" if j is not None and k == "a" else "") + rf"{p}(?<{name}{k}{i}>)" for i, (p, j) in enumerate(zip(each, before, strict=True)))

    ends = "".join(rf"(?:\k<{name}a{i}>|\k<{name}b{i}>)" for i in range(len(each)))
    return rf"(?:(?:{step('a')}){accent_pattern(joint)}){{{len(parts) - 1}}}(?:{step('b')}){ends}"


def manual_pattern(value: str) -> str:
    """What matches a value written in other ways, longest ways first: its parts in any order with a joint between them, and
    any of its neighbouring parts alone.  Orders aren't listed: a pattern takes the parts one by one, each of them once.
    """
    parts = parts_of(value)
    ways = {accent_pattern(value.strip() or value): len(value.strip())}
    whole = sum(map(len, parts))
    if len(parts) > 1:
        ways |= {any_order(parts, joint, f"j{k}"): whole + len(joint) * (len(parts) - 1) for k, joint in enumerate((". ", " ", "-", ""))}
    pieces = {joint.join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) for joint in (" ", "-")}
    ways |= {accent_pattern(piece): len(piece) for piece in pieces}
    return "(?iu)" + "|".join(sorted(ways, key=lambda w: (-ways[w], w)))


def manual_redact(text: Column, value: str, label: str = "NAME") -> tuple[Column, Column]:
    """(text with each variant of value replaced, number of replacements); no word boundaries, the label as it is."""
    p, parts = manual_pattern(value), parts_of(value)
    # each way of writing the value has one of its parts in it, which is looked for far faster
    some = text.rlike("(?iu)" + "|".join(accent_pattern(x) for x in parts)) if parts else F.lit(True)
    new = F.when(some, F.regexp_replace(text, p, F.lit(f"[REDACTED_{label}]").cast("string"))).otherwise(text)
    return new, F.when(some, F.regexp_count(text, F.lit(p))).when(text.isNotNull(), 0)


def manual_files(files: DataFrame, value: str, label: str = "NAME") -> DataFrame:
    """files (name, text, ...) and new_text, new_name, n_replaced (in the text): the value redacted in both.  Names that are
    equal afterwards are made different by runs.unique_names()."""
    text, n = manual_redact(F.col("text"), value, label)
    return files.withColumns({"new_text": text, "new_name": manual_redact(F.col("name"), value, label)[0], "n_replaced": n})


def sanitize_log(text: Column) -> Column:
    """A log line without user folders, document names and folders: only XYZ.pdf or .md, and last parts of paths, stay."""
    kinds = ("pdf", "md")
    rules = [(r"(?i)([A-Z]:\\Users\\)[^\\\r\n]+", "$1***")]
    rules += [(rf"(?i)(['\"])[^'\"\r\n]*\.{k}\1", f"$1XYZ.{k}$1") for k in kinds]
    rules += [(rf"(?iU)(?<=[/\\])[^/\\'\"\r\n]*\.{k}\b", f"XYZ.{k}") for k in kinds]
    rules += [(rf"(?iU)(?<=\b{p} ).*?\.pdf\b", "XYZ.pdf") for p in ("Converting", "processing", "document", "open")]
    rules += [(r"(?U)['\"]?/(?:[^\s'\",:\]/]*/)*([^\s'\",:\]/]+)/*", "/***/$1")]
    rules += [(rf"(?iU)[^\s/\\]+\.{k}\b", f"XYZ.{k}") for k in kinds]
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def redact_filename(path: Column, field: str, full: str) -> Column:
    """The stem of a path, names replaced in each part between spaced dashes; field: labelled-name pattern."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    pieces = F.split(stem, r"(?U)(?<=\s[-–—])(?=\s)|(?<=[^\s])(?=\s+[-–—]\s)", -1)

    def one(piece: Column) -> Column:
        dash = F.regexp_extract(piece, r"(?U)^(\s+[-–—])$", 1)
        lead = F.regexp_extract(piece, r"(?U)^(\s*)", 1)
        named = F.aggregate(F.regexp_extract_all(piece, F.lit(field), F.lit(1)), piece, lambda a, m: F.when(F.length(m) > 3, F.replace(a, m, F.lit("[REDACTED_NAME]"))).otherwise(a))
        named = F.regexp_replace(named, full, "[REDACTED_NAME]")
        return F.when(dash != "", piece).otherwise(F.concat(lead, F.regexp_replace(F.regexp_replace(named, r"(?U)^\s+|\s+$", ""), r"(?U)\s{2,}", " ")))

    return F.array_join(F.transform(pieces, one), "")

