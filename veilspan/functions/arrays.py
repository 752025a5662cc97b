"""Array expressions that take time in proportion to the array, where aggregate() with concat() would copy it each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded at once, as a power of two; characters of a piece of text.
SHIFT, PIECE = 6, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: inside other array functions, expressions are evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def before_each(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each element, the fold of those before it: of whole blocks, then of the rest of its own block."""
    width = 1 << SHIFT

    def of(v: Column) -> Column:
        blocks = F.transform(numbers(F.shiftright(F.size(v) + (width - 1), SHIFT)), lambda b: F.aggregate(F.slice(v, b * width + 1, F.lit(width)), zero, fold))
        return let(blocks, lambda bs: let(F.transform(numbers(F.size(bs)), lambda b: F.aggregate(F.slice(bs, F.lit(1), b), zero, fold)), lambda starts: with_starts(v, starts)))

    def with_starts(v: Column, starts: Column) -> Column:
        rest = lambda i: F.slice(v, i - i.bitwiseAND(F.lit(width - 1)) + 1, i.bitwiseAND(F.lit(width - 1)))
        return F.transform(v, lambda x, i: F.aggregate(rest(i), F.get(starts, F.shiftright(i, SHIFT)), fold))

    return let(values, of)


def in_pieces(text: Column) -> Column:
    """The text as an array of PIECE characters each: places in it are found without reading all that stands before."""
    return F.transform(numbers(F.shiftright(F.length(text), 12) + 1), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def between(pieces: Column, at: Column, n: Column) -> Column:
    """The n characters from place `at` on."""
    inside = at.bitwiseAND(F.lit(PIECE - 1))
    some = F.slice(pieces, F.shiftright(at, 12) + 1, F.shiftright(inside + n, 12) + 1)
    return F.substring(F.array_join(some, ""), inside + 1, n)
