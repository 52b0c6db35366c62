"""Column expressions over whole texts that several operators share.

They use built-in functions only. ``let`` binds a value once inside an expression: the value
becomes the single element of an array that a lambda runs over, so that it is neither
computed twice nor copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII white space, or everything in ASCII but letters and digits.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def white_words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def plain_words(text: Column) -> Column:
    """Runs of digits, small letters and all that is not ASCII; lower-case before."""
    return F.array_remove(F.split(text, NOT_WORD), "")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shifted(values: Column, by: int) -> Column:
    """The array without its first elements."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def zip_shifted(values: Column, other: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(values[i], other[i + by]) for each i at which both exist."""
    n = F.greatest(F.least(F.size(values), F.size(other) - by), F.lit(0))
    return F.zip_with(F.slice(values, 1, n), shifted(other, by), f)


def _joined(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def gram_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words, by joining hashes of shorter runs.

    The runs of 2, 4, 8 ... words come from two runs of half the length, so that each
    word takes part in about log2(k) hash calls instead of k.
    """

    def grow(power: Column, size: int, done: Column | None, length: int) -> Column:
        # power: hashes of runs of `size`; done: hashes of runs of `length`, the low bits of k
        if k & size:
            done, length = (power, size) if done is None else (zip_shifted(done, power, length, _joined), length + size)
        if length == k:
            return done
        step = lambda d: let(zip_shifted(power, power, size, _joined), lambda p: grow(p, size * 2, d, length))
        return step(None) if done is None else let(done, step)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda a: grow(a, 1, None, 0))


def sliding(values: Column, width: int, f: Callable[[Column, Column], Column]) -> Column:
    """f (a lambda of two, such as the least) over all runs of `width` neighbours, by doubling."""

    def grow(v: Column, have: int) -> Column:
        if have == width:
            return v
        more = min(have, width - have)
        return let(zip_shifted(v, v, more, f), lambda x: grow(x, have + more))

    return let(values, lambda v: grow(v, 1))
