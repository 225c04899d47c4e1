"""Sequence expressions: normalising, complementing, composition and structure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from oligo_engine.constants import (
    NEAREST_NEIGHBOUR,
    NEAREST_NEIGHBOUR_DEFAULT,
    STRAND_LENGTH,
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda over array elements an outer expression is evaluated anew for
    every element; bound this way it is not.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def count_of(s: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def count_in(s: Column, chars: str) -> Column:
    """Characters of ``s`` that belong to the set ``chars``."""
    return F.length(s) - F.length(F.translate(s, chars, ""))


def to_rna(s: Column) -> Column:
    return F.translate(F.upper(s), "T", "U")


def letters_as_rna(s: Column) -> Column:
    """Drop everything but letters, upper-case, DNA thymine to uracil."""
    return to_rna(F.regexp_replace(s, "[^A-Za-z]", ""))


def slow_code(text: Column) -> Column:
    """Nucleotides as one number, two bits each."""
    return F.conv(F.translate(text, "ACGU", "0123"), 4, 10).cast("bigint")


def is_rna(s: Column) -> Column:
    return s.rlike("^[AUGC]+$")


def reverse_complement(s: Column) -> Column:
    """RNA reverse complement; characters outside AUGC pass through."""
    return F.reverse(F.translate(s, "AUGC", "UACG"))


def gc_percent(s: Column) -> Column:
    """Share of G and C in percent, 0 for an empty string."""
    size = F.length(s)
    return F.when(size == 0, F.lit(0.0)).otherwise(
        count_in(F.upper(s), "GC") / size * F.lit(100.0)
    )


def has_palindrome(s: Column, stem: int = 4) -> Column:
    """True where a stem's reverse complement occurs downstream of it.

    The reverse complement of the whole strand is taken once; the stem starting at
    ``i`` has its complement at ``length - i - stem + 2`` there.
    """
    def search(x: Column) -> Column:
        size = F.length(x.s)
        return F.exists(
            F.sequence(F.lit(1), size - (2 * stem - 1)),
            lambda i: F.position(
                F.substr(x.rc, size - i - (stem - 2), F.lit(stem)), F.substr(x.s, i + stem)
            )
            > 0,
        )

    both = F.struct(s.alias("s"), reverse_complement(s).alias("rc"))
    return F.when(F.length(s) < 2 * stem, F.lit(False)).otherwise(let(both, search))


def strand_folds(s: Column, complement: Column, stem: int = 4) -> Column:
    """``has_palindrome`` where the reverse complement is known: written out by place for a
    strand of 21 letters, which is compiled, and a lambda is not."""
    tests = [
        F.position(F.substring(complement, STRAND_LENGTH - i - (stem - 2), stem), F.substring(s, i + stem, STRAND_LENGTH)) > 0
        for i in range(1, STRAND_LENGTH - 2 * stem + 2)
    ]
    return F.when(F.length(s) == STRAND_LENGTH, reduce(or_, tests)).otherwise(has_palindrome(s, stem))


def has_homopolymer(s: Column) -> Column:
    return reduce(or_, [F.contains(s, F.lit(5 * base)) for base in "AUGC"])


def has_gc_run(s: Column) -> Column:
    return F.contains(F.translate(s, "C", "G"), F.lit(6 * "G"))


def seed_of(antisense: Column) -> Column:
    """Guide positions 2 to 7."""
    return F.substring(to_rna(antisense), 2, 6)


def pad_to_strand(s: Column) -> Column:
    """Exactly 21 characters: cut at the 3' end or filled up with A."""
    return F.rpad(F.substring(s, 1, STRAND_LENGTH), STRAND_LENGTH, "A")


def replace_at(s: Column, position: Column, symbol: Column) -> Column:
    """Swap the character at a 1-based position; null when out of range."""
    inside = (position >= 1) & (position <= F.length(s))
    return F.when(inside, F.overlay(s, symbol, position, F.lit(1)))


def overlapping_count(s: Column, pattern: str) -> Column:
    """Occurrences of a pattern including overlapping ones."""
    return F.regexp_count(s, F.lit(f"(?={pattern})"))


def terminus_energy(s: Column, n: int = 4) -> Column:
    """Sum of nearest-neighbour enthalpies over the first ``n`` nucleotides."""
    table = F.create_map(*[F.lit(x) for pair in NEAREST_NEIGHBOUR for x in pair])
    head = F.substring(to_rna(s), 1, n)

    def step(i: int) -> Column:
        pair = F.substring(head, i, 2)
        energy = F.coalesce(F.try_element_at(table, pair), F.lit(NEAREST_NEIGHBOUR_DEFAULT))
        return F.when(F.length(pair) == 2, energy).otherwise(F.lit(0.0))

    return reduce(lambda a, b: a + b, [step(i) for i in range(1, n)])


def asymmetry(sense: Column, antisense: Column) -> Column:
    """Sense minus antisense 5'-end energy; above zero favours the wrong strand."""
    return terminus_energy(sense) - terminus_energy(antisense)
