"""Expressions over modified strands.

A modified strand carries a symbol in place of a base, so the base is only known
from the parent strand.  ``exposure`` folds both into one string that the rules can
read with plain string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oligo_engine.functions.cleaning import stripped
from oligo_engine.constants import (
    BULKY_SYMBOLS,
    CANONICAL,
    MODIFICATIONS,
    RESCUE_NAMES,
    RESCUE_PREFIX,
)
from oligo_engine.functions.sequence import overlapping_count

# Marks in an exposure string: a base letter is unmodified, FLUORO_PYRIMIDINE is a
# 2'-fluoro on a C or U, COVERED is any other replaced base.
COVERED = "."
FLUORO_PYRIMIDINE = "f"


def exposure_mark(symbol: Column, base: Column) -> Column:
    """Mark of one position that holds ``symbol`` over ``base``."""
    return (
        F.when(symbol == base, base)
        .when((symbol == "F") & base.isin("U", "C"), F.lit(FLUORO_PYRIMIDINE))
        .otherwise(F.lit(COVERED))
    )


def exposure(modified: Column, parent: Column) -> Column:
    """Per position: the base where unmodified, otherwise a coverage mark."""
    marks = F.zip_with(F.split(modified, ""), F.split(parent, ""), exposure_mark)
    return F.array_join(marks, "")


def changes(modified: Column, parent: Column) -> Column:
    """Array of (pos, symbol) where the variant differs from its parent."""
    places = F.transform(
        F.sequence(F.lit(1), F.length(modified)),
        lambda p: F.struct(
            p.alias("pos"),
            F.substr(modified, p, F.lit(1)).alias("symbol"),
            F.substr(parent, p, F.lit(1)).alias("base"),
        ),
    )
    changed = F.filter(places, lambda x: x.symbol != x.base)
    return F.transform(changed, lambda x: F.struct(x.pos.alias("pos"), x.symbol.alias("symbol")))


def sterically_viable(modified: Column, parent: Column) -> Column:
    """False for three or more adjacent bulky replacements."""
    bulky = F.array_join(
        F.zip_with(
            F.split(modified, ""),
            F.split(parent, ""),
            lambda x, y: F.when((x != y) & x.isin(list(BULKY_SYMBOLS)), F.lit("#")).otherwise(F.lit("-")),
        ),
        "",
    )
    suspicious = modified.rlike(f"[{BULKY_SYMBOLS}]{{3}}")
    return ~F.when(suspicious, F.contains(bulky, F.lit("###"))).otherwise(F.lit(False))


def seed_rescue(modified_antisense: Column) -> Column:
    """Array of (pos, symbol) of seed-rescuing chemistry at guide positions 2-7."""
    upper = F.upper(modified_antisense)
    places = F.transform(
        F.sequence(F.lit(2), F.lit(7)),
        lambda p: F.struct(p.alias("pos"), F.substr(upper, p, F.lit(1)).alias("symbol")),
    )
    return F.filter(places, lambda x: x.symbol.isin([s for s, _ in RESCUE_NAMES]))


def has_seed_rescue(modified_antisense: Column) -> Column:
    return F.substring(F.upper(modified_antisense), 2, 6).rlike("[MFLE]")


def rescue_note(rescues: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RESCUE_NAMES for x in pair])
    parts = F.transform(
        rescues, lambda x: F.concat(names[x.symbol], F.lit(" @ pos "), x.pos.cast("string"))
    )
    return F.when(F.size(rescues) > 0, F.concat(F.lit(RESCUE_PREFIX), F.array_join(parts, ", "))).otherwise(
        F.lit("")
    )


def parse_instructions(symbols: Column, positions: Column, strand: Column) -> Column:
    """Parse a grouped specification such as ``F,,M`` at ``2,5,,10,12``.

    Struct of ``steps`` (array of (symbol, pos) in application order) and ``error``
    (null when the specification is usable).
    """
    known = F.array(*[F.lit(s) for s in MODIFICATIONS + CANONICAL])
    given = (F.coalesce(F.length(symbols), F.lit(0)) > 0) & (F.coalesce(F.length(positions), F.lit(0)) > 0)
    symbol_groups = F.transform(F.split(symbols, ",,"), lambda x: stripped(x))
    position_groups = F.transform(
        F.split(positions, ",,"),
        lambda g: F.filter(F.transform(F.split(g, ","), lambda x: stripped(x)), lambda p: p != ""),
    )
    tokens = F.flatten(position_groups)
    steps = F.flatten(
        F.zip_with(
            symbol_groups,
            position_groups,
            lambda s, ps: F.transform(
                ps, lambda p: F.struct(s.alias("symbol"), p.try_cast("int").alias("pos"))
            ),
        )
    )
    error = (
        F.when(F.size(symbol_groups) != F.size(position_groups), F.lit("group count mismatch"))
        .when(F.exists(symbol_groups, lambda s: ~F.array_contains(known, s)), F.lit("unknown symbol"))
        .when(F.exists(tokens, lambda p: ~p.rlike(r"^[+-]?\d+$")), F.lit("bad position"))
        .when(F.exists(steps, lambda x: ~x.pos.between(1, F.length(strand))), F.lit("position out of range"))
    )
    return F.struct(
        F.when(given & error.isNull(), steps).otherwise(F.slice(steps, 1, 0)).alias("steps"),
        F.when(given, error).alias("error"),
    )


def apply_steps(strand: Column, steps: Column) -> Column:
    """Apply (symbol, pos) steps in order; a later step wins."""
    return F.aggregate(steps, strand, lambda s, x: F.overlay(s, x.symbol, x.pos, F.lit(1)))


def covered_by(strand: Column, mask: Column, symbol: str) -> Column:
    """The strand with positions blanked where an equally long mask holds ``symbol``."""
    blanked = F.array_join(
        F.zip_with(
            F.split(strand, ""),
            F.split(mask, ""),
            lambda x, m: F.when(m == symbol, F.lit(COVERED)).otherwise(x),
        ),
        "",
    )
    usable = (F.length(mask) == F.length(strand)) & F.contains(mask, F.lit(symbol))
    return F.when(F.coalesce(usable, F.lit(False)), blanked).otherwise(strand)


def motif_count(s: Column, motifs: list[str]) -> Column:
    """Overlapping hits of motifs of which at most one can start at any place."""
    return F.when(s.isNull(), F.lit(0)).otherwise(overlapping_count(s, "|".join(motifs)))
