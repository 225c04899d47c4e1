"""Cleaning expressions for raw exports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oligo_engine.constants import (
    ALIAS_RULES,
    CANONICAL,
    DEFAULT_DOSE_NM,
    PRIME_MARKS,
    UNMAPPABLE_AS_BLANK,
    UNMODIFIED_TOKENS,
)
from oligo_engine.functions.sequence import is_rna, letters_as_rna


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strict_sequence(raw: Column) -> Column:
    """Struct of the normalised sequence and the reason it is unusable (or null).

    The caller keeps rows without a reason and sends the rest to quarantine.
    """
    rna = letters_as_rna(raw)
    bad = F.regexp_replace(rna, "[AUGC]", "")
    reason = (
        F.when(raw.isNull() | (stripped(raw) == ""), F.lit("empty input"))
        .when(F.length(bad) > 0, F.lit("unexpected characters"))
        .when(F.length(rna) < 21, F.lit("shorter than 21 nt"))
    )
    return F.struct(F.when(reason.isNull(), rna).alias("sequence"), reason.alias("reason"))


def lenient_sequence(raw: Column) -> Column:
    """Normalised sequence, or null for anything unusable."""
    rna = letters_as_rna(raw)
    return F.when(is_rna(rna), rna)


def strand_length_ok(s: Column, lo: int = 19, hi: int = 25) -> Column:
    return F.coalesce(F.length(s).between(lo, hi), F.lit(False))


def parse_efficacy(raw: Column) -> Column:
    """First signed decimal in free text, clipped to 0-100; null without one."""
    number = F.regexp_extract(raw, r"[-+]?\d*\.?\d+", 0)
    value = F.nullif(number, F.lit("")).try_cast("double")
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)))


def parse_efficacy_dashed(raw: Column) -> Column:
    """As ``parse_efficacy`` for exports that write negatives with two dashes."""
    return parse_efficacy(F.regexp_replace(raw, "^--", "-"))


def normalise_modification_name(name: Column) -> Column:
    return stripped(F.translate(F.lower(name), PRIME_MARKS, ""))


def modification_symbol(name: Column, found: Column | None = None) -> Column:
    """Symbol of a raw modification name.

    Empty string where the field says "unmodified", null where no alias matches.
    The built-in aliases form one ordered CASE, so no join or shuffle is needed;
    ``found`` is the symbol that a table of rules gives instead.
    """
    raw = stripped(name)
    cleaned = normalise_modification_name(raw)
    chain = F.when(
        name.isNull() | raw.isin(UNMAPPABLE_AS_BLANK) | F.upper(raw).isin(CANONICAL), F.lit("")
    )
    if found is not None:
        return chain.otherwise(found)
    for text, symbol in ALIAS_RULES:
        chain = chain.when(F.contains(cleaned, F.lit(text)), F.lit(symbol))
    return chain


def is_unmodified(field: Column) -> Column:
    """True where a modification field says nothing was modified (null counts)."""
    raw = stripped(F.coalesce(field, F.lit("")))
    return F.lower(raw).isin(UNMODIFIED_TOKENS) | F.upper(raw).isin(CANONICAL)


def log_dose(concentration: Column) -> Column:
    """log1p of the dose; missing and non-positive doses count as 10 nM."""
    dose = F.when(concentration > 0, concentration).otherwise(F.lit(DEFAULT_DOSE_NM))
    return F.log1p(dose)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
