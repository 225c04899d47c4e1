"""Class labels for scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oligo_engine.constants import (
    EFFICACY_BANDS,
    EFFICACY_FLOOR_LABEL,
    EXOTIC_SYMBOLS,
    PANEL_THRESHOLD,
    STANDARD_CHEMISTRY,
    VIABILITY_CAUTION,
    VIABILITY_SAFE,
)


def efficacy_label(score: Column) -> Column:
    (top, top_label), *rest = EFFICACY_BANDS
    chain = F.when(score >= top, F.lit(top_label))
    for bound, label in rest:
        chain = chain.when(score >= bound, F.lit(label))
    return chain.otherwise(F.lit(EFFICACY_FLOOR_LABEL))


def viability_label(viability: Column, safe: float = VIABILITY_SAFE) -> Column:
    return (
        F.when(viability.isNull(), F.lit("Unknown"))
        .when(viability >= safe, F.lit("Safe"))
        .when(viability >= VIABILITY_CAUTION, F.lit("Caution"))
        .otherwise(F.lit("Toxic"))
    )


def panel_label(adjusted: Column) -> Column:
    return F.when(adjusted >= PANEL_THRESHOLD, F.lit("High")).otherwise(F.lit("Low"))


def chemistry_confidence(symbol: Column) -> Column:
    return (
        F.when(symbol.isin(list(STANDARD_CHEMISTRY)), F.lit("Standard"))
        .when(symbol.isin(list(EXOTIC_SYMBOLS)), F.lit("Exotic"))
        .otherwise(F.lit("Rare"))
    )


def clip_score(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def rescale_score(score: Column, batch_max: Column) -> Column:
    """Divide by the batch maximum only where that exceeds 100, else clip."""
    return F.when(batch_max > 100.0, score / batch_max * F.lit(100.0)).otherwise(clip_score(score))
