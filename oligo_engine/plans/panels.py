"""Validation panels: published designs with fixed modification masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine.functions.labels import panel_label
from oligo_engine.operators.ordering import spread
from oligo_engine.operators.penalties import with_adjusted
from oligo_engine.operators.variants import as_variants, clinical_pattern
from oligo_engine.plans.scoring import Scorer

# --- Fixed values: approved-pattern panel (masks over one duplex) -------------
PANEL_DUPLEX = ("GGAAAUAGACACCAAAUCUUA", "UAAGAUUUGGUGUCUAUUUCC")
PANEL_MASKS = [
    ("ESC", "SSMMMMMMMMMMMMMMMMMM4", "1SMMMFFFMMFMFFFMFFFSS"),
    ("ESC+", "SSMMMMMMMMMMMMMMMMMM4", "1SMMMF8FMMFMFFFMFFFSS"),
    ("LNA seed", "SSMMMMMMMMMMMMMMMMMM4", "1SLLLLFFMMFMFFFMFFFSS"),
    ("Unprotected termini", "MMMMMMMMMMMMMMMMMMMMM", "MMMMMMMMMMMMMMMMMMMMM"),
    ("Over-methylated", "MMMMMMMMMMMMMMMMMMMMM", "1MMMMMMMMMMMMMMMMMMMM"),
]

# --- Fixed values: literature designs (symbols and positions per strand) ------
LITERATURE_DUPLEX = ("CGUACGCGGAAUACUUCGAUU", "UCGAAGUAUUCCGCGUACGUU")
LITERATURE_DESIGNS = [
    ("unmodified", "", "", "", ""),
    ("lna_overhangs", "L,,L", "20,,21", "L,,L", "20,,21"),
    ("lna_guide_1", "", "", "L", "1"),
    ("lna_guide_10", "", "", "L", "10"),
    ("ps_terminal", "S", "1,2", "S", "1,2,20,21"),
    ("ps_internal", "S", "10,11", "S", "5,6,15,16"),
    ("conjugate_guide_1", "", "", "4", "1"),
    ("conjugate_sense_1", "4", "1", "", ""),
    ("conjugate_sense_1_21", "4,,4", "1,,21", "", ""),
]
# --- Fixed values: clinical-pattern duplexes and limits -----------------------
CLINICAL_DUPLEXES = [
    ("high_gc33", "GGAAAUAGACACCAAAUCUUA", "UAAGAUUUGGUGUCUAUUUCC"),
    ("gc48a", "AAGCUGGCCUCAGUUAACUGA", "UCAGUUAACUGAGGCCAGCUU"),
    ("gc38b", "ACCUUGAAUGUGUCUGAUUAC", "UAAUCAGACACAUUCAAGGUU"),
    ("gc48b", "UUCUCCGAACGUGUCACGUUU", "ACGUGACACGUUCGGAGAAUU"),
]
CLINICAL_LIMITS = {"nuclease": 5.0, "immuno": 6.0, "risc": 20.0, "thermo": 8.0, "serum": 4.0}


def mask_panel(parents: DataFrame, scorer: Scorer, masks: list[tuple[str, str, str]] = PANEL_MASKS) -> DataFrame:
    """Score every mask over every parent duplex; parents, which come in few splits, are dealt out first."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("design"), F.lit(s).alias("ms"), F.lit(a).alias("ma")) for n, s, a in masks]
    )
    rows = spread(parents).select(
        "parent_id",
        F.col("sense").alias("parent_sense"),
        F.col("antisense").alias("parent_antisense"),
        F.explode(cells).alias("_m"),
    ).select(
        "parent_id", "parent_sense", "parent_antisense", "_m.design",
        F.col("_m.ms").alias("sense"), F.col("_m.ma").alias("antisense"),
    )
    scored = with_adjusted(scorer.modified(as_variants(rows), "raw_score"), "raw_score", "adjusted_score")
    return scored.withColumn("label", panel_label(F.col("adjusted_score")))


def literature_designs(spark: SparkSession) -> DataFrame:
    sense, antisense = LITERATURE_DUPLEX
    return spark.createDataFrame(
        [(name, sense, antisense, *spec) for name, *spec in LITERATURE_DESIGNS],
        "parent_id string, sense string, antisense string, sense_mods string, sense_positions string,"
        "antisense_mods string, antisense_positions string",
    )


def clinical_duplexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLINICAL_DUPLEXES, "parent_id string, sense string, antisense string")


def clinical_panel(parents: DataFrame, scorer: Scorer) -> DataFrame:
    """Both clinical patterns side by side, one row per duplex."""

    def scored(plus: bool, tag: str) -> DataFrame:
        rows = with_adjusted(scorer.modified(clinical_pattern(parents, plus), "raw"), "raw", "adjusted")
        return rows.select("parent_id", *[F.col(c).alias(f"{c}{tag}") for c in (*CLINICAL_LIMITS, "adjusted")])

    plain = scored(False, "")
    plus = scored(True, "_plus").select("parent_id", "risc_plus", "adjusted_plus")
    return plain.join(plus, "parent_id").withColumn("risc_delta", F.col("risc_plus") - F.col("risc"))


def clinical_verdict(panel: DataFrame) -> DataFrame:
    """Whether all duplexes keep to the domain limits and the pattern's RISC gain."""
    return panel.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bool_and(F.col(name) <= limit).alias(f"{name}_ok") for name, limit in CLINICAL_LIMITS.items()],
        F.bool_and((F.col("adjusted") >= 50) & (F.col("adjusted_plus") >= 50)).alias("score_ok"),
        F.bool_and(F.col("risc_delta") == -2).alias("risc_delta_ok"),
    )
