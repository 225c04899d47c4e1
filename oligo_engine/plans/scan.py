"""Modification scans and user-defined designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oligo_engine.constants import MINI_SCAN_POSITIONS, MINI_SCAN_SYMBOLS, MODIFICATIONS
from oligo_engine.functions.labels import efficacy_label, rescale_score
from oligo_engine.functions.sequence import let
from oligo_engine.operators.ordering import spread
from oligo_engine.operators.penalties import (
    DOMAINS,
    adjusted_efficacy,
    breakdown,
    carried_reading,
    cells_alike,
    motifs_left,
    penalty_sum,
    penalty_total,
    read_replaced,
    symbols_alike,
    with_adjusted,
    with_penalties,
    with_reading,
    with_thermo,
)
from oligo_engine.operators.toxicity import annotate_variants, with_rescue, with_viability
from oligo_engine.operators.variants import (
    build_designs,
    expand,
    expand_by_place,
    full_scan,
    parent_as_variant,
    replaced,
    scan_grid,
)
from oligo_engine.plans.scoring import Scorer, normalise

STRANDS = ["sense", "antisense", "open_sense", "open_antisense"]


def with_baselines(parents: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``parent_score`` (modified model, adjusted), ``naked_baseline`` (naked
    score, adjusted) and the thermo penalty, once per parent."""
    scored = scorer.naked(with_thermo(parents), "_naked")
    scored = scorer.modified(parent_as_variant(scored), "_raw")
    # a batch of one: above 100 the score is its own maximum and becomes 100
    scored = with_adjusted(scored.withColumn("_raw", normalise(F.col("_raw"), "clip")), "_raw", "parent_score")
    scored = scored.withColumn("naked_baseline", adjusted_efficacy(F.col("_naked"), F.col("penalty_sum")))
    return scored.select(*parents.columns, "thermo", "parent_score", "naked_baseline")


def score_variants(
    variants: DataFrame, scorer: Scorer, batch: list[str], name: str = "efficacy_score"
) -> DataFrame:
    """Raw score, penalties, rescaled score (``norm_score``) per batch, adjusted score.

    Penalties come before the window: what is sorted then carries numbers, and the
    strands only where the caller wants them in the result. Rows that bring a raw score
    and penalties (``with_replacement``) keep them.
    """
    raw = variants if "raw_score" in variants.columns else scorer.modified(variants, "raw_score")
    raw = with_penalties(raw).withColumn("penalty_sum", penalty_sum())
    # a number in front spares most comparisons of the sort
    norm = normalise(F.col("raw_score"), "rescale", ["_batch", *batch])
    if "_top" in raw.columns:  # the batch maximum is known
        norm = rescale_score(F.col("raw_score"), F.col("_top"))
    return (
        raw.withColumn("_batch", F.xxhash64(*batch))
        .withColumn("norm_score", norm)
        .withColumn(name, adjusted_efficacy(F.col("norm_score"), F.col("penalty_sum")))
        .drop("_batch", "_top")
    )


def with_stand(variants: DataFrame, scorer: Scorer) -> DataFrame:
    """Add what ``with_replacement`` starts from: what the rules read and the raw score."""
    return with_reading(scorer.modified(variants, "_raw_before"))


def with_replacement(
    rows: DataFrame,
    scorer: Scorer,
    symbol: Column,
    at: Column,
    strand: Column,
    old: Column,
    old_mark: Column,
    base: Column,
    motifs: Column | None = None,
) -> DataFrame:
    """Raw score and penalties of rows that differ from the variant they stem from, whose
    ``with_stand`` columns they carry, in one place.

    Counts are moved by what came and went, so no strand is read again but for motifs.
    ``old`` and ``old_mark`` stood in that place, ``base`` is the parent's; ``motifs`` are
    the motif hits, where they are known.
    """
    on_guide = strand == "antisense"
    if motifs is None:
        motifs = motifs_left(carried_reading()["motifs"], F.concat("open_sense", "open_antisense"))
    reading = read_replaced(carried_reading(), symbol, at, on_guide, old, old_mark, base, motifs)
    if hasattr(scorer, "replaced"):
        scored = rows.withColumn("raw_score", scorer.replaced(F.col("_raw_before"), symbol, at, on_guide, old))
    else:
        scored = scorer.modified(rows, "raw_score")
    moved = scored.withColumns({f"_read_{name}": value for name, value in reading.items()})
    wanted = [d for d in DOMAINS if d not in rows.columns]
    totals = moved.withColumns({d: penalty_total(d, carried_reading()) for d in wanted})
    return totals.drop("_raw_before", *[f"_read_{name}" for name in reading])


def scan_top(scorer: Scorer, symbols: list[str], strands: list[str], positions: Column) -> Column:
    """Greatest raw score of a parent's scan, in the parent's own row."""

    def raw(parent: Column, cell: Column) -> Column:
        on_guide = cell.mod_strand == "antisense"
        target = F.when(on_guide, parent.antisense).otherwise(parent.sense)
        value = scorer.replaced(
            parent.raw, cell.mod_symbol, cell.mod_position, on_guide, F.substr(target, cell.mod_position, F.lit(1))
        )
        return F.when(cell.mod_position <= F.length(target), value)

    grid = scan_grid(symbols, strands, positions)
    parent = F.struct(F.col("_raw_before").alias("raw"), "sense", "antisense")
    return let(parent, lambda p: F.array_max(F.transform(grid, lambda cell: raw(p, cell))))


def scored_scan(
    parents: DataFrame, scorer: Scorer, full: bool = False, symbols: list[str] | None = None, top: bool = False
) -> DataFrame:
    """Every variant of the full or of the mini scan with its raw score and penalties.

    With ``top`` also ``_top``, the greatest raw score of the parent's row, if the scorer
    can tell it there.
    """
    stand = with_stand(parent_as_variant(parents), scorer)
    stand = stand.select(*[c for c in stand.columns if c in parents.columns or c.startswith(("_read_", "_raw_before"))])
    if full or symbols:
        grid = symbols or MODIFICATIONS, ["sense", "antisense"], F.greatest(F.length("sense"), F.length("antisense"))
    else:
        grid = MINI_SCAN_SYMBOLS, ["antisense"], F.lit(MINI_SCAN_POSITIONS)
    if top and hasattr(scorer, "replaced"):
        stand = stand.withColumn("_top", scan_top(scorer, *grid))
    before = carried_reading()["motifs"]
    covered = motifs_left(before, F.concat("open_sense", "open_antisense"))
    variants = expand_by_place(stand, *grid, "_covered", covered)
    symbol, at, strand = (F.col(f"mod_{x}") for x in ("symbol", "position", "strand"))
    there = F.substr(F.when(strand == "sense", F.col("parent_sense")).otherwise(F.col("parent_antisense")), at, F.lit(1))
    base, motifs = F.col("_base"), F.when(symbol == F.col("_base"), before).otherwise(F.col("_covered"))
    return with_replacement(
        variants.withColumn("_base", there), scorer, symbol, at, strand, base, base, base, motifs
    ).drop("_base", "_covered")


def scan_totals(parents: DataFrame, domain: str) -> DataFrame:
    """Number, sum, least and greatest penalty of one domain per cell of the full scan.

    In parents of A, U, G, C and T the rules are applied once to what they do not tell
    apart: symbols (``symbols_alike``) and strands (``cells_alike``), and the rows counted.
    Other parents, which may hold a scanned symbol already, are expanded in full.
    """
    plain = F.coalesce(F.concat("sense", "antisense").rlike("^[AUGCT]*$"), F.lit(False))
    parents = parents.select("parent_id", "sense", "antisense")
    alike = symbols_alike(domain, MODIFICATIONS)
    grid = scan_grid([""], ["sense", "antisense"], F.greatest(F.length("sense"), F.length("antisense")))
    places = spread(parents.filter(plain)).select("sense", "antisense", F.explode(grid).alias("_cell")).select("*", "_cell.mod_strand", "_cell.mod_position")
    target = F.when(F.col("mod_strand") == "sense", F.col("sense")).otherwise(F.col("antisense"))
    cells = cells_alike(domain, places.filter(F.col("mod_position") <= F.length(target)))
    here = cells.withColumnsRenamed({"mod_strand": "_strand", "mod_position": "_position"})
    one = F.array(*[
        F.struct(F.lit(s).alias("mod_symbol"), F.col("_strand").alias("mod_strand"), F.col("_position").alias("mod_position")) for s in alike
    ])
    every = F.create_map(*[x for s, same in alike.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in same]))])
    cell = ["mod_symbol", "mod_strand", "mod_position"]

    def totals(rows: DataFrame, n: Column) -> DataFrame:
        value = F.col(domain)
        return with_penalties(rows, [domain]).groupBy(*cell).agg(
            F.sum(n).alias("n"), F.sum(n * value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")
        )

    counted = totals(expand(here, one), F.col("n")).withColumn("mod_symbol", F.explode(every[F.col("mod_symbol")]))
    others = totals(full_scan(spread(parents.filter(~plain))), F.lit(1).cast("bigint"))
    return counted.unionByName(others).groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.sum("sum").alias(f"sum_{domain}"),
        F.min("min").alias(f"min_{domain}"),
        F.max("max").alias(f"max_{domain}"),
    )


def scan_modifications(
    parents: DataFrame,
    scorer: Scorer,
    seeds: DataFrame,
    full: bool = False,
    symbols: list[str] | None = None,
    top_n: int = 0,
    details: bool = False,
) -> DataFrame:
    """Score every single-modification variant of every parent.

    ``rank`` follows the score before penalties (ties: strand, position, symbol),
    ``adj_rank`` the adjusted one.  Parents are taken as a set and partitioned by their
    key before the expansion; all windows reuse that, and none sees more than the
    1,260 variants of one parent.  What depends on the parent alone - baselines, thermo
    penalty, seed viability - is computed before the expansion.
    """
    parents = parents.select("parent_id", "sense", "antisense").distinct()
    base = with_baselines(spread(parents, "parent_id", "sense"), scorer)
    base = with_viability(base, seeds, "antisense")
    base = base.withColumn("_key", F.xxhash64("parent_id", "sense", "antisense"))
    # strands are made again of the cell afterwards, so that the sorts do not carry them
    scored = scored_scan(base, scorer, full, symbols).withColumn("penalty_sum", penalty_sum()).drop(*STRANDS)
    # a number in front spares most comparisons of the sorts
    key = ["_key", "parent_id", "parent_sense", "parent_antisense"]
    tie = [F.col("mod_strand"), F.col("mod_position"), F.col("mod_symbol")]
    # rescaling keeps the order of raw scores, so rank and batch maximum share a sort
    by_raw = W.partitionBy(*key).orderBy(F.col("raw_score").desc(), *tie)
    by_adjusted = W.partitionBy(*key).orderBy(F.col("efficacy_score").desc(), *tie)
    ranked = (
        scored.withColumns({"rank": F.row_number().over(by_raw), "_top": F.first("raw_score").over(by_raw)})
        .withColumn("norm_score", rescale_score(F.col("raw_score"), F.col("_top")))
        .withColumn("efficacy_score", adjusted_efficacy(F.col("norm_score"), F.col("penalty_sum")))
        .withColumn("adj_rank", F.row_number().over(by_adjusted))
        .drop("_top", "_key")
    )
    if top_n:
        ranked = ranked.filter(F.col("rank") <= top_n)
    labelled = ranked.withColumns(
        {
            "delta_score": F.col("efficacy_score") - F.col("parent_score"),
            "efficacy_label": efficacy_label(F.col("efficacy_score")),
        }
    )
    cell = ["mod_symbol", "mod_position", "mod_positions", "mod_strand", "parent_sense", "parent_antisense"]
    labelled = replaced(labelled, [c for c in labelled.columns if c not in cell])
    if details:
        labelled = labelled.withColumn("biophysics", breakdown())
    return with_rescue(labelled)


def score_designs(designs: DataFrame, scorer: Scorer, seeds: DataFrame, details: bool = True) -> DataFrame:
    """Score user-defined multi-position designs (one row per usable design).

    Each design is its own batch, so everything is narrow but the seed lookup.
    """
    based = with_baselines(
        designs.withColumnRenamed("design_id", "parent_id") if "parent_id" not in designs.columns else designs,
        scorer,
    )
    variants = scorer.modified(build_designs(based), "raw_score")
    scored = with_adjusted(
        variants.withColumn("norm_score", normalise(F.col("raw_score"), "clip")), "norm_score"
    ).withColumns(
        {
            "delta_score": F.col("efficacy_score") - F.col("parent_score"),
            "efficacy_label": efficacy_label(F.col("efficacy_score")),
        }
    )
    if details:
        scored = scored.withColumn("biophysics", breakdown())
    return annotate_variants(scored, seeds)
