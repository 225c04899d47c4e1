"""Generators of modified variants from parent duplexes.

Parents carry ``parent_id, sense, antisense``.  Variants carry the modified strands,
both parent strands, the tracking columns and the two exposure strings, which are
cheap to maintain here and costly to derive later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oligo_engine.constants import (
    MINI_SCAN_POSITIONS,
    MINI_SCAN_SYMBOLS,
    MODIFICATIONS,
)
from oligo_engine.functions.chemistry import (
    apply_steps,
    exposure,
    exposure_mark,
    parse_instructions,
)
from oligo_engine.functions.sequence import let
from oligo_engine.operators.ordering import spread

VARIANT_COLUMNS = [
    "parent_id", "sense", "antisense", "mod_symbol", "mod_position", "mod_positions",
    "mod_strand", "parent_sense", "parent_antisense", "open_sense", "open_antisense",
]


def scan_grid(symbols: list[str], strands: list[str], positions: Column) -> Column:
    """Array of (mod_symbol, mod_strand, mod_position); ``positions`` is the last position."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("mod_symbol"), F.lit(t).alias("mod_strand"))
            for s in symbols
            for t in strands
        ]
    )
    return F.flatten(
        F.transform(
            cells,
            lambda c: F.transform(
                F.sequence(F.lit(1), positions),
                lambda p: F.struct(
                    c.mod_symbol.alias("mod_symbol"),
                    c.mod_strand.alias("mod_strand"),
                    p.alias("mod_position"),
                ),
            ),
        )
    )


def expand(parents: DataFrame, grid: Column) -> DataFrame:
    """Apply every grid cell to every parent (a narrow explode, no join).

    Columns of ``parents`` other than the strands ride along, so per-parent work
    done before is not repeated for each variant.
    """
    kept = [c for c in parents.columns if c not in ("sense", "antisense")]
    cells = parents.select(
        *kept,
        F.col("sense").alias("parent_sense"),
        F.col("antisense").alias("parent_antisense"),
        F.explode(grid).alias("_cell"),
    ).select("*", "_cell.*")
    target = F.when(F.col("mod_strand") == "sense", F.col("parent_sense")).otherwise(F.col("parent_antisense"))
    return replaced(cells.filter(F.col("mod_position") <= F.length(target)), kept)


def replaced(cells: DataFrame, kept: list[str]) -> DataFrame:
    """Variants of rows of parent strands and one cell (symbol, strand, position) each."""
    symbol, at, one = F.col("mod_symbol"), F.col("mod_position"), F.lit(1)

    def on(strand: str) -> tuple[Column, Column]:
        parent = F.col(f"parent_{strand}")
        mark = exposure_mark(symbol, F.substr(parent, at, one))
        here = F.col("mod_strand") == strand
        return (
            F.when(here, F.overlay(parent, symbol, at, one)).otherwise(parent),
            F.when(here, F.overlay(parent, mark, at, one)).otherwise(parent),
        )

    sense, open_sense = on("sense")
    antisense, open_antisense = on("antisense")
    return cells.select(
        *kept,
        sense.alias("sense"),
        antisense.alias("antisense"),
        "mod_symbol",
        "mod_position",
        F.lit("").alias("mod_positions"),
        "mod_strand",
        "parent_sense",
        "parent_antisense",
        open_sense.alias("open_sense"),
        open_antisense.alias("open_antisense"),
    )


def expand_by_place(
    parents: DataFrame, symbols: list[str], strands: list[str], positions: Column, name: str, of_place: Column
) -> DataFrame:
    """``expand`` in two steps: ``of_place``, stored as ``name``, is what a variant tells of
    its place alone and is computed once for all symbols there, from the strands with the
    place covered."""
    places = expand(parents, scan_grid([""], strands, positions)).withColumn(name, of_place)
    kept = [c for c in parents.columns if c not in ("sense", "antisense")] + [name]
    every = F.explode(F.array(*[F.lit(s) for s in symbols])).alias("mod_symbol")
    return replaced(places.select(*kept, "parent_sense", "parent_antisense", "mod_strand", "mod_position", every), kept)


def full_scan(parents: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Every symbol at every position of both strands, however long: 1,260 variants of a
    21-nt parent."""
    chosen = MODIFICATIONS if symbols is None else symbols
    return expand(parents, scan_grid(chosen, ["sense", "antisense"], F.greatest(F.length("sense"), F.length("antisense"))))


def scanned_pairs(both: Column, symbols: list[str] | None = None) -> Column:
    """Both strands, joined, of every variant of ``full_scan`` of the joined parent strands."""
    chosen = F.array(*[F.lit(s) for s in (MODIFICATIONS if symbols is None else symbols)])

    def at(p: Column) -> Column:
        ends = F.struct(F.substr(both, F.lit(1), p - 1).alias("before"), F.substr(both, p + 1).alias("after"))
        return let(ends, lambda x: F.transform(chosen, lambda s: F.concat(x.before, s, x.after)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(both)), at))


def scan_summary(parents: DataFrame, symbols: list[str] | None = None, in_row: int = 8) -> DataFrame:
    """Per parent id: variants of the full scan, different ones, the first and the last.

    An id's variants are compared in its own row, so that none is moved or stored. Ids with
    more than ``in_row`` different duplexes would make a large row; theirs are counted as rows, and so are those
    with a strand missing.
    """
    kinds = len(MODIFICATIONS if symbols is None else symbols)
    both = F.concat("sense", "antisense")
    dealt = spread(parents.select("parent_id", "sense", "antisense").filter(both.isNull() | (both != "")), "parent_id")
    duplexes = dealt.groupBy("parent_id", "sense", "antisense").agg(F.count(F.lit(1)).alias("copies"))
    of_id = W.partitionBy("parent_id")
    sized = duplexes.withColumn("_many", (F.count(F.lit(1)).over(of_id) > in_row) | F.max(both.isNull()).over(of_id))
    few = sized.filter(~F.col("_many")).groupBy("parent_id").agg(
        F.sum(F.col("copies") * F.length(both) * kinds).alias("n"), F.collect_list(both).alias("_both")
    )
    pairs = F.array_distinct(F.flatten(F.transform("_both", lambda x: scanned_pairs(x, symbols))))
    told = F.struct(
        F.size("_pairs").cast("bigint").alias("n_distinct"), F.array_min("_pairs").alias("first"), F.array_max("_pairs").alias("last")
    )
    in_rows = few.select("parent_id", "n", pairs.alias("_pairs")).select("parent_id", "n", told.alias("_t")).select("parent_id", "n", "_t.*")
    expanded = full_scan(sized.filter("_many"), symbols).groupBy("parent_id").agg(
        F.sum("copies").alias("n"), F.countDistinct(both).alias("n_distinct"), F.min(both).alias("first"), F.max(both).alias("last")
    )
    return in_rows.unionByName(expanded)


def mini_scan(parents: DataFrame) -> DataFrame:
    """Four symbols at guide positions 1-10: 40 variants per parent."""
    return expand(parents, scan_grid(MINI_SCAN_SYMBOLS, ["antisense"], F.lit(MINI_SCAN_POSITIONS)))


def positional_walk(parents: DataFrame, symbol: str) -> DataFrame:
    """One symbol walked along the guide strand."""
    return expand(parents, scan_grid([symbol], ["antisense"], F.length("antisense")))


def parent_as_variant(parents: DataFrame) -> DataFrame:
    """The unmodified duplex in variant form, for baselines."""
    kept = [c for c in parents.columns if c not in ("sense", "antisense")]
    return parents.select(
        *kept,
        "sense",
        "antisense",
        F.lit("").alias("mod_symbol"),
        F.lit(0).alias("mod_position"),
        F.lit("").alias("mod_positions"),
        F.lit("").alias("mod_strand"),
        F.col("sense").alias("parent_sense"),
        F.col("antisense").alias("parent_antisense"),
        F.col("sense").alias("open_sense"),
        F.col("antisense").alias("open_antisense"),
    )


def as_variants(designs: DataFrame) -> DataFrame:
    """Attach exposure strings to rows that already hold modified and parent strands."""
    return designs.withColumn(
        "open_sense", exposure(F.col("sense"), F.col("parent_sense"))
    ).withColumn("open_antisense", exposure(F.col("antisense"), F.col("parent_antisense")))


def parse_designs(designs: DataFrame) -> DataFrame:
    """Parse both strands' specifications; ``error`` is null for usable designs."""
    parsed = designs.withColumn(
        "_s", parse_instructions(F.col("sense_mods"), F.col("sense_positions"), F.col("sense"))
    ).withColumn(
        "_a",
        parse_instructions(F.col("antisense_mods"), F.col("antisense_positions"), F.col("antisense")),
    )
    return parsed.select(
        *designs.columns,
        F.col("_s.steps").alias("sense_steps"),
        F.col("_a.steps").alias("antisense_steps"),
        F.coalesce("_s.error", "_a.error").alias("error"),
    )


def build_designs(designs: DataFrame) -> DataFrame:
    """Multi-position variants of all usable designs, one row each."""
    spec = ["sense_mods", "sense_positions", "antisense_mods", "antisense_positions"]
    usable = parse_designs(designs).filter(F.col("error").isNull())
    kept = [c for c in designs.columns if c not in ("sense", "antisense", *spec)]
    return as_variants(
        usable.select(
            *kept,
            apply_steps(F.col("sense"), F.col("sense_steps")).alias("sense"),
            apply_steps(F.col("antisense"), F.col("antisense_steps")).alias("antisense"),
            F.lit("multi").alias("mod_symbol"),
            F.lit(0).alias("mod_position"),
            F.lit("").alias("mod_positions"),
            F.lit("both").alias("mod_strand"),
            F.col("sense").alias("parent_sense"),
            F.col("antisense").alias("parent_antisense"),
        )
    )


def rejected_designs(designs: DataFrame) -> DataFrame:
    return parse_designs(designs).filter(F.col("error").isNotNull()).select(*designs.columns, "error")


def clinical_pattern(parents: DataFrame, plus: bool = False) -> DataFrame:
    """Stabilised clinical pattern; ``plus`` puts GNA at guide position 7.

    Sense: PS at 1-2, 2'-OMe inside, conjugate at the 3' end.  Guide: phosphate, PS,
    2'-F on pyrimidines and 2'-OMe on purines, PS at the last two positions.
    """
    sense, guide = F.col("sense"), F.col("antisense")
    mod_sense = F.concat(
        F.lit("SS"),
        F.translate(F.substr(sense, F.lit(3), F.length(sense) - 3), "AUCG", "MMMM"),
        F.lit("4"),
    )
    core = F.translate(F.substr(guide, F.lit(3), F.length(guide) - 4), "UCAG", "FFMM")
    mod_guide = F.concat(F.lit("1S"), core, F.lit("SS"))
    if plus:
        mod_guide = F.overlay(mod_guide, F.lit("8"), F.lit(7), F.lit(1))
    kept = [c for c in parents.columns if c not in ("sense", "antisense")]
    return as_variants(
        parents.select(
            *kept,
            mod_sense.alias("sense"),
            mod_guide.alias("antisense"),
            F.lit("multi").alias("mod_symbol"),
            F.lit(0).alias("mod_position"),
            F.lit("").alias("mod_positions"),
            F.lit("both").alias("mod_strand"),
            sense.alias("parent_sense"),
            guide.alias("parent_antisense"),
        )
    )
