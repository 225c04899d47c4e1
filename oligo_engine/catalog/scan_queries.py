"""Modification scans, penalties, rankings and the beam search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine.catalog import inputs as I, sql as S
from oligo_engine.catalog.registry import query
from oligo_engine.catalog.sequence_queries import DESIGN_CTES, _designs, scratch
from oligo_engine.operators import metrics, penalties, variants
from oligo_engine.operators.ordering import Tables, rank_all, spread, top_per_group
from oligo_engine.operators.tiling import tile
from oligo_engine.plans import beam, panels, ranking
from oligo_engine.plans.scan import scan_modifications, scan_totals, score_designs
from oligo_engine.plans.scoring import LinearScorer
from oligo_engine.sources.writers import write_results

SCORER = LinearScorer()


def _by_cell_sql(*columns: str) -> str:
    parts = [f"sum({c}) AS sum_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in columns]
    return (
        "SELECT sym AS mod_symbol, strand AS mod_strand, pos AS mod_position, count(*) AS n, "
        + ", ".join(parts)
        + " FROM pen GROUP BY 1, 2, 3"
    )


_FULL = S.with_(S.PARENTS, S.scan("parents", "v", *S.FULL), S.penalised("v", "pen", score=False))

# --- generators and penalties over the full scan ------------------------------


@query(
    "g3_full_scan",
    S.with_(S.PARENTS, S.scan("parents", "v", *S.FULL))
    + "SELECT parent_id, count(*) AS n, count(DISTINCT concat(s, a)) AS n_distinct, min(concat(s, a)) AS first, max(concat(s, a)) AS last FROM v GROUP BY 1",
)
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return variants.scan_summary(I.parents(spark, sf))


@query(
    "g4_mini_scan",
    S.with_(S.PARENTS, S.scan("parents", "v", *S.MINI))
    + "SELECT parent_id, sym AS mod_symbol, pos AS mod_position, s AS sense, a AS antisense FROM v",
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return variants.mini_scan(I.parents(spark, sf)).select(
        "parent_id", "mod_symbol", "mod_position", "sense", "antisense"
    )


@query(
    "g6_positional_walk",
    S.with_(S.PARENTS, S.scan("parents", "v", "['M']", "['antisense']", 21), S.penalised("v", "pen", score=False))
    + "SELECT parent_id, pos AS mod_position, a AS antisense, risc FROM pen",
)
def g6(spark: SparkSession, sf: str) -> DataFrame:
    walk = variants.positional_walk(spread(I.parents(spark, sf), "parent_id"), "M")
    return penalties.with_penalties(walk, ["risc"]).select("parent_id", "mod_position", "antisense", "risc")


@query(
    "g7_clinical_patterns",
    S.with_(S.PARENTS, S.esc("parents", "e"), S.esc("parents", "p", plus=True))
    + "SELECT e.parent_id, e.s AS sense, e.a AS antisense, p.a AS antisense_plus FROM e JOIN p USING (parent_id)",
)
def g7(spark: SparkSession, sf: str) -> DataFrame:
    parents = I.parents(spark, sf)
    plain = variants.clinical_pattern(parents).select("parent_id", "sense", "antisense")
    plus = variants.clinical_pattern(parents, plus=True).select("parent_id", F.col("antisense").alias("antisense_plus"))
    return plain.join(plus, "parent_id")


@query("p1_nuclease", _FULL + _by_cell_sql("nuclease"))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return scan_totals(I.parents(spark, sf), "nuclease")


@query("p2_immuno", _FULL + _by_cell_sql("immuno"))
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return scan_totals(I.parents(spark, sf), "immuno")


@query("p3_risc", _FULL + _by_cell_sql("risc"))
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return scan_totals(I.parents(spark, sf), "risc")


@query("p4_thermo", S.with_(S.PARENTS) + f"SELECT parent_id, {S.thermo('sense', 'antisense')} AS thermo FROM parents")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return penalties.with_thermo(I.parents(spark, sf)).select("parent_id", "thermo")


@query("p5_serum", _FULL + _by_cell_sql("serum"))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return scan_totals(I.parents(spark, sf), "serum")


_MOD_PEN = S.with_(S.MEASURED, S.MODIFIED, S.penalised("modified", "pen", score=False))


@query(
    "p6_a9_p14_adjusted_efficacy",
    _MOD_PEN + "SELECT row_id, nuclease, immuno, risc, thermo, serum, penalty_sum, "
    + S.adjusted("efficacy") + " AS adjusted, " + S.adjusted("efficacy") + " + 0.7e0 * penalty_sum AS raw_again FROM pen",
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    rows = variants.as_variants(spread(I.modified(spark, sf)))
    scored = penalties.with_adjusted(rows, "efficacy", "adjusted")
    again = penalties.raw_from_adjusted(F.col("adjusted"), F.col("penalty_sum"))
    return scored.select("row_id", *penalties.DOMAINS, "penalty_sum", "adjusted", again.alias("raw_again"))


@query(
    "p6_penalty_breakdown",
    S.with_(S.PARENTS, S.esc("parents", "e"), S.penalised("e", "pen", score=False))
    + "SELECT 'nuclease' AS domain, count(*) AS n, sum(nuclease) AS total FROM pen UNION ALL SELECT 'immuno', count(*), sum(immuno) FROM pen "
    "UNION ALL SELECT 'risc', count(*), sum(risc) FROM pen UNION ALL SELECT 'thermo', count(*), sum(thermo) FROM pen UNION ALL SELECT 'serum', count(*), sum(serum) FROM pen",
)
def breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Totals rebuilt from the itemised reasons of the nested breakdown."""
    rows = penalties.with_penalties(variants.clinical_pattern(I.parents(spark, sf)))
    nested = rows.select(penalties.breakdown().alias("b"))
    limits = {"nuclease": (None, 20.0), "immuno": (None, 28.0), "risc": (-10.0, 60.0), "thermo": (None, 20.0), "serum": (-5.0, 60.0)}
    items = []
    for domain, (low, high) in limits.items():
        points = F.aggregate(F.map_values(f"b.{domain}.details"), F.lit(0.0), lambda s, x: s + x)
        total = F.least(points, F.lit(high))
        items.append(
            F.struct(F.lit(domain).alias("domain"), (total if low is None else F.greatest(total, F.lit(low))).alias("total"))
        )
    return (
        nested.select(F.explode(F.array(*items)).alias("x"))
        .groupBy(F.col("x.domain").alias("domain"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x.total").alias("total"))
    )


@query(
    "p15_composite",
    "SELECT p_partkey AS id, (0.5e0 * ((p_partkey % 101) / 100e0) + 0.12e0 * ((p_partkey % 90) / 100e0) + 0.12e0 * ((p_partkey % 80) / 100e0) "
    "+ 0.12e0 * ((p_partkey % 70) / 100e0) + 0.14e0 * ((p_partkey % 60) / 100e0)) * 100e0 AS composite FROM part",
)
def p15(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return I.table(spark, sf, "part").select(
        k.alias("id"), penalties.composite_score(*[k % m for m in (101, 90, 80, 70, 60)]).alias("composite")
    )


# --- rankings -----------------------------------------------------------------

_NAKED = f"naked AS (SELECT *, {S.naked_score()} AS score FROM tiles)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY score DESC, position DESC) AS rank FROM naked)"


@query(
    "q1_rank_candidates",
    S.with_(S.TRANSCRIPTS, S.TILES, S.SEEDS, _NAKED, _RANKED, "top AS (SELECT * FROM ranked WHERE rank <= 5)",
            f"f AS (SELECT *, coalesce({S.functional_reason('sense')}, {S.functional_reason('antisense')}, '') AS func_reason FROM top)")
    + f"SELECT transcript_id, rank::INTEGER AS rank, position, sense, antisense, score AS efficacy_score, {S.efficacy_label('score')} AS efficacy_label, "
    f"floor(viability * 10e0 + 0.5e0)::BIGINT AS toxicity_tenths, {S.viability_label('viability')} AS toxicity_label, func_reason = '' AS func_ok, func_reason "
    "FROM f LEFT JOIN seed_viability ON substr(antisense, 2, 6) = seed",
)
def q1(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranking.rank_candidates(I.transcripts(spark, sf), SCORER, I.seed_viability(spark, sf), top_n=5)
    return ranked.withColumn("toxicity_tenths", F.floor(F.col("toxicity_score") * 10 + 0.5)).drop("toxicity_score")


@query(
    "q1_rank_dicer",
    S.with_("transcripts AS (SELECT o_orderkey AS transcript_id, left(" + S.bases("o_orderkey::VARCHAR") + ", (25 + o_orderkey % 6)::INTEGER) AS sequence FROM orders)",
            "tiles AS (SELECT transcript_id, 0 AS position, right(sequence, 21) AS sense, " + S.revcomp("right(sequence, 21)") + " AS antisense FROM transcripts)", _NAKED)
    + f"SELECT transcript_id, 1 AS rank, sense, score AS efficacy_score, {S.efficacy_label('score')} AS efficacy_label FROM naked",
)
def q1_dicer(spark: SparkSession, sf: str) -> DataFrame:
    substrates = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transcript_id"),
        F.substr(I.bases(F.col("o_orderkey").cast("string")), F.lit(1), (25 + F.col("o_orderkey") % 6).cast("int")).alias("sequence"),
    )
    ranked = ranking.rank_candidates(substrates, SCORER, I.seed_viability(spark, sf), 1, "dsirna")
    return ranked.select("transcript_id", "rank", "sense", "efficacy_score", "efficacy_label")


@query(
    "w1_rank_all",
    S.with_(S.TRANSCRIPTS, S.TILES, _NAKED, _RANKED)
    + "SELECT transcript_id, sum(rank * (position + 1))::BIGINT AS checksum, max(rank)::INTEGER AS last FROM ranked GROUP BY 1",
)
def w1(spark: SparkSession, sf: str) -> DataFrame:
    scored = SCORER.naked(tile(I.transcripts(spark, sf)), "score").select("transcript_id", "position", "score")
    ranked = rank_all(scored, ["transcript_id"], [F.col("score").desc(), F.col("position").desc()])
    return ranked.groupBy("transcript_id").agg(
        F.sum(F.col("rank").cast("bigint") * (F.col("position") + 1)).alias("checksum"), F.max("rank").alias("last")
    )


@query(
    "w2_top_overall",
    S.with_(S.TRANSCRIPTS, S.TILES, _NAKED)
    + "SELECT transcript_id, position, score AS efficacy_score FROM naked ORDER BY score DESC, transcript_id, position DESC LIMIT 50",
)
def w2(spark: SparkSession, sf: str) -> DataFrame:
    top = ranking.top_overall(I.transcripts(spark, sf), SCORER, 50)
    return top.select("transcript_id", "position", "efficacy_score")


_TIE = "strand, pos, sym"


def _scored(grid: tuple, key: str = "parent_id") -> str:
    """Scan, penalties, rescaled and adjusted scores with ranks."""
    return ",\n".join(
        [
            S.scan("parents", "v", *grid),
            S.penalised("v", "pen"),
            f"norm AS (SELECT *, {S.rescale('raw', key)} AS norm_score FROM pen)",
            f"adj AS (SELECT *, {S.adjusted('norm_score')} AS efficacy_score FROM norm)",
            "scored AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY norm_score DESC, raw DESC, " + _TIE + ") AS rank, "
            "row_number() OVER (PARTITION BY parent_id ORDER BY efficacy_score DESC, " + _TIE + ") AS adj_rank FROM adj)",
        ]
    )


def _base(source: str = "parents") -> str:
    """Baselines of the parents themselves (b: parent_id, parent_score, naked_baseline)."""
    return ",\n".join(
        [
            f"b0 AS (SELECT parent_id, sense AS s, antisense AS a, sense AS ps, antisense AS pa, {S.naked_score()} AS naked FROM {source})",
            S.penalised("b0", "b1"),
            f"b AS (SELECT parent_id, {S.adjusted(S.clip('raw'))} AS parent_score, {S.adjusted('naked')} AS naked_baseline FROM b1)",
        ]
    )


_TOX = (
    "tox AS (SELECT scored.*, b.parent_score, viability, " + S.viability_label("viability") + " AS base_label, "
    "regexp_matches(substr(a, 2, 6), '[MFLE]') AS rescued FROM scored JOIN b USING (parent_id) LEFT JOIN seed_viability ON substr(pa, 2, 6) = seed)"
)
_LABEL = "CASE WHEN rescued AND base_label IN ('Toxic', 'Caution') THEN 'Mitigated' ELSE base_label END"


@query(
    "q2_mini_scan",
    S.with_(S.PARENTS, S.SEEDS, _scored(S.MINI), _base(), _TOX)
    + "SELECT parent_id, rank::INTEGER AS rank, adj_rank::INTEGER AS adj_rank, sym AS mod_symbol, pos AS mod_position, norm_score, efficacy_score, "
    f"efficacy_score - parent_score AS delta_score, {S.efficacy_label('efficacy_score')} AS efficacy_label, viability AS toxicity_score, {_LABEL} AS toxicity_label FROM tox",
)
def q2(spark: SparkSession, sf: str) -> DataFrame:
    scan = scan_modifications(I.parents(spark, sf), SCORER, I.seed_viability(spark, sf))
    return scan.select(
        "parent_id", "rank", "adj_rank", "mod_symbol", "mod_position", "norm_score", "efficacy_score", "delta_score",
        "efficacy_label", "toxicity_score", "toxicity_label",
    )


@query(
    "q2_full_scan_top",
    S.with_(S.PARENTS, S.SEEDS, _scored(S.FULL), _base(), _TOX)
    + "SELECT parent_id, rank::INTEGER AS rank, adj_rank::INTEGER AS adj_rank, sym AS mod_symbol, pos AS mod_position, strand AS mod_strand, norm_score, efficacy_score, "
    f"efficacy_score - parent_score AS delta_score, {_LABEL} AS toxicity_label FROM tox WHERE rank <= 20",
)
def q2_full(spark: SparkSession, sf: str) -> DataFrame:
    scan = scan_modifications(I.parents(spark, sf), SCORER, I.seed_viability(spark, sf), full=True, top_n=20)
    return scan.select(
        "parent_id", "rank", "adj_rank", "mod_symbol", "mod_position", "mod_strand", "norm_score", "efficacy_score",
        "delta_score", "toxicity_label",
    )


@query(
    "j8_parent_baselines",
    S.with_(S.PARENTS, _base()) + "SELECT parent_id, parent_score, naked_baseline FROM b",
)
def j8(spark: SparkSession, sf: str) -> DataFrame:
    from oligo_engine.plans.scan import with_baselines

    return with_baselines(I.parents(spark, sf), SCORER).select("parent_id", "parent_score", "naked_baseline")


@query(
    "q3_score_designs",
    S.with_(*DESIGN_CTES, S.SEEDS, _base(), S.penalised("built", "pen"), f"adj AS (SELECT *, {S.adjusted(S.clip('raw'))} AS efficacy_score FROM pen)",
            "tox AS (SELECT adj.*, b.parent_score, viability, " + S.viability_label("viability") + " AS base_label, regexp_matches(substr(a, 2, 6), '[MFLE]') AS rescued "
            "FROM adj JOIN b USING (parent_id) LEFT JOIN seed_viability ON substr(pa, 2, 6) = seed)")
    + f"SELECT parent_id, s AS sense, a AS antisense, efficacy_score, efficacy_score - parent_score AS delta_score, penalty_sum, {_LABEL} AS toxicity_label FROM tox",
)
def q3(spark: SparkSession, sf: str) -> DataFrame:
    return score_designs(_designs(spark, sf), SCORER, I.seed_viability(spark, sf), details=False).select(
        "parent_id", "sense", "antisense", "efficacy_score", "delta_score", "penalty_sum", "toxicity_label"
    )


@query(
    "s8_nested_results_json",
    S.with_(S.PARENTS, S.esc("parents", "e"), S.penalised("e", "pen"))
    + f"SELECT parent_id, round({S.adjusted('raw')}, 2) AS efficacy_score, nuclease, immuno, risc, thermo, serum FROM pen",
)
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """Scored clinical patterns written as nested JSON rows and read back."""
    path = scratch(spark, "json")
    designs = SCORER.modified(variants.clinical_pattern(I.parents(spark, sf)), "raw")
    scored = penalties.with_adjusted(designs, "raw").select(
        "parent_id", "efficacy_score", penalties.breakdown().alias("biophysics")
    )
    write_results(scored, path, ["efficacy_score"])
    totals = "struct<" + ",".join(f"{d}:struct<total:double,details:map<string,double>>" for d in penalties.DOMAINS) + ">"
    rows = spark.read.schema(f"parent_id bigint, efficacy_score double, biophysics {totals}").json(path)
    return rows.select(
        "parent_id", "efficacy_score", *[F.col(f"biophysics.{d}.total").alias(d) for d in penalties.DOMAINS]
    )


@query(
    "w4_round_robin",
    S.with_("p0 AS (SELECT 1)", S.PARENTS, _scored(S.MINI),
            "turn AS (SELECT *, row_number() OVER (PARTITION BY parent_id, sym ORDER BY efficacy_score DESC, strand, pos) AS turn FROM scored)",
            "slots AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY turn, sym) AS slot FROM turn)")
    + "SELECT parent_id, slot::INTEGER AS slot, sym AS mod_symbol, pos AS mod_position, efficacy_score FROM slots WHERE slot <= 10",
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    singles = scan_modifications(I.parents(spark, sf), SCORER, I.seed_viability(spark, sf))
    ids = singles.select("parent_id", *beam.PARENT, "mod_symbol", "mod_position", "mod_strand", "efficacy_score")
    # parents of the table are distinct duplexes, so the id rides along
    return beam.round_robin(ids, 10).select("parent_id", "slot", "mod_symbol", "mod_position", "efficacy_score")


@query(
    "w5_pairing_pool",
    S.with_(S.PARENTS, _scored(S.MINI))
    + "SELECT ps AS parent_sense, adj_rank::INTEGER AS pool_slot, sym AS add_symbol, pos AS add_position FROM scored WHERE adj_rank <= 12",
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    singles = scan_modifications(I.parents(spark, sf), SCORER, I.seed_viability(spark, sf))
    return beam.pairing_pool(singles, 12).select("parent_sense", "pool_slot", "add_symbol", "add_position")


@query(
    "q10_rerank_by_potential",
    S.with_(S.TRANSCRIPTS, S.TILES, _NAKED, _RANKED,
            "parents AS (SELECT transcript_id * 1000 + position AS parent_id, sense, antisense, rank AS naked_rank, score FROM ranked WHERE rank <= 50)",
            S.scan("parents", "v", *S.MINI), S.penalised("v", "pen"), f"norm AS (SELECT *, {S.rescale('raw', 'parent_id')} AS norm_score FROM pen)",
            f"best AS (SELECT parent_id, max({S.adjusted('norm_score')}) AS best_modified FROM norm GROUP BY 1)",
            "final AS (SELECT parent_id // 1000 AS transcript_id, (parent_id % 1000)::INTEGER AS position, naked_rank::INTEGER AS naked_rank, score AS naked_score, best_modified FROM best JOIN parents USING (parent_id))")
    + "SELECT transcript_id, position, naked_rank, naked_score, best_modified, rank FROM (SELECT *, (row_number() OVER (PARTITION BY transcript_id ORDER BY best_modified DESC, naked_rank))::INTEGER AS rank FROM final) WHERE rank <= 20",
)
def q10(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rerank_by_potential(I.transcripts(spark, sf), SCORER)


# --- beam search --------------------------------------------------------------


def _beam_sql(width: int, top: int, select: str, grid: tuple = S.MINI, seed: str | None = None) -> str:
    """Two rounds over a scan, one CTE per step of the search.

    ``seed`` makes a guide with replacements at 2 and 14 of ``antisense``; it takes the first place.
    """
    places, seeded = width, ""
    if seed:
        places = width - 1
        seeded = f" UNION ALL SELECT parent_id, sense, {seed}, sense, antisense, 'seed', 2, 'antisense', 0 FROM parents"
    pool = 2 * width
    touched = "substr(CASE WHEN q.strand = 'sense' THEN x.s ELSE x.a END, q.pos, 1) <> substr(CASE WHEN q.strand = 'sense' THEN x.ps ELSE x.pa END, q.pos, 1)"
    one, two = (f"concat({t}.sym, {t}.pos, {t}.strand)" for t in "xq")

    def grown(strand: str, column: str) -> str:
        return f"CASE WHEN strand = '{strand}' THEN {S.put(column, 'pos', 'sym')} ELSE {column} END AS {column}"

    return S.with_(
        S.PARENTS,
        _scored(grid),
        _base(),
        "turn AS (SELECT *, row_number() OVER (PARTITION BY parent_id, sym ORDER BY efficacy_score DESC, strand, pos) AS turn FROM scored)",
        "slots AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY turn, sym) AS slot FROM turn)",
        f"first_beam AS (SELECT parent_id, s, a, ps, pa, sym, pos, strand, slot FROM slots WHERE slot <= {places}{seeded})",
        S.penalised("first_beam", "r1"),
        f"r1n AS (SELECT *, {S.rescale('raw', 'parent_id')} AS norm_score FROM r1)",
        f"r1s AS (SELECT *, round({S.adjusted('norm_score')}, 2) AS score FROM r1n)",
        "round1 AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, slot) AS place FROM r1s)",
        f"pool AS (SELECT parent_id, sym, pos, strand, adj_rank FROM scored WHERE adj_rank <= {pool})",
        "pairs AS (SELECT x.parent_id, x.s, x.a, x.ps, x.pa, x.sym AS bsym, x.pos AS bpos, x.place, q.sym, q.pos, q.strand, q.adj_rank, "
        f"{touched} AS clash, least({one}, {two}) AS lo, greatest({one}, {two}) AS hi "
        "FROM round1 x JOIN pool q USING (parent_id))",
        "once AS (SELECT *, row_number() OVER (PARTITION BY parent_id, lo, hi ORDER BY place, adj_rank) AS nth FROM pairs)",
        f"grown AS (SELECT parent_id, {grown('sense', 's')}, {grown('antisense', 'a')}, ps, pa, concat(bsym, '+', sym) AS mod_symbol, "
        "concat(bpos::VARCHAR, ',', pos::VARCHAR) AS mod_positions, place, adj_rank FROM once WHERE nth = 1 AND NOT clash)",
        "viable AS (SELECT * FROM grown WHERE NOT regexp_matches(a, '[LYE][LYE][LYE]') AND NOT regexp_matches(s, '[LYE][LYE][LYE]'))",
        S.penalised("viable", "r2"),
        f"r2n AS (SELECT *, {S.rescale('raw', 'parent_id')} AS norm_score FROM r2)",
        f"r2s AS (SELECT *, round({S.adjusted('norm_score')}, 2) AS score FROM r2n)",
        "round2 AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, place, adj_rank) AS place2 FROM r2s)",
        "evaluated AS (SELECT parent_id, s, a, sym AS mod_symbol, pos::VARCHAR AS mod_positions, score, penalty_sum, 1 AS round, place AS slot FROM round1 "
        "UNION ALL SELECT parent_id, s, a, mod_symbol, mod_positions, score, penalty_sum, 2, place2 FROM round2)",
        "unique_designs AS (SELECT *, row_number() OVER (PARTITION BY parent_id, s, a ORDER BY score DESC, round, slot) AS nth FROM evaluated)",
        "final AS (SELECT parent_id, s AS sense, a AS antisense, mod_symbol, mod_positions, round, score AS efficacy_score, penalty_sum, "
        "row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, round, slot) AS rank FROM unique_designs WHERE nth = 1)",
    ) + select.format(top=top)


BEAM_SQL = _beam_sql(
    6, 10,
    "SELECT parent_id, rank::INTEGER AS rank, antisense, mod_symbol, mod_positions, round::INTEGER AS round, efficacy_score, penalty_sum, "
    "round(efficacy_score - parent_score, 2) AS delta_score FROM final JOIN b USING (parent_id) WHERE rank <= {top}",
)


@query("q4_g9_j7_w6_w7_beam_two_rounds", BEAM_SQL)
def q4(spark: SparkSession, sf: str) -> DataFrame:
    with Tables(spark) as tables:
        found = beam.beam_search(I.parents(spark, sf), SCORER, max_mods=2, beam_width=6)
        return tables.keep(
            beam.top_designs(found, 10).select(
                "parent_id", "rank", "antisense", "mod_symbol",
                F.when(F.col("mod_positions") == "", F.col("mod_position").cast("string")).otherwise(F.col("mod_positions")).alias("mod_positions"),
                "round", "efficacy_score", "penalty_sum", "delta_score",
            )
        )


@query(
    "q4_full_scan_beam",
    _beam_sql(
        20, 10,
        "SELECT parent_id, rank::INTEGER AS rank, sense, antisense, mod_symbol, mod_positions, round::INTEGER AS round, efficacy_score, penalty_sum FROM final WHERE rank <= {top}",
        grid=S.FULL,
    ),
)
def q4_full(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols at all positions of both strands as singles, default width."""
    with Tables(spark) as tables:
        found = beam.beam_search(I.parents(spark, sf), SCORER, full=True)
        positions = F.when(F.col("mod_positions") == "", F.col("mod_position").cast("string")).otherwise(F.col("mod_positions"))
        return tables.keep(
            beam.top_designs(found, 10).select(
                "parent_id", "rank", "sense", "antisense", "mod_symbol", positions.alias("mod_positions"),
                "round", "efficacy_score", "penalty_sum",
            )
        )


@query("q4_w10_beam_deep")
def q4_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds with the plateau rule; checked against brute force in the tests."""
    with Tables(spark) as tables:
        found = beam.beam_search(I.parents(spark, sf), SCORER, max_mods=5, beam_width=5)
        return tables.keep(beam.top_designs(found, 5).select("parent_id", "rank", "antisense", "mod_symbol", "round", "efficacy_score"))


# --- panels -------------------------------------------------------------------


@query(
    "q9_g10_mask_panel",
    S.with_(S.PARENTS, "masks AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}', '{a}')" for n, s, a in panels.PANEL_MASKS) + ") m(design, s, a))",
            "panel AS (SELECT parent_id, design, s, a, sense AS ps, antisense AS pa FROM parents, masks)", S.penalised("panel", "pen"))
    + f"SELECT parent_id, design, penalty_sum, {S.adjusted('raw')} AS adjusted_score, CASE WHEN {S.adjusted('raw')} >= 60 THEN 'High' ELSE 'Low' END AS label FROM pen",
)
def q9(spark: SparkSession, sf: str) -> DataFrame:
    return panels.mask_panel(I.parents(spark, sf), SCORER).select(
        "parent_id", "design", "penalty_sum", "adjusted_score", "label"
    )


@query(
    "a12_clinical_verdict",
    S.with_(S.PARENTS, S.esc("parents", "e"), S.esc("parents", "f", plus=True), S.penalised("e", "pe"), S.penalised("f", "pf"))
    + f"SELECT count(*) AS n, bool_and(pe.nuclease <= 5) AS nuclease_ok, bool_and(pe.immuno <= 6) AS immuno_ok, bool_and(pe.risc <= 20) AS risc_ok, "
    f"bool_and(pe.thermo <= 8) AS thermo_ok, bool_and(pe.serum <= 4) AS serum_ok, bool_and({S.adjusted('pe.raw', 'pe.penalty_sum')} >= 50 AND "
    f"{S.adjusted('pf.raw', 'pf.penalty_sum')} >= 50) AS score_ok, bool_and(pf.risc - pe.risc = -2) AS risc_delta_ok FROM pe JOIN pf USING (parent_id)",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return panels.clinical_verdict(panels.clinical_panel(I.parents(spark, sf), SCORER))


@query(
    "a15_symbol_profile",
    S.with_(S.MEASURED, S.MODIFIED, "c AS (SELECT unnest(list_concat(list_filter(list_transform(range(1, 22), lambda i: CASE WHEN substr(s, i, 1) <> substr(ps, i, 1) THEN substr(s, i, 1) END), "
            "lambda x: x IS NOT NULL), list_filter(list_transform(range(1, 22), lambda i: CASE WHEN substr(a, i, 1) <> substr(pa, i, 1) THEN substr(a, i, 1) END), lambda x: x IS NOT NULL))) AS symbol FROM modified)",
            "g AS (SELECT symbol, count(*) AS n FROM c GROUP BY 1)")
    + "SELECT symbol, n, 100e0 * n / sum(n) OVER () AS percent FROM g",
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.symbol_profile(I.modified(spark, sf))
