"""Off-target joins, safety reports and the fold-in of safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine import constants as K
from oligo_engine.catalog import inputs as I, sql as S
from oligo_engine.catalog.registry import query
from oligo_engine.catalog.scan_queries import SCORER, _base, _beam_sql
from oligo_engine.catalog.sequence_queries import DESIGN_CTES, _designs, scratch
from oligo_engine.functions.labels import efficacy_label
from oligo_engine.operators import curation, kmer_index, offtarget, toxicity, variants
from oligo_engine.operators.ordering import Tables, spread
from oligo_engine.operators.tiling import tile, tile_pieces
from oligo_engine.plans import beam, screening
from oligo_engine.plans.scan import score_designs
from oligo_engine.sources import long_fasta


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return tile(I.transcripts(spark, sf))


# --- seed viability -----------------------------------------------------------


@query(
    "f19_j1_seed_viability",
    S.with_(S.PARENTS, S.SEEDS)
    + f"SELECT parent_id, viability AS toxicity_score, {S.viability_label('viability')} AS toxicity_label FROM parents LEFT JOIN seed_viability ON substr(antisense, 2, 6) = seed",
)
def j1(spark: SparkSession, sf: str) -> DataFrame:
    seeds = toxicity.seed_table(I.seed_viability(spark, sf))
    return toxicity.with_viability(I.parents(spark, sf), seeds, "antisense").select(
        "parent_id", "toxicity_score", "toxicity_label"
    )


@query(
    "p7_annotate_candidates",
    S.with_(S.TRANSCRIPTS, S.TILES, S.SEEDS, f"f AS (SELECT tiles.*, viability, coalesce({S.functional_reason('sense')}, {S.functional_reason('antisense')}, '') AS reason "
            "FROM tiles LEFT JOIN seed_viability ON substr(antisense, 2, 6) = seed)")
    + f"SELECT {S.viability_label('viability')} AS toxicity_label, reason AS func_reason, reason = '' AS func_ok, count(*) AS n, count(DISTINCT transcript_id) AS transcripts FROM f GROUP BY 1, 2, 3",
)
def p7(spark: SparkSession, sf: str) -> DataFrame:
    rows = toxicity.annotate_candidates(_candidates(spark, sf), I.seed_viability(spark, sf))
    return rows.groupBy("toxicity_label", "func_reason", "func_ok").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("transcript_id").alias("transcripts")
    )


@query(
    "p8_mitigated_toxicity",
    S.with_(S.MEASURED, S.MODIFIED, S.SEEDS, "r AS (SELECT viability, regexp_matches(substr(a, 2, 6), '[MFLE]') AS rescued, a, " + S.viability_label("viability") + " AS base FROM modified LEFT JOIN seed_viability ON substr(pa, 2, 6) = seed)",
            "n AS (SELECT *, list_filter(range(2, 8), lambda p: contains('MFLE', substr(a, p, 1))) AS hits FROM r)")
    + "SELECT base AS base_label, CASE WHEN rescued AND base IN ('Toxic', 'Caution') THEN 'Mitigated' ELSE base END AS toxicity_label, "
    "CASE WHEN rescued AND base <> 'Unknown' THEN concat('Seed off-target rescue: ', array_to_string(list_transform(hits, lambda p: concat("
    "MAP {'M': '2''-OMe', 'F': '2''-Fluoro', 'L': 'LNA', 'E': '2''-MOE'}[substr(a, p, 1)], ' @ pos ', p::VARCHAR)), ', ')) ELSE '' END AS toxicity_note, count(*) AS n FROM n GROUP BY 1, 2, 3",
)
def p8(spark: SparkSession, sf: str) -> DataFrame:
    from oligo_engine.functions.labels import viability_label

    rows = toxicity.annotate_variants(I.modified(spark, sf), I.seed_viability(spark, sf))
    return rows.groupBy(
        viability_label(F.col("toxicity_score")).alias("base_label"), "toxicity_label", "toxicity_note"
    ).agg(F.count(F.lit(1)).alias("n"))


# --- transcriptome joins ------------------------------------------------------


def _index_sql(k: int) -> str:
    return (
        f"index_{k} AS (SELECT DISTINCT substr(sequence, i::INTEGER, {k}) AS kmer FROM "
        f"(SELECT sequence, unnest(range(1, length(sequence) - {k - 2})) AS i FROM transcriptome))"
    )


def _hits_sql(k: int, source: str) -> str:
    return (
        f"windows_{k} AS (SELECT antisense, substr({S.revcomp('antisense')}, i::INTEGER, {k}) AS kmer FROM "
        f"(SELECT antisense, unnest(range(1, {23 - k})) AS i FROM (SELECT DISTINCT antisense FROM {source}))),\n"
        f"hits AS (SELECT DISTINCT antisense FROM windows_{k} WHERE kmer IN (SELECT kmer FROM index_{k}))"
    )


_SITES = (
    "sites AS (SELECT DISTINCT substr(sequence, i::INTEGER, 6) AS site FROM (SELECT sequence, unnest(range(1, length(sequence) - 4)) AS i FROM transcriptome)),\n"
    "per_record AS (SELECT record_id, sequence, unnest(list_distinct(list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i, 6)))) AS site FROM transcriptome),\n"
    "counts AS (SELECT site, sum((length(sequence) - length(replace(sequence, site, ''))) // 6)::BIGINT AS seed_occurrences FROM per_record GROUP BY 1)"
)


def _critical(k: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index = kmer_index.build_index(I.transcriptome(spark, sf), k)
        return kmer_index.critical_guides(_candidates(spark, sf), index)

    return run


for _k in (11, 15):
    query(
        f"j2_critical_guides_k{_k}",
        S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.TILES, _index_sql(_k), _hits_sql(_k, "tiles")) + "SELECT antisense FROM hits",
    )(_critical(_k))


@query(
    "j2_few_candidates",
    S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.PARENTS, _index_sql(11), _hits_sql(11, "parents")) + "SELECT antisense FROM hits",
)
def j2_few(spark: SparkSession, sf: str) -> DataFrame:
    """Search for the k-mers of few candidates, without an index of the transcriptome."""
    return kmer_index.matching_guides(I.parents(spark, sf), I.transcriptome(spark, sf), 11)


@query("j3_seed_site_counts", S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, _SITES) + "SELECT site, seed_occurrences FROM counts")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return offtarget.seed_site_counts(I.transcriptome(spark, sf))


@query(
    "j4_screen",
    S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.TILES, _index_sql(15), _hits_sql(15, "tiles"), _SITES,
            "x AS (SELECT transcript_id, hits.antisense IS NOT NULL AS hit, coalesce(seed_occurrences, 0) AS n FROM tiles LEFT JOIN hits USING (antisense) "
            "LEFT JOIN counts ON site = " + S.revcomp("substr(tiles.antisense, 2, 6)") + ")")
    + "SELECT transcript_id, count(*) FILTER (hit) AS critical, sum(n)::BIGINT AS seed_occurrences FROM x GROUP BY 1",
)
def j4(spark: SparkSession, sf: str) -> DataFrame:
    rows = offtarget.screen(_candidates(spark, sf), I.transcriptome(spark, sf))
    return rows.groupBy("transcript_id").agg(
        F.count_if("has_critical_match").alias("critical"), F.sum("seed_occurrences").alias("seed_occurrences")
    )


@query(
    "j2_screen_excluding_targets",
    S.with_(S.TRANSCRIPTS, "all_records AS (SELECT * FROM (" + S.TRANSCRIPTOME.split(" AS (", 1)[1] + " )",
            "transcriptome AS (SELECT * FROM all_records WHERE record_id NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0))",
            S.TILES, _index_sql(11), _hits_sql(11, "tiles"))
    + "SELECT count(*) AS guides FROM hits",
)
def j2_exclude(spark: SparkSession, sf: str) -> DataFrame:
    excluded = I.table(spark, sf, "pages").filter(F.col("page_id") % 2 == 0).select(F.col("page_id").alias("record_id"))
    screened = offtarget.screen(_candidates(spark, sf), I.transcriptome(spark, sf), 11, exclude_record_ids=excluded)
    return screened.filter("has_critical_match").agg(F.countDistinct("antisense").alias("guides"))


@query(
    "j6_overlap_removed",
    S.with_(S.MEASURED, "known AS (SELECT DISTINCT concat(left(sense, 20), left(antisense, 20)) AS k FROM measured WHERE source = 'A')")
    + "SELECT source, count(*) AS n FROM measured WHERE source <> 'A' AND concat(left(sense, 20), left(antisense, 20)) NOT IN (SELECT k FROM known) GROUP BY 1",
)
def j6(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.measured(spark, sf)
    known, fresh = rows.filter(F.col("source") == "A"), rows.filter(F.col("source") != "A")
    return curation.without_overlap(fresh, known).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- stored index, long records -----------------------------------------------


@query(
    "j2_j3_stored_index",
    S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.TILES, S.PARENTS, _index_sql(15),
            "guides AS (SELECT 'parents' AS candidates, antisense FROM parents UNION ALL SELECT 'tiles', antisense FROM tiles)",
            _hits_sql(15, "guides"), _SITES)
    + "SELECT candidates, count(*) AS n, count(*) FILTER (hits.antisense IS NOT NULL) AS critical, sum(coalesce(seed_occurrences, 0))::BIGINT AS seed_occurrences FROM guides "
    "LEFT JOIN hits USING (antisense) LEFT JOIN counts ON site = " + S.revcomp("substr(guides.antisense, 2, 6)") + " GROUP BY 1",
)
def stored(spark: SparkSession, sf: str) -> DataFrame:
    """An index built once, stored, opened again and used for two candidate sets."""
    path = scratch(spark, "index")
    kmer_index.build_index(I.transcriptome(spark, sf), path=path)
    index = kmer_index.open_index(spark, path)
    sets = {"parents": I.parents(spark, sf).select("antisense"), "tiles": _candidates(spark, sf).select("antisense")}
    screened = [offtarget.screen(rows, index=index).withColumn("candidates", F.lit(name)) for name, rows in sets.items()]
    return screened[0].unionByName(screened[1]).groupBy("candidates").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_critical_match").alias("critical"), F.sum("seed_occurrences").alias("seed_occurrences")
    )


LINE = 70
_LONG = (
    "records AS (SELECT coalesce(source, '') AS record, string_agg(translate(hex(text), '0123456789ABCDEF', 'AUGCAUGCAUGCAUGC'), '' ORDER BY doc_id) AS seq FROM documents GROUP BY 1),\n"
    "nts AS (SELECT record, length(seq) AS nt, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS i FROM records WHERE seq <> ''),\n"
)


def _long_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, two nucleotides a byte, as one record for each source: millions of
    nucleotides in lines, written sorted and read as one text."""
    docs = spread(I.table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("record"), "doc_id", "text"))
    bases = F.translate(F.hex("text"), I.HEX.upper(), I.BASES)
    lines = docs.select("record", "doc_id", F.posexplode(F.regexp_extract_all(bases, F.lit(f".{{1,{LINE}}}"), F.lit(0))).alias("no", "line"))
    names = docs.select("record", F.lit(None).cast("bigint").alias("doc_id"), F.lit(-1).alias("no"), F.concat(F.lit(">"), "record").alias("line")).distinct()
    path = scratch(spark, "long")
    lines.unionByName(names).orderBy("record", F.col("doc_id").asc_nulls_first(), "no").select("line").write.text(path)
    return long_fasta.read_pieces(spark, path, one_stream=True)


@query(
    "s1_g1_long_records",
    S.with_(_LONG + "w AS (SELECT *, concat(c, lead(c) OVER o, lead(c, 2) OVER o) AS tri, lead(c, 20) OVER o AS z FROM nts WINDOW o AS (PARTITION BY record ORDER BY i))")
    + "SELECT record AS header, count(*) AS tiles, max(i) AS last_position, count(*) FILTER (tri = 'AUG') AS aug, (sum(i) FILTER (tri = 'AUG'))::BIGINT AS aug_positions, "
    "count(*) FILTER (z IN ('G', 'C')) AS gc_ends FROM w WHERE i <= nt - 21 GROUP BY 1",
)
def long_tiles(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _long_pieces(spark, sf).withColumn("record", F.struct("record_no", "header"))
    tiles = tile_pieces(pieces, "record")
    aug = F.startswith("sense", F.lit("AUG"))
    return tiles.groupBy("record").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.max("position").alias("last_position"),
        F.count_if(aug).alias("aug"),
        F.sum(F.when(aug, F.col("position"))).alias("aug_positions"),
        F.count_if(F.substring("sense", 21, 1).isin("G", "C")).alias("gc_ends"),
    ).select("record.header", "tiles", "last_position", "aug", "aug_positions", "gc_ends")


@query(
    "j2_j3_long_records",
    S.with_(_LONG + "d AS (SELECT record, nt, i, instr('ACGU', c) - 1 AS d FROM nts),\n"
            "codes AS (SELECT DISTINCT " + " + ".join(f"lead(d, {j}) OVER o * {4 ** (14 - j)}" for j in range(15)) + " AS code FROM d WINDOW o AS (PARTITION BY record ORDER BY i) QUALIFY i <= nt - 15),\n"
            "six AS (SELECT DISTINCT concat(c, lead(c) OVER o, lead(c, 2) OVER o, lead(c, 3) OVER o, lead(c, 4) OVER o, lead(c, 5) OVER o) AS site FROM nts WINDOW o AS (PARTITION BY record ORDER BY i) QUALIFY i <= nt - 6),\n"
            "counts AS (SELECT site, sum((nt - length(replace(seq, site, ''))) // 6)::BIGINT AS n FROM six, (SELECT *, length(seq) AS nt FROM records) GROUP BY 1)")
    + "SELECT site, n FROM counts WHERE n > 0 UNION ALL SELECT 'k-mers', count(*) FROM codes UNION ALL SELECT 'sum of codes', sum(code % 1000003)::BIGINT FROM codes",
)
def long_index(spark: SparkSession, sf: str) -> DataFrame:
    index = kmer_index.build_index(_long_pieces(spark, sf), path=scratch(spark, "index"), key="record_no")
    kmers = index.kmers.select(F.explode(F.array(
        F.struct(F.lit("k-mers").alias("site"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("sum of codes").alias("site"), (F.col("code") % 1000003).alias("n")),
    )).alias("x")).groupBy("x.site").agg(F.sum("x.n").alias("n"))
    return index.seeds.select("site", F.col("seed_occurrences").alias("n")).unionByName(kmers)


# --- safety reports -----------------------------------------------------------


def _safety_sql(source: str, k: int = 15) -> str:
    """Safety over (id, sense, antisense, amask, smask, start): motif hits one by one."""
    motifs = "[" + ",".join(f"'{m}'" for m in K.SAFETY_MOTIFS) + "]"

    def found(strand: str, mask: str) -> str:
        return (
            f"flatten(list_transform({motifs}, lambda t: list_transform(list_filter(range(1, length({strand}) + 1), lambda i: substr({strand}, i, length(t)) = t), "
            f"lambda i: {{'t': t, 'masked': length({mask}) = length({strand}) AND contains(substr({mask}, i, length(t)), 'M')}})))"
        )

    return ",\n".join(
        [
            _index_sql(k),
            _hits_sql(k, source),
            _SITES,
            f"s0 AS (SELECT x.*, hits.antisense IS NOT NULL AS crit, coalesce(seed_occurrences, 0) AS n, {S.energy('x.sense')} - {S.energy('x.antisense')} AS asym, "
            f"{found('x.sense', 'smask')} AS ms, {found('x.antisense', 'amask')} AS ma, "
            "CASE WHEN length(amask) >= 8 AND substr(amask, 2, 1) = 'M' THEN 2 WHEN length(amask) >= 8 AND substr(amask, 7, 1) IN ('d', '8') THEN 7 ELSE 0 END AS mit, "
            "contains(amask, '4') OR contains(smask, '4') AS conj "
            f"FROM {source} x LEFT JOIN hits ON x.antisense = hits.antisense LEFT JOIN counts ON site = {S.revcomp('substr(x.antisense, 2, 6)')})",
            "s1 AS (SELECT *, CASE WHEN crit THEN 0e0 ELSE least(100e0, greatest(0e0, 100e0 - (CASE WHEN asym > 0 THEN 40e0 ELSE 0e0 END) - "
            "(CASE WHEN left(start, 1) NOT IN ('A', 'U', 'T') THEN 5e0 ELSE 0e0 END) - (CASE WHEN n = 0 THEN 0e0 WHEN mit > 0 THEN least(5e0, n * 0.1e0) ELSE least(30e0, n * 5e0) END) - "
            "15e0 * (len(list_filter(ms, lambda h: NOT h.masked)) + len(list_filter(ma, lambda h: NOT h.masked))) - (CASE WHEN conj THEN 0e0 ELSE 10e0 END))) END AS safety_score FROM s0)",
            "safe AS (SELECT *, NOT crit AS is_safe, CASE WHEN crit THEN 'TOXIC' WHEN safety_score < 80 THEN 'WARNING_SEED' ELSE 'CLEARED' END AS safety_status FROM s1)",
        ]
    )


def _texts_sql() -> str:
    def slot(text: str, **values: str) -> str:
        out = S.quote(text)
        for name, value in values.items():
            out = f"replace({out}, '{{{name}}}', {value})"
        return out

    def motif(hits: str, strand: str, masked: bool, text: str) -> str:
        line = S.quote(text.replace("{strand}", strand))
        keep = "h.masked" if masked else "NOT h.masked"
        return f"list_transform(list_filter({hits}, lambda h: {keep}), lambda h: replace({line}, '{{m}}', h.t))"

    def one(condition: str, text: str) -> str:
        return f"(CASE WHEN {condition} THEN [{text}] ELSE [] END)"

    shown = "format('{:,}', n)"
    risks = [
        one("asym > 0", slot(K.RISK_ASYMMETRY, x="asym::VARCHAR")),
        one("crit", S.quote(K.RISK_CRITICAL)),
        one("n > 0 AND mit = 0", slot(K.RISK_SEED, seed="substr(antisense, 2, 6)", n=shown)),
        motif("ms", "Sense", False, K.RISK_MOTIF),
        motif("ma", "Antisense", False, K.RISK_MOTIF),
        one("NOT conj", S.quote(K.RISK_CONJUGATE)),
    ]
    notes = [
        one("left(start, 1) NOT IN ('A', 'U', 'T')", S.quote(K.NOTE_GUIDE_START)),
        one("mit = 2", S.quote(K.NOTE_SEED_M2)),
        one("mit = 7", S.quote(K.NOTE_SEED_7)),
        one("n > 0 AND mit > 0", slot(K.NOTE_SEED_MITIGATED, n=shown)),
        motif("ms", "Sense", True, K.NOTE_MOTIF),
        motif("ma", "Antisense", True, K.NOTE_MOTIF),
        one("conj", S.quote(K.NOTE_CONJUGATE)),
    ]

    def joined(parts: list[str]) -> str:
        return "flatten([" + ", ".join(parts) + "])"

    return f"texts AS (SELECT *, {joined(risks)} AS risks, {joined(notes)} AS notes FROM safe)"


_ROWS = (
    "rows_in AS (SELECT parent_id AS id, sense, antisense, CASE WHEN parent_id % 3 = 0 THEN '' WHEN parent_id % 3 = 1 THEN "
    + S.put("antisense", "2", "'M'") + " ELSE " + S.put("antisense", "7", "'8'")
    + " END AS amask, CASE WHEN parent_id % 2 = 0 THEN concat('4', substr(sense, 2, 9), repeat('M', 11)) ELSE '' END AS smask, antisense AS start FROM parents)"
)


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    k, one = F.col("parent_id"), F.lit(1)
    return I.parents(spark, sf).select(
        k.alias("candidate_id"),
        "sense",
        "antisense",
        F.when(k % 3 == 0, F.lit(""))
        .when(k % 3 == 1, F.overlay("antisense", F.lit("M"), F.lit(2), one))
        .otherwise(F.overlay("antisense", F.lit("8"), F.lit(7), one))
        .alias("antisense_mods"),
        F.when(k % 2 == 0, F.concat(F.lit("4"), F.substring("sense", 2, 9), F.lit("M" * 11))).otherwise(F.lit("")).alias("sense_mods"),
    )


_REPORT = S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.PARENTS, _ROWS, _safety_sql("rows_in"), _texts_sql())


@query(
    "p9_p10_p11_safety_score",
    _REPORT + "SELECT id AS candidate_id, crit AS has_critical_match, n AS seed_occurrences, is_safe, safety_score, safety_status FROM safe",
)
def p9(spark: SparkSession, sf: str) -> DataFrame:
    report = screening.screen_offtargets(_masked(spark, sf), I.transcriptome(spark, sf), texts=False)
    return report.select("candidate_id", "has_critical_match", "seed_occurrences", "is_safe", "safety_score", "safety_status")


@query(
    "q6_safety_report",
    _REPORT + "SELECT id AS candidate_id, safety_status, array_to_string(risks, chr(10)) AS risks, array_to_string(notes, chr(10)) AS notes FROM texts",
)
def q6(spark: SparkSession, sf: str) -> DataFrame:
    report = screening.screen_offtargets(_masked(spark, sf), I.transcriptome(spark, sf))
    return report.select(
        "candidate_id", "safety_status",
        F.array_join("risk_factors", "\n").alias("risks"), F.array_join("safety_notes", "\n").alias("notes"),
    )


def _certificate_sql() -> str:
    def bullets(items: str, none: str) -> str:
        return f"CASE WHEN len({items}) = 0 THEN '{none}' ELSE array_to_string(list_transform({items}, lambda x: concat('* ', x)), chr(10)) END"

    parts = [
        S.quote(K.CERTIFICATE_TITLE), S.quote(K.CERTIFICATE_SUBTITLE), "''", "'## Sequence Details'",
        "concat('* **Sense Strand:** `', sense, '`')", "concat('* **Antisense Strand:** `', antisense, '`')",
        "concat('* **Antisense Modifications:** `', CASE WHEN amask = '' THEN 'None' ELSE amask END, '`')", "''",
        "'## Validation Results'", "concat('* **Status:** **', safety_status, '**')",
        "concat('* **Overall Safety Score:** **', safety_score::VARCHAR, '%**')", "''",
        "'### Risk Factors Identified'", bullets("risks", "* None detected."), "''",
        "'### Safety Notes & Mitigations'", bullets("notes", "* None."), "''", "'---'", S.quote(K.CERTIFICATE_FOOTER),
    ]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


@query("s10_certificates", _REPORT + f"SELECT id AS candidate_id, {_certificate_sql()} AS markdown FROM texts")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    report = screening.screen_offtargets(_masked(spark, sf), I.transcriptome(spark, sf))
    return screening.certify(report).select("candidate_id", "markdown")


# --- fold-in of safety --------------------------------------------------------

_VARIANT_ROWS = "v_in AS (SELECT parent_id AS id, s AS sense, pa AS antisense, a AS amask, s AS smask, pa AS start FROM {source})"


@query(
    "p12_j9_fold_in_designs",
    S.with_(*DESIGN_CTES, S.TRANSCRIPTS, S.TRANSCRIPTOME, _base(), S.penalised("built", "pen"),
            f"adj AS (SELECT *, {S.adjusted(S.clip('raw'))} AS eff FROM pen)", _VARIANT_ROWS.format(source="built"), _safety_sql("v_in"),
            "f AS (SELECT adj.parent_id, safety_score, safety_status, CASE WHEN safety_score < 100 THEN (CASE WHEN NOT is_safe THEN 0e0 ELSE greatest(0e0, eff - (100e0 - safety_score) * 0.2e0) END) ELSE eff END AS efficacy_score "
            "FROM adj JOIN safe ON adj.parent_id = safe.id)")
    + f"SELECT parent_id, safety_score, safety_status, efficacy_score, {S.efficacy_label('round(efficacy_score, 1)')} AS efficacy_label FROM f",
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    designs = score_designs(_designs(spark, sf), SCORER, I.seed_viability(spark, sf), details=False)
    folded = screening.fold_safety_into_designs(designs, I.transcriptome(spark, sf))
    return folded.select("parent_id", "safety_score", "safety_status", "efficacy_score", "efficacy_label")


_SEED_GUIDE = S.put(S.put("antisense", "2", "'M'"), "14", "'F'")
_FOUND = _beam_sql(20, 100, "", seed=_SEED_GUIDE).rstrip()


@query(
    "q5_p13_w8_w9_seeded_beam_safety",
    _FOUND + ",\n" + ",\n".join([
        S.TRANSCRIPTS, S.TRANSCRIPTOME,
        "top100 AS (SELECT final.parent_id, final.antisense AS a, parents.sense AS s, parents.antisense AS pa, rank, efficacy_score AS eff, penalty_sum, parent_score FROM final JOIN parents USING (parent_id) JOIN b USING (parent_id) WHERE rank <= 100)",
        "v_in AS (SELECT concat(parent_id, '|', a) AS id, s AS sense, pa AS antisense, a AS amask, s AS smask, pa AS start FROM top100)",
        _safety_sql("v_in"),
        "folded AS (SELECT top100.*, safety_score, safety_status, is_safe, round(eff + 0.7e0 * penalty_sum, 2) AS raw_eff, "
        "CASE WHEN safety_score < 100 THEN round((100e0 - safety_score) * 0.2e0, 1) ELSE 0e0 END AS extra FROM top100 JOIN safe ON safe.id = concat(parent_id, '|', a))",
        "final2 AS (SELECT *, CASE WHEN NOT is_safe THEN 0e0 ELSE greatest(0e0, round(raw_eff - 0.7e0 * (penalty_sum + extra), 2)) END AS efficacy_score FROM folded)",
    ])
    + f"\nSELECT parent_id, a AS antisense, raw_eff AS raw_efficacy_score, efficacy_score, safety_score, safety_status, {S.efficacy_label('efficacy_score')} AS efficacy_label, "
    "(row_number() OVER (PARTITION BY parent_id ORDER BY efficacy_score DESC, rank))::INTEGER AS rank FROM final2",
)
def q5(spark: SparkSession, sf: str) -> DataFrame:
    """Beam search from given singles and a given design; leading designs screened and ranked anew."""
    from oligo_engine.plans.scan import scan_modifications

    parents = I.parents(spark, sf)
    singles = scan_modifications(parents, SCORER, I.seed_viability(spark, sf)).select(
        *beam.PARENT, "sense", "antisense", "mod_symbol", "mod_position", "mod_positions", "mod_strand", "efficacy_score"
    )
    guide = F.overlay(F.overlay("antisense", F.lit("M"), F.lit(2), F.lit(1)), F.lit("F"), F.lit(14), F.lit(1))
    seeds = parents.select(
        F.col("sense").alias("parent_sense"), F.col("antisense").alias("parent_antisense"), "sense", guide.alias("antisense"),
        F.lit("M+F").alias("mod_symbol"), F.lit(2).alias("mod_position"), F.lit("2,14").alias("mod_positions"),
        F.lit("antisense+antisense").alias("mod_strand"),
    )
    with Tables(spark) as tables:
        found = beam.beam_search(parents, SCORER, singles=singles, seed_designs=seeds)
        folded = screening.fold_safety_into_search(beam.top_designs(found), I.transcriptome(spark, sf))
        return tables.keep(
            folded.withColumn("efficacy_label", efficacy_label(F.col("efficacy_score"))).select(
                "parent_id", "antisense", "raw_efficacy_score", "efficacy_score", "safety_score", "safety_status", "efficacy_label", "rank"
            )
        )


@query(
    "q6_parent_safety_all_candidates",
    S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME, S.TILES,
            "rows_in AS (SELECT transcript_id AS id, sense, antisense, '' AS amask, '' AS smask, antisense AS start FROM tiles)", _safety_sql("rows_in"))
    + "SELECT id AS transcript_id, safety_status, count(*) AS n, sum(safety_score)::BIGINT AS total FROM safe GROUP BY 1, 2",
)
def q6_all(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-transcript screen of unmodified candidates, scores only."""
    report = screening.screen_offtargets(_candidates(spark, sf), I.transcriptome(spark, sf), texts=False)
    return report.groupBy("transcript_id", "safety_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("safety_score").cast("bigint").alias("total")
    )
