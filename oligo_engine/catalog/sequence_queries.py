"""Sources, cleaning, sequence functions and row generators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine import constants as K
from oligo_engine.catalog import inputs as I, sql as S
from oligo_engine.catalog.registry import query
from oligo_engine.functions import chemistry, cleaning, labels, sequence as seq
from oligo_engine.operators import curation, tiling, toxicity, variants
from oligo_engine.operators.ordering import checkpoint_root
from oligo_engine.plans.scoring import normalise
from oligo_engine.sources import readers, writers


def scratch(spark: SparkSession, name: str) -> str:
    """New folder under the shared checkpoint folder, for write-and-read queries."""
    return f"{checkpoint_root(spark)}/oligo/{name}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------


@query(
    "s2_first_records",
    "SELECT file, length(seq)::BIGINT AS nt, md5(seq) AS digest FROM (SELECT doc_id // 64 AS file, arg_min(translate(hex(coalesce(text, '')), '0123456789ABCDEF', 'AUGCAUGCAUGCAUGC'), doc_id) AS seq "
    "FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)",
)
def s2_first(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, two nucleotides a byte, as FASTA files of 64 records; the first of each."""
    docs = I.table(spark, sf, "documents").filter("doc_id IS NOT NULL")
    bases = F.translate(F.hex(F.coalesce("text", F.lit(""))), I.HEX.upper(), I.BASES)
    lines = F.regexp_replace(bases, "(.{70})", "$1\n")
    records = docs.select(F.floor(F.col("doc_id") / 64).alias("file"), "doc_id", F.concat(F.lit(">doc "), F.col("doc_id"), F.lit("\n"), lines).alias("value"))
    path = scratch(spark, "firsts")
    records.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    read = readers.read_sequences(spark, path)
    sequence = F.regexp_replace("sequence", r"\s+", "")
    return read.select(
        F.regexp_extract("transcript_id", "file=([0-9]+)/", 1).cast("bigint").alias("file"),
        F.length(sequence).cast("bigint").alias("nt"),
        F.md5(sequence).alias("digest"),
    )


@query(
    "s1_fasta_scan",
    S.with_(S.TRANSCRIPTS, S.TRANSCRIPTOME)
    + "SELECT concat('record ', record_id::VARCHAR, ' > chr') AS header, sequence FROM transcriptome",
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "fasta")
    text = F.concat(
        F.lit(">record "), F.col("record_id").cast("string"), F.lit(" > chr\n"),
        F.lower(F.substring("sequence", 1, 60)), F.lit("\n"),
        F.translate(F.substring("sequence", 61, 100), "U", "T"), F.lit("  \n"), F.substring("sequence", 161, 96),
    )
    I.transcriptome(spark, sf).select(text).write.text(path)
    return readers.read_fasta(spark, path)


_INLINE = (
    "CASE WHEN transcript_id % 3 = 0 THEN concat('>first', chr(10), left(sequence, 100), chr(10), substr(sequence, 101, 50), "
    "chr(10), '>second', chr(10), sequence) ELSE sequence END"
)


@query(
    "s2_first_sequence",
    S.with_(S.TRANSCRIPTS)
    + "SELECT transcript_id, CASE WHEN transcript_id % 3 = 0 THEN left(sequence, 150) ELSE sequence END AS sequence FROM transcripts",
)
def s2(spark: SparkSession, sf: str) -> DataFrame:
    t = I.transcripts(spark, sf)
    inline = F.when(
        F.col("transcript_id") % 3 == 0,
        F.concat(
            F.lit(">first\n"), F.substring("sequence", 1, 100), F.lit("\n"), F.substring("sequence", 101, 50),
            F.lit("\n>second\n"), F.col("sequence"),
        ),
    ).otherwise(F.col("sequence"))
    return t.select(
        "transcript_id", seq.letters_as_rna(readers.first_sequence(inline)).alias("sequence")
    )


@query(
    "s3_s7_measured_csv",
    S.with_(S.MEASURED)
    + "SELECT source, count(*) AS n, sum(efficacy)::DOUBLE AS total, count(DISTINCT sense) AS duplexes FROM measured GROUP BY source",
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "csv")
    rows = I.measured(spark, sf).select(
        F.col("sense").alias(" sense"), F.col("antisense").alias("antisense "), "efficacy", "source"
    )
    writers.write_csv(rows, path)
    return readers.read_measured(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("efficacy").alias("total"), F.countDistinct("sense").alias("duplexes")
    )


@query("s4_seed_tsv", S.with_(S.SEEDS) + "SELECT seed, viability FROM seed_viability")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "tsv")
    I.seed_viability(spark, sf).select(
        F.lower("seed").alias("Seed"), F.col("viability").alias("cell_viability")
    ).write.csv(path, sep="\t", header=True)
    return toxicity.seed_table(readers.read_seed_table(spark, path))


NAMES = [
    "2'-O-Methyluridine", "2’-O-Methyladenosine-3'-phosphorothioate", "2'-Deoxy-2'-fluorocytidine", "2'-Fluoroguanosine",
    "Unlocked nucleic acid uridine", "Locked nucleic acid adenosine", "2'-Deoxythymidine", "Phosphorothioate", "0", "A",
    "", "nan", "Glycol nucleic acid", "2'-O-methoxyethyl", "Pseudouridine", "N-acetylgalactosamine", "5'-Phosphate",
    "Methylphosphonate", "Unknown linker 7", "Mystery cap", "`4′-thio uridine", " u ",
]


def _names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    return I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.element_at(names, (F.col("p_partkey") % len(NAMES) + 1).cast("int")).alias("name")
    )


_NAMES = (
    "names AS (SELECT p_partkey AS id, [" + ", ".join(S.quote(n) for n in NAMES) + f"][(p_partkey % {len(NAMES)} + 1)::INTEGER] AS name FROM part)"
)
_CLEAN = "trim(replace(replace(replace(replace(lower(name), '''', ''), '’', ''), '`', ''), '′', ''))"
_SYMBOL = (
    "CASE WHEN trim(name) IN ('', '0', 'nan', 'NaN') OR upper(trim(name)) IN ('A','U','G','C','T') THEN '' "
    + " ".join(f"WHEN contains({_CLEAN}, '{m}') THEN '{s}'" for m, s in K.ALIAS_RULES)
    + " END"
)


@query(
    "s9_a10_unmapped_report",
    S.with_(_NAMES, f"u AS (SELECT trim(name) AS name, count(*) AS n FROM names WHERE ({_SYMBOL}) IS NULL GROUP BY 1)")
    + "SELECT concat(lpad(n::VARCHAR, greatest(8, length(n::VARCHAR))::INTEGER, ' '), '  ', name) AS line FROM u UNION ALL SELECT '# Unmapped modifications' "
    "UNION ALL SELECT concat('# Total distinct unmapped names: ', count(*)::VARCHAR, chr(10)) FROM u",
)
def s9(spark: SparkSession, sf: str) -> DataFrame:
    counts = curation.unmapped_frequencies(_names(spark, sf), "name")
    return writers.report_lines(counts, "Unmapped modifications").select("line")


@query(
    "j10_s6_symbol_taxonomy",
    S.with_(_NAMES)
    + "SELECT t.type, t.name AS symbol_name, count(*) AS n FROM "
    f"(SELECT {_SYMBOL} AS symbol FROM names) x JOIN (VALUES "
    + ", ".join(f"('{s}', {S.quote(n)}, '{t}')" for s, n, t in K.SYMBOLS)
    + ") t(symbol, name, type) ON x.symbol = t.symbol WHERE t.type <> 'canonical' GROUP BY 1, 2",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    _, modifications = readers.supported_modifications(readers.taxonomy(spark))
    used = curation.map_names(_names(spark, sf), "name").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    named = modifications.withColumnRenamed("name", "symbol_name")
    return used.join(named, "symbol").select("type", "symbol_name", "n")


@query(
    "s5_j5_alias_rules_json",
    S.with_(_NAMES) + f"SELECT {_SYMBOL} AS symbol, count(*) AS n FROM names GROUP BY 1",
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """Rules read from a taxonomy document written by Spark, in document order."""
    path = scratch(spark, "taxonomy")
    rules = F.array(
        *[F.struct(F.lit(m).alias("match"), F.lit(s).alias("symbol"), F.lit("").alias("note")) for m, s in K.ALIAS_RULES]
    )
    doc = readers.taxonomy(spark).agg(F.collect_list(F.struct("*")).alias("modifications")).withColumn("alias_rules", rules)
    doc.coalesce(1).write.json(path)
    _, alias = readers.read_taxonomy(spark, path)
    mapped = curation.map_names(_names(spark, sf), "name", alias)
    return mapped.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j5_many_alias_rules",
    "WITH rules AS (SELECT i AS rule_no, concat('none', i::VARCHAR, ';') AS match, '!' AS symbol FROM range(5000) t(i) "
    "UNION ALL SELECT 5000 + s_suppkey, concat('dye ', s_suppkey::VARCHAR), chr((97 + s_suppkey % 26)::INTEGER) FROM supplier), "
    "names AS (SELECT p_partkey AS id, concat('Dye ', (p_partkey % 150)::VARCHAR, ' cap') AS name FROM part) "
    "SELECT id, arg_min(symbol, rule_no) AS symbol FROM names LEFT JOIN rules ON contains(lower(name), match) GROUP BY id",
)
def j5_many(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of rules given at run time; the first that is contained counts."""
    fixed = spark.range(5000).select(F.col("id").alias("rule_no"), F.concat(F.lit("none"), F.col("id").cast("string"), F.lit(";")).alias("match"), F.lit("!").alias("symbol"))
    key = F.col("s_suppkey")
    own = I.table(spark, sf, "supplier").select(
        (key + 5000).alias("rule_no"), F.concat(F.lit("dye "), key.cast("string")).alias("match"), F.chr((key % 26 + 97).cast("bigint")).alias("symbol")
    )
    names = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Dye "), (F.col("p_partkey") % 150).cast("string"), F.lit(" cap")).alias("name")
    )
    return curation.map_names(names, "name", fixed.unionByName(own)).select("id", "symbol")


# --- cleaning -----------------------------------------------------------------

_DIRTY = (
    "dirty AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN lower(replace(sequence, 'U', 'T')) "
    "WHEN 1 THEN concat(' ', left(sequence, 12), '-', substr(sequence, 13, 10), ' 1') WHEN 2 THEN concat(left(sequence, 20), 'N', right(sequence, 5)) "
    "WHEN 3 THEN left(sequence, (doc_id % 30)::INTEGER) ELSE '  ' END AS raw FROM "
    f"(SELECT doc_id, {S.bases('text')} AS sequence FROM documents))"
)
_RNA = "replace(upper(regexp_replace(raw, '[^A-Za-z]', '', 'g')), 'T', 'U')"


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("s"), F.col("doc_id") % 5
    raw = (
        F.when(k == 0, F.lower(F.replace(s, F.lit("U"), F.lit("T"))))
        .when(k == 1, F.concat(F.lit(" "), F.substring(s, 1, 12), F.lit("-"), F.substring(s, 13, 10), F.lit(" 1")))
        .when(k == 2, F.concat(F.substring(s, 1, 20), F.lit("N"), F.right(s, F.lit(5))))
        .when(k == 3, F.substr(s, F.lit(1), (F.col("doc_id") % 30).cast("int")))
        .otherwise(F.lit("  "))
    )
    docs = I.table(spark, sf, "documents").select("doc_id", I.bases(F.col("text")).alias("s"))
    return docs.select(F.col("doc_id").alias("id"), raw.alias("sequence"))


@query(
    "f1_f3_strict_sequences",
    S.with_(_DIRTY, f"r AS (SELECT id, raw, {_RNA} AS rna FROM dirty)", "q AS (SELECT id, rna, CASE WHEN trim(raw) = '' THEN 'empty input' "
    "WHEN regexp_matches(rna, '[^AUGC]') THEN 'unexpected characters' WHEN length(rna) < 21 THEN 'shorter than 21 nt' END AS reason FROM r)")
    + "SELECT id, CASE WHEN reason IS NULL THEN rna END AS sequence, reason FROM q",
)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return curation.clean_transcripts(_dirty(spark, sf))


@query(
    "f2_lenient_sequences",
    S.with_(_DIRTY, f"r AS (SELECT id, {_RNA} AS rna FROM dirty)")
    + "SELECT id, CASE WHEN regexp_matches(rna, '^[AUGC]+$') THEN rna END AS sequence, "
    "coalesce(regexp_matches(rna, '^[AUGC]+$') AND length(rna) BETWEEN 19 AND 25, false) AS length_ok FROM r",
)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = cleaning.lenient_sequence(F.col("sequence"))
    return _dirty(spark, sf).select(
        "id", cleaned.alias("sequence"), cleaning.strand_length_ok(cleaned).alias("length_ok")
    )


_EFF = "nullif(regexp_extract(t, '[-+]?\\d*\\.?\\d+', 0), '')"


@query(
    "f4_efficacy_text",
    "SELECT id, CASE WHEN " + _EFF + " IS NOT NULL THEN " + S.clip(f"{_EFF}::DOUBLE") + " END AS efficacy FROM (SELECT c_custkey AS id, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'not measured' ELSE concat((c_acctbal / 64e0)::DECIMAL(12, 3)::VARCHAR, ' percent inhibition') END AS t FROM customer)",
)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("not measured")).otherwise(
        F.concat((F.col("c_acctbal") / 64.0).cast("decimal(12,3)").cast("string"), F.lit(" percent inhibition"))
    )
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), cleaning.parse_efficacy(text).alias("efficacy")
    )


@query(
    "f5_dashed_efficacy",
    "SELECT id, " + S.clip("v") + " AS efficacy FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN -(s_suppkey % 90) - 0.5e0 "
    "ELSE (s_suppkey % 90) + 0.5e0 END AS v FROM supplier)",
)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat((F.col("s_suppkey") % 90).cast("string"), F.lit(".5"))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("--"), number)).otherwise(number)
    return I.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), cleaning.parse_efficacy_dashed(text).alias("efficacy")
    )


@query("f6_f7_modification_names", S.with_(_NAMES) + f"SELECT id, {_CLEAN} AS cleaned, {_SYMBOL} AS symbol FROM names")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf).select(
        "id",
        cleaning.normalise_modification_name(name).alias("cleaned"),
        cleaning.modification_symbol(name).alias("symbol"),
    )


@query(
    "f8_unmodified_flag",
    S.with_(_NAMES) + "SELECT id, lower(trim(name)) IN ('', '0', 'nan', 'none') OR upper(trim(name)) IN ('A','U','G','C','T') AS unmodified FROM names",
)
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("id", cleaning.is_unmodified(F.col("name")).alias("unmodified"))


def _export(spark: SparkSession, sf: str) -> DataFrame:
    """Raw export rows from ``part`` with faults of every kind."""
    names = _names(spark, sf).withColumnRenamed("id", "parent_id")
    rows = I.parents(spark, sf).join(names, "parent_id")
    k = F.col("parent_id")
    return rows.select(
        k.alias("id"),
        F.when(k % 11 == 0, F.lit("n/a")).otherwise(F.concat((k % 130).cast("string"), F.lit(" percent"))).alias("efficacy_text"),
        F.when(k % 13 == 0, F.substring("sense", 1, 15)).otherwise(F.lower("sense")).alias("sense_raw"),
        F.when(k % 17 == 0, F.concat(F.col("antisense"), F.lit("X"))).otherwise(F.col("antisense")).alias("antisense_raw"),
        F.when(k % 3 == 0, F.col("name")).otherwise(F.lit("0")).alias("sense_mod_names"),
        F.when(k % 5 == 0, F.col("name")).otherwise(F.lit(None).cast("string")).alias("antisense_mod_names"),
    )


_EXPORT = (
    "export AS (SELECT p.parent_id AS id, CASE WHEN id % 11 = 0 THEN NULL ELSE least(100e0, (id % 130)::DOUBLE) END AS efficacy, "
    "CASE WHEN id % 13 = 0 THEN left(sense, 15) ELSE sense END AS sense, CASE WHEN id % 17 = 0 THEN NULL ELSE antisense END AS antisense, "
    "CASE WHEN id % 3 = 0 THEN name ELSE '0' END AS sm, CASE WHEN id % 5 = 0 THEN name ELSE '' END AS am "
    "FROM parents p JOIN names n ON p.parent_id = n.id)"
)
_PLAIN = "(lower(trim({c})) IN ('', '0', 'nan', 'none') OR upper(trim({c})) IN ('A','U','G','C','T'))"
_ROUTED = (
    "routed AS (SELECT *, CASE WHEN efficacy IS NULL THEN 'bad efficacy' WHEN NOT coalesce(length(sense) BETWEEN 19 AND 25, false) "
    "OR NOT coalesce(length(antisense) BETWEEN 19 AND 25, false) THEN 'bad sequence' WHEN NOT "
    + _PLAIN.format(c="sm") + " OR NOT " + _PLAIN.format(c="am") + " THEN 'modified' END AS reason FROM export)"
)


@query("f9_row_routing", S.with_(_NAMES, S.PARENTS, _EXPORT, _ROUTED) + "SELECT id, efficacy, reason AS reject_reason FROM routed")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return curation.route_export(_export(spark, sf)).select("id", "efficacy", "reject_reason")


@query(
    "a11_rejection_counts",
    S.with_(_NAMES, S.PARENTS, _EXPORT, _ROUTED) + "SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM routed GROUP BY 1",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return curation.rejection_counts(curation.route_export(_export(spark, sf)))


_EXISTING = "existing AS (SELECT sense, antisense, (parent_id % 130)::DOUBLE AS efficacy FROM parents WHERE parent_id % 4 = 0)"
_FRESH = "fresh AS (SELECT DISTINCT sense, antisense, efficacy FROM routed WHERE reason IS NULL)"


@query(
    "u3_u5_increment",
    S.with_(_NAMES, S.PARENTS, _EXPORT, _ROUTED, _EXISTING, _FRESH,
            "merged AS (SELECT sense, antisense, efficacy, min(flag) AS flag FROM (SELECT *, 0 AS flag FROM existing "
            "UNION ALL SELECT *, 1 AS flag FROM fresh) GROUP BY 1, 2, 3)")
    + "SELECT count(*) FILTER (flag = 0) AS rows_before, count(*) AS rows_after, count(*) FILTER (flag = 1) AS rows_added FROM merged",
)
def u5(spark: SparkSession, sf: str) -> DataFrame:
    fresh = curation.kept_rows(curation.route_export(_export(spark, sf)))
    existing = (
        I.parents(spark, sf)
        .filter(F.col("parent_id") % 4 == 0)
        .select("sense", "antisense", (F.col("parent_id") % 130).cast("double").alias("efficacy"))
    )
    return curation.increment_report(curation.merge_increment(existing, fresh))


_GUIDE = f"substr({S.bases('c_custkey::VARCHAR')}, 1, 19)"


@query(
    "f10_f11_published_guides",
    "SELECT id, concat(" + S.revcomp("guide") + ", 'UU') AS sense, concat(guide, 'UU') AS antisense, "
    "(round(least(100e0, greatest(0e0, label * 100e0)) * 100e0) / 100e0) AS efficacy, 'published' AS source FROM "
    f"(SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN left({_GUIDE}, 18) ELSE {_GUIDE} END AS guide, "
    "(c_custkey % 1200) / 1024e0 AS label FROM customer) WHERE length(guide) = 19",
)
def f10(spark: SparkSession, sf: str) -> DataFrame:
    guide = F.substring(I.bases(F.col("c_custkey").cast("string")), 1, 19)
    rows = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 9 == 0, F.substring(guide, 1, 18))
        .when(F.col("c_custkey") % 2 == 0, F.lower(F.translate(guide, "U", "T")))
        .otherwise(guide)
        .alias("guide"),
        ((F.col("c_custkey") % 1200) / 1024.0).alias("label"),
    )
    return curation.from_published_guides(rows, "published")


# --- sequence functions -------------------------------------------------------


@query(
    "f12_f18_sequence_functions",
    S.with_(S.PARENTS)
    + f"SELECT parent_id, {S.revcomp('sense')} AS revcomp, {S.gc_percent('sense')} AS gc, {S.palindrome('sense')} AS palindrome, "
    f"{S.homopolymer('sense')} AS homopolymer, {S.gc_run('sense')} AS gc_run, substr(antisense, 2, 6) AS seed FROM parents",
)
def f12(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sense")
    return I.parents(spark, sf).select(
        "parent_id",
        seq.reverse_complement(s).alias("revcomp"),
        seq.gc_percent(s).alias("gc"),
        seq.has_palindrome(s).alias("palindrome"),
        seq.has_homopolymer(s).alias("homopolymer"),
        seq.has_gc_run(s).alias("gc_run"),
        seq.seed_of(F.col("antisense")).alias("seed"),
    )


@query(
    "f17_functional_filter",
    S.with_(S.PARENTS, f"r AS (SELECT parent_id, coalesce({S.functional_reason('sense')}, {S.functional_reason('antisense')}, '') AS func_reason FROM parents)")
    + "SELECT parent_id, func_reason, func_reason = '' AS func_ok FROM r",
)
def f17(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.with_functionality(I.parents(spark, sf)).select("parent_id", "func_reason", "func_ok")


@query(
    "f20_f21_f34_labels",
    f"SELECT l_returnflag AS source, {S.efficacy_label('l_quantity * 2')} AS efficacy_label, CASE WHEN l_quantity * 2 >= 60 THEN 'High' ELSE 'Low' END AS panel, "
    f"CASE WHEN contains('MFS1LED', sym) THEN 'Standard' WHEN contains('BJVINOPRHKZQWX7', sym) THEN 'Exotic' ELSE 'Rare' END AS confidence, count(*) AS n "
    f"FROM (SELECT *, {S.SYMBOL_LIST}[(l_partkey % 30 + 1)::INTEGER] AS sym FROM lineitem) GROUP BY 1, 2, 3, 4",
)
def f20(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("l_quantity") * 2
    symbol = F.element_at(F.array(*[F.lit(s) for s in K.MODIFICATIONS]), (F.col("l_partkey") % 30 + 1).cast("int"))
    return (
        I.table(spark, sf, "lineitem")
        .select(
            F.col("l_returnflag").alias("source"),
            labels.efficacy_label(score).alias("efficacy_label"),
            labels.panel_label(score).alias("panel"),
            labels.chemistry_confidence(symbol).alias("confidence"),
        )
        .groupBy("source", "efficacy_label", "panel", "confidence")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f23_f24_pad_and_replace",
    S.with_(S.PARENTS, "c AS (SELECT parent_id, left(sense, (10 + parent_id % 12)::INTEGER) AS part, (parent_id % 24)::INTEGER AS pos FROM parents)")
    + "SELECT parent_id, rpad(part, 21, 'A') AS padded, CASE WHEN pos BETWEEN 1 AND length(part) THEN " + S.put("part", "pos", "'M'") + " END AS replaced FROM c",
)
def f23(spark: SparkSession, sf: str) -> DataFrame:
    part = F.substr("sense", F.lit(1), (10 + F.col("parent_id") % 12).cast("int"))
    return I.parents(spark, sf).select(
        "parent_id",
        seq.pad_to_strand(part).alias("padded"),
        seq.replace_at(part, (F.col("parent_id") % 24).cast("int"), F.lit("M")).alias("replaced"),
    )


SPECS = [
    ("F,,M", "2,5,,10,12", "S", "1,2"), ("", "", "L,, E ", " 3 ,,4,5"), ("F,,M", "2,5", "S", "1"),
    ("?", "4", "", ""), ("M", "22", "", ""), ("M", "3,x", "A", "1"), ("4,,4", "1,,21", "M,,F", "7,8,,8,9"),
]
_SPECS = "[" + ", ".join("{" + ", ".join(f"'{k}': {S.quote(v)}" for k, v in zip(("sm", "sp", "am", "ap"), spec)) + "}" for spec in SPECS) + "]"
_DESIGNS = f"designs AS (SELECT parent_id, sense, antisense, unnest(({_SPECS})[(parent_id % {len(SPECS)} + 1)::INTEGER]) FROM parents)"


def _designs(spark: SparkSession, sf: str) -> DataFrame:
    names = ["sense_mods", "sense_positions", "antisense_mods", "antisense_positions"]
    specs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, spec)]) for spec in SPECS])
    rows = I.parents(spark, sf).withColumn("_s", F.element_at(specs, (F.col("parent_id") % len(SPECS) + 1).cast("int")))
    return rows.select("parent_id", "sense", "antisense", "_s.*")


def _spec_ctes() -> str:
    """Steps and error per strand, tested token by token."""

    def strand(tag: str, seq_: str) -> str:
        mods, poss = f"{tag}m", f"{tag}p"
        groups = f"list_transform(string_split({mods}, ',,'), lambda x: trim(x))"
        tokens = f"list_transform(string_split({poss}, ',,'), lambda g: list_filter(list_transform(string_split(g, ','), lambda p: trim(p)), lambda p: p <> ''))"
        flat = f"flatten({tokens})"
        known = "'" + "".join(K.MODIFICATIONS + K.CANONICAL) + "'"
        return (
            f"CASE WHEN {mods} = '' OR {poss} = '' THEN NULL WHEN len({groups}) <> len({tokens}) THEN 'group count mismatch' "
            f"WHEN len(list_filter({groups}, lambda x: NOT (length(x) = 1 AND contains({known}, x)))) > 0 THEN 'unknown symbol' "
            f"WHEN len(list_filter({flat}, lambda p: NOT regexp_matches(p, '^[+-]?\\d+$'))) > 0 THEN 'bad position' "
            f"WHEN len(list_filter({flat}, lambda p: TRY_CAST(p AS INTEGER) NOT BETWEEN 1 AND length({seq_}))) > 0 THEN 'position out of range' END AS {tag}_error, "
            f"CASE WHEN {mods} = '' OR {poss} = '' THEN [] ELSE flatten(list_transform(range(1, len({groups}) + 1), "
            f"lambda i: list_transform(({tokens})[i], lambda p: concat(({groups})[i], p)))) END AS {tag}_steps"
        )

    return (
        f"parsed AS (SELECT parent_id, sense, antisense, {strand('s', 'sense')}, {strand('a', 'antisense')} FROM designs), "
        "good AS (SELECT * FROM parsed WHERE s_error IS NULL AND a_error IS NULL)"
    )


def _applied(steps: str, strand: str) -> str:
    """Last step per position wins."""
    last = f"list_filter({steps}, lambda x: substr(x, 2)::INTEGER = i)"
    return (
        f"array_to_string(list_transform(range(1, length({strand}) + 1), lambda i: CASE WHEN len({last}) > 0 "
        f"THEN left(({last})[-1], 1) ELSE substr({strand}, i, 1) END), '')"
    )


@query(
    "f25_spec_errors",
    S.with_(S.PARENTS, _DESIGNS, _spec_ctes()) + "SELECT parent_id, coalesce(s_error, a_error) AS error FROM parsed WHERE coalesce(s_error, a_error) IS NOT NULL",
)
def f25(spark: SparkSession, sf: str) -> DataFrame:
    return variants.rejected_designs(_designs(spark, sf)).select("parent_id", "error")


BUILT = (
    "built AS (SELECT parent_id, " + _applied("s_steps", "sense") + " AS s, " + _applied("a_steps", "antisense")
    + " AS a, sense AS ps, antisense AS pa FROM good)"
)
DESIGN_CTES = (S.PARENTS, _DESIGNS, _spec_ctes(), BUILT)


@query("g5_multi_designs", S.with_(*DESIGN_CTES) + "SELECT parent_id, s AS sense, a AS antisense FROM built")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return variants.build_designs(_designs(spark, sf)).select("parent_id", "sense", "antisense")


@query(
    "f26_f27_changes",
    S.with_(S.MEASURED, S.MODIFIED, "v AS (SELECT row_id, concat(left(s, 8), 'LEYL', substr(s, 13)) AS s, a, ps, pa FROM modified)")
    + "SELECT len(list_filter(range(1, 22), lambda i: substr(s, i, 1) <> substr(ps, i, 1)))::INTEGER AS n_sense, "
    "array_to_string(list_transform(list_filter(range(1, 22), lambda i: substr(a, i, 1) <> substr(pa, i, 1)), lambda i: concat(substr(a, i, 1), i::VARCHAR)), ',') AS guide, "
    "NOT regexp_matches(s, '[LYE][LYE][LYE]') AS viable, count(*) AS n FROM v GROUP BY 1, 2, 3",
)
def f26(spark: SparkSession, sf: str) -> DataFrame:
    m = I.modified(spark, sf).withColumn("sense", F.overlay("sense", F.lit("LEYL"), F.lit(9), F.lit(4)))
    s, a, ps, pa = (F.col(c) for c in ("sense", "antisense", "parent_sense", "parent_antisense"))
    guide = F.transform(chemistry.changes(a, pa), lambda x: F.concat(x.symbol, x.pos.cast("string")))
    return (
        m.select(
            F.size(chemistry.changes(s, ps)).alias("n_sense"),
            F.array_join(guide, ",").alias("guide"),
            chemistry.sterically_viable(s, ps).alias("viable"),
        )
        .groupBy("n_sense", "guide", "viable")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f22_seed_rescue",
    S.with_(S.MEASURED, S.MODIFIED, "r AS (SELECT list_filter(range(2, 8), lambda p: contains('MFLE', substr(a, p, 1))) AS hits, a FROM modified)")
    + "SELECT CASE WHEN len(hits) = 0 THEN '' ELSE concat('Seed off-target rescue: ', array_to_string(list_transform(hits, lambda p: concat("
    "MAP {'M': '2''-OMe', 'F': '2''-Fluoro', 'L': 'LNA', 'E': '2''-MOE'}[substr(a, p, 1)], ' @ pos ', p::VARCHAR)), ', ')) END AS note, count(*) AS n FROM r GROUP BY 1",
)
def f22(spark: SparkSession, sf: str) -> DataFrame:
    note = chemistry.rescue_note(chemistry.seed_rescue(F.col("antisense")))
    return I.modified(spark, sf).select(note.alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f28_log_dose",
    S.with_(S.MEASURED)
    + "SELECT concentration_nM, " + S.micro("ln(1e0 + CASE WHEN concentration_nM > 0 THEN concentration_nM ELSE 10e0 END)") + " AS log_dose, count(*) AS n FROM measured GROUP BY 1, 2",
)
def f28(spark: SparkSession, sf: str) -> DataFrame:
    dose = F.floor(cleaning.log_dose(F.col("concentration_nM")) * 1e6 + 0.5)
    return I.measured(spark, sf).groupBy("concentration_nM", dose.alias("log_dose")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f29_asymmetry",
    S.with_(S.PARENTS) + f"SELECT parent_id, {S.energy('sense')} - {S.energy('antisense')} AS asymmetry FROM parents",
)
def f29(spark: SparkSession, sf: str) -> DataFrame:
    return I.parents(spark, sf).select("parent_id", seq.asymmetry(F.col("sense"), F.col("antisense")).alias("asymmetry"))


#: A rising function with a level stretch and values beyond 0-100.
CALIBRATION = ([-10.0, 0.0, 12.5, 30.0, 55.0, 80.0, 120.0], [-5.0, 4.0, 4.0, 31.0, 60.0, 90.0, 104.0])


def _calibrated_sql(x: str) -> str:
    bounds, values = CALIBRATION
    parts = "".join(
        f"WHEN {x} < {bounds[i + 1]}e0 THEN {values[i]}e0 + ({values[i + 1]}e0 - ({values[i]}e0)) * ({x} - ({bounds[i]}e0)) / ({bounds[i + 1]}e0 - ({bounds[i]}e0)) "
        for i in range(len(bounds) - 1)
    )
    return S.clip(f"CASE WHEN {x} <= {bounds[0]}e0 THEN {values[0]}e0 {parts} ELSE {values[-1]}e0 END")


@query(
    "f30_a16_normalise",
    "SELECT c_custkey AS id, " + S.clip("v") + " AS clipped, " + S.rescale("v", "batch") + " AS rescaled, " + S.clip("v") + " AS uncalibrated, "
    + _calibrated_sql("v") + " AS calibrated FROM "
    "(SELECT c_custkey, c_acctbal / 64e0 - 20e0 AS v, c_custkey // 8 AS batch FROM customer)",
)
def f30(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    rows = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_acctbal") / 64.0 - 20.0).alias("v"),
        F.floor(F.col("c_custkey") / 8).alias("batch"),
    )
    return rows.select(
        "id",
        normalise(v, "clip").alias("clipped"),
        normalise(v, "rescale", ["batch"]).alias("rescaled"),
        normalise(v, "calibrate").alias("uncalibrated"),
        normalise(v, "calibrate", points=CALIBRATION).alias("calibrated"),
    )


@query(
    "f31_f32_usable_rows",
    S.with_(S.MEASURED)
    + "SELECT source, count(*) AS n, count(*) FILTER (concentration_nM IS NOT NULL) AS with_dose, count(*) FILTER (concentration_nM IS NOT NULL AND "
    "concentration_nM <> 5e0) AS finite FROM measured GROUP BY 1",
)
def f31(spark: SparkSession, sf: str) -> DataFrame:
    m = I.measured(spark, sf)
    # a ratio that is infinite for 5 nM and null without a dose
    gap = F.nullif(F.col("concentration_nM") - 5.0, F.lit(0.0))
    ratio = F.when(F.col("concentration_nM").isNotNull(), F.coalesce(1.0 / gap, F.lit(float("inf"))))
    kept = m.withColumn("ratio", ratio).na.drop(subset=["sense", "antisense", "efficacy"])
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ratio").alias("with_dose"),
        F.count_if(cleaning.is_finite(F.col("ratio"))).alias("finite"),
    )


@query(
    "f35_catalog_tokens",
    S.with_(S.PARENTS)
    + "SELECT parent_id, " + S.put(S.put("sense", "2", "'M'"), "5", "'F'") + " AS sense, CASE WHEN parent_id % 2 = 0 THEN "
    + S.put(S.put("antisense", "1", "'S'"), "(3 + parent_id % 15)", "'L'")
    + " ELSE antisense END AS antisense, (parent_id % 2)::INTEGER AS unmapped FROM parents",
)
def f35(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("parent_id") % 2 == 0
    at = (3 + F.col("parent_id") % 15).cast("string")
    cell = F.concat(
        F.lit("1*Uridine-x,2*2'-O-Methyluridine,"),
        F.lit("5*2'-Fluorouridine"),
        F.when(even, F.concat(F.lit(",1*Phosphorothioate|"), at, F.lit("*Locked nucleic acid"))).otherwise(F.lit("")),
    )
    # the first token is unmapped on odd rows only
    cell = F.when(even, F.regexp_replace(cell, r"^1\*Uridine-x", "1*A")).otherwise(cell)
    rows = I.parents(spark, sf).select(
        "parent_id", F.col("sense").alias("base_sense"), F.col("antisense").alias("base_antisense"), cell.alias("cell")
    )
    return curation.parse_catalog(rows, "cell").select("parent_id", "sense", "antisense", "unmapped")


@query(
    "f36_tolerant_singles",
    "SELECT p_partkey AS parent_id, CASE WHEN p_partkey % 2 = 0 THEN 'M' ELSE 'F' END AS mod_symbol, (p_partkey % 21)::INTEGER AS mod_position, "
    "'antisense' AS mod_strand, (p_partkey % 21)::VARCHAR AS mod_positions, p_retailprice AS efficacy_score FROM part",
)
def f36(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    at = (F.col("p_partkey") % 21).cast("int")
    rows = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("parent_id"),
        F.when(even, F.lit("M")).otherwise(F.lit("")).alias("mod_symbol"),
        F.when(even, F.lit("x")).otherwise(F.lit("F")).alias("modification"),
        F.when(even, at).alias("mod_position"),
        at.alias("position"),
        F.when(even, F.lit("antisense")).alias("mod_strand"),
        F.lit("antisense").alias("strand"),
        F.when(even, F.col("p_retailprice")).otherwise(F.lit(0.0)).alias("efficacy_score"),
        F.col("p_retailprice").alias("score"),
    )
    return curation.tolerant_singles(rows).drop("sense", "antisense", "delta_score")


# --- generators ---------------------------------------------------------------


@query("g1_tile", S.with_(S.TRANSCRIPTS, S.TILES) + "SELECT transcript_id, position, sense, antisense FROM tiles")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return tiling.tile(I.transcripts(spark, sf))


@query(
    "g2_dicer",
    S.with_("subs AS (SELECT o_orderkey AS transcript_id, left(" + S.bases("o_orderkey::VARCHAR") + ", (20 + o_orderkey % 13)::INTEGER) AS sequence FROM orders)")
    + "SELECT transcript_id, 0 AS position, right(sequence, 21) AS sense, " + S.revcomp("right(sequence, 21)") + " AS antisense FROM subs WHERE length(sequence) BETWEEN 25 AND 30",
)
def g2(spark: SparkSession, sf: str) -> DataFrame:
    length = (20 + F.col("o_orderkey") % 13).cast("int")
    subs = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transcript_id"),
        F.substr(I.bases(F.col("o_orderkey").cast("string")), F.lit(1), length).alias("sequence"),
    )
    return tiling.dicer_product(subs)


@query(
    "g8_target_windows",
    S.with_(S.PARENTS, "w AS (SELECT substr(" + S.revcomp("antisense") + ", i::INTEGER, 15) AS kmer FROM (SELECT antisense, unnest(range(1, 8)) AS i FROM (SELECT DISTINCT antisense FROM parents)))")
    + "SELECT kmer, count(*) AS n FROM w GROUP BY 1",
)
def g8(spark: SparkSession, sf: str) -> DataFrame:
    sites = I.parents(spark, sf).select("antisense").distinct().select(
        seq.reverse_complement(F.col("antisense")).alias("site")
    )
    return tiling.windows(sites, "site", 15, "kmer").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
