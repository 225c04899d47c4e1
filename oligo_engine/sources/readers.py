"""Readers for FASTA, delimited tables, the symbol taxonomy and inline sequences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from oligo_engine.functions.cleaning import stripped
from oligo_engine.constants import ALIAS_RULES, SYMBOLS

MEASURED = T.StructType(
    [
        T.StructField("sense", T.StringType()),
        T.StructField("antisense", T.StringType()),
        T.StructField("efficacy", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
MEASURED_MODIFIED = T.StructType(
    [
        T.StructField("sense", T.StringType()),
        T.StructField("antisense", T.StringType()),
        T.StructField("base_sense", T.StringType()),
        T.StructField("base_antisense", T.StringType()),
        T.StructField("efficacy", T.DoubleType()),
        T.StructField("concentration_nM", T.DoubleType()),
        T.StructField("target_gene", T.StringType()),
    ]
)
TAXONOMY = "symbol string, name string, binary string, type string"


def _fasta_record(text: Column) -> tuple[Column, Column]:
    """Header and sequence of one record without its leading marker."""
    lines = F.split(F.regexp_replace(text, r"^\s*>", ""), r"\r?\n")
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "")
    return stripped(lines[0]), F.translate(F.upper(F.regexp_replace(body, r"\s+", "")), "T", "U")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """All records of FASTA files: ``header, sequence`` (RNA, upper case).

    Files are split at record starts, so one large file is read by many tasks; gzip
    files are not splittable and should be repartitioned by the caller.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    header, sequence = _fasta_record(F.col("value"))
    return text.select(header.alias("header"), sequence.alias("sequence")).filter(F.length("sequence") > 0)


def with_record_ids(records: DataFrame) -> DataFrame:
    """Stable id from content: independent of file splits and of retried tasks."""
    return records.withColumn("record_id", F.xxhash64("header", "sequence"))


def first_sequence(text: Column) -> Column:
    """Sequence of an inline text: the first FASTA record, or the text itself."""
    trimmed = F.regexp_replace(text, r"^\s+", "")
    first = F.regexp_extract(F.concat(trimmed, F.lit("\n>")), r"(?s)^>[^\n]*\n(.*?)\n>", 1)
    return F.when(F.startswith(trimmed, F.lit(">")), first).otherwise(text)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """First sequence of every file under ``path`` (one file per transcript).

    Files are split at record starts, and of each file only the first record that is not
    blank is carried on, so a file may hold any number of records. A file that does not
    begin with a record is an inline text; one with records behind such a text keeps a
    record marker at its end, which no cleaning accepts. Files without any text give no
    row. A record is a row; those too long for one are read by ``long_fasta``.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(
        F.input_file_name().alias("transcript_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no")).alias("_at"),
        "value",
    )
    stated = F.length(stripped(F.col("value"))) > 0
    firsts = rows.groupBy("transcript_id").agg(
        F.min("_at").alias("_begin"),
        F.max(F.when(stated, F.col("_at"))).alias("_end"),
        F.min_by(F.when(stated, F.struct("_at", "value")), F.when(stated, F.col("_at"))).alias("_first"),
    )
    text, begins = F.col("_first.value"), F.col("_first._at") == F.col("_begin")
    inline = begins & ~F.regexp_like(text, F.lit(r"^\s*>"))
    more = F.when(F.col("_end") > F.col("_first._at"), F.concat(text, F.lit("\n>"))).otherwise(text)
    sequence = F.when(inline, more).otherwise(first_sequence(F.concat(F.lit(">"), F.regexp_replace(text, r"^\s*>", ""))))
    return firsts.filter(F.col("_first").isNotNull()).select("transcript_id", sequence.alias("sequence"))


def read_measured(spark: SparkSession, path: str, schema: T.StructType = MEASURED) -> DataFrame:
    """Measured-efficacy CSV; header names are trimmed and matched to the schema,
    and columns the file lacks come out null."""
    raw = spark.read.csv(path, header=True)
    found = {c.strip(): c for c in raw.columns}
    return raw.select(
        *[
            (F.col(f"`{found[f.name]}`").try_cast(f.dataType) if f.name in found else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def read_seed_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated seed viabilities as ``seed, viability``, columns found by name.

    Without a file every seed is unknown; a column the file lacks comes out null.
    """
    try:
        rows = spark.read.csv(path, sep="\t", header=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_seed_table(spark)
    found = {c.strip(): F.col(f"`{c}`") for c in rows.columns}
    seed, viability = (found.get(c, F.lit(None).cast("string")) for c in ("Seed", "cell_viability"))
    return rows.select(F.upper(stripped(seed)).alias("seed"), stripped(viability).try_cast("double").alias("viability"))


def empty_seed_table(spark: SparkSession) -> DataFrame:
    """Stand-in where no viability table is available: every seed is Unknown."""
    return spark.createDataFrame([], "seed string, viability double")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and ordered alias rules of a taxonomy JSON document."""
    doc = spark.read.schema(
        "modifications array<struct<symbol:string,name:string,binary:string,type:string>>,"
        "alias_rules array<struct<match:string,symbol:string,note:string>>"
    ).json(path, multiLine=True)
    symbols = doc.select(F.inline("modifications"))
    rules = doc.select(F.posexplode("alias_rules").alias("rule_no", "_r")).select("rule_no", "_r.match", "_r.symbol", "_r.note")
    return symbols, rules


def taxonomy(spark: SparkSession) -> DataFrame:
    """Built-in symbols; the six-bit code is the 1-based place in the list."""
    rows = [(s, n, format(i, "06b"), t) for i, (s, n, t) in enumerate(SYMBOLS, start=1)]
    return spark.createDataFrame(rows, TAXONOMY)


def alias_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, m, s) for i, (m, s) in enumerate(ALIAS_RULES)]
    return spark.createDataFrame(rows, "rule_no int, match string, symbol string")


def supported_modifications(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical letters and chemical modifications apart."""
    return symbols.filter(F.col("type") == "canonical"), symbols.filter(F.col("type") != "canonical")
