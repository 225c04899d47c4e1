"""Inputs derived from the driver tables, which hold no sequences themselves.

Every function mirrors a common table expression of the same name in
``catalog.sql``; digests of the table columns stand in for sequence content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEX = "0123456789abcdef"
BASES = "AUGCAUGCAUGCAUGC"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bases(text: Column) -> Column:
    """32 nucleotides from the digest of a text."""
    return F.translate(F.md5(text), HEX, BASES)


def long_bases(text: Column, pieces: int = 8) -> Column:
    return F.concat(*[bases(F.concat(text, F.lit(f"#{i}"))) for i in range(pieces)])


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("transcript_id"), long_bases(F.col("text")).alias("sequence")
    )


def transcriptome(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as records, plus every 50th transcript as a true off-target."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("record_id"), long_bases(F.col("html")).alias("sequence")
    )
    planted = transcripts(spark, sf).filter(F.col("transcript_id") % 50 == 0)
    return pages.unionByName(
        planted.select((F.col("transcript_id") + 1000000000).alias("record_id"), "sequence")
    )


def parents(spark: SparkSession, sf: str) -> DataFrame:
    sense = F.substring(bases(F.col("p_partkey").cast("string")), 1, 21)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("parent_id"),
        sense.alias("sense"),
        F.reverse(F.translate(sense, "AUGC", "UACG")).alias("antisense"),
    )


def seed_viability(spark: SparkSession, sf: str) -> DataFrame:
    """Viability of the seeds cut from order digests.

    Distinct hexamers of the tables, at most 4,096; the value comes from a digest
    byte.  Seeds whose digest starts with ``0`` are left out, to have unknown ones.
    """
    cut = F.translate(F.md5(F.col("o_orderkey").cast("string")), HEX, BASES)
    seeds = table(spark, sf, "orders").select(F.substring(cut, 1, 6).alias("seed")).distinct()
    digest = F.md5(F.col("seed"))
    value = (F.instr(F.lit(HEX), F.substring(digest, 1, 1)) - 1) * 16 + (
        F.instr(F.lit(HEX), F.substring(digest, 2, 1)) - 1
    )
    return seeds.filter(~F.startswith(digest, F.lit("0"))).select(
        "seed", (value * F.lit(100.0) / F.lit(255.0)).alias("viability")
    )


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as measured duplexes; lines of one order share some duplexes.

    ``prediction`` is another column of the table, so that metrics have two inputs.
    """
    sense = F.substring(
        bases(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 3).cast("string"))),
        1,
        21,
    )
    gene = F.col("l_suppkey") % 13
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("row_id"),
        sense.alias("sense"),
        F.reverse(F.translate(sense, "AUGC", "UACG")).alias("antisense"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("linenumber"),
        (F.col("l_quantity") * 2.0).alias("efficacy"),
        F.floor(F.col("l_extendedprice") / 1000.0).cast("double").alias("prediction"),
        F.col("l_returnflag").alias("source"),
        F.when(gene == 0, F.lit("Unknown")).otherwise(F.concat(F.lit("gene"), gene.cast("string"))).alias("target_gene"),
        F.nullif(F.col("l_discount") * 100.0, F.lit(0.0)).alias("concentration_nM"),
    )


def modified(spark: SparkSession, sf: str) -> DataFrame:
    """Measured duplexes with three modifications each."""
    one = F.lit(1)
    guide = F.overlay("antisense", F.lit("F"), (F.lit(2) + F.col("partkey") % 19).cast("int"), one)
    return measured(spark, sf).select(
        "row_id",
        F.overlay("sense", F.lit("M"), F.lit(1) + F.col("linenumber"), one).alias("sense"),
        F.overlay(guide, F.lit("S"), (F.lit(21) - F.col("suppkey") % 5).cast("int"), one).alias("antisense"),
        F.col("sense").alias("parent_sense"),
        F.col("antisense").alias("parent_antisense"),
        "efficacy", "prediction", "source", "target_gene", "concentration_nM",
    )
