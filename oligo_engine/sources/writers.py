"""Sinks for result tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def rounded(df: DataFrame, scores: list[str], digits: int = 2) -> DataFrame:
    """Presentation view: scores rounded, everything else as it is."""
    return df.withColumns({c: F.round(c, digits) for c in scores})


def write_results(df: DataFrame, path: str, scores: list[str], mode: str = "errorifexists") -> None:
    """Nested rows as JSON lines with rounded scores."""
    rounded(df, scores).write.mode(mode).json(path)


def report_lines(frequencies: DataFrame, title: str) -> DataFrame:
    """Ordered text lines of a frequency report (``name, n``)."""
    body = frequencies.select(
        F.lit(2).alias("part"),
        F.col("n"),
        F.col("name"),
        F.concat(
            # narrower counts are padded to eight characters, wider ones kept whole
            F.when(F.length(F.col("n").cast("string")) < 8, F.lpad(F.col("n").cast("string"), 8, " ")).otherwise(
                F.col("n").cast("string")
            ),
            F.lit("  "),
            F.col("name"),
        ).alias("line"),
    )
    total = frequencies.agg(F.count(F.lit(1)).alias("d"))
    head = total.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.lit(f"# {title}").alias("line")),
                F.struct(
                    F.lit(1).alias("part"),
                    F.concat(F.lit("# Total distinct unmapped names: "), F.col("d").cast("string"), F.lit("\n")).alias("line"),
                ),
            )
        ).alias("_h")
    ).select("_h.part", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("name"), "_h.line")
    return head.unionByName(body).orderBy("part", F.desc("n"), "name")


def write_report(frequencies: DataFrame, path: str, title: str, mode: str = "errorifexists") -> None:
    report_lines(frequencies, title).select("line").write.mode(mode).text(path)


def write_certificates(reported: DataFrame, document: Column, path: str, mode: str = "errorifexists") -> None:
    """One Markdown document per row in a ``(candidate_id, markdown)`` dataset."""
    reported.select("candidate_id", document.alias("markdown")).write.mode(mode).parquet(path)


def write_metadata(meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One-row training summary as JSON."""
    meta.write.mode(mode).json(path)
