"""Row generators over sequences: pieces, tiles, Dicer products, k-mer windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine.constants import STRAND_LENGTH
from oligo_engine.functions.sequence import reverse_complement
from oligo_engine.operators.ordering import spread

# Windows cut from one piece of a sequence.  Cutting a window out of a string walks
# to its start, so pieces keep the cost linear in the length of a sequence.
PIECE = 2048
# A piece goes on for so many characters, which serves windows of HALO + 1.
HALO = STRAND_LENGTH - 1
# Windows of a piece are cut from parts of so many starts, which shortens that walk again.
PART = 64


def pieces(df: DataFrame, sequence: str, k: int) -> DataFrame:
    """Cut sequences into overlapping pieces that together hold every k-window once.

    Adds ``_piece`` and the 0-based ``_start`` of the piece.  One regular-expression
    pass captures each piece with a look-ahead of k-1 further characters.  Sequences too
    long for one row come as pieces from ``sources.long_fasta``.
    """
    cut = f"(?s)(?=(.{{1,{PIECE + k - 1}}})).{{1,{PIECE}}}"
    listed = F.when(F.length(sequence) <= PIECE + k - 1, F.array(F.col(sequence))).otherwise(
        F.regexp_extract_all(F.col(sequence), F.lit(cut), F.lit(1))
    )
    return (
        df.select(*[c for c in df.columns if c != sequence], F.posexplode(listed).alias("_no", "_piece"))
        .withColumn("_start", F.col("_no") * PIECE)
        .drop("_no")
        .filter(F.length("_piece") >= k)
    )


def as_pieces(records: DataFrame, *keys: str) -> DataFrame:
    """``keys``, start (bigint), piece: of rows with a ``sequence``, or as they are if they
    are pieces already."""
    if "piece" in records.columns:
        return records.select(*keys, "start", "piece")
    dealt = spread(records.select(*keys, "sequence"))
    cut = f"(?s)(?=(.{{1,{PIECE + HALO}}})).{{1,{PIECE}}}"
    listed = F.when(F.length("sequence") <= PIECE, F.array("sequence")).otherwise(
        F.regexp_extract_all("sequence", F.lit(cut), F.lit(1))
    )
    return dealt.select(*keys, F.posexplode(listed).alias("_no", "piece")).select(
        *keys, (F.col("_no") * F.lit(PIECE).cast("bigint")).alias("start"), "piece"
    )


def starts(piece: Column, k: int) -> Column:
    """1-based places of a piece's own k-windows; null if it has none."""
    n = F.least(F.length(piece) - (k - 1), F.lit(PIECE))
    return F.when(n >= 1, F.sequence(F.lit(1), n))


def windows(df: DataFrame, sequence: str, k: int, name: str) -> DataFrame:
    """One row per k-window with its 0-based ``position``; other columns are kept."""
    cut = pieces(df, sequence, k)
    kept = [c for c in df.columns if c != sequence]
    return cut.select(*kept, "_start", "_piece", F.explode(starts(F.col("_piece"), k)).alias("_at")).select(
        *kept,
        (F.col("_start") + F.col("_at") - 1).cast("int").alias("position"),
        F.substr(F.col("_piece"), F.col("_at"), F.lit(k)).alias(name),
    )


def tile(transcripts: DataFrame) -> DataFrame:
    """All 21-mer candidates: length - 20 rows per transcript, 0-based position."""
    dealt = spread(transcripts.select("transcript_id", "sequence"))
    return windows(dealt, "sequence", STRAND_LENGTH, "sense").withColumn("antisense", reverse_complement(F.col("sense")))


def tile_pieces(cut: DataFrame, key: str = "record_no") -> DataFrame:
    """All 21-mer candidates of records that come in pieces; position is a bigint."""
    n = F.least(F.length("piece") - HALO, F.lit(PIECE))
    firsts = F.when(n >= 1, F.sequence(F.lit(1), n, F.lit(PART)))
    parts = spread(cut.select(key, "start", "piece")).select(key, "start", "piece", n.alias("_n"), F.explode(firsts).alias("_from")).select(
        key,
        (F.col("start") + F.col("_from") - 2).alias("_start"),
        F.substr(F.col("piece"), F.col("_from"), F.lit(PART + HALO)).alias("_part"),
        F.least(F.lit(PART), F.col("_n") - F.col("_from") + 1).alias("_n"),
    )
    return (
        parts.select(key, "_start", "_part", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_at"))
        .select(
            key,
            (F.col("_start") + F.col("_at")).alias("position"),
            F.substr(F.col("_part"), F.col("_at"), F.lit(STRAND_LENGTH)).alias("sense"),
        )
        .withColumn("antisense", reverse_complement(F.col("sense")))
    )


def dicer_product(substrates: DataFrame) -> DataFrame:
    """The 3'-terminal 21-mer of each 25-30 nt substrate; others are not usable."""
    sense = F.substring("sequence", -STRAND_LENGTH, STRAND_LENGTH)
    return substrates.filter(F.length("sequence").between(25, 30)).select(
        "transcript_id",
        F.lit(0).alias("position"),
        sense.alias("sense"),
        reverse_complement(sense).alias("antisense"),
    )
