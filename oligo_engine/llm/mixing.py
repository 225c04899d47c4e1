"""Mixing sources to target weights by capped water-filling.

DataFrame functions only. Sources are clamped at ``max_epochs`` times their words, the
excess goes to the others by weight until none is above its clamp, and every source
repeats its documents: whole repetitions for all, and a fractional one for documents in
seeded random order until the target is met. The order is by hash buckets, so no task
ever sorts or sums a whole source.

Nulls and odd rows: a null text has size 0; a null source is a source of its own, last
in order; a null id draws like any other id; repeated rows count and draw alike; an
empty table gives an empty result. A source without words gets target 0. Further
columns of the input are ignored unless named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(identity: Column, seed: str) -> Column:
    """Seeded bucket of a document, uniform over 0 .. BUCKETS - 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def water_fill(totals: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Targets for (source, source_size) rows, one per source.

    Sorted by clamp over weight, the first sources are clamped; the level for the rest is
    what is left of the total over their weights. The first source whose clamp stands at
    or above that level, and all after it, get level times weight, which is where
    repeated resharing ends. Windows run over one row per source.
    """
    every = W.partitionBy(F.lit(0))
    in_order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    fill = W.partitionBy(F.lit(0)).orderBy("_full", F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn(
        "weight", F.element_at(listed, (F.row_number().over(in_order) - 1) % len(weights) + 1)
    ).withColumns({"_clamp": F.col("source_size") * F.lit(float(max_epochs)), "_all": F.sum("source_size").over(every)})
    levels = (
        weighted.withColumn("_full", F.col("_clamp") / F.col("weight"))
        .withColumns(
            {
                "_clamped": F.sum("_clamp").over(fill.rowsBetween(W.unboundedPreceding, -1)),
                "_weights": F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)),
            }
        )
        .withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.coalesce("_clamped", F.lit(0.0))) / F.col("_weights"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(every)["_level"])
    )
    target = F.when(F.col("_level").isNull(), F.col("_clamp")).otherwise(
        F.least(F.col("_clamp"), F.col("_level") * F.col("weight"))
    )
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and ``carry``) of every row.

    Within a source all buckets before the threshold take one more repetition, the
    threshold bucket takes the remaining share of each document's words, so the taken
    words meet the target but for rounding. Joined by (source, bucket): a source that
    holds a third of all rows is spread over its buckets.
    """
    sized = docs.select(
        "doc_id", "source", *carry, word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("bucket")
    )
    filled = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    totals = filled.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(totals, weights, share, max_epochs)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = (
        filled.alias("f")
        .join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source")))
        .select("f.source", "f.bucket", "f.words", "t.source_size", "t.target")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn(
            "part",
            F.when(F.col("words") <= 0, 0.0).otherwise(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_rest") - F.col("_before")) / F.col("words")))
            ),
        )
    )
    taken = F.col("size") * F.col("whole") + F.floor(F.col("size") * F.col("part") + F.lit(0.5))
    return (
        sized.alias("d")
        .join(
            plan.alias("p"),
            F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")),
        )
        .select(
            "d.doc_id",
            "d.source",
            *[f"d.{c}" for c in carry],
            "d.size",
            "p.source_size",
            "p.target",
            taken.cast("long").alias("taken"),
        )
    )
