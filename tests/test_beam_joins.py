"""How the beam search joins its parents."""

import contextlib
import io

from pyspark.sql import functions as F

from oligo_engine.operators import ordering
from oligo_engine.plans import beam
from oligo_engine.plans.scoring import LinearScorer


def test_no_table_of_parents_is_broadcast(spark, monkeypatch):
    """Small as the tables are here, every join with them is planned as a merge join."""
    plans = []

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain()
        plans.append(said.getvalue())
        return df

    monkeypatch.setattr(beam, "materialise", lambda df: ordering.materialise(plan(df)))
    parents = spark.createDataFrame([(i, "AUGC" * 5 + c, c + "GCAU" * 5) for i, c in enumerate("AUGC")], "parent_id long, sense string, antisense string")
    strands = parents.select(F.col("sense").alias("parent_sense"), F.col("antisense").alias("parent_antisense"), "sense")
    track = [F.lit("").alias("mod_positions"), F.lit("antisense").alias("mod_strand")]
    singles = strands.select(
        "*", F.overlay("parent_antisense", F.lit("M"), F.lit(3)).alias("antisense"), F.lit("M").alias("mod_symbol"), F.lit(3).alias("mod_position"),
        *track, F.lit(50.0).alias("efficacy_score"),
    )
    seeds = singles.drop("efficacy_score").withColumn("antisense", F.overlay("parent_antisense", F.lit("F"), F.lit(5)))
    found = plan(beam.beam_search(parents, LinearScorer(), singles=singles, seed_designs=seeds, beam_width=5))
    assert {r[0] for r in found.select("parent_id").distinct().collect()} == {0, 1, 2, 3}
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 3 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)
