"""Design rules of strands, judged once, and panels dealt out."""

import random

from pyspark.sql import functions as F

from oligo_engine.functions.sequence import has_gc_run, has_homopolymer, has_palindrome, reverse_complement, strand_folds
from oligo_engine.operators import toxicity
from oligo_engine.plans.panels import mask_panel
from oligo_engine.plans.scoring import LinearScorer


def _strands(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices(rng.choice(["AUGC", "AUG", "AG", "AU", "GGC"]), k=21)),) for _ in range(1500)]
    rows += [(x,) for x in ("", "AUGC", "augcaugcaugcaugcaugca", "AUGCNAUGCAUGCAUGCAUGC", "A" * 30, "GCGCAAAAGCGC", None)]
    return spark.createDataFrame(rows, "sense string")


def test_folds_written_out_equal_the_search(spark):
    rows = _strands(spark).select(
        strand_folds(F.col("sense"), reverse_complement(F.col("sense"))).alias("a"), has_palindrome(F.col("sense")).alias("b")
    )
    got = rows.collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} >= {True, False}


def test_runs_equal_the_patterns(spark):
    rows = _strands(spark).select(
        has_homopolymer(F.col("sense")).eqNullSafe(F.col("sense").rlike("A{5}|U{5}|G{5}|C{5}")).alias("a"),
        has_gc_run(F.col("sense")).eqNullSafe(F.col("sense").rlike("[GC]{6}")).alias("b"),
    )
    assert rows.filter("NOT (a AND b)").count() == 0


def test_reasons_equal_those_of_single_strands(spark):
    rows = _strands(spark).withColumn("antisense", F.reverse(F.translate("sense", "AUGC", "UACG")))
    got = toxicity.with_functionality(rows)
    assert got.columns == ["sense", "antisense", "func_reason", "func_ok"]
    want = F.coalesce(toxicity.functional_reason(F.col("sense")), toxicity.functional_reason(F.col("antisense")), F.lit(""))
    assert got.filter(~F.col("func_reason").eqNullSafe(want)).count() == 0


def test_parents_in_one_split_are_dealt_out(spark):
    parents = spark.createDataFrame([(i, "AUGCAUGCAUGCAUGCAUGCA", "UGCAUGCAUGCAUGCAUGCAU") for i in range(40)], "parent_id long, sense string, antisense string").coalesce(1)
    assert mask_panel(parents, LinearScorer()).rdd.getNumPartitions() >= 4
