"""Plan properties that matter at scale, read off the physical plans."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oligo_engine.catalog import inputs as I
from oligo_engine.operators import kmer_index, offtarget
from oligo_engine.plans.ranking import rank_candidates
from oligo_engine.plans.scan import scan_modifications
from oligo_engine.plans.scoring import LinearScorer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
MODELS = ("m3_", "m4_", "m7_", "m10_a6", "m11_", "a8_")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_joins(spark):
    """Join sides of any size: only hinted broadcasts remain."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(MODELS)))
def test_no_cross_joins_and_no_python(spark, no_small_joins, name):
    text = plan(entry.queries()[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_scan_windows_reuse_the_partitioning_of_parents(spark, no_small_joins):
    text = plan(scan_modifications(I.parents(spark, SF), LinearScorer(), I.seed_viability(spark, SF), full=True))
    # nothing is exchanged above the expansion
    above = text[: text.index("Generate")]
    assert "Exchange hashpartitioning" not in above and above.count("Window [") == 2


def test_top_n_is_limited_before_the_shuffle(spark, no_small_joins):
    ranked = rank_candidates(I.transcripts(spark, SF), LinearScorer(), I.seed_viability(spark, SF), 5)
    text = plan(ranked)
    assert text.count("WindowGroupLimit") == 2


def test_critical_screen_is_a_semi_join_of_distinct_kmers(spark, no_small_joins):
    guides = I.parents(spark, SF)
    text = plan(kmer_index.critical_guides(guides, kmer_index.build_index(I.transcriptome(spark, SF))))
    assert "LeftSemi" in text


def test_few_candidates_leave_the_transcriptome_in_place(spark):
    few = spark.createDataFrame([("A" * 21,)], "antisense string")
    text = plan(kmer_index.matching_guides(few, I.transcriptome(spark, SF)))
    assert "BroadcastHashJoin" in text


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["a1_source_profile"](spark, SF))
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "l_returnflag" in schema and "l_tax" not in schema


def test_hot_guide_keeps_every_row(spark):
    """A third of all candidates share one guide, a third of records are copies."""
    guide = "UAAGAUUUGGUGUCUAUUUCC"
    rows = [(i, guide if i % 3 == 0 else f"{'ACGU'[i % 4]}" * 21) for i in range(3000)]
    site = guide.translate(str.maketrans("AUGC", "UACG"))[::-1]
    records = [(i, "GG" + site if i % 3 == 0 else "ACGUAC" * 5) for i in range(300)]
    out = offtarget.screen(
        spark.createDataFrame(rows, "candidate_id int, antisense string"),
        spark.createDataFrame(records, "record_id int, sequence string"),
    )
    got = out.groupBy("has_critical_match").agg(F.count("*").alias("n")).collect()
    assert {r["has_critical_match"]: r["n"] for r in got} == {True: 1000, False: 2000}
    assert out.filter("antisense = '%s'" % guide).select("seed_occurrences").distinct().collect()[0][0] == 100
