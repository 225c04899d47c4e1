"""Whole scans in few rows: equal strands and symbols counted, variants kept in a parent's row."""

import random

import pytest
from pyspark.sql import functions as F

from oligo_engine.operators import penalties, variants
from oligo_engine.plans.scan import scan_totals

SCHEMA = "parent_id long, sense string, antisense string"


def _parents(spark):
    rng = random.Random(5)
    letters = ["AUGC"] * 20 + ["AUGCT"] * 6 + ["AUGCFMSL1"] * 6 + ["GU"] * 6 + ["A"] * 2
    rows = []
    for i, kind in enumerate(letters):
        size = 21 if i % 5 else rng.choice([1, 7, 19, 22, 23])
        rows.append((i, "".join(rng.choices(kind, k=size)), "".join(rng.choices(kind, k=rng.choice([size, 21])))))
    rows += [(100, *rows[3][1:]), (101, None, "AUGC"), (3, *rows[3][1:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("domain", ["nuclease", "immuno", "risc", "serum"])
def test_totals_equal_those_of_every_variant(spark, domain):
    parents = _parents(spark)
    rows = penalties.with_penalties(variants.full_scan(parents), [domain])
    want = rows.groupBy("mod_symbol", "mod_strand", "mod_position").agg(
        F.count(F.lit(1)).alias("n"), F.sum(domain), F.min(domain), F.max(domain)
    )
    got = scan_totals(parents, domain)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("domain", ["nuclease", "risc", "serum"])
def test_rules_meet_few_strands(spark, domain):
    """Ten times the parents bring no more rows to the rules."""
    def rows(n):
        rng = random.Random(1)
        made = [("".join(rng.choices("AUGC", k=21)), "".join(rng.choices("AUGC", k=21)), "antisense", p) for _ in range(n) for p in (1, 9, 21)]
        cells = spark.createDataFrame(made, "sense string, antisense string, mod_strand string, mod_position int")
        return penalties.cells_alike(domain, cells).count()

    assert rows(2000) <= 3 * 2 * 22 and rows(2000) - rows(200) <= 3 * 2 * 8


def test_scan_summary_keeps_variants_in_the_row(spark):
    parents = _parents(spark)
    many = spark.createDataFrame([(200, "A" * i, "U" * 20) for i in range(1, 13)] * 2, SCHEMA)
    parents = parents.unionByName(many)
    both = F.concat("sense", "antisense")
    want = variants.full_scan(parents).groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(both), F.min(both), F.max(both)
    )
    got = variants.scan_summary(parents)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
