"""Variants scored from the duplex they stem from, against the rules read from their strands."""

import random

from pyspark.sql import functions as F

from oligo_engine.constants import MODIFICATIONS
from oligo_engine.operators import penalties
from oligo_engine.operators.variants import as_variants, full_scan, mini_scan
from oligo_engine.plans.scan import scored_scan, with_replacement, with_stand
from oligo_engine.plans.scoring import LinearScorer

TOTALS = ["raw_score", "nuclease", "immuno", "risc", "serum"]


def _parents(spark):
    draw = random.Random(7)
    rows = [("GUUGUGUGUUGUGUCCAGUUG", "GUGUUGUGUACUGUUGUGUGU"), (None, "GUUGUACGUACGUACGUACGU"), ("GUGUACGUACGUACGUACGUA", None), ("", "ACGU"), (None, None)]
    for n in [21] * 12 + [5, 19, 20, 22, 23, 30]:
        letters = "AUGC" if n == 21 else "AUGCT" + "".join(MODIFICATIONS)
        rows.append(tuple("".join(draw.choice(letters) for _ in range(n)) for _ in "sa"))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "parent_id int, sense string, antisense string")


def _same(left, right, key):
    want = {tuple(r[c] for c in key): [r[c] for c in TOTALS] for r in right.select(*key, *TOTALS).collect()}
    got = {tuple(r[c] for c in key): [r[c] for c in TOTALS] for r in left.select(*key, *TOTALS).collect()}
    assert got == want and got


def test_scans_equal_the_rules_read_from_strands(spark):
    parents, scorer = _parents(spark).withColumn("thermo", F.lit(0.0)), LinearScorer()
    key = ["parent_id", "sense", "antisense", "mod_symbol", "mod_strand", "mod_position"]
    for full, plain in ((True, full_scan(parents)), (False, mini_scan(parents))):
        _same(scored_scan(parents, scorer, full), penalties.with_penalties(scorer.modified(plain, "raw_score")), key)


def test_a_further_replacement_equals_the_rules_read_from_strands(spark):
    parents, scorer, draw = _parents(spark).filter("sense <> ''").collect(), LinearScorer(), random.Random(8)
    rows = []
    for p in parents:
        for _ in range(60):
            pair = [p.sense, p.antisense]
            if None in pair:
                continue
            for _ in range(draw.randint(0, 9)):
                t = draw.randrange(2)
                i = draw.randrange(len(pair[t]))
                pair[t] = pair[t][:i] + draw.choice(MODIFICATIONS) + pair[t][i + 1 :]
            t = draw.randrange(2)
            i, symbol = draw.randrange(len(pair[t])), draw.choice(MODIFICATIONS)
            after = list(pair)
            after[t] = pair[t][:i] + symbol + pair[t][i + 1 :]
            rows.append((len(rows), *pair, p.sense, p.antisense, symbol, i + 1, ("sense", "antisense")[t], *after))
    names = "n int, sense string, antisense string, parent_sense string, parent_antisense string, s string, p int, t string, as string, aa string"
    before = as_variants(spark.createDataFrame(rows, names)).withColumn("thermo", F.lit(0.0))
    at, one, on_sense = F.col("p"), F.lit(1), F.col("t") == "sense"

    def there(prefix):
        return F.substr(F.when(on_sense, F.col(f"{prefix}sense")).otherwise(F.col(f"{prefix}antisense")), at, one)

    placed = with_stand(before, scorer).withColumns({"_old": there(""), "_mark": there("open_"), "_base": there("parent_")})
    after = as_variants(placed.withColumns({"sense": F.col("as"), "antisense": F.col("aa")}))
    got = with_replacement(after, scorer, F.col("s"), at, F.col("t"), F.col("_old"), F.col("_mark"), F.col("_base"))
    want = penalties.with_penalties(scorer.modified(as_variants(before.withColumns({"sense": F.col("as"), "antisense": F.col("aa")})), "raw_score"))
    _same(got, want, ["n"])
