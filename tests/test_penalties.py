"""Golden totals of published designs, rule by rule properties, and an independent
position-by-position calculation over random designs."""

import random

import pytest
from pyspark.sql import functions as F

from oligo_engine import constants as K
from oligo_engine.operators.penalties import DOMAINS, breakdown, with_adjusted, with_penalties
from oligo_engine.operators.variants import as_variants, build_designs
from oligo_engine.plans.panels import clinical_duplexes, clinical_panel, literature_designs
from oligo_engine.plans.scoring import LinearScorer

GOLDEN = {
    "unmodified": {"nuclease": 9, "risc": 11, "serum": 12},
    "lna_overhangs": {"risc": 11},
    "lna_guide_1": {"risc": 19},
    "lna_guide_10": {"risc": 14},
    "ps_terminal": {"nuclease": 4, "risc": 15},
    "ps_internal": {"nuclease": 7, "risc": 15},
    "conjugate_guide_1": {"serum": 52},
    "conjugate_sense_1": {"serum": 12},
    "conjugate_sense_1_21": {"serum": 2},
}


@pytest.fixture(scope="module")
def literature(spark):
    rows = with_penalties(build_designs(literature_designs(spark))).collect()
    return {r["parent_id"]: r for r in rows}


@pytest.mark.parametrize("design", GOLDEN)
def test_golden_totals(literature, design):
    for domain, expected in GOLDEN[design].items():
        assert literature[design][domain] == expected


def test_clinical_patterns_gain_two_risc_points(spark):
    rows = clinical_panel(clinical_duplexes(spark), LinearScorer()).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["risc_delta"] == -2
        assert r["nuclease"] <= 5 and r["serum"] <= 4


def naive(sense, guide, base_sense, base_guide):
    """Straight reading of the rule tables, one position at a time."""
    both, base = sense + guide, base_sense + base_guide
    ps = both.count("S")
    nuclease = 5 if ps == 0 else 3 if ps < 3 else 0
    if ps >= 3:
        nuclease += 2 if sum(guide[i] == "S" for i in (0, 1, 20)) < 2 else 0
        nuclease += 1 if "S" not in sense[:2] else 0
    density = sum(c in K.RIBOSE_SYMBOLS for c in both) / 42
    nuclease += 4 if density < 0.2 else 2 if density < 0.4 else 0
    immuno = 0.0
    for i in range(21):
        if base_guide[i] == guide[i] == "U" and i >= 1:
            immuno += 2 if i < 8 else 0.5
        if base_sense[i] == sense[i] == "U":
            immuno += 1
    hidden = set()
    for motif in K.PENALTY_MOTIFS:
        blocked = set(hidden)
        for i in range(42 - len(motif) + 1):
            span = range(i, i + len(motif))
            if base[i : i + len(motif)] == motif and not blocked & set(span):
                if all(both[j] == base[j] for j in span):
                    immuno += 3
                    hidden |= set(span)
    immuno += 4 if both.count("M") > 24 else 0
    risc = (5 if guide[0] != "1" else 0) + (2 if guide[0] == "S" else 0) + (8 if guide[0] == "L" else 0)
    for p in range(2, 9):
        risc += 2 if guide[p - 1] != base_guide[p - 1] and not (guide[p - 1] == "6" and p == 7) else 0
    for first, last, symbol, points, _ in K.GUIDE_POSITION_RULES:
        risc += points * guide[first - 1 : last].count(symbol)
    pyrimidines = [i for i in range(21) if base_guide[i] in "UC"]
    if pyrimidines:
        share = sum(guide[i] == "F" for i in pyrimidines) / len(pyrimidines)
        risc += 6 if share < 0.2 else 3 if share < 0.4 else 0
    risc += sum(c in K.EXOTIC_SYMBOLS for c in guide) + ("B" in guide) + ("J" in guide)
    serum = (40 if guide[0] == "4" else 0) + (4 if guide[0] in "AUCG4" else 0)
    serum += (3 if guide[20] not in "S1" else 0) + (3 if sense[0] not in "S4" else 0)
    serum += 2 if sense[20] not in "S4" else 0
    if both.count("4") == 1 and sense[0] == "4":
        serum += 3
    elif sense[0] == "4" and sense[20] == "4":
        serum -= 5
    return {
        "nuclease": min(nuclease, 20),
        "immuno": min(immuno, 28),
        "risc": min(max(risc, -10), 60),
        "serum": min(max(serum, -5), 60),
    }


def random_designs(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        letters = rng.choice(["AUGC", "GU", "GUUC"])
        parent = ["".join(rng.choice(letters) for _ in range(21)) for _ in range(2)]
        share = rng.choice([0.0, 0.1, 0.5, 0.9])
        symbols = rng.choice([K.MODIFICATIONS, ["M", "F", "S"], ["L", "E", "Y", "8", "9", "6", "4"], ["A", "U", "M"]])
        strands = ["".join(rng.choice(symbols) if rng.random() < share else c for c in s) for s in parent]
        rows.append((i, *strands, *parent))
    return rows


def test_totals_match_position_by_position_reading(spark):
    rows = random_designs(1500, 7)
    df = spark.createDataFrame(
        rows, "parent_id int, sense string, antisense string, parent_sense string, parent_antisense string"
    )
    got = {r["parent_id"]: r for r in with_penalties(as_variants(df)).collect()}
    for i, *strands in rows:
        for domain, expected in naive(*strands).items():
            assert got[i][domain] == expected, (domain, strands)


def test_breakdown_adds_up_before_clamping(spark):
    rows = random_designs(300, 11)
    df = spark.createDataFrame(
        rows, "parent_id int, sense string, antisense string, parent_sense string, parent_antisense string"
    )
    scored = with_penalties(as_variants(df)).select(*DOMAINS, breakdown().alias("b")).collect()
    bounds = {"nuclease": (None, 20), "immuno": (None, 28), "risc": (-10, 60), "thermo": (None, 20), "serum": (-5, 60)}
    for r in scored:
        for domain, (low, high) in bounds.items():
            total = min(sum(r["b"][domain]["details"].values()), high)
            assert r["b"][domain]["total"] == (total if low is None else max(total, low))


def test_adjusted_stays_in_range(spark):
    rows = random_designs(200, 3)
    df = spark.createDataFrame(
        rows, "parent_id int, sense string, antisense string, parent_sense string, parent_antisense string"
    )
    out = with_adjusted(as_variants(df).withColumn("raw", F.rand(1) * 140 - 20), "raw").collect()
    assert all(0 <= r["efficacy_score"] <= 100 for r in out)


def test_gna_and_una_at_seven_cost_less_than_methyl(spark):
    base = ("GCAGCACGACUUCUUCAAGUU", "CUUGAAGAAGUCGUGCUGCUU")
    rows = [(s, *base, "", "", s, "7") for s in ("M", "8", "6")]
    df = spark.createDataFrame(
        rows,
        "parent_id string, sense string, antisense string, sense_mods string, sense_positions string,"
        "antisense_mods string, antisense_positions string",
    )
    risc = {r["parent_id"]: r["risc"] for r in with_penalties(build_designs(df)).collect()}
    assert risc["8"] <= risc["M"] - 2
    assert risc["6"] < risc["M"]
