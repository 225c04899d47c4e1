"""Beam search against a plain Python search, and properties of its output."""

import pytest
from pyspark.sql import functions as F
from test_penalties import naive
from test_sequences import palindrome, revcomp

from oligo_engine import constants as K
from oligo_engine.operators import ordering
from oligo_engine.plans import beam
from oligo_engine.plans.scan import scan_modifications
from oligo_engine.plans.scoring import LinearScorer

PARENTS = [
    ("p1", "GCAGCACGACUUCUUCAAGUU"), ("p2", "CGUACGCGGAAUACUUCGAUU"), ("copy", "GCAGCACGACUUCUUCAAGUU"),
    ("p3", "AAUAUUAGAUUUAUAAUUGUA"),
]


def thermo(sense, guide):
    gc = (sense.count("G") + sense.count("C")) / 21 * 100
    total = 8 if gc < 30 or gc > 65 else 3 if gc < 35 or gc > 55 else 0
    total += 5 if palindrome(sense) else 0
    total += 5 if any(b * 5 in sense for b in "AUGC") else 0
    total += 4 if guide[0] not in "AU" else 0
    total += 3 if sense[18] not in "GC" else 0
    total += 3 if any(all(c in "GC" for c in sense[i : i + 6]) for i in range(16)) else 0
    return min(total, 20)


def raw_score(sense, guide, parent_guide):
    weights = {"M": 1.5, "F": 2.0, "S": 1.0, "L": -2.25, "D": 0.75, "E": -0.5}
    raw = 88.0 + sum(parent_guide.count(c) for c in "AU") + sum(w * guide.count(c) for c, w in weights.items())
    raw += sense.count("S") + 0.75 * sense.count("M") + 0.5 * sense.count("F")
    return raw + (3.0 if guide[0] == "1" else 0.0)


def adjusted(norm, sense, guide, ps, pg):
    penalty = sum(naive(sense, guide, ps, pg).values()) + thermo(ps, pg)
    return max(0.0, min(100.0, norm - 0.7 * penalty))


def rescale(values):
    top = max(values)
    return [v / top * 100.0 if top > 100 else max(0.0, min(100.0, v)) for v in values]


def search(ps, pg, max_mods, width):
    """Literal search over dict rows; returns ranked (score, guide, symbols)."""
    singles = []
    for symbol in K.MINI_SCAN_SYMBOLS:
        for pos in range(1, 11):
            guide = pg[: pos - 1] + symbol + pg[pos:]
            singles.append({"guide": guide, "sig": f"{symbol}|{pos}|antisense|", "symbol": symbol, "pos": pos, "symbols": symbol})
    for row, norm in zip(singles, rescale([raw_score(ps, r["guide"], pg) for r in singles])):
        row["score"] = adjusted(norm, ps, row["guide"], ps, pg)
    groups = {}
    for row in sorted(singles, key=lambda r: (-r["score"], r["pos"])):
        groups.setdefault(row["symbol"], []).append(row)
    first = []
    for turn in range(10):
        first += [groups[s][turn] for s in sorted(groups)]
    first = [dict(r) for r in first[:width]]
    pool = sorted(singles, key=lambda r: (-r["score"], r["pos"], r["symbol"]))[: 2 * width]

    def scored(rows):
        for row, norm in zip(rows, rescale([raw_score(ps, r["guide"], pg) for r in rows]) if rows else []):
            row["score"] = round(adjusted(norm, ps, row["guide"], ps, pg), 2)
        return sorted(rows, key=lambda r: -r["score"])  # stable

    current = scored(first)
    everything, history = list(current), [current[0]["score"]]
    for number in range(2, max_mods + 1):
        best = current[0]["score"] if current else 0.0
        if number >= 4 and best - history[-3] < K.PLATEAU_GAIN:
            break
        history.append(best)
        seen, fresh = set(), []
        for base in current:
            for extra in pool:
                pair = tuple(sorted([base["sig"], extra["sig"]]))
                if pair in seen:
                    continue
                seen.add(pair)
                if base["guide"][extra["pos"] - 1] != pg[extra["pos"] - 1]:
                    continue
                places = [i for i in range(21) if base["guide"][i] != pg[i]]
                guide = base["guide"][: extra["pos"] - 1] + extra["symbol"] + base["guide"][extra["pos"] :]
                if any(all(c in "LYE" for c in guide[i : i + 3]) for i in range(19)):
                    continue
                symbols = "+".join([base["guide"][i] for i in places] + [extra["symbol"]])
                positions = [i + 1 for i in places] + [extra["pos"]]
                strands = "+".join(["antisense"] * len(positions))
                sig = f"{symbols}|{positions[0]}|{strands}|{','.join(map(str, positions))}"
                fresh.append({"guide": guide, "sig": sig, "symbols": symbols})
        fresh = scored(fresh)
        everything += fresh
        current = fresh[:width]
    unique = {}
    for row in everything:
        if row["guide"] not in unique or row["score"] > unique[row["guide"]]["score"]:
            unique[row["guide"]] = row
    return sorted(unique.values(), key=lambda r: -r["score"])


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([(n, s, revcomp(s)) for n, s in PARENTS], "parent_id string, sense string, antisense string")


@pytest.mark.parametrize("max_mods,width", [(2, 6), (5, 5), (7, 8)])
def test_matches_plain_search(parents, max_mods, width):
    found = beam.beam_search(parents, LinearScorer(), max_mods, width).collect()
    for name, sense in PARENTS:
        got = [(r["efficacy_score"], r["antisense"], r["mod_symbol"]) for r in sorted(found, key=lambda r: r["rank"]) if r["parent_id"] == name]
        want = [(r["score"], r["guide"], r["symbols"]) for r in search(sense, revcomp(sense), max_mods, width)]
        assert [g[0] for g in got] == pytest.approx([w[0] for w in want], abs=1e-9)
        assert got == [(pytest.approx(w[0], abs=1e-9), *w[1:]) for w in want]


def test_output_is_unique_and_viable(parents):
    found = beam.beam_search(parents, LinearScorer(), 3, 5, full=True)
    assert found.groupBy("parent_id", "sense", "antisense").count().filter("count > 1").count() == 0
    assert found.filter(F.col("sense").rlike("[LYE]{3}") | F.col("antisense").rlike("[LYE]{3}")).count() == 0


def test_no_table_is_left_after_a_search(spark, parents, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "checkpoint_root", lambda _: str(tmp_path))
    with ordering.Tables(spark):
        found = beam.beam_search(parents, LinearScorer(), 3, 5)
        beam.top_designs(found, 10).write.parquet(str(tmp_path / "result"))
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10 * len(PARENTS)
    assert not list((tmp_path / "oligo").iterdir())


def test_seed_design_takes_the_first_place(spark, parents):
    sense = PARENTS[1][1]
    guide = revcomp(sense)
    seed = spark.createDataFrame(
        [(sense, guide, sense, "1S" + guide[2:], "1+S", 1, "1,2", "antisense+antisense")],
        "parent_sense string, parent_antisense string, sense string, antisense string, mod_symbol string,"
        "mod_position int, mod_positions string, mod_strand string",
    )
    found = beam.beam_search(parents, LinearScorer(), 2, 5, seed_designs=seed)
    mine = found.filter("parent_id = 'p2'")
    assert mine.filter(F.col("antisense") == "1S" + guide[2:]).count() == 1
    assert mine.filter(F.col("mod_symbol").startswith("1+S+")).count() > 0
    # four singles remain beside the seed
    assert mine.filter("round = 1").count() == 5


def test_bounds_are_checked(parents):
    with pytest.raises(ValueError):
        beam.beam_search(parents, LinearScorer(), 1, 20)
    with pytest.raises(ValueError):
        beam.beam_search(parents, LinearScorer(), 3, 200)


def test_full_scan_has_1260_distinct_variants(spark, parents):
    seeds = spark.createDataFrame([("AAGAAG", 40.0)], "seed string, viability double")
    scan = scan_modifications(parents, LinearScorer(), seeds, full=True, details=True)
    counts = scan.groupBy("parent_id").agg(F.count("*").alias("n"), F.countDistinct("sense", "antisense").alias("d"))
    assert {(r["n"], r["d"]) for r in counts.collect()} == {(1260, 1260)}
    differing = F.size(
        F.filter(F.sequence(F.lit(1), F.lit(42)), lambda i: F.substr(F.concat("sense", "antisense"), i, F.lit(1)) != F.substr(F.concat("parent_sense", "parent_antisense"), i, F.lit(1)))
    )
    assert scan.filter(differing != 1).count() == 0
    totals = F.col("biophysics.nuclease.total") + F.col("biophysics.risc.total")
    assert scan.filter(totals != F.col("nuclease") + F.col("risc")).count() == 0
    mini = scan_modifications(parents, LinearScorer(), seeds)
    assert mini.count() == 4 * 40


def test_given_singles_count_with_their_better_row_in_any_order(spark):
    """Parents of one duplex bring the same single with two scores."""
    parents = spark.createDataFrame([(i, s, revcomp(s)) for i, s in PARENTS], "parent_id string, sense string, antisense string")
    scan = scan_modifications(parents, LinearScorer(), spark.createDataFrame([], "seed string, viability double"))
    singles = scan.select("parent_id", *beam.PARENT, "sense", "antisense", *[c for c in beam.TRACK if c in scan.columns and c not in ("sense", "antisense")], "efficacy_score").persist()
    worse = singles.withColumn("efficacy_score", F.col("efficacy_score") / 2)
    found = []
    for rows in (singles.unionByName(worse), worse.unionByName(singles), singles):
        out = beam.beam_search(parents, LinearScorer(), max_mods=2, beam_width=5, singles=rows)
        found.append(sorted((r["parent_id"], r["sense"], r["antisense"], r["efficacy_score"], r["rank"]) for r in out.collect()))
    singles.unpersist()
    assert found[0] == found[1] == found[2] and found[0]
