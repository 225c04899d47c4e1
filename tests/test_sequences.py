"""Sequence expressions and generators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from oligo_engine.functions import sequence as seq
from oligo_engine.operators import tiling
from oligo_engine.operators.curation import clean_transcripts

COMPLEMENT = str.maketrans("AUGC", "UACG")


def revcomp(s):
    return s.translate(COMPLEMENT)[::-1]


def palindrome(s, stem=4):
    return any(revcomp(s[i : i + stem]) in s[i + stem :] for i in range(len(s) - 2 * stem + 1))


def strands(n, seed, lengths):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(["AUGC", "GC", "AU", "A"])) for _ in range(rng.choice(lengths))) for _ in range(n)]


def test_scalars_match_python(spark):
    rows = strands(400, 1, [0, 1, 4, 7, 8, 9, 19, 21, 25, 40])
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    s = F.col("s")
    out = df.select(
        "s",
        seq.reverse_complement(s).alias("rc"),
        seq.reverse_complement(seq.reverse_complement(s)).alias("twice"),
        seq.gc_percent(s).alias("gc"),
        seq.has_palindrome(s).alias("pal"),
        seq.has_homopolymer(s).alias("homo"),
        seq.has_gc_run(s).alias("run"),
        seq.pad_to_strand(s).alias("pad"),
    ).collect()
    for r in out:
        text = r["s"]
        assert r["rc"] == revcomp(text) and r["twice"] == text
        assert r["gc"] == (100.0 * 0 if not text else (text.count("G") + text.count("C")) / len(text) * 100.0)
        assert r["pal"] == palindrome(text)
        assert r["homo"] == any(b * 5 in text for b in "AUGC")
        assert r["run"] == any(all(c in "GC" for c in text[i : i + 6]) for i in range(len(text) - 5))
        assert r["pad"] == text[:21].ljust(21, "A")


def test_tile_count_and_order(spark):
    df = spark.createDataFrame([("a", "A" * 100), ("b", "AUGC" * 8), ("short", "AUG")], "transcript_id string, sequence string")
    rows = tiling.tile(df).collect()
    assert sum(r["transcript_id"] == "a" for r in rows) == 80
    for r in rows:
        if r["transcript_id"] == "b":
            assert r["sense"] == ("AUGC" * 8)[r["position"] : r["position"] + 21]
            assert r["antisense"] == revcomp(r["sense"])
    assert not any(r["transcript_id"] == "short" for r in rows)


def test_windows_cover_long_records_once(spark):
    rng = random.Random(5)
    sizes = [5, 6, 7, tiling.PIECE, tiling.PIECE + 5, tiling.PIECE + 6, 2 * tiling.PIECE + 5, 2 * tiling.PIECE + 7, 9001]
    texts = {n: "".join(rng.choice("ACGU") for _ in range(n)) for n in sizes}
    df = spark.createDataFrame(list(texts.items()), "id int, s string")
    got = {}
    for r in tiling.windows(df, "s", 7, "w").collect():
        got.setdefault(r["id"], []).append((r["position"], r["w"]))
    for n, text in texts.items():
        assert sorted(got.get(n, [])) == [(i, text[i : i + 7]) for i in range(n - 6)]


def test_dicer_length_limits(spark):
    df = spark.createDataFrame([(n, "AUGCU" * 7) for n in range(20, 36)], "transcript_id int, sequence string")
    cut = df.withColumn("sequence", F.substr("sequence", F.lit(1), F.col("transcript_id")))
    rows = {r["transcript_id"]: r for r in tiling.dicer_product(cut).collect()}
    assert sorted(rows) == list(range(25, 31))
    assert rows[27]["sense"] == ("AUGCU" * 7)[6:27] and rows[27]["position"] == 0


def test_strict_cleaning(spark):
    df = spark.createDataFrame(
        [("a", "ATGCATGCATGCATGCATGCA"), ("b", "AUGCAU"), ("c", "AUGCAUGCAUGCAUGCAUGCAX"), ("d", "  "), ("e", None)],
        "transcript_id string, sequence string",
    )
    rows = {r["transcript_id"]: r for r in clean_transcripts(df).collect()}
    assert rows["a"]["sequence"] == "AUGCAUGCAUGCAUGCAUGCA" and rows["a"]["reason"] is None
    assert rows["b"]["reason"] == "shorter than 21 nt"
    assert rows["c"]["reason"] == "unexpected characters"
    assert rows["d"]["reason"] == rows["e"]["reason"] == "empty input"
