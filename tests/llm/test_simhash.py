"""SimHash fingerprints and components against plain Python."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from oligo_engine.llm import simhash

SCHEMA = "doc_id long, text string, code long, fingerprint string, component_id long, first long, node string, a long, b long, n int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgéñAB", k=r.randint(2, 9))) for _ in range(words))


def plain(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    codes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def corpus():
    base = prose(1, 400)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one  two\tthree"), (8, "one two three"), (None, base), (None, None),
            (20, "x y z"), (21, prose(2, 30_000)), (22, "x" * 5_000_000), (23, "x" * 5_000_000)]
    for k in range(30):
        words = base.split()
        for j in range(k % 5):
            words[(37 * k + 11 * j) % len(words)] = f"changed{k}"
        rows.append((100 - k, " ".join(words)))
    return rows + [(300, base)] * 20 + [(400, prose(3, 50)), (400, base)] + [(500 + k, prose(10 + k, 5)) for k in range(40)]


def expected(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    nodes = [(i, plain(t)) for i, t in rows if i is not None]
    for (i, x), (j, y) in combinations(nodes, 2):
        if i == j or (x ^ y).bit_count() <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted([(i, f"{plain(t):016x}", None if i is None else find(i)) for i, t in rows], key=str)


def test_fingerprints_and_components_match_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "f", 2, 3, "n", 4, 5, 6) for i, t in rows], SCHEMA).repartition(3)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size, hot", [(1, 2_000), (1, 3), (2, 5), (3, 4), (3, 10_000), (5, 1)])
def test_links_of_all_lists_match_brute_force(spark, size, hot):
    """Families around few centres make lists of all lengths; no split of them loses a pair."""
    r = random.Random(size)
    codes = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = r.getrandbits(64)
        codes |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(40)}
    codes |= {r.getrandbits(64) for _ in range(100)}
    want = {tuple(sorted((x, y))) for x, y in combinations(codes, 2) if (x ^ y).bit_count() <= 3}
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.links(df, 3, size, hot).distinct().collect()}
    assert got == want and len(want) > 100


def test_position_sets_cover_every_minimum_set():
    for size in range(1, 6):
        sets = simhash.covering(size, 5)
        assert all(any(set(c) <= set(t) for c in sets) for t in combinations(range(8), 5))
    assert len(simhash.covering(2, 5)) == 4 and all({1, 4, 6} <= set(t) for t in simhash.covering(5, 5, (1, 4, 6)))


def test_shared_positional_bytes(spark):
    r = random.Random(5)
    pairs = [(0, 0), (0, -1), (-1, -1), (1 << 62, 0)]
    for _ in range(200):
        x = r.getrandbits(63)
        pairs.append((x, x ^ r.getrandbits(63) & sum(0xFF << 8 * p for p in range(8) if r.random() < 0.4) & (1 << 63) - 1))
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", simhash.shared_bytes(F.col("x"), F.col("y")).alias("n"))
    for x, y, n in df.collect():
        a, b = (x % 2**64).to_bytes(8, "big"), (y % 2**64).to_bytes(8, "big")
        assert n == sum(p == q for p, q in zip(a, b))
