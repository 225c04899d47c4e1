"""Ranked search against a plain scan of all documents, and the bounds it skips by."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from oligo_engine.llm import ranked_search as rs

DOCS = "doc_id long, text string, n long, score long, rank int, item string, item_id string, terms int, ids int"
ITEMS = "item_id long, text string, item int, doc_id long, term string"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    N, L = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if terms(t):
            asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c, n in own:
            m = 10 + (90 * n * N) // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, n, i))
        out += [(item, r, x[-1], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3, count=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "ñandú", "X1", "Über"]
    heavy = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, heavy, k=r.randint(1, 60)))) for i in range(count)]
    docs += [(1000 + i, "same Text, of all w1") for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, " -- !! "), (None, "w1 w200 alone"), (None, "w1 w200"), (5, "W7 w7 w9"), (5, "w7 w9 w9"),
             (2003, "w250 " * 200_000), (2004, "x" * 1_000_000 + " w3")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(40)]
    items += [(100, None), (101, "?!"), (102, "unseen"), (None, "w1 w200"), (103, "same text of all"), (104, "w7"), (104, "W9 w9")]
    return docs, items


@pytest.mark.parametrize("k, partitions", [(10, 3), (1, 1), (3, 6), (1000, 2)])
def test_search_matches_a_scan_of_all_documents(spark, k, partitions, monkeypatch):
    monkeypatch.setattr(rs, "SHARD_DOCS", 64)
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, 2, 3, "i", "j", 4, 5) for i, t in docs], DOCS).repartition(partitions)
    asked = spark.createDataFrame([(i, t, 1, 2, "t") for i, t in items], ITEMS)
    got = rs.ranked(df, asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(docs, items, k)


def test_blocks_of_items_and_small_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_ITEMS", 17)
    monkeypatch.setattr(rs, "SHARD_POSTINGS", 300)
    docs, items = corpus(4, 200)
    got = rs.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some, asked = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert rs.ranked(docs, items).count() == 0 and rs.ranked(docs, asked).count() == 0 and rs.ranked(some, items).count() == 0
    assert [tuple(r)[:3] for r in rs.ranked(some, asked).collect()] == [("q", 1, 1)]


def test_pair_bounds_hold_and_read_less():
    """A bound is never below what any document can still gain; pairs tighten it."""
    r = np.random.default_rng(7)
    docs, vocabulary = 4_000, 40
    share = np.linspace(0.02, 0.6, vocabulary)
    tf = r.poisson(2, (docs, vocabulary)) + 1
    has = r.random((docs, vocabulary)) < share
    has[:, 1::2] &= ~has[:, ::2]  # neighbours seldom meet: independent maxima are far too high
    sizes, lengths = has.sum(axis=1), (has * tf).sum(axis=1) + 1
    frequency = {t: int(has[:, t].sum()) for t in range(vocabulary)}
    names = [b"%02d" % t for t in range(vocabulary)]
    items = rs.Items([(0, names)], {n: t for t, n in enumerate(names)}, frequency, docs)
    shard = rs.Shard.build(lengths, sizes, np.nonzero(has)[1].astype(np.int32), tf[has].astype(np.int32), items, docs, int(lengths.sum()), 10)
    own, pairs = items.terms[0], items.pair_places[0]
    gain = np.zeros((docs, vocabulary), np.int64)
    for t in range(vocabulary):
        at = shard.docs[shard.starts[t] : shard.starts[t + 1]]
        gain[at, t] = items.weight[t] * shard.saturation[shard.starts[t] : shard.starts[t + 1]].astype(np.int64)
    by_pairs, alone = shard.bounds(own, pairs), shard.bounds(own, pairs, False)
    for i in range(len(own)):
        assert gain[:, own[i:]].sum(axis=1).max() <= by_pairs[i] <= alone[i]
    found, sums, read = shard.search(own, pairs, items.weight, 10)
    found_alone, sums_alone, read_alone = shard.search(own, pairs, items.weight, 10, False)
    best = np.sort(gain.sum(axis=1))[-10:]
    assert np.array_equal(np.sort(sums)[-10:], best) and np.array_equal(np.sort(sums_alone)[-10:], best)
    print("postings", int(has.sum()), "read with single maxima", read_alone, "with pairs", read)
    assert read < read_alone <= has.sum()
