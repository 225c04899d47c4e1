"""Benchmark decontamination against a plain search for every window in every document."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from oligo_engine.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(documents, items, window):
    """Rows of (doc_id, text) judged by looking every window up at every place."""
    wanted: dict[tuple, set] = {}
    for item, text in items:
        found = words(text)
        for i in range(max(len(found) - window, 0) + 1 if found else 0):
            wanted.setdefault(tuple(found[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in documents:
        found, hit, met = words(text), set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(found) - n + 1):
                owners = wanted.get(tuple(found[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    met |= owners
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((doc, len(found), len(hit), len(met), digest, bool(hit)))
    return sorted(out, key=str)


def judged(docs, items, window):
    return sorted((tuple(r) for r in decontamination.decontaminate(docs, items, window).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("window", [10, 3])
def test_equals_brute_force_on_the_test_tables(spark, window):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), window)
    assert judged(docs, items, window) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_equals_brute_force_on_overlapping_and_awkward_rows(spark):
    """Few words, so windows overlap, repeat and are shared; null and repeated ids."""
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice(["a", "B", "cé", "4", "d"]) + rng.choice([" ", "--", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 9]))) for i in range(12)] + [(50, None), (51, ""), (52, " .,")]
    documents = [(i if i % 7 else None, text(rng.randint(0, 40))) for i in range(90)]
    documents += [(3, documents[3][1]), (3, text(30)), (91, None), (92, ""), (93, "a " * 3000)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert judged(docs, bench, 4) == brute(documents, items, 4)
