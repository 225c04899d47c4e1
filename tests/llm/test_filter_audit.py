"""The audit of filter orders against a plain walk over all documents and orders."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from oligo_engine.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, kept long, n long, good int, toxic int, orders int"
LABELS = "doc_id long, quality int, toxic int, part string, good int"


def corpus():
    long = " ".join(f"word{i}" for i in range(220))
    texts = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, None, "en"), (4, "", None), (5, "short # text", ""),
        (6, "a " * 250, "fr"), (7, "A B C " * 90, "fr"), (None, long, "en"), (None, long, "fr"), (8, long.upper(), "en"),
        (9, " \t\n\x0b\x0c\r ", None), (10, "é" * 300 + " ABCDEFGHI", "fr"), (11, long + " 50%", "en"),
        (12, "x" * 1_000_000 + " " + long, "de"), (13, "    one", "de"), (14, long, "fr"), (15, "short # text", "de"),
    ]
    return [(i, t, lang, "p", 1, "d", 5, 6, 7, 8, 9) for i, t, lang in texts]


def expected(docs, labels):
    marks: dict = {}
    for i, q, t, *_ in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q == 1), max(old[1], t == 1))
    first: dict = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, *marks.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c = [0] * 6
                for _, fails, good, toxic in (r for r in rows if r[0] == part):
                    gone, hit = bool(fails & set(order[: step - 1])), f in fails
                    c[0] += not gone and not hit
                    c[1] += hit and not gone
                    c[2] += hit and gone
                    c[3] += fails == {f}
                    c[4] += (hit and not gone) * good
                    c[5] += (hit and not gone) * toxic
                out[part, "".join(order), step] = c
                shapley[f] += c[1]
        for (p, order, step), c in out.items():
            if p == part:
                c.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LABEL_ROWS = [(1, 1, 0, "", 3), (2, 0, 1, "", 3), (2, 1, None, "", 3), (None, 1, 1, "", 3), (6, 1, 1, "", 3), (14, None, None, "", 3), (99, 1, 1, "", 3)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_audit_matches_a_walk_over_all_orders(spark, partitions):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(partitions)
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    want = expected(corpus(), LABEL_ROWS)
    assert len(got) == 600 * len({k[0] for k in want}) and got == want


def test_audit_of_equal_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    same = [(i, "one text", "en", "p", 1, "d", 5, 6, 7, 8, 9) for i in range(500)]
    got = filter_audit.audit(spark.createDataFrame(same, SCHEMA), labels)
    rows = {(r["filter_order"], r["step"]): r for r in got.collect()}
    assert rows["EABCD", 1]["removed"] == 499 and rows["EABCD", 1]["kept"] == 1 and rows["EABCD", 2]["removed"] == 1
    assert rows["ABCDE", 5]["redundant"] == 499 and rows["ABCDE", 1]["unique_fails"] == 1


def test_limits_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en"), (2, "A A A A", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels, min_words=2, capital_percent=99).collect()}
    assert got["ABCDE", 1]["kept"] == 2 and got["ABCDE", 2]["removed"] == 1 and got["ABCDE", 3]["removed"] == 0
