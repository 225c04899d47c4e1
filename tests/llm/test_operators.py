"""Corpus operators on awkward rows: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing further columns, each against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligo_engine.llm import (
    chunk_dedup,
    decontamination,
    language_id,
    minhash,
    mixing,
    neighbours,
    suffix_dedup,
    token_counts,
    toxic_text,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, score string, label int"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgéñ", k=r.randint(2, 9))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    a, b = prose(1, 150), prose(2, 150)
    near = a.split()
    near[20] = "changed"
    shared = prose(9, 90)
    return [
        (1, a), (2, a), (2, a), (3, " ".join(near)), (4, b), (5, ""), (6, None), (7, "one"), (8, "One"), (None, b),
        (9, prose(3, 40) + " " + shared + " " + prose(4, 40)), (10, prose(5, 60) + " " + shared), (11, "x" * 1500),
        (12, " \t\n "), (13, prose(6, 4000)), (14, "¡é! 123"), (15, a[:700]),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 7, "x", 1) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("group", [256, 1])
def test_suffix_dedup_matches_window_counts(docs, empty, group):
    blobs = [(i, (t or "").encode()) for i, t in texts()]
    seen: dict[bytes, int] = {}
    for _, b in blobs:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    want = []
    for i, b in blobs:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert rows_of(suffix_dedup.dedup_suffixes(docs, group=group).drop("removed")) == sorted(want, key=str)
    if group == 256:
        assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_chunk_dedup_keeps_the_first_of_every_passage(docs, empty):
    out = chunk_dedup.dedup_substrings(docs.withColumns({"n_bytes": F.lit("x"), "n_spans": F.lit(-1)}))
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == got[2]["n_bytes"] and got[2]["text"] == ""
    assert got[6]["text"] is None and got[None]["text"] == ""
    assert got[9]["n_removed"] == 0 and got[10]["n_removed"] > 250 and got[13]["n_removed"] == 0
    assert chunk_dedup.dedup_substrings(empty).count() == 0


def test_chunk_dedup_tells_rows_of_one_id_apart(spark):
    """Null ids of different lengths, one id with two texts, and equal rows."""
    shared, own = prose(31, 90), [prose(40 + k, 60 + 30 * k) for k in range(6)]
    rows = [(1, shared), (None, own[0]), (None, own[1] + " " + shared), (None, "é" * 30), (None, None), (None, ""),
            (2, own[2]), (2, shared + " " + own[3]), (3, own[4]), (3, own[4]), (3, own[4]), (None, own[5]), (None, own[5]),
            (4, "short"), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = chunk_dedup.dedup_substrings(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["n_removed"] <= r["n_bytes"] for r in out)
    left = [(r["doc_id"], r["text"]) for r in out]
    for row in [(1, shared), (None, own[0]), (None, "é" * 30), (None, None), (2, own[2])]:
        assert left.count(row) == 1
    assert left.count((3, own[4])) == 1 and left.count((3, "")) == 2
    assert left.count((None, own[5])) == 1 and left.count((None, "")) == 2 and left.count((4, "short")) == 2
    for i, text, unique in ((None, own[1] + " " + shared, own[1]), (2, shared + " " + own[3], own[3])):
        got = [r for r in out if r["doc_id"] == i and r["n_bytes"] == len(text.encode())]
        assert len(got) == 1 and got[0]["n_removed"] > 250 and unique in got[0]["text"]


def test_chunk_dedup_finds_short_passages_whole(spark):
    """Passages of 51 to 60 words, each in two documents: found, and removed to their ends."""
    rows, want = [], {}
    for k in range(120):
        passage = prose(1000 + k, 51 + k % 10)
        rows.append((k, prose(3000 + k, 40) + "<" + passage + ">" + prose(5000 + k, 40)))
        before, after = prose(7000 + k, 30) + "[", "]" + prose(9000 + k, 30)
        rows.append((1000 + k, before + passage + after))
        want[1000 + k] = (before + after, len(passage.encode()))
    out = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k]["n_removed"] == 0 for k in range(120))
    found = [i for i in want if out[i]["n_removed"]]
    removed = sum(out[i]["n_removed"] for i in want) / sum(n for _, n in want.values())
    print(f"recall of passages of 51 to 60 words: {len(found)} of {len(want)}, {removed:.4f} of their bytes")
    assert len(found) >= 0.99 * len(want) and all((out[i]["text"], out[i]["n_removed"]) == want[i] for i in found)


def test_chunk_dedup_extends_far_and_to_whole_characters(spark, monkeypatch):
    """Ends are compared again while all bytes are equal; a character that differs in its last byte stays whole."""
    monkeypatch.setattr(chunk_dedup, "cuts", lambda text: [60, len(text)] if len(text) > 1500 else [len(text)])
    shared = prose(60, 300)[:1500]
    rows = [(1, "A" * 60 + "x" + "é" + shared + "é" + "y" * 9), (2, "B" * 60 + "z" + "è" + shared + "è" + "w" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in chunk_dedup.dedup_substrings(docs).collect())  # no chunk is shared: no seed
    head = prose(62, 5)[:20]
    monkeypatch.setattr(chunk_dedup, "cuts", lambda text: [a for a in (62, 82) if a < len(text)] + [len(text)])
    rows = [(i, c * 61 + e + head + shared + tail) for i, c, e, tail in ((1, "A", "1", "é"), (2, "B", "2", "è"))]
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == "B" * 61 + "2è"


def test_chunks_find_their_places_again_after_an_insertion():
    text = prose(21, 400).encode()
    moved = b"inserted words " + text

    def pieces(b):
        stops = chunk_dedup.cuts(np.frombuffer(b, np.uint8))
        assert stops[-1] == len(b)
        return {b[a:z] for a, z in zip([0, *stops], stops)}

    assert len(pieces(text) & pieces(moved)) > 0.8 * len(pieces(text))


def test_near_duplicates_match_all_pairs(docs, empty):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} - {()}
    known = sorted(i for i in sets if i is not None)
    root = {i: i for i in known}
    for _ in known:
        for a in known:
            for b in known:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    want = [(i, len(sets[i]), root.get(i), i is None or root[i] == i) for i, _ in texts()]
    assert rows_of(minhash.near_duplicates(docs, words=2)) == sorted(want, key=str)
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_permutation_is_a_bijection():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.permuted(x.copy()))) == len(x)


def test_decontamination(spark, docs, empty):
    items = [(1, prose(1, 150)[:200]), (2, "ONE"), (3, None), (4, "nowhere to be found at all"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert got[7]["n_hit"] == got[8]["n_hit"] == 1 and got[8]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    assert got[1]["n_items"] == 1 and got[1]["contaminated"] and not got[4]["contaminated"]
    assert got[6]["n_words"] == 0 and got[6]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox and a red hen"), (2, "red a b c d e fox")], "doc_id long, text string")
    index = decontamination.postings(docs, spark.createDataFrame([("red",), ("fox",)], "term string"))
    pairs = spark.createDataFrame([("red", "fox")], "left string, right string")
    assert rows_of(decontamination.proximity_matches(index, pairs, 3)) == [("red", "fox", 1, 0, 1), ("red", "fox", 1, 4, 1)]


def test_token_counts(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache_size=50, table_size=20)
    assert rows_of(got.drop("over_limit")) == sorted(want, key=str)
    assert token_counts.token_counts(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_toxicity_folds_and_learns(spark, docs, empty):
    table = toxic_text.Fold()
    assert toxic_text.folded("Idıot 1d10t іdіоt stup!d", table).split() == ["idiot", "idiot", "idiot", "stupid"]
    x = toxic_text.features(iter(["you idiot", "the trash can", "fine", None]), {" idiot ": 4.0, " trash ": 4.0}, ("trash can",))
    assert x[0, 0] > 0 and not x[1:].any()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = spark.createDataFrame([(i, prose(i, 30) + (" zarkling" if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxic_text.toxicity(rows, labels).collect()}
    assert got == {i: i % 2 for i in range(60)}
    judged = toxic_text.toxicity(docs, labels)
    assert judged.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in judged.collect()) and judged.count() == len(texts())
    assert toxic_text.toxicity(empty, labels.limit(0)).count() == 0


def test_mixing_meets_its_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    total: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        total.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= len(v) for (_, t), v in total.items()) and len(rows) == len(texts())
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(5)))
    assert mixing.mix(empty).count() == 0


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    page = "<html>" + "payload " * 40
    pages = [(3, "u\r\nx", page), (1, None, page), (2, "u", "short"), (4, "u", "short"), (None, "u", page), (5, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived(df).collect()}
    n = len(page)
    assert got == {(1, "response", None, n), (3, "revisit", 1, n), (None, "revisit", 1, n), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0)}
    assert warc.archived(df.limit(0)).count() == 0
    warc.register(spark)
    warc.with_revisits(df).write.format("warc").mode("append").save(str(tmp_path / "w"))
    read = spark.read.format("warc").load(str(tmp_path / "w")).filter("record_type = 'response' AND page_id = '1'")
    assert [bytes(r["payload"]).decode() for r in read.collect()] == [page]


def test_warc_ids_of_any_text_come_back(spark):
    ids = ["b\r\nX-Payload-Length: 7", " a ", "a", "", "%41", "é\n", None]
    page = "<html>" + "payload " * 40
    df = spark.createDataFrame([(i, "u", page, "x") for i in ids], "page_id string, url string, html string, payload_bytes string")
    got = warc.archived(df).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == sorted(map(str, ids))
    assert all(r["payload_bytes"] == len(page) and r["refers_to"] == (None if r["page_id"] == "" else "") for r in got)


def test_warc_length_and_digest_are_those_of_the_stored_payload(spark, tmp_path):
    """One byte of a stored payload is changed: the row changes with it, whatever the headers say."""
    page = "payload " * 40
    digest = hashlib.sha256(page.encode()).hexdigest()
    rows = [(1, "response", None), (2, "revisit", 1)]
    archive = b"".join(
        warc.record({"page_id": i, "url": "u", "payload": page, "payload_digest": digest, "record_type": kind, "refers_to": first})
        for i, kind, first in rows
    )
    at = archive.index(b"payload payload")
    warc.register(spark)
    for name, stored, want in (("whole", archive, page), ("changed", archive[:at] + b"q" + archive[at + 1 :], "q" + page[1:])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(stored)
        got = {r["page_id"]: r for r in warc.read_back(spark, str(tmp_path / name), "long").collect()}
        assert got[1]["payload_digest"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["payload_bytes"] == len(want)
        assert got[2]["payload_digest"] == digest and got[2]["payload_bytes"] == len(page) and got[2]["refers_to"] == 1


@pytest.mark.parametrize("payload", [True, False])
def test_warc_inflates_little_by_little(payload):
    """Payloads that shrink a thousandfold, between small ones, with and without ``sl``."""
    import gzip
    import io

    pages = ["a", "b" * 3_000_000, "", "c" * 100_000, "d"]
    made = [warc.record({"page_id": k, "url": "u", "payload": p, "payload_digest": "d", "record_type": "response", "refers_to": None}) for k, p in enumerate(pages)]
    for packed in (b"".join(warc.member(m, 9) for m in made), b"".join(gzip.compress(m) for m in made), b"".join(made)):
        found = list(warc.records(io.BytesIO(packed), len(packed), lambda f: True, payload))
        assert [f["page_id"] for f in found] == ["0", "1", "2", "3", "4"]
        assert not payload or [f["payload"].decode() for f in found] == pages


def test_warc_reads_plain_and_foreign_gzip_members():
    import gzip
    import io

    one = warc.record({"page_id": 1, "url": "u", "payload": "p" * 9000, "payload_digest": "d", "record_type": "response", "refers_to": None})
    for packed in (one + one, gzip.compress(one) + gzip.compress(one)):
        found = list(warc.records(io.BytesIO(packed), len(packed), lambda f: True, True))
        assert [f["payload"] for f in found] == [b"p" * 9000] * 2


def test_nearest_neighbours(spark):
    source = np.random.default_rng(1)
    centres = source.standard_normal((20, 16))
    vectors = [(i, (centres[i % 20] + 0.1 * source.standard_normal(16)).astype(np.float32).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[0][1]) for i in range(40)]
    odd = [(700, None), (701, [0.0] * 16), (702, [float("nan")] + [1.0] * 15), (703, [None] + [1.0] * 15), (704, [1.0]), (None, vectors[3][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    x = np.array([v for _, v in vectors], dtype=np.float32).astype(float)
    ids = np.array([i for i, _ in vectors])
    unit, hits, n = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0
    for q in [i for i in ids.tolist() if i % 50 == 0]:
        near = np.round(unit @ unit[q], 12)
        near[q] = -9
        want = ids[np.lexsort((ids, -near))[:5]].tolist()
        mine = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        hits, n = hits + len(set(want) & set(mine)), n + 5
    assert hits / n >= 0.9 and len(found) == n
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def exact_neighbours(vectors, queries, k):
    """Brute force over finite vectors that are not zero, each length among its own."""
    want = {}
    for q, asked in vectors:
        if q in queries and len(asked) > 0 and any(asked):
            near = []
            for i, other in vectors:
                if i != q and len(other) == len(asked) and any(other):
                    a, b = (np.array(v) / max(map(abs, v)) for v in (asked, other))
                    near.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i))
            want[q] = [i for _, i in sorted(near)[:k]]
    return {q: ids for q, ids in want.items() if ids}


@pytest.mark.parametrize("distinct", [1, 2, 4, 6, 10])
def test_neighbours_of_few_different_vectors_are_complete(spark, distinct):
    source = np.random.default_rng(distinct)
    shapes = source.standard_normal((distinct, 8)).tolist()
    vectors = [(i, shapes[(i * i) % distinct]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact_neighbours(vectors, {0, 20, 40}, 5)


def test_neighbours_of_extreme_and_unlike_vectors(spark, monkeypatch):
    """Components whose squares leave the range of doubles, two lengths, several parts of queries."""
    monkeypatch.setattr(neighbours, "ASKED", 3)
    source = np.random.default_rng(5)
    shapes = source.standard_normal((40, 8))
    vectors = [(i, (shapes[i] * (1e-200, 1e200, 1.0, 5e-310)[i % 4]).tolist()) for i in range(40)]
    vectors += [(100 + i, source.standard_normal(3).tolist()) for i in range(7)] + [(200, [0.0] * 8), (201, []), (202, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 2 == 0, visit=4).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    tiny = {i for i in range(40) if i % 4 == 3}  # subnormal: few digits, told apart by them alone
    assert got == exact_neighbours(vectors, {i for i, _ in vectors if i % 2 == 0}, 5) and tiny & set(sum(got.values(), []))


def test_language_id(docs, spark, empty):
    rows = [(i, ("the and of to in is " if i % 2 else "der und die das ist zu ") * (3 + i % 7), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "123 ...", "en"), (102, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows[:80])
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en"
    assert language_id.identify(empty).count() == 0


def test_gradients_through_time():
    source = np.random.default_rng(3)
    windows, real = source.integers(0, 256, (4, 6)), np.ones((4, 6), bool)
    real[1, 4:] = False
    labels = np.array([0, 1, 2, 0])
    net = {k: v.astype(np.float64) for k, v in language_id.new_network(3, 4, 1).items()}
    _, grads = language_id.gradients(net, windows, real, labels)
    for name, place in (("uf", (2, 1)), ("ub", (9, 3)), ("xf", (5, int(windows[0, 2]))), ("out", (1, 6)), ("bias", (2, 0))):
        up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        up[name][place] += 1e-2
        down[name][place] -= 1e-2
        slope = (language_id.gradients(up, windows, real, labels)[0] - language_id.gradients(down, windows, real, labels)[0]) / 2e-2
        assert abs(slope - grads[name][place]) < 2e-3
