"""Stored k-mer index and records of any length against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from oligo_engine.operators import kmer_index, offtarget, tiling
from oligo_engine.sources import long_fasta

COMPLEMENT = str.maketrans("AUGC", "UACG")


def revcomp(s):
    return s.upper().translate(COMPLEMENT)[::-1]


def seed_counts(texts):
    hexamers = {t[i : i + 6] for t in texts for i in range(len(t) - 5)}
    return {h: sum(t.count(h) for t in texts) for h in hexamers if set(h) <= set("ACGU")}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = ["".join(rng.choice(rng.choice(["ACGU", "AU", "A", "GC", "ACGN"])) for _ in range(rng.choice([1, 5, 14, 15, 60, 2047, 2048, 2049, 2068, 2070, 6000]))) for _ in range(60)]
    out += ["A" * 9001, "AU" * 4100, "GCA" * 3000 + "ACGUN" * 900, ("AAUAA" * 7 + "GC") * 600]
    return out


def write_fasta(folder, name, texts, widths, end="\n"):
    rng = random.Random(1)
    lines = []
    for i, t in enumerate(texts):
        lines.append(f">r{i} > x ")
        at = 0
        while at < len(t):
            n = rng.choice(widths)
            lines += [(t[at : at + n].lower() if i % 2 else t[at : at + n].replace("U", "T")) + rng.choice(["", " ", "\t"])] + [""] * (rng.random() < 0.05)
            at += n
    (folder / name).write_bytes(end.join(lines).encode())


@pytest.mark.parametrize("widths, end, block", [([70], "\n", 60_000), ([1, 3, 60], "\r\n", 40_000), ([100_000], "\n", 128 << 20)])
def test_long_records_come_in_pieces_of_lines(spark, tmp_path, texts, widths, end, block):
    long = ["".join(random.Random(8).choices("ACGU", k=300_000))]
    for name, part in (("a.fa", texts[:30]), ("b.fa", texts[30:] + long)):
        write_fasta(tmp_path, name, part, widths, end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        pieces = long_fasta.read_pieces(spark, str(tmp_path))
        rows = pieces.withColumn("name", F.col("header")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(len(r["piece"]) for r in rows) <= tiling.PIECE + tiling.HALO
    found = {}
    for r in rows:
        found.setdefault((r["record_no"], r["header"]), {})[r["start"]] = r["piece"]
    got = []
    for (_, header), parts in found.items():
        whole = "".join(parts[s][: tiling.PIECE] for s in sorted(parts))
        assert all(p == whole[s : s + tiling.PIECE + tiling.HALO] for s, p in parts.items())
        got.append((header, whole))
    want = [(f"r{i} > x", t) for part in (texts[:30], texts[30:] + long) for i, t in enumerate(part)]
    assert sorted(got) == sorted(want)


def test_headers_carry_over_blocks_and_files(spark, tmp_path):
    """One text in several files: a record goes on where no header stands; bases before any
    header are a record without one; empty and header-only files change nothing."""
    for name, text in (("p0", "ACGU\nAC\n"), ("p1", ">a\nAAAA"), ("p2", "CCCC\nC\n"), ("p3", ""), ("p4", "GG\n>empty\n>b\nUU\n"), ("p5", "\n\nU\n")):
        (tmp_path / name).write_text(text)
    rows = long_fasta.read_lines(spark, str(tmp_path), one_stream=True).collect()
    assert sorted((r["header"] or "", r["start"], r["bases"]) for r in rows) == [
        ("", 0, "ACGU"), ("", 4, "AC"), ("a", 0, "AAAA"), ("a", 4, "CCCC"), ("a", 8, "C"), ("a", 9, "GG"), ("b", 0, "UU"), ("b", 2, "U"),
    ]
    alone = long_fasta.read_lines(spark, str(tmp_path)).collect()
    assert sorted((r["header"] or "", r["start"], r["bases"]) for r in alone if r["header"]) == [("a", 0, "AAAA"), ("b", 0, "UU")]
    assert len({r["record_no"] for r in alone}) == 6


@pytest.mark.parametrize("k", [6, 15, 21])
def test_index_of_strings_and_of_pieces_holds_every_kmer_once(spark, tmp_path, texts, k):
    records = spark.createDataFrame([(i, t.lower() if i % 2 else t) for i, t in enumerate(texts)], "record_id int, sequence string")
    write_fasta(tmp_path, "a.fa", texts, [60])
    stored = kmer_index.build_index(records, k, path=f"{tmp_path}/index")
    from_lines = kmer_index.build_index(long_fasta.read_pieces(spark, f"{tmp_path}/a.fa"), k, key="record_no")
    digits = {"A": 0, "C": 1, "G": 2, "U": 3}
    windows = {t[i : i + k] for t in texts for i in range(len(t) - k + 1)}
    want = sorted((sum(digits[c] * 4 ** (k - 1 - j) for j, c in enumerate(w)), None) if set(w) <= set("ACGU") else (-1, w) for w in windows)
    for index in (stored, from_lines, kmer_index.open_index(spark, f"{tmp_path}/index")):
        got = [(max(r["code"], -1), r["letters"]) for r in index.kmers.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert {r["site"]: r["seed_occurrences"] for r in index.seeds.collect()} == seed_counts(texts)


def test_stored_index_serves_candidate_sets_without_moving(spark, tmp_path, texts):
    rng = random.Random(9)
    records = spark.createDataFrame(list(enumerate(texts)), "record_id int, sequence string")
    kmer_index.build_index(records, path=f"{tmp_path}/index")
    index = kmer_index.open_index(spark, f"{tmp_path}/index")
    guides = [revcomp(t[i : i + 21]) for t in texts if len(t) >= 60 for i in [rng.randrange(len(t) - 21)]]
    guides = [g if rng.random() < 0.5 else "".join(rng.sample(g, 21)) for g in guides] + ["NNNNNACGU" * 2 + "AAA", "ACG", ""]
    for part in (guides[::2], guides[1::2]):
        candidates = spark.createDataFrame([(i, g) for i, g in enumerate(part)], "id int, antisense string")
        rows = offtarget.screen(candidates, index=index).collect()
        assert len(rows) == len(part)
        for r in rows:
            site = revcomp(r["antisense"])
            assert r["has_critical_match"] == any(site[i : i + 15] in t for i in range(len(site) - 14) for t in texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kmer_index.critical_guides(candidates, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = plan[plan.index("LeftSemi") :]
    right = scan[scan.index("FileScan parquet spark_catalog") - 400 :]
    assert "Bucketed: true" in scan and "Exchange" not in right.split("FileScan parquet spark_catalog")[0].split("\n")[-2]
    with pytest.raises(ValueError):
        offtarget.screen(candidates, index=index, exclude_record_ids=records.select("record_id"))


def test_the_transcriptome_is_read_once(spark, texts):
    """Pieces are written once; k-mers, seed counts and corrections come from those."""
    seen = spark.sparkContext.accumulator(0)
    schema = "record_id int, sequence string"

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    records = spark.createDataFrame(list(enumerate(texts)), schema).mapInArrow(passing, schema)
    index = kmer_index.build_index(records, exclude=spark.createDataFrame([(0,)], "record_id int"))
    candidates = spark.createDataFrame([("A" * 21,)], "antisense string")
    assert offtarget.screen(candidates, index=index).count() == 1 and index.seeds.count() > 0
    assert seen.value == len(texts)


@pytest.mark.parametrize("k", [6, 12, 13, 14, 15, 16, 17, 19, 21])
def test_bits_of_the_index_tell_every_guide(spark, k):
    """Words and blocks of bits against plain search: windows at every offset, near misses, other letters."""
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGU", k=n)) for n in (15, 21, 40, 200, 900)] + ["A" * 30, "ACGUN" * 12 + "CCGGAAUUCCGGAAUUCCGG"]
    sites = []
    for t in texts:
        for _ in range(25):
            n = min(rng.choice([k - 1, k, k + 1, 21]), len(t), 21)
            at, lead = rng.randrange(len(t) - n + 1), rng.randrange(22 - n)
            sites.append("".join(rng.choices("ACGU", k=lead)) + t[at : at + n] + "".join(rng.choices("ACGU", k=21 - n - lead)))
    guides = sorted({revcomp(s) for s in sites} | {"ACG", "", "A" * 25, revcomp(texts[3][:21]).lower()})
    index = kmer_index.build_index(spark.createDataFrame(list(enumerate(texts)), "record_id int, sequence string"), k)
    candidates = spark.createDataFrame([(i, g) for i, g in enumerate(guides * 2)] + [(-1, None)], "id int, antisense string")
    want = {g for g in guides if any(revcomp(g)[i : i + k] in t for i in range(len(g) - k + 1) for t in texts)}
    assert sorted(r[0] for r in kmer_index.critical_guides(candidates, index).collect()) == sorted(want)
    rows = kmer_index.with_match(candidates, index).collect()
    assert len(rows) == len(guides) * 2 + 1
    assert all(r["has_critical_match"] == (r["antisense"] in want) for r in rows)


@pytest.mark.parametrize("k", [11, 15])
def test_a_guide_moves_once_and_not_its_windows(spark, texts, k):
    """Rows shuffled for the guides are no more than the guides (22 - k windows of each before)."""
    records = spark.createDataFrame(list(enumerate(texts)), "record_id int, sequence string")
    index = kmer_index.build_index(records, k)
    rng = random.Random(3)
    candidates = spark.createDataFrame([("".join(rng.choices("ACGU", k=21)),) for _ in range(500)], "antisense string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kmer_index.critical_guides(candidates, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("\n")
    guides = next(i for i, line in enumerate(lines) if "antisense" in line and "Scan" in line)
    depth = len(lines[guides]) - len(lines[guides].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:guides]):
        if len(line) - len(line.lstrip(" :+-")) < depth:
            above.append(line)
            depth = len(line) - len(line.lstrip(" :+-"))
    assert not any("Generate" in line for line in above)
    assert sum("Exchange hashpartitioning" in line for line in above) == 1
