"""Readers, writers and the cleaning of raw exports."""

import gzip

from pyspark.sql import functions as F

from oligo_engine import constants as K
from oligo_engine.functions import chemistry, cleaning
from oligo_engine.operators import curation, toxicity
from oligo_engine.operators.metrics import data_checks
from oligo_engine.operators.variants import build_designs, clinical_pattern, rejected_designs
from oligo_engine.sources import readers, writers


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one desc > more\nacgt\nACGU\n\n>two\nAAAA\r\nCC \n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">three\nGGTT\n>empty\n>four\nUU")
    rows = {r["header"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert rows == {"one desc > more": "ACGUACGU", "two": "AAAACC", "three": "GGUU", "four": "UU"}
    ids = readers.with_record_ids(readers.read_fasta(spark, str(tmp_path)))
    assert ids.select("record_id").distinct().count() == 4


def test_first_sequence_of_inline_text_and_files(spark, tmp_path):
    texts = [">gene1\nAUGC\nAUG\n>gene2\nCCC", "AUGCAUGC", "\n  >x\nAU\n", ">only header"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(readers.first_sequence(F.col("t"))).collect()]
    assert [g.replace("\n", "") for g in got] == ["AUGCAUG", "AUGCAUGC", "AU", ""]
    (tmp_path / "g.fa").write_text(">g\nATGC\n>h\nAA\n")
    (tmp_path / "p.txt").write_text("ATG\nATG\n")
    read = curation.clean_transcripts(readers.read_sequences(spark, str(tmp_path)))
    assert {r["reason"] for r in read.collect()} == {"shorter than 21 nt"}


def test_first_sequences_of_files_with_many_records(spark, tmp_path):
    files = {
        "many.fa": ">a one\nACGU\nAC\n" + "".join(f">r{k}\n{'GGCC' * 500}\n" for k in range(200)),
        "blank.fa": "\n\n>b\r\nAU\r\nGC\r\n>c\nAA\n",
        "indented.fa": " \n  >d\nUUU",
        "inline.txt": "ACG\nUUU\n",
        "mixed.txt": "ACG\n>e\nUUU\n",
        "header.fa": ">only header",
        "empty_record.fa": ">f\n>g\nAAA\n",
        "nothing.fa": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # many.fa is read in several splits
    try:
        read = readers.read_sequences(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["transcript_id"].rsplit("/", 1)[1]: "".join(r["sequence"].split()) for r in read}
    assert got == {
        "many.fa": "ACGUAC", "blank.fa": "AUGC", "indented.fa": "UUU", "inline.txt": "ACGUUU", "mixed.txt": "ACG>",
        "header.fa": "", "empty_record.fa": "",
    }
    cleaned = curation.clean_transcripts(readers.read_sequences(spark, str(tmp_path / "mixed.txt"))).collect()
    assert [r["reason"] for r in cleaned] != [None]


def test_measured_csv_with_padded_and_missing_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text(" sense ,antisense, efficacy\nAUG,CAU,12.5\nAUG,CAU,n/a\n")
    rows = readers.read_measured(spark, str(tmp_path / "m.csv"), readers.MEASURED_MODIFIED)
    assert rows.columns == [f.name for f in readers.MEASURED_MODIFIED.fields]
    assert sorted(str(r["efficacy"]) for r in rows.collect()) == ["12.5", "None"]


def test_seed_table(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("Seed\tcell_viability\naaguga\t33.5\nTOOLONGX\t5\n")
    seeds = toxicity.seed_table(readers.read_seed_table(spark, str(tmp_path / "v.tsv")))
    assert [(r["seed"], r["viability"]) for r in seeds.collect()] == [("AAGUGA", 33.5)]
    df = spark.createDataFrame([("UAAGUGAUUUUUUUUUUUUUU",), ("CCCCCCCCCCCCCCCCCCCCC",)], "antisense string")
    rows = toxicity.with_viability(df, seeds, "antisense").collect()
    assert {(r["toxicity_score"], r["toxicity_label"]) for r in rows} == {(33.5, "Toxic"), (None, "Unknown")}
    none = toxicity.with_viability(df, toxicity.seed_table(readers.empty_seed_table(spark)), "antisense")
    assert {r["toxicity_label"] for r in none.collect()} == {"Unknown"}


def test_mitigation_keeps_unknown_and_notes_safe(spark):
    seeds = spark.createDataFrame([("AAAAAA", 20.0), ("CCCCCC", 60.0), ("GGGGGG", 90.0)], "seed string, viability double")
    rows = [(b * 7 + "A" * 14, b) for b in "ACGU"]
    df = spark.createDataFrame([(p[:1] + "M" + p[2:], p) for p, _ in rows], "antisense string, parent_antisense string")
    got = {r["parent_antisense"][0]: (r["toxicity_label"], r["toxicity_note"]) for r in toxicity.annotate_variants(df, seeds).collect()}
    note = "Seed off-target rescue: 2'-OMe @ pos 2"
    assert got == {"A": ("Mitigated", note), "C": ("Mitigated", note), "G": ("Safe", note), "U": ("Unknown", "")}


def test_taxonomy(spark, tmp_path):
    symbols = readers.taxonomy(spark)
    canonical, modifications = readers.supported_modifications(symbols)
    assert canonical.count() == 5 and modifications.count() == 30
    assert symbols.filter("symbol = '9'").collect()[0]["binary"] == "100011"
    assert readers.alias_rules(spark).count() == len(K.ALIAS_RULES) == 31
    names = spark.createDataFrame([("2'-O-Methyluridine",), ("locked nucleic acid",), ("none",), (None,), ("A",)], "name string")
    built_in, given = (
        {r["name"]: r["symbol"] for r in curation.map_names(names, "name", rules).collect()} for rules in (None, readers.alias_rules(spark))
    )
    assert built_in == given and given["2'-O-Methyluridine"] == "M" and given["none"] is None
    order = spark.createDataFrame([(2, "acid", "y"), (1, "nucleic", "x"), (0, "zzz", "z")], "rule_no int, match string, symbol string")
    assert [r["symbol"] for r in curation.map_names(names, "name", order).collect()] == [None, "x", None, "", ""]
    assert [r["symbol"] for r in curation.map_names(names, "name", order.limit(0)).collect()] == [None, None, None, "", ""]


def test_alias_order_matters(spark):
    names = ["Unlocked nucleic acid A", "Locked nucleic acid A", "2'-Deoxy-2'-fluorouridine", "2'-Deoxyuridine",
             "2'-O-Methyl-3'-phosphorothioate", "phosphorothioate", "weird", "G", None, " 0 "]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r[0] for r in df.orderBy("i").select(cleaning.modification_symbol(F.col("name"))).collect()]
    assert got == ["6", "L", "F", "D", "M", "S", None, "", "", ""]


def test_efficacy_text(spark):
    texts = ["69.5 percent", "-3", "150%", "none", ".5x", "+7 of 10", None, "--8.87"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(cleaning.parse_efficacy(F.col("t")), cleaning.parse_efficacy_dashed(F.col("t"))).collect()
    assert [r[0] for r in rows] == [69.5, 0.0, 100.0, None, 0.5, 7.0, None, 0.0]
    assert rows[-1][1] == 0.0


def test_catalog_cell(spark):
    base = ("AUGCAUGCAUGCAUGCAUGCA", "UGCAUGCAUGCAUGCAUGCAU")
    cell = "1*A,2*2'-O-Methyluridine,5*2'-O-Methyluridine,8*2'-O-Methyluridine,1*0,3*2'-O-Methyladenosine,7*odd thing"
    df = spark.createDataFrame([(*base, cell), (*base, ""), (*base, "21*2'-Fluoro")], "base_sense string, base_antisense string, cell string")
    rows = curation.parse_catalog(df, "cell").collect()
    assert (rows[0]["sense"], rows[0]["antisense"], rows[0]["unmapped"]) == ("AMGCMUGMAUGCAUGCAUGCA", "UGMAUGCAUGCAUGCAUGCAU", 1)
    assert (rows[1]["sense"], rows[1]["antisense"]) == base
    assert rows[2]["sense"] == base[0][:20] + "F"


def test_designs(spark):
    base = ("GCAGCACGACUUCUUCAAGUU", "CUUGAAGAAGUCGUGCUGCUU")
    specs = [("ok", "F,,M", "2,,5", "", ""), ("later wins", "F,,M", "2,,2", "", ""), ("groups", "F,,M", "2", "", ""),
             ("symbol", "?", "2", "", ""), ("number", "F", "x", "", ""), ("range", "", "", "F", "22"), ("none", "F", "", "", "3")]
    df = spark.createDataFrame(
        [(n, *base, *s) for n, *s in specs],
        "parent_id string, sense string, antisense string, sense_mods string, sense_positions string, antisense_mods string, antisense_positions string",
    )
    built = {r["parent_id"]: r for r in build_designs(df).collect()}
    assert built["ok"]["sense"] == "GFAGMACGACUUCUUCAAGUU"
    assert built["later wins"]["sense"] == "GMAGCACGACUUCUUCAAGUU"
    assert built["none"]["sense"] == base[0] and set(built) == {"ok", "later wins", "none"}
    errors = {r["parent_id"]: r["error"] for r in rejected_designs(df).collect()}
    assert errors == {"groups": "group count mismatch", "symbol": "unknown symbol", "number": "bad position", "range": "position out of range"}


def test_clinical_pattern(spark):
    df = spark.createDataFrame([("x", "GGAAAUAGACACCAAAUCUUA", "UAAGAUUUGGUGUCUAUUUCC")], "parent_id string, sense string, antisense string")
    plain, plus = clinical_pattern(df).collect()[0], clinical_pattern(df, plus=True).collect()[0]
    assert (plain["sense"], plain["antisense"]) == ("SS" + "M" * 18 + "4", "1SMMMFFFMMFMFFFMFFFSS")
    assert plus["antisense"] == "1SMMMF8FMMFMFFFMFFFSS"


def test_steric_rule_ignores_unmodified(spark):
    df = spark.createDataFrame([("ALYEA", "AUGCA"), ("ALYCA", "AUGCA"), ("LLACL", "AUACG")], "m string, p string")
    got = [r[0] for r in df.select(chemistry.sterically_viable(F.col("m"), F.col("p"))).collect()]
    assert got == [False, True, True]


def test_report_and_results(spark, tmp_path):
    counts = spark.createDataFrame([("rare", 1), ("common", 12)], "name string, n long")
    writers.write_report(counts, str(tmp_path / "r"), "Unmapped")
    lines = [r[0] for r in writers.report_lines(counts, "Unmapped").select("line").collect()]
    assert lines == ["# Unmapped", "# Total distinct unmapped names: 2\n", "      12  common", "       1  rare"]
    assert spark.read.text(str(tmp_path / "r")).count() == 5
    df = spark.createDataFrame([(1, 1.2345, [1, 2])], "id int, score double, x array<int>")
    writers.write_results(df, str(tmp_path / "j"), ["score"])
    assert spark.read.json(str(tmp_path / "j")).collect()[0]["score"] == 1.23
    writers.write_certificates(df.withColumn("candidate_id", F.col("id")), F.lit("# doc"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).collect()[0]["markdown"] == "# doc"


def test_tolerant_rows(spark):
    df = spark.createDataFrame([("M", None, None, 4, "antisense", 7.5), ("", "F", 2, 9, "sense", 0.5)],
                               "mod_symbol string, modification string, mod_position int, position int, strand string, score double")
    rows = curation.tolerant_singles(df).collect()
    assert [(r["mod_symbol"], r["mod_position"], r["mod_strand"], r["mod_positions"], r["efficacy_score"]) for r in rows] == [
        ("M", 4, "antisense", "4", 7.5), ("F", 2, "sense", "2", 0.5)]


def test_data_checks(spark):
    s = "AUGCAUGCAUGCAUGCAUGCA"
    df = spark.createDataFrame([(s, s, 5.0), (s[:20], s, 200.0), (s[:20] + "?", s, float("nan"))], "sense string, antisense string, efficacy double")
    got = {r["check"]: r["failing"] for r in data_checks(df).collect()}
    assert got == {"finite_label": 1, "label_in_range": 2, "strand_length_21": 1, "known_symbols": 1, "label_varies": 0}
