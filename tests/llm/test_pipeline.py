"""The pipeline's stages one after another on a small table."""

import corpus_pipeline as pipeline

from test_operators import prose


def test_stages_take_effect(spark, tmp_path):
    base = {i: prose(i, 120) for i in range(30)}
    base[30] = base[1] + " end"  # near copy
    base[31] = base[2].replace(base[2].split()[3], "idiot moron scum", 1) + prose(99, 30)  # toxic
    base[32] = prose(77, 60) + " " + " ".join(base[3].split()[:100])  # long passage of another
    base[33] = prose(78, 60)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in base.items()] + [(40, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(base[33].split()[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(base) | {40} == set(sizes["toxicity"]) | {31}
    assert set(sizes["toxicity"]) - set(sizes["near_duplicates"]) == {30}
    assert len(sizes["substring_dedup"][32]) < len(base[32]) - 300 and sizes["substring_dedup"][3] == base[3]
    assert set(sizes["substring_dedup"]) - set(sizes["decontamination"]) == {33}
    mixed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} <= set(sizes["decontamination"]) and all(r["taken"] > 0 for r in mixed)


CLASH = {"score": "x", "held_out": "x", "predicted": 1, "n_bytes": "y", "n_removed": 2, "n_spans": 3, "n_words": "z", "n_hit": 4,
         "n_items": 5, "contaminated": "no", "kept": "k", "component_id": 6, "size": "s", "bucket": 7, "target": "t", "taken": 8}


def test_stages_take_clashing_columns_null_ids_and_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = [(i, prose(i, 60)) for i in range(12)] + [(None, prose(50, 60)), (None, prose(50, 60)), (None, None), (3, prose(3, 60)), (3, prose(3, 60)), (4, "")]
    rows = [(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {name: F.lit(value) for name, value in CLASH.items()}
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, texts[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left = docs.collect()
        assert all(r[c] == v for r in left for c, v in CLASH.items())
        ids = [r["doc_id"] for r in left]
        assert ids.count(None) == 3
        if name == "near_duplicates":
            assert ids.count(3) == 1 and [r["source"] for r in left if r["doc_id"] == 3] == ["a"] and ids.count(4) == 2
    assert sorted(i for i in ids if i is not None) == sorted([*range(5), 4, *range(6, 12)])
    mixed = pipeline.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns.count("size") == mixed.columns.count("taken") == 1 and dict(mixed.dtypes)["target"] == "double"
    assert all(r["taken"] > 0 and r["score"] == "x" for r in mixed.collect())


def test_stages_of_empty_tables_are_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
