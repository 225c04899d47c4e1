"""Order-dependent operators against pandas, with one group holding most rows."""

import random
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oligo_engine.operators import curation, metrics, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        group = "hot" if i % 3 else rng.choice(["a", "b", None])
        # a third of the values are equal
        value = 0.0 if rng.random() < 0.34 else round(rng.uniform(0, 100), 1)
        rows.append((i, group, value, round(value * 0.5 + rng.uniform(0, 40), 0)))
    pdf = pd.DataFrame(rows, columns=["id", "g", "y", "p"])
    return spark.createDataFrame(rows, "id int, g string, y double, p double").repartition(5), pdf


def test_row_index(skewed):
    df, pdf = skewed
    got = ordering.with_row_index(df, ["g"], [F.col("y").desc(), F.col("id")]).toPandas()
    want = pdf.sort_values(["y", "id"], ascending=[False, True])
    want["row_index"] = want.groupby("g", dropna=False).cumcount()
    assert got.set_index("id")["row_index"].sort_index().tolist() == want.set_index("id")["row_index"].sort_index().tolist()


def test_row_index_moves_rows_once(skewed):
    """Rows are shuffled for the sort alone; the small table of offsets is then broadcast."""
    df, _ = skewed
    for keys in ([], ["g"]):
        plan = ordering.with_row_index(df, keys, [F.col("y").desc(), F.col("id")])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_row_index_of_an_empty_table(skewed):
    df, _ = skewed
    assert ordering.with_row_index(df.limit(0), ["g"], [F.col("id")]).count() == 0
    assert ordering.with_row_index(df.limit(0), [], [F.col("id")]).count() == 0


def test_tables_go_at_the_end_of_their_block(spark, tmp_path, monkeypatch):
    """Also those of threads, of nested blocks and of a block that fails."""
    monkeypatch.setattr(ordering, "checkpoint_root", lambda _: str(tmp_path))
    folder = tmp_path / "oligo"
    with ordering.Tables(spark) as outer:
        ordering.materialise(spark.range(3))
        with ordering.Tables(spark) as inner:
            first = ordering.materialise(spark.range(5))
            context = copy_context()
            with ThreadPoolExecutor(1) as pool:
                pool.submit(context.run, ordering.materialise, spark.range(7)).result()
            kept = inner.keep(first.selectExpr("sum(id) AS total"))
            assert len(list(folder.iterdir())) == 4
        assert len(list(folder.iterdir())) == 2 and kept.collect()[0]["total"] == 10
        last = outer.keep(kept)
    assert len(list(folder.iterdir())) == 1 and last.collect()[0]["total"] == 10
    with pytest.raises(ZeroDivisionError):
        with ordering.Tables(spark):
            ordering.materialise(spark.range(3))
            raise ZeroDivisionError
    assert len(list(folder.iterdir())) == 1
    ordering.materialise(spark.range(3))  # no block is open: left to its caller
    assert len(list(folder.iterdir())) == 2


def test_rank_all_matches_top(skewed):
    df, _ = skewed
    order = [F.col("y").desc(), F.col("id")]
    full = ordering.rank_all(df, ["g"], order).filter("rank <= 7")
    top = ordering.top_per_group(df, ["g"], order, 7)
    assert sorted(full.select("id", "rank").collect()) == sorted(top.select("id", "rank").collect())


def test_spearman_with_ties(skewed):
    df, pdf = skewed
    got = {r["g"]: r["spearman"] for r in metrics.spearman(df, ["g"], "y", "p").collect()}
    for group, part in pdf.groupby("g", dropna=False):
        key = None if pd.isna(group) else group
        assert got[key] == pytest.approx(part["y"].rank().corr(part["p"].rank()), abs=1e-9)


def test_regression_metrics_drop_small_and_nonfinite(spark):
    rows = [("a", float(i), float(i) + 1) for i in range(6)] + [("b", 1.0, 2.0)] * 4 + [("a", float("nan"), 1.0), ("a", 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "source string, y double, p double")
    out = metrics.regression_metrics(df, ["source"], "y", "p").collect()
    assert [r["source"] for r in out] == ["a"]
    r = out[0]
    assert (r["n"], r["mae"], r["rmse"]) == (6, 1.0, 1.0)
    assert r["pcc"] == pytest.approx(1) and r["spearman"] == pytest.approx(1)
    assert r["r2"] == pytest.approx(1 - 6 / 17.5)


def test_stride_split_takes_every_tenth_from_the_fifth(skewed):
    df, pdf = skewed
    out = curation.stride_split(df, "y", "id").filter("split = 'validation'").toPandas()
    want = pdf.sort_values(["y", "id"], ascending=[False, True]).reset_index(drop=True)
    assert sorted(out["id"]) == sorted(want[want.index % 10 == 4]["id"])


def test_folds_are_even_per_stratum(skewed):
    df, _ = skewed
    sizes = curation.stratified_folds(df, "id", "g").groupBy("g").pivot("fold").count().collect()
    for r in sizes:
        counts = list(r)[1:]
        assert max(counts) - min(counts) <= 1


def test_stratified_split_shares(skewed):
    df, _ = skewed
    total = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    parts = {(r["g"], r["split"]): r["count"] for r in curation.stratified_split(df, "id", "g").groupBy("g", "split").count().collect()}
    for g, n in total.items():
        assert abs(parts[(g, "test")] - 0.15 * n) <= 1
        assert sum(v for (k, _), v in parts.items() if k == g) == n


def test_first_source_wins(spark):
    df = spark.createDataFrame(
        [("s", "a", 1.0, "late", 1, 0), ("s", "a", 2.0, "early", 0, 5), ("s", "a", 3.0, "early", 0, 4), ("t", "a", 4.0, "late", 1, 1)],
        "sense string, antisense string, efficacy double, source string, source_priority int, row_no int",
    )
    rows = curation.dedup_first(df, ["sense", "antisense"], ["source_priority", "row_no"]).collect()
    assert sorted((r["sense"], r["efficacy"]) for r in rows) == [("s", 3.0), ("t", 4.0)]


def test_ndcg_with_tied_predictions(spark):
    # ties share their mean gain: 3 and 1 at ranks 1-2
    df = spark.createDataFrame([(3.0, 9.0), (1.0, 9.0), (2.0, 5.0)], "y double, p double")
    from math import log2

    dcg = 2 / log2(2) + 2 / log2(3) + 2 / log2(4)
    ideal = 3 / log2(2) + 2 / log2(3) + 1 / log2(4)
    assert metrics.ndcg(df, "y", "p").collect()[0]["ndcg"] == pytest.approx(dcg / ideal)


def test_split_does_not_shuffle_by_stratum(spark):
    """A stratum may hold a third of all rows, so none is gathered in one task."""
    from oligo_engine.operators.curation import stratified_split

    rows = spark.range(600).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).cast("string").alias("source"))
    split = stratified_split(rows, "row_id")
    assert "hashpartitioning(source" not in split._jdf.queryExecution().executedPlan().toString()
    assert split.filter("split = 'test'").count() == 90 and split.count() == 600
