"""Merging, splits, features, metrics and model fitting over measured tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from oligo_engine import constants as K
from oligo_engine.catalog import inputs as I, sql as S
from oligo_engine.catalog.registry import query
from oligo_engine.functions.cleaning import is_finite
from oligo_engine.operators import curation, features, metrics, variants
from oligo_engine.operators.ordering import Tables, materialise, spread
from oligo_engine.plans import training


def _micro(name: str):
    return F.floor(F.col(name) * 1e6 + 0.5)


# --- merging and deduplication ------------------------------------------------

_STACKED = (
    "stacked AS (SELECT 'first' AS source, 0 AS source_priority, sense, antisense, efficacy, row_id FROM measured WHERE source = 'N' "
    "UNION ALL SELECT 'second', 1, sense, antisense, efficacy, row_id FROM measured WHERE source = 'R' "
    "UNION ALL SELECT 'third', 2, sense, antisense, efficacy, row_id FROM measured)"
)
_FIRST = "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sense, antisense ORDER BY source_priority, row_id) AS nth FROM stacked) WHERE nth = 1)"


def _parts(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    rows = I.measured(spark, sf)
    kept = rows.select("sense", "antisense", "efficacy", "row_id", F.col("source").alias("flag"))
    return [
        ("first", kept.filter(F.col("flag") == "N").drop("flag")),
        ("second", kept.filter(F.col("flag") == "R").drop("flag")),
        ("third", kept.drop("flag")),
    ]


@query("u1_u2_first_source_wins", S.with_(S.MEASURED, _STACKED, _FIRST) + "SELECT sense, antisense, efficacy, source, row_id FROM uniq")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    stacked = curation.union_sources(_parts(spark, sf))
    unique = curation.dedup_first(stacked, ["sense", "antisense"], ["source_priority", "row_id"])
    return unique.select("sense", "antisense", "efficacy", "source", "row_id")


@query(
    "u3_exact_duplicates",
    S.with_(S.MEASURED) + "SELECT source, count(*) AS n FROM (SELECT DISTINCT sense, antisense, efficacy, source FROM measured) GROUP BY 1",
)
def u3(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.measured(spark, sf).select("sense", "antisense", "efficacy", "source").dropDuplicates()
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q7_w11_prepare_training",
    S.with_(S.MEASURED, _STACKED, _FIRST, "o AS (SELECT *, row_number() OVER (ORDER BY efficacy DESC, source_priority, row_id) - 1 AS i FROM uniq)")
    + "SELECT row_id, source, efficacy, CASE WHEN i % 10 = 4 THEN 'validation' ELSE 'train' END AS split FROM o",
)
def q7(spark: SparkSession, sf: str) -> DataFrame:
    return training.prepare_naked(_parts(spark, sf), "row_id").select("row_id", "source", "efficacy", "split")


# --- profiles -----------------------------------------------------------------


@query(
    "a1_source_profile",
    S.with_(S.MEASURED) + "SELECT source, count(*) AS n, min(efficacy) AS min_efficacy, avg(efficacy) AS mean_efficacy, max(efficacy) AS max_efficacy FROM measured GROUP BY 1",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.source_profile(I.measured(spark, sf))


@query(
    "a15_gene_profile",
    S.with_(S.MEASURED) + "SELECT target_gene, count(*) AS n, avg(efficacy) AS mean_efficacy, " + S.micro("stddev_samp(efficacy)") + " AS std_efficacy FROM measured GROUP BY 1",
)
def a15g(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gene_profile(I.measured(spark, sf)).withColumn("std_efficacy", _micro("std_efficacy"))


@query(
    "m15_data_checks",
    S.with_(S.MEASURED, S.MODIFIED)
    + "SELECT 'finite_label' AS \"check\", count(*) FILTER (efficacy IS NULL OR isnan(efficacy) OR isinf(efficacy)) AS failing FROM modified "
    "UNION ALL SELECT 'label_in_range', count(*) FILTER (NOT efficacy BETWEEN 0 AND 100) FROM modified "
    "UNION ALL SELECT 'strand_length_21', count(*) FILTER (length(s) <> 21 OR length(a) <> 21) FROM modified "
    "UNION ALL SELECT 'known_symbols', count(*) FILTER (regexp_matches(concat(s, a), '[^AUGCTFMLDEBNIZYXQSPRHVWJKO1-9]')) FROM modified "
    "UNION ALL SELECT 'label_varies', CASE WHEN var_pop(efficacy) > 0 THEN 0 ELSE 1 END::BIGINT FROM modified",
)
def m15(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.data_checks(I.modified(spark, sf))


# --- metrics ------------------------------------------------------------------


def _metrics_sql(source: str, group: str | None, min_n: int = 5) -> str:
    keys = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return (
        f"ranks AS (SELECT *, rank() OVER ({part}ORDER BY efficacy) + (count(*) OVER (PARTITION BY {keys}efficacy) - 1) / 2e0 AS ry, "
        f"rank() OVER ({part}ORDER BY prediction) + (count(*) OVER (PARTITION BY {keys}prediction) - 1) / 2e0 AS rp FROM {source}), "
        f"m AS (SELECT {keys}count(*) AS n, corr(efficacy, prediction) AS pcc, corr(ry, rp) AS spearman, avg(abs(efficacy - prediction)) AS mae, "
        f"sqrt(avg((efficacy - prediction) * (efficacy - prediction))) AS rmse, 1e0 - sum((efficacy - prediction) * (efficacy - prediction)) / (var_pop(efficacy) * count(*)) AS r2 "
        f"FROM ranks {by} HAVING count(*) >= {min_n})"
    )


def _metric_columns() -> str:
    return ", ".join(f"{S.micro(m)} AS {m}" for m in metrics.METRICS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: _micro(m) for m in metrics.METRICS})


@query("a2_regression_metrics", S.with_(S.MEASURED, _metrics_sql("measured", None)) + f"SELECT n, {_metric_columns()} FROM m")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(I.measured(spark, sf), [], "efficacy", "prediction"))


@query("a3_w12_metrics_per_source", S.with_(S.MEASURED, _metrics_sql("measured", "source")) + f"SELECT source, n, {_metric_columns()} FROM m")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.regression_metrics(I.measured(spark, sf), ["source"], "efficacy", "prediction"))


_GENES = (
    "genes AS (SELECT target_gene AS gene, count(*) AS n, corr(efficacy, prediction) AS pcc, avg(abs(efficacy - prediction)) AS mae FROM measured "
    "WHERE target_gene NOT IN ('', 'nan', 'None', 'Unknown') GROUP BY 1 HAVING count(*) >= 20)"
)


@query("a4_gene_metrics", S.with_(S.MEASURED, _GENES) + f"SELECT gene, n, {S.micro('pcc')} AS pcc, {S.micro('mae')} AS mae FROM genes")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.gene_metrics(I.measured(spark, sf), "efficacy", "prediction")
    return rows.withColumns({"pcc": _micro("pcc"), "mae": _micro("mae")})


@query("a4_mean_gene_pcc", S.with_(S.MEASURED, _GENES) + f"SELECT count(*) AS n_genes, {S.micro('avg(pcc)')} AS mean_pcc FROM genes")
def a4_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.mean_gene_pcc(metrics.gene_metrics(I.measured(spark, sf), "efficacy", "prediction"))
    return rows.withColumn("mean_pcc", _micro("mean_pcc"))


_FOLDS = (
    "folds AS (SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY md5(concat('42:', row_id)), row_id) - 1) % 5)::INTEGER AS fold FROM measured)"
)


@query(
    "a5_fold_summary",
    S.with_(S.MEASURED, _FOLDS, _metrics_sql("folds", "fold"), "long AS (UNPIVOT m ON pcc, spearman, mae, rmse, r2 INTO NAME metric VALUE value)")
    + f"SELECT metric, {S.micro('avg(value)')} AS mean, {S.micro('stddev_pop(value)')} AS std, {S.micro('min(value)')} AS min, {S.micro('max(value)')} AS max FROM long GROUP BY 1",
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    folded = curation.stratified_folds(I.measured(spark, sf), "row_id")
    summary = metrics.fold_summary(metrics.regression_metrics(folded, ["fold"], "efficacy", "prediction"))
    return summary.withColumns({c: _micro(c) for c in ("mean", "std", "min", "max")})


@query(
    "a7_ndcg",
    S.with_(S.MEASURED,
            "g AS (SELECT prediction, avg(efficacy) AS gain, count(*) AS size FROM measured GROUP BY 1 ORDER BY prediction DESC LIMIT 10)",
            "c AS (SELECT *, sum(size) OVER (ORDER BY prediction DESC)::BIGINT AS hi FROM g)",
            "d AS (SELECT sum(gain * coalesce(list_sum(list_transform(range(hi - size + 1, least(hi, 10) + 1), lambda r: 1e0 / log2(r + 1))), 0e0)) AS dcg FROM c)",
            "i AS (SELECT sum(efficacy / log2(r + 1)) AS ideal FROM (SELECT efficacy, row_number() OVER (ORDER BY efficacy DESC) AS r FROM measured) WHERE r <= 10)")
    + f"SELECT {S.micro('dcg')} AS dcg, {S.micro('ideal')} AS ideal, {S.micro('dcg / ideal')} AS ndcg FROM d, i",
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.ndcg(I.measured(spark, sf), "efficacy", "prediction")
    return rows.withColumns({c: _micro(c) for c in ("dcg", "ideal", "ndcg")})


# --- splits -------------------------------------------------------------------


@query(
    "w11_stride_split",
    S.with_(S.MEASURED, "o AS (SELECT row_id, row_number() OVER (ORDER BY efficacy DESC, row_id) - 1 AS i FROM measured)")
    + "SELECT row_id, CASE WHEN i % 10 = 4 THEN 'validation' ELSE 'train' END AS split FROM o",
)
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return curation.stride_split(I.measured(spark, sf), "efficacy", "row_id").select("row_id", "split")


@query(
    "m8_stratified_split",
    S.with_(S.MEASURED,
            "o AS (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('42:', row_id)), row_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM measured)",
            "t AS (SELECT *, ceil(n * 0.15e0) AS nt FROM o)")
    + "SELECT row_id, CASE WHEN i < nt THEN 'test' WHEN i < nt + ceil((n - nt) * 0.176e0) THEN 'validation' ELSE 'train' END AS split FROM t",
)
def m8(spark: SparkSession, sf: str) -> DataFrame:
    return curation.stratified_split(I.measured(spark, sf), "row_id").select("row_id", "split")


_BUCKET = "(concat('0x', left(md5(concat('42:', {k})), 8))::BIGINT % {n})"


@query(
    "m9_random_split",
    S.with_(S.MEASURED, "o AS (SELECT source, " + _BUCKET.format(k="row_id", n=10) + " AS b FROM measured)")
    + "SELECT source, CASE b WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM o GROUP BY 1, 2",
)
def m9(spark: SparkSession, sf: str) -> DataFrame:
    return curation.random_split(I.measured(spark, sf), "row_id").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("m10_stratified_folds", S.with_(S.MEASURED, _FOLDS) + "SELECT row_id, fold FROM folds")
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return curation.stratified_folds(I.measured(spark, sf), "row_id").select("row_id", "fold")


@query(
    "m13_gene_folds",
    S.with_(S.MEASURED) + "SELECT target_gene, " + _BUCKET.format(k="target_gene", n=5) + "::INTEGER AS fold, count(*) AS n FROM measured GROUP BY 1, 2",
)
def m13(spark: SparkSession, sf: str) -> DataFrame:
    return curation.gene_folds(I.measured(spark, sf)).groupBy("target_gene", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m14_capped_sample",
    S.with_(S.MEASURED) + "SELECT row_id FROM measured ORDER BY md5(concat('42:', row_id)), row_id LIMIT 5000",
)
def m14(spark: SparkSession, sf: str) -> DataFrame:
    return curation.capped_sample(I.measured(spark, sf), "row_id").select("row_id")


# --- features -----------------------------------------------------------------


@query(
    "m1_a13_naked_features",
    S.with_(S.PARENTS,
            "o AS (SELECT parent_id, concat('ss_', i::VARCHAR, '_', substr(sense, i::INTEGER, 1)) AS feature, 1e0 AS value FROM (SELECT parent_id, sense, unnest(range(1, 22)) AS i FROM parents))",
            "t AS (SELECT parent_id, feature, count(*) / 19e0 AS value FROM (SELECT parent_id, unnest(list_concat(list_transform(range(1, 20), lambda i: concat('ss_', substr(sense, i, 3))), "
            "list_transform(range(1, 20), lambda i: concat('as_', substr(antisense, i, 3))))) AS feature FROM parents) GROUP BY 1, 2)",
            f"g AS (SELECT parent_id, 'ss_gc' AS feature, {S.count_in('sense', 'GC')} / 21e0 AS value FROM parents UNION ALL SELECT parent_id, 'as_gc', {S.count_in('antisense', 'GC')} / 21e0 FROM parents)")
    + "SELECT * FROM o UNION ALL SELECT * FROM t UNION ALL SELECT * FROM g WHERE value <> 0",
)
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return features.naked_long(spread(I.parents(spark, sf), "parent_id"), "parent_id")


def _modified_features_sql() -> str:
    names = "MAP {" + ", ".join(f"'{s}': '{n}'" for s, n in features.FEATURE_FLAGS) + "}"

    def changed(x: str, y: str) -> str:
        return f"list_filter(range(1, 22), lambda i: substr({x}, i, 1) <> substr({y}, i, 1))"

    parts = []
    for tag, x, y in (("ss", "s", "ps"), ("as", "a", "pa")):
        places = f"(SELECT row_id, {x} AS x, {y} AS y, unnest(range(1, 22))::INTEGER AS i FROM modified)"
        here = f"substr(x, i, 1) <> substr(y, i, 1)"
        parts += [
            f"SELECT concat('{tag}_', i::VARCHAR, CASE WHEN {here} THEN '_modified' ELSE '_canonical' END) AS feature, 1e0 AS value FROM {places}",
            f"SELECT concat('{tag}_', i::VARCHAR, '_', {names}[substr(x, i, 1)]), 1e0 FROM {places} WHERE {here}",
            f"SELECT concat('{tag}_n_', {names}[sym]), count(*)::DOUBLE FROM (SELECT row_id, unnest(list_transform({changed(x, y)}, lambda i: substr({x}, i, 1))) AS sym FROM modified) GROUP BY row_id, sym",
        ]
        stats = {
            "fraction_modified": f"len({changed(x, y)}) / 21e0",
            "seed_2F": f"{S.count_of(f'substr({x}, 2, 7)', 'F')} / 7e0",
            "seed_2OMe": f"{S.count_of(f'substr({x}, 2, 7)', 'M')} / 7e0",
            "cleavage_2F": f"{S.count_of(f'substr({x}, 9, 3)', 'F')}::DOUBLE",
            "cleavage_2OMe": f"{S.count_of(f'substr({x}, 9, 3)', 'M')}::DOUBLE",
            "cleavage_LNA": f"{S.count_of(f'substr({x}, 9, 3)', 'L')}::DOUBLE",
            "gc": f"round({S.count_in(y, 'GC')} / 21e0, 6)",
            "ps_5": f"(left({x}, 1) = 'S')::INTEGER::DOUBLE",
            "ps_3": f"(substr({x}, 21, 1) = 'S')::INTEGER::DOUBLE",
        }
        parts += [f"SELECT '{tag}_{name}', {value} FROM modified" for name, value in stats.items()]
    parts.append("SELECT 'log_dose', ln(1e0 + CASE WHEN concentration_nM > 0 THEN concentration_nM ELSE 10e0 END) FROM modified")
    return "long AS (" + " UNION ALL ".join(parts) + ")"


@query(
    "m2_a14_modified_features",
    S.with_(S.MEASURED, S.MODIFIED, _modified_features_sql())
    + f"SELECT feature, count(*) AS n, floor(sum(value) * 1e3 + 0.5e0)::BIGINT AS total, {S.micro('min(value)')} AS low, {S.micro('max(value)')} AS high FROM long WHERE value <> 0 GROUP BY 1",
)
def m2(spark: SparkSession, sf: str) -> DataFrame:
    """Non-zero features of every measured row, profiled per feature."""
    rows = features.modified_profile(I.modified(spark, sf), "concentration_nM")
    return rows.select(
        "feature",
        "n",
        F.floor(F.col("sum") * 1e3 + 0.5).alias("total"),
        F.floor(F.col("min") * 1e6 + 0.5).alias("low"),
        F.floor(F.col("max") * 1e6 + 0.5).alias("high"),
    )


@query(
    "a14_strand_summary",
    S.with_(S.MEASURED, S.MODIFIED)
    + "SELECT source, count(*) AS n, count(*) FILTER (left(a, 1) = 'S' OR left(s, 1) = 'S') AS ps_5, count(*) FILTER (substr(a, 21, 1) = 'S') AS ps_3, "
    f"sum({S.count_of('substr(a, 2, 7)', 'F')})::BIGINT AS seed_f, sum({S.count_of('substr(a, 9, 3)', 'F')})::BIGINT AS cleavage_f FROM modified GROUP BY 1",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.strand_summary(I.modified(spark, sf))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("ss_ps_5") == 1) | (F.col("as_ps_5") == 1)).alias("ps_5"),
        F.count_if(F.col("as_ps_3") == 1).alias("ps_3"),
        F.sum(F.round(F.col("as_seed_2F") * 7).cast("bigint")).alias("seed_f"),
        F.sum(F.col("as_cleavage_2F").cast("bigint")).alias("cleavage_f"),
    )


def _vector_totals(featured: DataFrame, names: list[str], group: str) -> DataFrame:
    """Sum and non-zero count per vector place and group, as named rows.

    Summaries stay sparse until one vector per group is left.
    """
    summary = Summarizer.metrics("sum", "numNonZeros").summary(F.col("features"))
    rows = featured.groupBy(group).agg(summary.alias("s"))
    labels = F.array(*[F.lit(n) for n in names])
    cells = F.arrays_zip(
        labels.alias("feature"),
        vector_to_array("s.sum").alias("total"),
        vector_to_array("s.numNonZeros").alias("n"),
    )
    return rows.select(group, F.inline(cells)).filter(F.col("n") > 0)


@query(
    "m2_modified_vectors",
    S.with_(S.MEASURED, S.MODIFIED, _modified_features_sql().replace("SELECT ", "SELECT source, ").replace("(SELECT source, row_id, s AS x", "(SELECT source, row_id, s AS x")
            .replace("GROUP BY row_id, sym", "GROUP BY source, row_id, sym"))
    + f"SELECT source, feature, count(*) AS n, floor(sum(value) * 1e3 + 0.5e0)::BIGINT AS total FROM long WHERE value <> 0 GROUP BY 1, 2",
)
def m2_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of the 1,467-wide vectors against the named features."""
    featured = training.training_features(_training_rows(spark, sf))
    totals = _vector_totals(featured, features.modified_vocabulary(), "source")
    return totals.select(
        "source", "feature", F.col("n").cast("bigint").alias("n"), F.floor(F.col("total") * 1e3 + 0.5).alias("total")
    )


@query(
    "m1_naked_vectors",
    S.with_(S.PARENTS,
            "o AS (SELECT concat('ss_', i::VARCHAR, '_', substr(sense, i::INTEGER, 1)) AS feature, parent_id, 1e0 AS value FROM (SELECT parent_id, sense, unnest(range(1, 22)) AS i FROM parents))",
            "t AS (SELECT feature, parent_id, count(*) / 19e0 AS value FROM (SELECT parent_id, unnest(list_concat(list_transform(range(1, 20), lambda i: concat('ss_', substr(sense, i, 3))), "
            "list_transform(range(1, 20), lambda i: concat('as_', substr(antisense, i, 3))))) AS feature FROM parents) GROUP BY 1, 2)",
            f"g AS (SELECT 'ss_gc' AS feature, parent_id, {S.count_in('sense', 'GC')} / 21e0 AS value FROM parents UNION ALL SELECT 'as_gc', parent_id, {S.count_in('antisense', 'GC')} / 21e0 FROM parents)",
            "long AS (SELECT * FROM o UNION ALL SELECT * FROM t UNION ALL SELECT * FROM g)")
    + "SELECT parent_id % 4 AS part, feature, count(*) AS n, floor(sum(value) * 1e3 + 0.5e0)::BIGINT AS total FROM long WHERE value <> 0 GROUP BY 1, 2",
)
def m1_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of the 214-wide vectors against the named features."""
    rows = spread(I.parents(spark, sf)).withColumn("part", F.col("parent_id") % 4)
    totals = _vector_totals(features.naked_features(rows), features.naked_names(), "part")
    return totals.select(
        "part", "feature", F.col("n").cast("bigint").alias("n"), F.floor(F.col("total") * 1e3 + 0.5).alias("total")
    )


@query(
    "m3_source_one_hot",
    S.with_(S.MEASURED) + "SELECT source, concat('source_', source) AS feature, count(*) AS n, count(*) * 1000 AS total FROM measured GROUP BY 1",
)
def m3_onehot(spark: SparkSession, sf: str) -> DataFrame:
    """Source places appended to the unmodified-duplex vectors."""
    sources = ["A", "N", "R"]
    rows = spread(I.measured(spark, sf).select("sense", "antisense", "source"))
    featured = features.with_source_onehot(features.naked_features(rows), sources)
    names = features.naked_names() + [f"source_{x}" for x in sources]
    totals = _vector_totals(featured, names, "source").filter(F.startswith("feature", F.lit("source_")))
    return totals.select(
        "source", "feature", F.col("n").cast("bigint").alias("n"), F.floor(F.col("total") * 1e3 + 0.5).alias("total")
    )


@query(
    "m15_feature_checks",
    S.with_(S.MEASURED, S.MODIFIED) + "SELECT count(*) AS rows, count(*) FILTER (isnan(ln(1e0 + coalesce(concentration_nM, 10e0)))) AS bad_rows FROM modified",
)
def m15_features(spark: SparkSession, sf: str) -> DataFrame:
    return training.feature_checks(training.training_features(_training_rows(spark, sf)))


# --- models ---------------------------------------------------------------------

#: Settings of the registered fits: fewer rounds than the operators' 3,000 and a larger
#: step, so that the error turns and patience acts within minutes on the test tables.
ROUNDS = dict(max_iter=16, max_depth=3, stepSize=0.5, patience=4)


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Modified duplexes with a planted effect: 2'-F in the seed adds 40."""
    planted = F.lit(30.0) + F.when(F.contains(F.substring("antisense", 2, 7), F.lit("F")), 40.0).otherwise(0.0) + F.col("efficacy") / 10
    renamed = I.modified(spark, sf).withColumnsRenamed({"parent_sense": "base_sense", "parent_antisense": "base_antisense"})
    return renamed.withColumn("efficacy", planted).drop("prediction")


def _judged(scored: DataFrame, key: str) -> DataFrame:
    """Rows, finite predictions, and whether they beat the mean of the rows themselves."""
    error = F.avg(F.pow(F.col("efficacy") - F.col("prediction"), 2))
    finite = F.col("prediction").isNotNull() & (F.abs("prediction") < F.lit(float("inf")))
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("finite"), (error < F.var_pop("efficacy") / 4).alias("learnt")
    )


@query(
    "m4_m5_m6_holdout_model",
    S.with_(S.MEASURED, "o AS (SELECT source, count(*) AS n FROM measured GROUP BY 1)")
    + "SELECT source, ceil(n * 0.15e0)::BIGINT AS n, ceil(n * 0.15e0)::BIGINT AS finite, true AS learnt, true AS replayed, true AS error_of_best FROM o",
)
def m4(spark: SparkSession, sf: str) -> DataFrame:
    """Fit with early stopping on the stratified split, score the test part.

    The ensemble has the rounds that a plain replay of the validation errors gives.
    """
    model, scored, errors = training.holdout(_training_rows(spark, sf), "row_id", **ROUNDS)
    kept = model.stages[-1].getNumTrees
    later = [e for i, e in enumerate(errors[:kept + ROUNDS["patience"]], 1) if i != kept]
    return _judged(scored, "source").withColumns(
        {"replayed": F.lit(kept == training.best_round(errors, ROUNDS["patience"])[0]), "error_of_best": F.lit(all(errors[kept - 1] <= e for e in later))}
    )


def _inner_sql(key: str, rows: str) -> str:
    inner = "concat('0x', left(md5(concat('1000:', row_id)), 8))::BIGINT % 20 < 3"
    return (
        f"parts AS (SELECT DISTINCT {key} AS part FROM {rows})\nSELECT part AS {key}, count(*) FILTER ({key} <> part AND NOT ({inner})) AS n_train, "
        f"count(*) FILTER ({key} <> part AND {inner}) AS n_validation, count(*) FILTER ({key} = part) AS n_test, count(*) FILTER ({key} = part) AS n, "
        f"count(*) FILTER ({key} = part) AS finite, true AS learnt, true AS stopped"
    )


@query(
    "m10_a6_m12_cross_validation",
    S.with_(S.MEASURED, _FOLDS, "inside AS (SELECT row_id, fold FROM folds JOIN measured USING (row_id) WHERE measured.source <> 'A')",
            _inner_sql("fold", "inside") + ", (SELECT count(*) FROM measured WHERE source = 'A') AS external FROM inside, parts GROUP BY 1"),
)
def m10_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds over two sources, the third scored as external set by every fold."""
    rows = _training_rows(spark, sf)
    external, inside = rows.filter(F.col("source") == "A"), rows.filter(F.col("source") != "A")
    with Tables(spark) as tables:
        out = training.cross_validate(inside, "row_id", k=5, external=external, **ROUNDS)
        beyond = out["external_per_fold"].select("fold", F.col("n").alias("external"))
        stopped = F.col("best_iteration").between(1, ROUNDS["max_iter"])
        fits = out["fits"].join(_judged(out["out_of_fold"], "fold"), "fold").join(beyond, "fold")
        return tables.keep(fits.withColumn("stopped", stopped).drop("best_iteration"))


@query(
    "m11_leave_one_source_out",
    S.with_(S.MEASURED, "inside AS (SELECT row_id, source AS held_out FROM measured)", _inner_sql("held_out", "inside") + " FROM inside, parts GROUP BY 1"),
)
def m11(spark: SparkSession, sf: str) -> DataFrame:
    with Tables(spark) as tables:
        out = training.leave_one_source_out(_training_rows(spark, sf), "row_id", **ROUNDS)
        stopped = F.col("best_iteration").between(1, ROUNDS["max_iter"])
        fits = out["fits"].join(_judged(out["scored"], "held_out"), "held_out")
        return tables.keep(fits.withColumn("stopped", stopped).drop("best_iteration"))


@query("a8_feature_importance", "SELECT 'as_seed_2F' AS feature, true AS most, (SELECT count(*) FROM region) > 0 AS sorted")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    """The feature that holds the planted effect comes first."""
    featured, selector = training.weighted_features(_training_rows(spark, sf))
    model = training.train(featured, max_iter=5, max_depth=3, stepSize=0.5)
    names = features.modified_vocabulary()
    top = training.importances(model, [names[i] for i in selector.selectedFeatures], spark)
    every = top.agg(F.max_by("feature", "gain").alias("feature"), F.max("gain").alias("_gain"), F.collect_list("gain").alias("_all"))
    return every.select("feature", (F.col("_gain") > 0.5).alias("most"), (F.sort_array("_all", False) == F.col("_all")).alias("sorted"))


@query("m7_calibration")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    """Isotonic map of prediction to efficacy, applied to all rows."""
    rows = I.measured(spark, sf).select("source", "efficacy", "prediction")
    calibrated = training.calibrate(rows, training.fit_calibrator(rows))
    return calibrated.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), 6).alias("mean"), F.round(F.avg("efficacy"), 6).alias("mean_efficacy")
    )


@query(
    "m3_s11_s12_naked_model",
    S.with_(S.MEASURED, "firsts AS (SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY sense, antisense ORDER BY row_id) = 1)",
            "sized AS (SELECT count(*) AS n FROM firsts)")
    + f"SELECT n, n AS same, true AS replayed, 217 AS n_features, source, count(*) AS source_rows, '{K.GBT_MAX_ITER}' AS max_iter FROM firsts, sized GROUP BY n, source",
)
def m3(spark: SparkSession, sf: str) -> DataFrame:
    """Unmodified-duplex model with source one-hot: fitted with the published rounds and
    patience on the stride split, saved, loaded and summarised.

    Vectors are made of the strands in every pass and not stored: they are many times as large.
    """
    from oligo_engine.catalog.sequence_queries import scratch

    firsts = curation.dedup_first(I.measured(spark, sf).select("sense", "antisense", "efficacy", "source", "row_id"), ["sense", "antisense"], ["row_id"])
    with Tables(spark) as tables:
        rows = curation.stride_split(firsts, "efficacy", "row_id")
        sources = ["A", "N", "R"]
        dealt = training.dealt_for_places(rows, features.NAKED_SIZE + len(sources))
        featured = features.with_source_onehot(features.naked_features(dealt), sources)
        path = scratch(spark, "model")
        settings = dict(max_iter=K.GBT_MAX_ITER, patience=K.GBT_PATIENCE)
        fitted, errors = training.train_stopping(featured, F.col("split") == "validation", **settings)
        training.save_model(fitted, path)
        model = training.load_model(path)
        both = training.predict(model, fitted.transform(featured).withColumnRenamed("prediction", "_fitted"))
        finite = is_finite(F.col("efficacy")) & is_finite(F.col("prediction"))
        summary = both.agg(F.count_if(finite).alias("n"), F.count_if(F.col("_fitted") == F.col("prediction")).alias("same"))
        about = training.metadata(rows, summary, model, settings).drop("created")
        kept = training.best_round(errors, K.GBT_PATIENCE)[0]
        return tables.keep(
            about.select(
                "n", "same", (F.col("best_iteration") == kept).alias("replayed"), "n_features",
                F.explode("training_rows").alias("source", "source_rows"), F.element_at("params", "max_iter").alias("max_iter"),
            )
        )
