"""Preparing measured tables: routing, deduplication, merging and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine.functions.cleaning import (
    is_unmodified,
    lenient_sequence,
    modification_symbol,
    normalise_modification_name,
    stripped,
    parse_efficacy,
    strand_length_ok,
    strict_sequence,
)
from oligo_engine.functions.sequence import is_rna, reverse_complement, to_rna
from oligo_engine.operators.ordering import materialise, with_row_index


def clean_transcripts(raw: DataFrame) -> DataFrame:
    """Normalised transcripts with a ``reason`` for unusable rows."""
    return raw.withColumn("_c", strict_sequence(F.col("sequence"))).select(
        *[c for c in raw.columns if c != "sequence"], "_c.sequence", "_c.reason"
    )


def route_export(raw: DataFrame) -> DataFrame:
    """Clean an export and give each row its first rejection reason (null = kept)."""
    cleaned = raw.withColumns(
        {
            "efficacy": parse_efficacy(F.col("efficacy_text")),
            "sense": lenient_sequence(F.col("sense_raw")),
            "antisense": lenient_sequence(F.col("antisense_raw")),
        }
    )
    reason = (
        F.when(F.col("efficacy").isNull(), F.lit("bad efficacy"))
        .when(
            ~(strand_length_ok(F.col("sense")) & strand_length_ok(F.col("antisense"))), F.lit("bad sequence")
        )
        .when(
            ~(is_unmodified(F.col("sense_mod_names")) & is_unmodified(F.col("antisense_mod_names"))),
            F.lit("modified"),
        )
    )
    return cleaned.withColumn("reject_reason", reason)


def rejection_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def kept_rows(routed: DataFrame) -> DataFrame:
    """Usable unmodified rows, identical ones once."""
    return (
        routed.filter(F.col("reject_reason").isNull()).select("sense", "antisense", "efficacy").dropDuplicates()
    )


def from_published_guides(rows: DataFrame, source: str) -> DataFrame:
    """19-nt guides with a 0-1 label to 21-nt duplexes with percent efficacy."""
    guide = to_rna(F.col("guide"))
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("label") * F.lit(100.0)))
    return rows.filter((F.length(guide) == 19) & is_rna(guide)).select(
        *[c for c in rows.columns if c not in ("guide", "label")],
        F.concat(reverse_complement(guide), F.lit("UU")).alias("sense"),
        F.concat(guide, F.lit("UU")).alias("antisense"),
        F.round(percent, 2).alias("efficacy"),
        F.lit(source).alias("source"),
    )


def union_sources(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Stack tables by name with their source tag and priority (first = 0)."""
    tagged = [
        df.withColumn("source", F.lit(tag)).withColumn("source_priority", F.lit(i))
        for i, (tag, df) in enumerate(parts)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dedup_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row per key in the given order.

    An aggregation rather than a window: copies collapse before the shuffle, however
    many there are of one key.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def overlap_key(sense: str, antisense: str) -> Column:
    """First 20 characters of both strands."""
    return F.concat(F.substring(sense, 1, 20), F.substring(antisense, 1, 20))


def without_overlap(df: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose overlap key does not occur in ``known`` (left anti join)."""
    keys = known.select(overlap_key("sense", "antisense").alias("_key")).distinct()
    return (
        df.withColumn("_key", overlap_key("sense", "antisense")).join(keys, "_key", "left_anti").drop("_key")
    )


def merge_increment(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """New version of a measured table; ``is_new`` marks rows absent before."""
    keys = ["sense", "antisense", "efficacy"]
    both = existing.select(*keys, F.lit(False).alias("is_new")).unionByName(
        fresh.select(*keys, F.lit(True).alias("is_new"))
    )
    return both.groupBy(*keys).agg(F.min("is_new").alias("is_new"))


def increment_report(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(~F.col("is_new")).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(F.col("is_new")).alias("rows_added"),
    )


def map_names(df: DataFrame, name: str, rules: DataFrame | None = None) -> DataFrame:
    """Symbol of each modification name, by the built-in rules or a table of them
    (rule_no, match, symbol): the first whose text the name contains.

    A rule's text is met by the parts of a name that are as long as any rule's, so the work
    grows with the different names and with the rules, not with their product.
    """
    if rules is None:
        return df.withColumn("symbol", modification_symbol(F.col(name)))
    sizes = rules.filter(F.col("match").isNotNull()).agg(F.collect_set(F.length("match"))).scalar()
    cleaned = normalise_modification_name(stripped(F.col("_name")))
    names = df.select(F.col(name).alias("_name")).filter(F.col(name).isNotNull()).distinct().withColumns({"_text": cleaned, "_sizes": sizes})
    parts = F.transform(
        F.filter("_sizes", lambda n: n <= F.length("_text")),
        lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda p: F.substr(F.col("_text"), p, n)),
    )
    met = names.select("_name", F.explode(F.array_distinct(F.flatten(parts))).alias("match")).join(rules, "match")
    # written down: few different names are broadcast by their size, so that rows stay where they are
    first = materialise(met.groupBy("_name").agg(F.min(F.struct("rule_no", "match", "symbol"))["symbol"].alias("_symbol")))
    found = df.join(first, df[name] == first["_name"], "left")
    return found.withColumn("symbol", modification_symbol(F.col(name), F.col("_symbol"))).drop("_name", "_symbol")


def unmapped_frequencies(df: DataFrame, name: str) -> DataFrame:
    """Names without a symbol by frequency."""
    return (
        map_names(df, name)
        .filter(F.col("symbol").isNull())
        .groupBy(stripped(F.col(name)).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parse_catalog(rows: DataFrame, cell: str) -> DataFrame:
    """Rebuild both strands from ``position*name`` tokens of one malformed cell.

    Tokens run through the sense strand and start again at 1 for the antisense.  Rows
    carry ``base_sense, base_antisense``; ``unmapped`` counts tokens without a symbol.
    Everything happens inside the row: a cell holds at most two strands of tokens.
    """
    tokens = F.transform(
        F.regexp_extract_all(cell, F.lit(r"\d+\*[^|,]+"), F.lit(0)),
        lambda t: F.struct(
            F.regexp_extract(t, r"^(\d+)\*", 1).cast("int").alias("pos"),
            modification_symbol(F.regexp_replace(t, r"^\d+\*", "")).alias("symbol"),
        ),
    )
    # index of the first token whose position does not exceed the one before it
    parsed = rows.withColumn("_tokens", tokens)
    reset = F.filter(
        F.sequence(F.lit(2), F.greatest(F.size("_tokens"), F.lit(2))),
        lambda i: F.get(F.col("_tokens"), i - 1).pos <= F.get(F.col("_tokens"), i - 2).pos,
    )
    parsed = parsed.withColumn("_cut", F.coalesce(F.get(reset, F.lit(0)) - 1, F.size("_tokens")))

    def rebuilt(base: str, steps: Column) -> Column:
        usable = F.filter(
            steps,
            lambda x: x.symbol.isNotNull() & (x.symbol != "") & x.pos.between(1, F.length(base)),
        )
        return F.aggregate(usable, F.col(base), lambda s, x: F.overlay(s, x.symbol, x.pos, F.lit(1)))

    sense_steps = F.slice("_tokens", F.lit(1), F.col("_cut"))
    antisense_steps = F.slice("_tokens", F.col("_cut") + 1, F.greatest(F.size("_tokens") - F.col("_cut"), F.lit(0)))
    return parsed.withColumns(
        {
            "sense": rebuilt("base_sense", sense_steps),
            "antisense": rebuilt("base_antisense", antisense_steps),
            "unmapped": F.size(F.filter("_tokens", lambda x: x.symbol.isNull())),
        }
    ).drop("_tokens", "_cut")


def tolerant_singles(rows: DataFrame) -> DataFrame:
    """Pre-computed single results under either set of field names, with defaults."""

    def pick(*names: str, default) -> Column:
        present = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*present, F.lit(default))

    def blank_to_null(name: str, other: str) -> Column:
        columns = [F.nullif(F.col(n), F.lit("")) for n in (name, other) if n in rows.columns]
        return F.coalesce(*columns, F.lit(""))

    def zero_to_null(name: str, other: str, zero) -> Column:
        columns = [F.nullif(F.col(n), F.lit(zero)) for n in (name, other) if n in rows.columns]
        return F.coalesce(*columns, F.lit(zero))

    position = zero_to_null("mod_position", "position", 0)
    positions = F.nullif(F.col("mod_positions"), F.lit("")) if "mod_positions" in rows.columns else F.lit(None)
    return rows.select(
        *[c for c in ("parent_id",) if c in rows.columns],
        blank_to_null("mod_symbol", "modification").alias("mod_symbol"),
        position.alias("mod_position"),
        blank_to_null("mod_strand", "strand").alias("mod_strand"),
        F.coalesce(positions.cast("string"), position.cast("string")).alias("mod_positions"),
        zero_to_null("efficacy_score", "score", 0.0).alias("efficacy_score"),
        pick("sense", default="").alias("sense"),
        pick("antisense", default="").alias("antisense"),
        pick("delta_score", default=0.0).alias("delta_score"),
    )


# --- splits -------------------------------------------------------------------


def hash_order(row_id: str, seed: int) -> Column:
    """Reproducible pseudo-random order of rows, independent of partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def stride_split(df: DataFrame, efficacy: str = "efficacy", row_no: str = "row_no") -> DataFrame:
    """Order by falling efficacy; every 10th row from the 5th is validation."""
    indexed = with_row_index(df, [], [F.col(efficacy).desc(), F.col(row_no)], "_index")
    return indexed.withColumn(
        "split", F.when(F.col("_index") % 10 == 4, F.lit("validation")).otherwise(F.lit("train"))
    ).drop("_index")


def stratified_split(
    df: DataFrame,
    row_id: str,
    stratum: str = "source",
    test: float = 0.15,
    validation: float = 0.176,
    seed: int = 42,
) -> DataFrame:
    """Test share of every stratum, then the validation share of what remains."""
    indexed = with_row_index(df, [stratum], [hash_order(row_id, seed), F.col(row_id)], "_index")
    # written down, so that the join is planned on its size and no stratum meets in one task
    sizes = materialise(df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_n")))
    joined = indexed.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")))
    n_test = F.ceil(F.col("_n") * F.lit(test))
    n_validation = F.ceil((F.col("_n") - n_test) * F.lit(validation))
    return joined.withColumn(
        "split",
        F.when(F.col("_index") < n_test, F.lit("test"))
        .when(F.col("_index") < n_test + n_validation, F.lit("validation"))
        .otherwise(F.lit("train")),
    ).select(*df.columns, "split")


def stratified_folds(df: DataFrame, row_id: str, stratum: str = "source", k: int = 5, seed: int = 42) -> DataFrame:
    """Fold numbers dealt out inside every stratum."""
    indexed = with_row_index(df, [stratum], [hash_order(row_id, seed), F.col(row_id)], "_index")
    return indexed.withColumn("fold", (F.col("_index") % k).cast("int")).drop("_index")


def random_split(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """80/10/10 by row hash (narrow)."""
    bucket = hash_bucket(F.col(row_id), seed, 10)
    return df.withColumn(
        "split",
        F.when(bucket == 0, F.lit("test")).when(bucket == 1, F.lit("validation")).otherwise(F.lit("train")),
    )


def gene_folds(df: DataFrame, gene: str = "target_gene", k: int = 5, seed: int = 42) -> DataFrame:
    """All rows of a gene in one fold (narrow)."""
    return df.withColumn("fold", hash_bucket(F.coalesce(gene, F.lit("")), seed, k))


def capped_sample(df: DataFrame, row_id: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Reproducible sample of at most ``n`` rows."""
    return df.orderBy(hash_order(row_id, seed), F.col(row_id)).limit(n)
