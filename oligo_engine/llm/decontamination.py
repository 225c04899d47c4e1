"""Benchmark decontamination with a distributed positional inverted index.

DataFrame functions only. Every item window of ``window`` words is looked up by its
rarest terms in the corpus: their postings (term, document, position) are shifted by the
term's offset in the window and intersected on (window, document, start); what remains is
confirmed on the document's own words. Exact phrases and proximity matches are both read
from the same index.

The index holds the terms a query set asks for, found in one scan; term frequencies count
all documents. The terms of the test set are broadcast when there are at most
``BROADCAST_TERMS`` of them, else joined by shuffle. A very frequent term is a hot key of
the join on terms, which Spark splits (or streams past the broadcast terms).

Defined results: a null or wordless text has no words and no hit; a wordless item matches
nothing; a null id is an id of its own (items: the text ``null``); repeated rows give
repeated rows; rows that share an id are judged each by its own text; further columns are
ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oligo_engine.llm.common import checkpoint

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most this many terms or windows are broadcast (some tens of MB).
BROADCAST_TERMS = 200_000
#: Terms of a window whose postings are intersected before words are compared.
RAREST = 2


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def bounded(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Broadcast if its size is within the bound; otherwise as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """phrase, words, item_ids: the distinct windows of all items."""
    listed = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (
        listed.select("item_id", "words", F.explode(starts).alias("_at"))
        .select("item_id", F.slice("words", F.col("_at"), window).alias("words"))
        .groupBy(F.array_join("words", " ").alias("phrase"))
        .agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids"))
    )


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, frequency: occurrences of the given terms in all documents."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("frequency"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, doc_id, position from 0."""
    tokens = docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return tokens.join(bounded(terms), "term").select("term", "doc_id", "position")


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """phrase, n, rank, term, offset: the rarest different terms of each window.

    Windows with a term that no document has cannot occur and are left out.
    """
    terms = windows.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    rated = terms.join(counts, "term", "left").groupBy("phrase", "n", "term").agg(
        F.min("offset").alias("offset"), F.min(F.coalesce("frequency", F.lit(0))).alias("frequency")
    )
    order = W.partitionBy("phrase").orderBy("frequency", "offset")
    return (
        rated.withColumn("rank", F.row_number().over(order))
        .withColumn("_least", F.min("frequency").over(W.partitionBy("phrase")))
        .filter((F.col("_least") > 0) & (F.col("rank") <= rarest))
        .select("phrase", "n", "rank", "term", "offset")
    )


def intersected(index: DataFrame, lookups: DataFrame, rarest: int = RAREST) -> DataFrame:
    """phrase, n, doc_id, start: places where the shifted lists of all looked-up terms meet."""
    shifted = index.join(bounded(lookups), "term").select(
        "phrase", "n", "rank", "doc_id", (F.col("position") - F.col("offset")).alias("start")
    ).filter(F.col("start") >= 0)
    met = shifted.filter("rank = 1").drop("rank")
    for rank in range(2, rarest + 1):
        other = shifted.filter(F.col("rank") == rank).select("phrase", "doc_id", "start").alias("o")
        without = lookups.groupBy("phrase").agg(F.max("rank").alias("_ranks")).filter(F.col("_ranks") < rank).select("phrase")
        met = (
            met.alias("m")
            .join(
                other,
                (F.col("m.phrase") == F.col("o.phrase"))
                & (F.col("m.start") == F.col("o.start"))
                & F.col("m.doc_id").eqNullSafe(F.col("o.doc_id")),
                "left_semi",
            )
            .unionByName(met.join(without, "phrase", "left_semi"))
        )
    return met


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """left, right, doc_id, left_position, right_position of terms at most ``within``
    words apart, either way round. ``pairs`` has left and right.

    Positions meet in strips of ``within`` + 1 words and the strips next to them, so a
    frequent pair never compares all its positions in a document.
    """
    width = within + 1
    strip = F.floor(F.col("position") / width)
    left = index.withColumn("strip", strip).alias("l")
    right = index.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1))).alias("r")
    return (
        pairs.alias("p")
        .join(left, F.col("p.left") == F.col("l.term"))
        .join(
            right,
            (F.col("p.right") == F.col("r.term"))
            & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
            & (F.col("l.strip") == F.col("r.strip")),
        )
        .filter((F.abs(F.col("l.position") - F.col("r.position")) <= within) & (F.col("l.position") != F.col("r.position")))
        .select("p.left", "p.right", "l.doc_id", F.col("l.position").alias("left_position"), F.col("r.position").alias("right_position"))
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and ``carry``)."""
    windows = item_windows(items, window)
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    lookups = rarest_terms(windows, term_counts(docs, vocabulary))
    lookups = checkpoint(lookups)
    index = checkpoint(postings(docs, lookups.select("term").distinct()))
    found = (
        intersected(index, lookups)
        .join(bounded(windows.select("phrase", "item_ids")), "phrase")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.collect_set(F.struct("start", "n", "phrase", "item_ids")).alias("_met"))
    )
    rows = docs.select("doc_id", *carry, F.col("text").alias("_text"))  # shuffled as text, split afterwards
    valid = F.filter(
        F.coalesce("_met", F.array().cast(found.schema["_met"].dataType)),
        lambda m: F.array_join(F.slice(F.col("_words"), m["start"] + 1, m["n"]), " ") == m["phrase"],
    )
    judged = (
        rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_valid", valid)
        .select(
            "doc_id",
            *carry,
            F.size("_words").cast("long").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.transform("_valid", lambda m: F.sequence(m["start"], m["start"] + m["n"] - 1)))))
            .cast("long")
            .alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("_valid", lambda m: m["item_ids"])))).alias("item_ids"),
        )
    )
    return judged.select(
        "doc_id",
        *carry,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
