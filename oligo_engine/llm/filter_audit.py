"""Interaction audit of corpus filters over every order of applying them.

Each document becomes a cell: its part and a mask of the filters it fails. Cells are
counted once over the whole corpus, at most 32 masks for a part whatever its size. Every
cell then folds across the array of all orders: ``aggregate`` walks an order's steps with
the mask still to be judged, ``transform`` runs it over the orders, and one weighted
struct comes out for each order and step (600). The structs of a part's cells are added
up element by element.

Filters (failure): A under ``min_words`` words; B under ``distinct_percent`` distinct words
of 100; C over ``capital_percent`` capitals A-Z of 100 code points; D holds one of
``#$%&*|``; E identical to the text of a smaller doc_id anywhere in the table.

Hot groups: equal texts meet as digests, pre-aggregated to their smallest id before the
shuffle, and the join that brings the id back is one Spark can split, so a text that a
third of all documents share is no task of its own.

Defined results: a null text is an empty one; a null lang and an empty one are the part
``''``; a null doc_id is neither smaller nor larger than another, so it never fails E and
never makes another fail; rows that repeat an id and its text do not fail E for each other
and are counted each; a label row that repeats an id counts once, with its largest values; a
document without labels has none; further columns, of any name, are ignored; an empty table
has no part and gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from oligo_engine.llm.common import Scratch, checkpoint

FILTERS = "ABCDE"
SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text: Column, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> Column:
    """The bits of A to D (1, 2, 4, 8) that a text fails."""
    trimmed = F.btrim(text, F.lit(SPACES))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))

    def judged(w: Column) -> Column:
        n, distinct = F.size(w), F.size(F.array_distinct(w))
        few = F.when(n < min_words, 1).otherwise(0)
        return few + F.when(100 * distinct < distinct_percent * n, 2).otherwise(0)

    # one element: the words are split once and used twice
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    by_words = F.transform(F.array(words), judged)[0]
    by_capitals = F.when(100 * capitals > capital_percent * F.length(text), 4).otherwise(0)
    return by_words + by_capitals + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures(text, **limits).alias("own"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marked = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    with Scratch(docs.sparkSession) as tables:
        return checkpoint(counted(tables.keep(rows), marked))


def counted(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Documents by part and mask, E (16) included."""
    # only texts that come under two ids can fail E
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    firsts = firsts.select(F.col("digest").alias("_digest"), "first").hint("rebalance", "_digest")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
        .join(marked, F.col("doc_id") == F.col("_id"), "left")
        .groupBy("part", (F.col("own") + F.when(again, 16).otherwise(0)).alias("mask"))
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )


def orders(filters: str = FILTERS) -> list[tuple[str, list[int]]]:
    """Every order of the filters with the bits of its steps."""
    return [("".join(o), [1 << filters.index(f) for f in o]) for o in permutations(filters)]


#: One struct for each step of one order. ``open`` says whether the cell's documents are
#: still there; a step's filter removes them where its bit is in the mask.
FOLD = f"""
aggregate(
  o.steps,
  named_struct('open', 1L, 'out', array_repeat(named_struct(
    'filter_order', '', 'step', 0, 'bit', 0, {", ".join(f"'{c}', 0L" for c in COUNTS)}), 0)),
  (s, bit) -> named_struct(
    'open', IF(mask & bit > 0, 0L, s.open),
    'out', s.out || array(named_struct(
      'filter_order', o.name,
      'step', size(s.out) + 1,
      'bit', bit,
      'kept', n * IF(mask & bit > 0, 0L, s.open),
      'removed', n * IF(mask & bit > 0, s.open, 0L),
      'redundant', n * IF(mask & bit > 0, 1L - s.open, 0L),
      'unique_fails', IF(mask = bit, n, 0L),
      'good_lost', good * IF(mask & bit > 0, s.open, 0L),
      'toxic_lost', toxic * IF(mask & bit > 0, s.open, 0L)))),
  s -> s.out)
"""
#: Cells of one part, added up element by element.
MERGE = f"""
aggregate(slice(cells, 2, size(cells)), cells[0], (s, c) -> zip_with(s, c, (x, y) -> named_struct(
  'filter_order', x.filter_order, 'step', x.step, 'bit', x.bit, {", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS)})))
"""
SHAPLEY = "map_from_arrays(bits, transform(bits, b -> aggregate(filter(sums, s -> s.bit = b), 0L, (a, s) -> a + s.removed)))"


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, filter_order, step and the counts: a row for each part, order and step."""
    spark = docs.sparkSession
    every = spark.createDataFrame([(orders(),)], "orders array<struct<name:string,steps:array<int>>>")
    folded = (
        cells(docs, labels, **limits)
        .withColumn("orders", every.scalar())  # one value, sent to all tasks
        .select("part", F.expr(f"flatten(transform(orders, o -> {FOLD}))").alias("cell"))
    )
    return (
        folded.groupBy("part")
        .agg(F.collect_list("cell").alias("cells"))  # at most 32 for a part
        .select("part", F.expr(MERGE).alias("sums"), F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]).alias("bits"))
        .select("part", "sums", F.expr(SHAPLEY).alias("shares"))
        .select("part", "shares", F.explode("sums").alias("sum"))
        .select("part", "sum.filter_order", "sum.step", *[f"sum.{c}" for c in COUNTS], F.col("shares")[F.col("sum.bit")].alias("shapley"))
    )
