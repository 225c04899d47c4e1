"""Order-dependent operators for groups of any size.

A window partitioned by a group key runs each group in one task.  Groups here (a
data source, a whole table, one long transcript) may hold a third of all rows, so
positions are computed over range partitions instead: sort globally, count inside
each range partition, and add the totals of the ranges before it.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    """One folder for each application; the setting itself cannot be changed at run time."""
    return tempfile.mkdtemp(prefix="oligo-checkpoint-")


_OPEN: ContextVar[Tables | None] = ContextVar("tables", default=None)


class Tables:
    """Owns the tables that are materialised while it is open and deletes them at its end,
    after a failure too.

    Results read from those tables must be stored before the end, by the caller or with
    ``keep``.  Blocks nest; threads take part if they run in a copy of the context.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._token = _OPEN.set(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """A table that outlives this block; the block around it owns it, if there is one."""
        around = self._token.old_value
        return _written(df, None if around is Token.MISSING else around)

    def __exit__(self, *_) -> None:
        _OPEN.reset(self._token)
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage and
    survives the loss of executors.  An open ``Tables`` deletes it in the end."""
    return _written(df, _OPEN.get())


def _written(df: DataFrame, owner: Tables | None) -> DataFrame:
    path = f"{checkpoint_root(df.sparkSession)}/oligo/{uuid.uuid4().hex}"
    if owner is not None:
        owner.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out before each of them is expanded a hundred- or thousandfold.

    Few, uneven input splits would otherwise leave the expansion to few tasks; moving
    the rows first costs little next to what they expand to.  With keys, the
    partitioning survives the narrow steps after it, so windows on the keys need no
    shuffle of the expanded rows; without keys rows go round robin, so no key is hot.
    The number is explicit, or AQE would merge the small partitions into one.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def with_running_total(
    df: DataFrame,
    group_by: list[str],
    order_by: list[Column],
    weight: Column,
    name: str,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the group (exclusive).

    ``order_by`` must be total within a group; that also lets the range partitioner
    split a hot group.  Each window below sees one range partition's share of a
    group, or one row per range partition.
    """
    keys = [F.col(c) for c in group_by]
    ranged = materialise(
        df.withColumn("_weight", weight).orderBy(*keys, *order_by).withColumn("_range", F.spark_partition_id())
    )
    within = W.partitionBy("_range", *keys).orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumn("_local", F.sum("_weight").over(within) - F.col("_weight"))
    totals = _offsets(ranged.groupBy("_range", *keys).agg(F.sum("_weight").alias("_total")), group_by, F.lit(0))
    return _placed(local, totals, df.columns, group_by, F.col("_local") + F.col("_offset"), name)


def with_row_index(
    df: DataFrame, group_by: list[str], order_by: list[Column], name: str = "row_index"
) -> DataFrame:
    """0-based position inside the group in the given (total) order.

    A sorted row's number tells its range partition and its place there, and a group's
    rows stand together, so positions need no window and rows move once, for the sort.
    """
    keys = [F.col(c) for c in group_by]
    ranged = materialise(df.orderBy(*keys, *order_by).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counted = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_total"), F.min("_at").alias("_first"))
    totals = _offsets(counted, group_by, F.col("_first"))
    return _placed(ranged, totals, df.columns, group_by, F.col("_at") + F.col("_offset"), name)


def _offsets(counted: DataFrame, group_by: list[str], less: Column) -> DataFrame:
    """_range, the keys and _offset: the totals of a group's ranges before this one, ``less``
    subtracted. Written down, so that the join with it is planned on its measured size."""
    keys = [F.col(c) for c in group_by] or [F.lit(1)]
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offset = F.sum("_total").over(before) - F.col("_total") - less
    return materialise(counted.select("_range", *group_by, offset.alias("_offset")))


def _placed(rows: DataFrame, totals: DataFrame, columns: list[str], group_by: list[str], place: Column, name: str) -> DataFrame:
    same = F.col("l._range") == F.col("t._range")
    for c in group_by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}"))
    return rows.alias("l").join(totals.alias("t"), same).select(*[F.col(f"l.{c}") for c in columns], place.alias(name))


def with_average_rank(df: DataFrame, group_by: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Average (tie-sharing) rank of distinct (group, value) rows carrying a count."""
    ranked = with_running_total(df, group_by, [F.col(value)], F.col(weight), "_before")
    return ranked.withColumn(name, F.col("_before") + (F.col(weight) + 1) / F.lit(2.0)).drop("_before")


def top_per_group(df: DataFrame, group_by: list[str], order_by: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group, numbered from 1.

    Spark limits each group on the map side before the shuffle, so a hot group sends
    at most ``n`` rows per task.
    """
    w = W.partitionBy(*group_by).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def rank_all(df: DataFrame, group_by: list[str], order_by: list[Column], name: str = "rank") -> DataFrame:
    """Number every row of every group from 1, for groups of any size."""
    return with_row_index(df, group_by, order_by, "_index").withColumn(
        name, (F.col("_index") + 1).cast("int")
    ).drop("_index")
