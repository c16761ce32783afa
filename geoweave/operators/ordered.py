"""Values by their place in an order, and folds in an order, without a single task that sees all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.operators.storage import cut, release

#: Values that one step of a fold puts together.
FAN_IN = 64


def order_statistics(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with b0, b1, ...: the values at places floor(n * share) of the order, counted from one; the first value for places below one.

    Equal values are counted first; what is left is dealt out by ranges of values. Ranges are told apart by their totals, one row each, and
    only within a range values are counted in order. Nulls have no place; without values all are null.
    """
    sizes = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    ranged = cut(sizes.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("range").agg(F.sum("k").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))  # a row for each partition
    upto = F.sum("k").over(Window.partitionBy("range").orderBy("v")) + F.col("before")
    placed = ranged.join(F.broadcast(before), "range").withColumn("upto", upto)
    return placed.agg(*[F.min(F.when(F.col("upto") >= F.floor(F.col("all") * f), F.col("v"))).alias(f"b{i}") for i, f in enumerate(shares)])


def fold_in_order(rows: DataFrame, group: str, order: str, value: str, merge: Callable[[Column, Column], Column], fan_in: int = FAN_IN) -> DataFrame:
    """(group, value): the values of each group put together by merge(a, b) in the order of a column, ties by value.

    merge is associative. Rows are dealt out by ranges of (group, order), numbered within these, and runs of `fan_in` neighbours of a group
    become one row, until each group has one. So a group as large as the table is folded by many tasks, each holding `fan_in` values at a time.
    """
    def folded(chunks: DataFrame, *keys: str) -> DataFrame:
        partial = chunks.groupBy("g", *keys).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("h"))
        one = F.aggregate(F.slice("h", 2, F.size("h")), F.get("h", F.lit(0))["v"], lambda a, x: merge(a, x["v"]))
        return partial.select("g", F.get("h", F.lit(0))["o"].alias("o"), one.alias("v"))

    state = cut(rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("v")), "folded")
    while True:
        n, most = state.groupBy("g").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if most <= fan_in:
            return folded(state).select(F.col("g").alias(group), F.col("v").alias(value))
        ranges = max(1, min(n // fan_in, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        ranged = cut(state.repartitionByRange(ranges, "g", "o", "v").withColumn("range", F.spark_partition_id()), "ranges")
        place = F.row_number().over(Window.partitionBy("range").orderBy("g", "o", "v"))
        new = cut(folded(ranged.withColumn("chunk", F.floor((place - 1) / fan_in)), "range", "chunk"), "folded")
        release(state), release(ranged)
        state = new
