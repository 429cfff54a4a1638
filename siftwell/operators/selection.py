"""Exact order statistics of groups of any size, all groups at once, without sorting a group.

A group's value of some rank lies between its least and largest value. That bracket is cut into equal ranges, rows are counted by range (a count is
combined before its shuffle, so a group sends at most ``bins`` rows a task), and the range that holds the rank becomes the bracket, from the
least to the largest value in it. A bracket of one value is the answer; one of few rows is ranked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import shared_folder

BINS, FEW = 1024, 10_000
#: Rows of a table of groups that is broadcast at most.
SMALL = 100_000


def _saved(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/siftwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def order_statistic(rows: DataFrame, by: str, value: str, rank: Callable[[Column], Column], bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, n, mean, value) for each group of ``rows``: the value at ``rank(n)``, from 0, of its n sorted values. Values that are null or not finite take no
    part; a group without others has no row; a null key is a group.

    Each round reads the rows once; values that spread evenly take one round for a factor of ``bins`` in a group's size. A group of which one value holds nearly all rows is no
    hot key: its rows are counted where they are. The table of groups is broadcast up to SMALL rows, beyond them joined."""
    v = F.col("_v")
    rows = rows.select(F.col(f"`{by}`").alias("_g"), F.col(f"`{value}`").cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    first = rows.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    state = _saved(first.withColumns({"rank": rank(F.col("n")).cast("long"), "held": F.col("n")}))
    small = state.limit(SMALL + 1).count() <= SMALL

    def inside(groups: DataFrame) -> DataFrame:
        """Rows within their group's bracket, with its columns."""
        g = groups.select(F.col("_g").alias("_k"), "low", "high", "rank")
        return rows.join(F.broadcast(g) if small else g, F.col("_g").eqNullSafe(F.col("_k")) & (v >= F.col("low")) & (v <= F.col("high")))

    open_ = (F.col("low") < F.col("high")) & (F.col("held") > few)
    while not state.filter(open_).isEmpty():
        width = F.col("high") - F.col("low")
        share = F.when(width < float("inf"), (v - F.col("low")) / width).otherwise((v / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        bin_ = F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")
        counts = inside(state.filter(open_)).groupBy("_g", "rank", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("_g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = counts.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        new = at.select(F.col("_g").alias("_k"), F.struct((F.col("rank") - F.col("before")).alias("rank"), "low", "high", F.col("c").alias("held")).alias("new"))
        met = state.join(F.broadcast(new) if small else new, F.col("_g").eqNullSafe(F.col("_k")), "left")
        state = _saved(met.select("_g", "n", "mean", *[F.coalesce(F.col("new")[c], F.col(c)).alias(c) for c in ("low", "high", "rank", "held")]))
    left = inside(state.filter(F.col("low") < F.col("high"))).withColumn("nth", F.row_number().over(Window.partitionBy("_g").orderBy("_v")) - 1)
    ranked = left.filter("nth = rank").select(F.col("_g").alias("_k"), F.col("_v").alias("found"))
    out = state.join(ranked, F.col("_g").eqNullSafe(F.col("_k")), "left")
    return out.select(F.col("_g").alias(by), "n", "mean", F.coalesce("found", "low").alias(value))
