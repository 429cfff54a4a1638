"""Numbering the rows of a table in an order, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """``rows`` with ``_part``, the range of their key, of ``parts`` whose edges come from a bounded sample of the keys."""
    keys = rows.select(order)
    sample = sorted(r[0] for r in keys.filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(20 * parts).collect())
    edges = sorted(set(sample[20::20]))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(order))) if edges else F.lit(0)
    return rows.withColumn("_part", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(part))


def numbered_by(rows: DataFrame, by: str, order: str, name: str = "at", size: str = "size", parts: int = 200) -> DataFrame:
    """``rows`` with their number from 0 within their group, in the order of a column, and the size of the group. A group is dealt to ranges of keys as
    well, so a task sees a range of a group; ranges of all groups are counted in a table of at most ``parts`` rows a group."""
    dealt = _dealt(rows, order, parts)
    counts = dealt.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"_before": before, "_total": F.sum("_n").over(group)}).drop("_n")
    met = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)))
    met = met.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return met.withColumns({name: F.col("_before") + F.col("_nth") - 1, size: F.col("_total")}).drop("_part", "_by", "_of", "_before", "_total", "_nth")


def numbered(rows: DataFrame, order: str, name: str = "at", parts: int = 200) -> DataFrame:
    """``rows`` with their number from 0 in the order of a column. Keys are dealt to ``parts`` ranges, whose edges come from a bounded sample of the
    keys and whose sizes are counted, so no task sees them all; the driver gets the edges and the sizes."""
    dealt = _dealt(rows, order, parts)
    sizes = dict(dealt.groupBy("_part").count().collect())
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p], upto = upto, upto + sizes[p]
    entries = [F.lit(x) for p, n in before.items() for x in (p, n)]
    offset = F.element_at(F.create_map(*entries), F.col("_part")) if entries else F.lit(0)
    return dealt.withColumn(name, (offset + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).cast("long")).drop("_part")
