"""Windows over long groups, computed block by block.

A plain window puts a whole group into one task. Here a group is cut into blocks of its
order column; the window runs within (group, block), and what passes over a border comes
from a summary with one row for each block. order must be BIGINT and distinct within keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds of a block: at most so many rows of one group meet in a task.
WIDTH = 86_400


def block_of(order: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def with_next(df: DataFrame, keys: list[str], order: str, take: dict[str, str], width: int = WIDTH) -> DataFrame:
    """df with, for each name -> column of take, that column of the next row of the group; null for the last."""
    rows = df.withColumn("_blk", block_of(order, width))
    row = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(n) for n, c in take.items()])
    first = rows.groupBy(*keys, "_blk").agg(F.min(row).alias("_first"))
    first = first.select(*keys, "_blk", F.lead("_first").over(W.partitionBy(*keys).orderBy("_blk")).alias("_after"))
    rows = rows.withColumn("_next", F.lead(row).over(W.partitionBy(*keys, "_blk").orderBy(order)))
    rows = rows.join(first, [*keys, "_blk"]).withColumn("_next", F.coalesce("_next", "_after"))
    return rows.select(*[F.col(c) for c in df.columns], *[F.col(f"_next.{n}").alias(n) for n in take])


def with_running_max(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the greatest value of the group up to and with each row, nulls left out."""
    rows = df.withColumn("_blk", block_of(order, width)).withColumn("_val", value)
    top = rows.groupBy(*keys, "_blk").agg(F.max("_val").alias("_top"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    top = top.select(*keys, "_blk", F.max("_top").over(before).alias("_carry"))
    upto = W.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.max("_val").over(upto)).join(top, [*keys, "_blk"])
    return rows.select(*[F.col(c) for c in df.columns], F.greatest("_run", "_carry").alias(name))


def as_of(df: DataFrame, other: DataFrame, keys: list[str], at: str, order: str, name: str, forward: bool = False, width: int = WIDTH) -> DataFrame:
    """df with the greatest order of other's rows of the same keys at or before at (forward: the least at or after); null where none is.

    Rows of both are put together by key and block of time, so neither a long interval nor a long
    group is ever expanded. order and at are BIGINT; rows of df with a null key or at get null.
    """
    sign = -1 if forward else 1
    points = other.select(*keys, (F.col(order) * sign).alias("_t"), (F.col(order) * sign).alias("_o")).unionByName(df.select(*keys, (F.col(at) * sign).alias("_t"), F.lit(None).cast("bigint").alias("_o")))
    points = points.dropna(subset=[*keys, "_t"]).groupBy(*keys, "_t").agg(F.max("_o").alias("_o"))
    found = with_running_max(points, keys, "_t", F.col("_o"), "_found", width)
    found = found.select(*keys, (F.col("_t") * sign).alias(at), (F.col("_found") * sign).alias(name))
    return df.join(found, [*keys, at], "left").select(*df.columns, name)


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place, from 0, of each row in the order of the columns, which must part all rows.

    Rows are range-sorted; ranks are those within a part plus the rows of the parts before.
    """
    from wayspan.session import cut

    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # one row for each part
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_w", within).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_w") - 1).cast("bigint").alias(name))


def by_cells(df: DataFrame, start: Column, end: Column, width: int, name: str = "_cell") -> DataFrame:
    """A row of df for each cell of width seconds that [start, end) touches, for range joins on equal cells.

    Rows with start >= end have no cell. A long interval has many cells: where its end may lie far
    beyond all that it is joined with, give the lesser end.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    return df.where(start < end).withColumn(name, F.explode(F.sequence(cell(start), cell(end - 1))))
