"""Places in an order of all rows, and the row before each, without a window over all of them or over a group of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.storage import materialize

#: ``monotonically_increasing_id`` counts the rows of a partition in so many bits, below the partition's number.
ROW_BITS = 33
#: Rows of a block, as a power of two.
BLOCK_BITS = 9


def in_order(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with ``rid``, a long that ascends in the order of ``keys``, written once. Rows of equal keys are told apart by where they were read, so
    that even one key of most rows is dealt to many partitions."""
    spread = rows.withColumn("_read_at", F.monotonically_increasing_id())
    keys = [*keys, F.col("_read_at").asc()]
    return materialize(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read_at").withColumn("rid", F.monotonically_increasing_id()))


def ranked(rows: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """(``rows`` with ``rank`` 1, 2, 3 ... in the order of ``keys``, their number). The driver gets one row for each partition."""
    placed = in_order(rows, keys).withColumn("_part", F.shiftright("rid", ROW_BITS))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, table = 0, []
    for part, n in sizes:
        table.append((part, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(table, "_part long, _before long"))
    rank = F.col("_before") + F.col("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return placed.join(offsets, "_part").withColumn("rank", rank).drop("_part", "_before", "rid"), before


def ranked_within(rows: DataFrame, group: str, keys: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... within each ``group``, in the order of ``keys``; a group of any size is dealt to many tasks."""
    placed, _ = ranked(rows, [F.col(group).asc(), *keys])
    first = placed.groupBy(group).agg(F.min("rank").alias("_first")).withColumnRenamed(group, "_group")
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first", "_group")


def with_previous(rows: DataFrame, keys: list[Column], columns: list[str]) -> DataFrame:
    """``rows`` with ``previous``, a struct of the ``columns`` of the row before it in the order of ``keys`` (null for the first row).

    A window looks within blocks of rows; a block's first row gets the last one of the block before. The driver gets one row for each partition.
    """
    placed = in_order(rows, keys).withColumn("_block", F.shiftright("rid", BLOCK_BITS))
    per_part = ROW_BITS - BLOCK_BITS
    ends = placed.groupBy(F.shiftright("_block", per_part).alias("part")).agg(F.max("_block").alias("last")).collect()
    last = sorted((r["part"], r["last"]) for r in ends)
    jumps = [((part << per_part), before) for (part, _), (_, before) in zip(last[1:], last, strict=False)]
    table = F.broadcast(rows.sparkSession.createDataFrame(jumps, "_block long, _above long"))
    blocks = placed.select("_block").distinct().join(table, "_block", "left").select("_block", F.coalesce("_above", F.col("_block") - 1).alias("_above"))
    tails = placed.groupBy(F.col("_block").alias("_above")).agg(F.max_by(F.struct(*columns), "rid").alias("_tail"))
    own = F.lag(F.struct(*columns)).over(Window.partitionBy("_block").orderBy("rid"))
    linked = placed.withColumn("previous", own).join(blocks.join(tails, "_above").select("_block", "_tail"), "_block", "left")
    first = F.col("rid").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0
    return linked.withColumn("previous", F.when(first, F.col("_tail")).otherwise(F.col("previous"))).drop("_block", "_tail", "rid")


def with_last(rows: DataFrame, group: str, keys: list[Column], value: str) -> DataFrame:
    """``rows`` with ``last``: the latest ``value`` that isn't null, at or before each row of its ``group`` in the order of ``keys``.

    Windows look within blocks of rows, then over the blocks of a run of blocks, and then over these runs, of which there is one for each quarter of a million rows.
    """
    mark = F.when(F.col(value).isNotNull(), F.struct(F.col(group).alias("g"), F.col(value).alias("v")))
    placed = in_order(rows.withColumn("_mark", mark), [F.col(group).asc(), *keys]).withColumn("_block", F.shiftright("rid", BLOCK_BITS))
    here = Window.partitionBy("_block").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    tails = materialize(placed.groupBy("_block").agg(F.max_by(F.when(F.col("_mark").isNotNull(), F.col("_mark")), F.when(F.col("_mark").isNotNull(), F.col("rid"))).alias("tail"))).withColumn("_run", F.shiftright("_block", BLOCK_BITS))
    runs = tails.groupBy("_run").agg(F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("_block"))).alias("tail"))
    before = lambda w: F.last("tail", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_run", before(Window.orderBy("_run")).alias("_far"))
    carried = tails.select("_block", "_run", before(Window.partitionBy("_run").orderBy("_block")).alias("_near")).join(runs, "_run").select("_block", F.coalesce("_near", "_far").alias("_carried"))
    known = placed.withColumn("_own", F.last("_mark", True).over(here)).join(carried, "_block").withColumn("_at", F.coalesce("_own", "_carried"))
    return known.withColumn("last", F.when(F.col("_at.g").eqNullSafe(F.col(group)), F.col("_at.v"))).drop("_mark", "_block", "_own", "_carried", "_at", "rid")
