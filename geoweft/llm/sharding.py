"""Contiguous shards of equal bytes from global prefix sums.

Rows lie in the order of their ids, dealt by range. Each partition's total of bytes and rows gives, summed over the
partitions before it, where its own prefix sums start; one row per partition takes part in that step. A row goes to
the shard in whose equal share of all bytes its middle lies, so shards are contiguous and differ by about a row.

Only ids, sizes and checksums move; texts are read once and stay. DataFrame functions only.

Defined results: null text has no bytes but counts `overhead`; repeated rows are rows of their own, in the order of
checksum and size; an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm._common import cut

SHARDS = 24
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, *, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 within the shard), first_byte."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    rows = cut(rows)  # texts are read once; ranges are sampled from three numbers a row
    rows = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    whole = rows.agg(F.sum("size")).first()[0] or 1
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(own)).withColumn("nth", F.row_number().over(own))
    placed = placed.join(F.broadcast(starts), "part")  # one row per partition
    first = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = cut(placed.select("doc_id", "size", "text_crc32", first.alias("first_byte"), (F.col("rows_before") + F.col("nth") - 1).alias("rank"), F.expr(f"cast(least({shards - 1}, (2 * (bytes_before + upto - size) + size) * {shards} div {2 * whole}) as int)").alias("shard")))
    heads = placed.groupBy("shard").agg(F.min("rank").alias("head"))
    return placed.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("head")).alias("slot"), "first_byte")
