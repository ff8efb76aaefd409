"""What several training-data operators need: input shaping, lineage cuts, and exchanges of packed rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: str | Column) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that further columns of any name can't clash.

    The text travels as UTF-8 bytes; null stays null.
    """
    extra = [F.col(x) if isinstance(x, str) else x for x in more]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *extra)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which a cluster shares. Where it is unset, a folder of our own in local mode, an
    error on a cluster, whose machines couldn't see such a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="geoweft-checkpoint-"))
    return sc.getCheckpointDir()


#: Stands for a null id where ids are packed as numbers: behind all others.
NO_ID = (1 << 63) - 1


def packed_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def unpacked_id(name: str) -> Column:
    """The id behind packed_id(), under the same name."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder: what follows survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as a compressed table of the shared folder: for wide rows, which checkpoint files would hold as they are."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def blob_partitions(rows: int, per_partition: int) -> int:
    """How many partitions hold `rows` rows at about `per_partition` each."""
    return max(1, -(-int(rows) // per_partition))


#: So many ids (eight bytes each) may be broadcast.
BROADCAST_IDS = 1 << 20


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the ids of gone (one column id_col). Few ids, counted first, go to the rows; many meet them by shuffle."""
    gone = cut(gone.distinct())
    n = gone.count()
    if not n:
        return docs
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, id_col, "left_anti")


#: One exchange deals packed rows to so many parts at most; more parts take a second step.
FAN = 1024


def packed_parts(rows: np.ndarray, hashes: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    """rows cut into `parts` equal ranges of their 64-bit hashes: (part, bytes), without the empty ones."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    if len(part) and (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
    held, first = np.unique(part, return_index=True)
    return held.tolist(), [x.tobytes() for x in np.split(rows, first[1:])] if len(held) else []


def dealt(blobs: DataFrame, partitions: int, kinds: dict[int, tuple[np.dtype, Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """(part, kind, blob) with each part's rows in one of `partitions` partitions.

    blobs: (part, salt, kind, blob) as packed_parts(rows, hashes, min(FAN, partitions)) cuts them; salt tells a task's
    chunks apart; kinds gives the type and hashes of rows by kind, other kinds hold something else and may go to any task.
    Up to FAN partitions one exchange does. Beyond, the rows of a coarse part first meet in as many tasks as it has fine
    ones, which cut them anew, so that a chunk never makes a row for each of very many partitions.
    """
    if partitions <= FAN:
        return blobs.select("part", "kind", "blob").repartition(partitions, "part")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {k: [] for k in kinds}
        for batch in batches:
            passed = batch.filter(pa.array([k not in kinds for k in batch.column("kind").to_pylist()], pa.bool_()))
            if passed.num_rows:
                yield passed
            for k, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if k in kinds:
                    held[k].append(blob)
        for k, (kind, hash_of) in kinds.items():
            rows = np.frombuffer(b"".join(held.pop(k)), kind)
            parts, cut_rows = packed_parts(rows, hash_of(rows), partitions)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([k] * len(parts), pa.int32()), pa.array(cut_rows, pa.binary())], names=["part", "kind", "blob"])

    fine = F.pmod(F.xxhash64("salt"), F.lit(-(-partitions // FAN)))
    return blobs.repartition(partitions, "part", fine).select("part", "kind", "blob").mapInArrow(again, "part int, kind int, blob binary").repartition(partitions, "part")


#: Keys of more than HOT_ROWS rows and more than 1/HOT_PARTS of all are fewer than HOT_PARTS, and are broadcast.
HOT_ROWS, HOT_PARTS = 1000, 1 << 16


def matched(rows: DataFrame, table: DataFrame, key: str, times: str, total: int, spread: str) -> DataFrame:
    """rows left-joined with table (unique in key, other columns than rows), whatever number of rows a key has.

    times: the column of table that counts its key's rows, total: all rows. Hot keys are broadcast, behind the bound that
    follows from total; their rows are spread over the shuffle by the column `spread`, the others meet table by key.
    """
    most = max(HOT_ROWS, total // HOT_PARTS)
    values = [c for c in table.columns if c != key]
    hot = table.filter(F.col(times) > most).select(F.col(key), F.struct(*values).alias("_hot"))
    rest = table.filter(F.col(times) <= most).select(F.col(key), F.struct(*values).alias("_rest"), F.lit(0).cast("long").alias("_spread"))
    found = rows.join(F.broadcast(hot), key, "left")
    found = found.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 40))))
    return found.join(rest, [key, "_spread"], "left").withColumn("_hot", F.coalesce("_hot", "_rest")).select(*rows.columns, "_hot.*")


#: Rows that one task numbers.
NUMBERED_ROWS = 1 << 16


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(row, id, text) with a number for each row, in the order of the ids, nulls last; None where ids are unique and never
    null, so that they can serve themselves. Rows of one id, or without one, would else meet each other at every join."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        return None
    rows = docs.select(packed_id(id_col).alias("packed"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("nth"))
    rows = cut(rows)  # `nth` is fixed from here on
    dealt = rows.repartitionByRange(blob_partitions(rows.count(), NUMBERED_ROWS), "packed", "nth").sortWithinPartitions("packed", "nth")
    dealt = cut(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "packed", "text"))
    totals = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per task
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    placed = dealt.join(F.broadcast(starts), "part")
    return cut(placed.select((F.col("start") + F.col("at")).alias("row"), unpacked_id("packed").alias("id"), "text"))


def named(found: DataFrame, rows: DataFrame, other: str) -> DataFrame:
    """found, whose doc_id and `other` are numbers of numbered(), with the ids of the rows instead."""
    names = rows.select("row", "id")
    found = cut(found)
    table = found.groupBy(F.col(other).alias("row")).agg(F.count(F.lit(1)).alias("times")).join(names, "row").select(F.col("row").alias(other), F.col("id").alias("other_id"), "times")
    own = found.join(names.select(F.col("row").alias("doc_id"), F.col("id").alias("own_id")), "doc_id")
    both = matched(own, table, other, "times", found.count(), "doc_id")
    return both.select(*[F.col("own_id").alias(c) if c == "doc_id" else F.col("other_id").alias(c) if c == other else F.col(c) for c in found.columns])
