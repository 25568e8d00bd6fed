"""Contiguous shards of nearly equal bytes, cut by global prefix sums.

Documents get one global order; the running byte total before a document says which shard it is in.
The total comes from two levels: a running sum inside each range partition, and the sums of whole
partitions before it. Only the latter (one row per partition) meet in one place.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import partitions, stored


def _running(batches):
    """Adds the partition number and the bytes and rows before each row inside the partition."""
    part, bytes_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = np.cumsum(size) + bytes_before
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(upto - size),
             pa.array(np.arange(len(size), dtype=np.int64) + rows_before)],
            names=[*batch.schema.names, "_part", "_bytes", "_rows"])
        rows_before += len(size)
        bytes_before = int(upto[-1]) if len(size) else bytes_before


def prefix_sums(rows: DataFrame, order: list, name: str) -> tuple:
    """``rows`` with ``bytes_before`` and ``rows_before``: the sum of ``size``, and the rows, before each in the global ``order``.

    Also the sum over all. The sorted rows are stored, so ties can't fall differently when a task runs again.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = StructType([*ranged.schema.fields, StructField("_part", IntegerType()), StructField("_bytes", LongType()), StructField("_rows", LongType())])
    summed = stored(ranged.mapInArrow(_running, schema), name)
    # One row per range partition, so the driver sees as many numbers as there are partitions.
    totals = sorted(tuple(r) for r in summed.groupBy("_part").agg(F.sum("size"), F.count("*")).collect())
    starts, size, count = [], 0, 0
    for part, part_size, part_count in totals:
        starts.append((part, size, count))
        size, count = size + part_size, count + part_count
    offsets = spark.createDataFrame(starts, "_part int, _size long, _count long")
    placed = (summed.join(F.broadcast(offsets), "_part")
              .withColumn("bytes_before", F.col("_bytes") + F.col("_size")).withColumn("rows_before", F.col("_rows") + F.col("_count")))
    return placed.drop("_part", "_bytes", "_rows", "_size", "_count"), size


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1). The global order is (MD5 of the text, doc_id), so
    equal texts lie side by side and shards stay independent of the order of the input. A document belongs
    to the shard in which its middle byte falls, hence a shard is off its equal target by at most one
    document at either end. ``slot`` counts from 0 without gaps inside a shard. Rows repeated whole get slots of their own;
    a null doc_id is first among equal texts; an empty table gives no rows. A shard stays empty
    only where one document is larger than a target.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = stored(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), F.md5(whole.cast("binary")).alias("at")), "shard-sizes")
    placed, total = prefix_sums(sized, ["at", "doc_id", "text_crc32"], "shard-sums")
    # In whole numbers: they hold 2**62 bytes over the number of shards, and an overflow is an error.
    middle = F.expr(f"(bytes_before * 2 + size) * {shards}L div {max(2 * total, 1)}L")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle.cast("int")))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot")))
