"""What the operators of this folder share: the shared folder, stored tables, text as bytes."""

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.scratch import scratch_path


#: Spark removes the shuffle files of a query at its end.
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage, so nothing is computed twice and a lost executor costs one task, not the job. Nothing reads the
    shuffle files of the write again, so they go as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_FILES_GO)
    spark.conf.set(_FILES_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_FILES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(doc_id) -> Column:
    """crc32 of an id written as text; the folds of the learning operators are cut by it."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def bounded_sample(keys: DataFrame, group: str, per_group: int, most_groups: int = 1000) -> DataFrame:
    """``id`` and ``group`` of at most ``per_group`` ids of each group, chosen by hash of the id.

    So the choice doesn't depend on the order or partitions of the input. A count of each group gives the range of hashes
    that holds about twice the wanted ids; only those are shuffled and ranked, so a group of a third of all rows is cut where it is
    read. Groups are the classes of a model: more than ``most_groups`` are refused, since a model holds them all.
    """
    space = 1 << 30
    counts = keys.groupBy(group).count().limit(most_groups + 1).collect()
    if len(counts) > most_groups:
        raise ValueError(f"more than {most_groups} different values of {group}")
    if not counts:
        return keys.select("id", group).limit(0)
    ends = F.create_map(*[F.lit(x) for g, n in counts for x in (g, min(space, 2 * per_group * space // n))])
    at = F.pmod(F.xxhash64("id"), F.lit(space))
    near = keys.filter(at < ends[F.col(group)]).select("id", group).distinct().withColumn("at", at)
    order = Window.partitionBy(group).orderBy("at", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_group).select("id", group)


def tidy():
    """Hands freed memory back to the system. Spark keeps Python workers for the tasks of later stages, and beside
    them other workers and the JVM need room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run):
    """A function for mapInArrow that tidies up when its partition ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()
    return wrapped


def sliced(batches, rows: int = 1000):
    """The batches in slices of ``rows`` rows, for work that holds much more than the text of a row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_texts(column: pa.Array) -> list:
    """The values of a string column as UTF-8 bytes, null as None."""
    return column.cast(pa.large_binary()).to_pylist()


def with_texts(batch: pa.RecordBatch, text: str, n_chars: str, values: list, changed: dict) -> pa.RecordBatch:
    """The batch with ``values`` (bytes) as its texts, and the lengths of the ``changed`` ones (place to bytes) in ``n_chars``, if it has that column, of whole numbers."""
    if not changed:
        return batch
    at = batch.schema.get_field_index(text)
    batch = batch.set_column(at, batch.schema.field(at), pa.array(values, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type))
    at = batch.schema.get_field_index(n_chars)
    if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):
        counts = batch.column(at).to_pylist()
        for i, data in changed.items():
            counts[i] = len(data.decode())
        batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
    return batch
