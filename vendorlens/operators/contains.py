"""Exact "text contains needle" join without comparing every pair.

Texts are numbered. Blocks of a few fixed lengths, at every place of a text, are listed with the numbers of their texts; a needle is looked up by the
rarest of its longest blocks, each at least half as long as the needle, or nearly. So the rows that meet grow with the texts that are found, not with needles times texts.
Where all blocks of a needle are frequent, bitmaps take less: each character n-gram has the numbers of its texts as bitmaps, 32,768 texts each, and the
candidates are the texts that hold all grams of the needle: the intersection of their bitmaps. Where one gram is rare by itself, its bitmap alone gives the few
candidates, and the others aren't read. Candidates are then verified. A needle with a block no text holds has none. An index can be stored once and read by several joins.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch_path

#: A gram of so few texts is enough by itself.
FEW = 16
#: Lengths of the listed blocks beside n, and how many rows of a list cost as much as one bitmap of 4 KB.
BLOCKS, ROWS = (3, 4, 8, 16, 32), 128


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("array()").cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def _lengths(n: int) -> list:
    return [n, *[k for k in BLOCKS if k > n]]


@dataclass(frozen=True)
class TextIndex:
    """``texts``: ``number, text``, the distinct texts; ``postings``: ``gram, bucket, bitmap, df`` of their grams of ``n`` characters; ``blocks``: ``gram, number``
    of their blocks; ``frequency``: ``gram, df``, how many texts hold a block."""

    n: int
    texts: DataFrame
    postings: DataFrame
    blocks: DataFrame
    frequency: DataFrame


def write_index(texts: DataFrame, n: int, path: str = None) -> TextIndex:
    """Builds the index of the column ``text`` and stores it; ``path``: a new folder that all executors see."""
    spark = texts.sparkSession
    path = path or scratch_path(spark, "text-index")
    # Numbers are stored before they are used, so that they can't change when a task runs again.
    texts.filter("text IS NOT NULL").select("text").distinct().select((F.monotonically_increasing_id() + 1).alias("number"), "text").write.parquet(f"{path}/texts")
    numbered = spark.read.schema("number long, text string").parquet(f"{path}/texts")
    grams = numbered.select("number", F.explode(_grams(F.col("text"), n)).alias("gram"))
    (grams.groupBy("gram", F.bitmap_bucket_number("number").alias("bucket"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"), F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/postings"))
    listed = F.concat(*[_grams(F.col("text"), k) for k in _lengths(n)])
    numbered.select(F.explode(listed).alias("gram"), "number").write.parquet(f"{path}/blocks")
    blocks = spark.read.schema("gram string, number long").parquet(f"{path}/blocks")
    blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/frequency")
    return read_index(spark, path, n)


def read_index(spark: SparkSession, path: str, n: int) -> TextIndex:
    return TextIndex(n, spark.read.schema("number long, text string").parquet(f"{path}/texts"),
                     spark.read.schema("gram string, bucket long, bitmap binary, df long").parquet(f"{path}/postings"),
                     spark.read.schema("gram string, number long").parquet(f"{path}/blocks"),
                     spark.read.schema("gram string, df long").parquet(f"{path}/frequency"))


def _numbers(bits: DataFrame) -> DataFrame:
    """``needle, number`` of the set bits of ``needle, bucket, bits``: first the blocks of 128 bytes, then the words of 8 bytes with any bit are looked at."""
    def some(size, first, count):
        return F.explode(F.expr(f"filter(sequence(0, {count - 1}), i -> substring(bits, {first} + {size} * i + 1, {size}) <> cast(unhex('{'00' * size}') AS binary))"))

    blocks = bits.withColumn("block", some(128, "0", 32))
    words = blocks.withColumn("word", some(8, "128 * block", 16))
    byte = "cast(conv(hex(substring(bits, 128 * block + 8 * word + (i div 8) + 1, 1)), 16, 10) AS int)"
    places = words.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, 63), i -> shiftright({byte}, cast(i % 8 AS int)) & 1 = 1)")))
    # Bit p of bucket b is number (b - 1) * 32768 + p + 1.
    return places.select("needle", ((F.col("bucket") - 1) * 32768 + F.col("block") * 1024 + F.col("word") * 64 + F.col("bit") + 1).alias("number"))


def candidates(needles: DataFrame, index: TextIndex) -> DataFrame:
    """``needle, number`` of the texts that hold all grams of each needle, by bitmaps."""
    frequency = index.postings.groupBy("gram").agg(F.sum("df").alias("df"))
    grams = needles.select("needle", F.explode(_grams(F.col("needle"), index.n)).alias("gram"))
    rarest = (grams.join(frequency, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best"), F.collect_set("gram").alias("grams"))
              .filter("best.df > 0"))
    wanted = rarest.select("needle", F.when(F.col("best.df") <= FEW, F.array("best.gram")).otherwise(F.col("grams")).alias("grams"))
    asked = wanted.select("needle", F.size("grams").alias("asked"), F.explode("grams").alias("gram"))
    met = (asked.join(index.postings.select("gram", "bucket", "bitmap"), "gram").groupBy("needle", "bucket")
           .agg(F.bitmap_and_agg("bitmap").alias("bits"), F.count(F.lit(1)).alias("found"), F.first("asked").alias("asked")))
    return _numbers(met.filter("found = asked").select("needle", "bucket", "bits"))


def looked_up(needles: DataFrame, index: TextIndex) -> DataFrame:
    """``needle, number`` of the texts that may contain each needle: those that hold its rarest block, or by bitmaps where these take less."""
    needle = F.col("needle")
    longest = F.coalesce(*[F.when(F.length(needle) >= k, _grams(needle, k)) for k in reversed(_lengths(index.n))])
    asked = needles.select("needle", F.explode(longest).alias("gram"))
    rarest = (asked.join(index.frequency, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best")).filter("best.df > 0"))
    buckets = index.texts.select(F.bitmap_bucket_number("number").alias("bucket")).distinct().count()
    listed = F.col("best.df") <= F.lit(ROWS * buckets) * (F.length(needle) - (index.n - 1))
    found = rarest.filter(listed).select("needle", F.col("best.gram").alias("gram")).join(index.blocks, "gram").select("needle", "number")
    return found.unionByName(candidates(rarest.filter(~listed).select("needle"), index))


def contains_join(needles: DataFrame, texts: DataFrame, n: int, index: TextIndex = None) -> DataFrame:
    """``needles`` (needle: distinct strings of at least ``n`` characters) joined to ``texts``
    (text and payload columns) wherever the text contains the needle. ``index``: one that holds these texts, and may hold others."""
    index = index or write_index(texts, n)
    found = looked_up(needles, index).join(index.texts, "number").filter(F.contains("text", "needle")).select("needle", "text")
    return texts.join(found, "text")
