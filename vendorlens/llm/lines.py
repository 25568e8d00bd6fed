"""Line dedup by a sharded minimal perfect hash: documents probe arrays instead of joining lines.

1. Every line that is long enough becomes a hash of 128 bits: one half chooses its shard and is its fingerprint there, the other one is its mark.
2. Hashes found with several doc_ids go to their shards; each shard builds a minimal perfect hash over them, and three arrays
   in the order of its numbers: fingerprints, counts of lines, smallest doc_id.
3. Documents send the hashes of their lines, without the text, to the shards, which answer with the numbers of the lines to drop.

A line of a third of all documents is one entry of one shard; the probes of a shard with more than its share are dealt to copies of it.
Nothing is broadcast but the number of parts of each shard.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, partitions, stored, tidied
from .perfect import PerfectHash

WHITE = b" \t\n\x0b\x0c\r"
_ROW = ["row_a", "row_b"]


def line_key(line: bytes) -> bytes:
    """What makes lines equal: no white space at the ends, A-Z in lower case."""
    return line.strip(WHITE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    """Whether the key has ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _identity() -> list:
    """Two hashes of id and text: rows with the same are the same row, and get the same answer."""
    return [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(7), F.col("text"), F.col("doc_id")).alias("row_b")]


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """``doc_id, row_a, row_b, line, place, mark``: the two halves of the hash of every line that is long enough."""
    def run(batches):
        for batch in batches:
            rows, numbers, hashes = [], [], []
            for k, data in enumerate(byte_texts(batch.column("text"))):
                for i, line in enumerate((data or b"").split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least_chars):
                        rows.append(k)
                        numbers.append(i)
                        hashes.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in ("doc_id", *_ROW)], pa.array(numbers, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", *_ROW, "line", "place", "mark"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidied(run), f"doc_id {id_type}, row_a long, row_b long, line int, place long, mark long")


def _slot_keys(place: np.ndarray, mark: np.ndarray, seed: int) -> np.ndarray:
    """The 64 bits of a line that its shard hashes."""
    with np.errstate(over="ignore"):
        return mark.view(np.uint64) + np.uint64(seed) * place.view(np.uint64)


def build_shard(table: pa.Table) -> pa.Table:
    """One row for a shard: its perfect hash and its arrays. Two lines of a shard whose 64 bits are equal get others by the next seed."""
    place, mark = (table.column(c).to_numpy() for c in ("place", "mark"))
    seed = next(s for s in range(1, 1000, 2) if len(np.unique(_slot_keys(place, mark, s))) == len(place))
    keys = _slot_keys(place, mark, seed)
    found = PerfectHash.build(keys)
    order = np.argsort(found.numbers(keys))
    bits, starts = found.packed()
    arrays = {c: pa.array([table.column(c).to_numpy()[order].astype("<i8").tobytes()], pa.binary()) for c in ("place", "count", "first")}
    return pa.table({"shard": table.column("shard")[:1].combine_chunks(), "seed": pa.array([seed], pa.int32()),
                     "bits": pa.array([bits], pa.binary()), "starts": pa.array([starts], pa.binary()), **arrays})


def _probe(key, probes: pa.Table, index: pa.Table) -> pa.Table:
    """The probes of lines that the shard knows, but for those of the document that keeps the line."""
    if not index.num_rows or not probes.num_rows:
        return probes.slice(0, 0).select([*_ROW, "line"])
    row = {c: index.column(c)[0].as_py() for c in ("seed", "bits", "starts", "place", "first")}
    place, mark = (probes.column(c).to_numpy() for c in ("place", "mark"))
    number = PerfectHash.unpacked(row["bits"], row["starts"]).numbers(_slot_keys(place, mark, row["seed"]))
    prints, firsts = np.frombuffer(row["place"], "<i8"), np.frombuffer(row["first"], "<i8")
    ids = probes.column("doc_id").combine_chunks()
    same = (firsts[number] == ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
    drop = (number >= 0) & (prints[number] == place) & ~same
    return probes.filter(pa.array(drop)).select([*_ROW, "line"])


def line_index(lines: DataFrame, shard_lines: int = 1 << 18) -> tuple[DataFrame, int]:
    """(``shard, seed, bits, starts, place, count, first`` of the lines found with two doc_ids or more, number of shards).

    A line with one doc_id needs no entry: its fingerprint is not in the arrays, so a probe of it finds nothing. ``count`` are the lines.
    """
    spark = lines.sparkSession
    counted = (lines.groupBy("place", "mark").agg(F.count("*").alias("count"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
               .filter("first < last").select("place", "mark", "count", "first"))
    repeated = stored(counted, "repeated-lines")
    shards = max(partitions(spark), -(-repeated.count() // shard_lines))
    dealt = repeated.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartition(partitions(spark), "shard")
    schema = "shard int, seed int, bits binary, starts binary, place binary, count binary, first binary"
    return stored(dealt.groupBy("shard").applyInArrow(build_shard, schema), "line-index"), shards


def drop_repeated_lines(docs: DataFrame, least_chars: int = 10, doc_id: str = "doc_id", text: str = "text", shard_lines: int = 1 << 18) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs``: its text without the lines that a document with a smaller id keeps.

    Texts are split at \\n; null and empty texts are one empty line. Lines are equal whose keys are (no white space at the ends, A-Z lower-cased).
    A key of ``least_chars`` code points or more found with two doc_ids or more stays in the rows of the smallest of them,
    with all its repeats there, and goes everywhere else. Rows that repeat a doc_id are one document; a row without doc_id makes no line
    repeated and loses those that are. Other lines stay as they are, joined by \\n; ``kept`` is empty where all go. ``shard_lines``: lines in a shard.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", "text", *_identity())
    lines = stored(line_hashes(docs, least_chars), "line-hashes")
    index, shards = line_index(lines.select("doc_id", "place", "mark"), shard_lines)

    probes = lines.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    # Each shard has as many parts as its probes are times the mean, so no task has more than that.
    loads = probes.groupBy("shard").count()
    total = F.lit(lines.count() / shards)
    parts = stored(loads.select("shard", F.ceil(F.col("count") / total).cast("int").alias("parts")), "line-parts")
    parts = F.broadcast(parts)  # a row for each shard, of which there are as many as shuffle partitions or one for shard_lines lines
    dealt = (probes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64(*_ROW), F.col("parts")).cast("int"))
             .select("shard", "part", "doc_id", *_ROW, "line", "place", "mark"))
    copies = (index.drop("count").join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("shard", "part", "seed", "bits", "starts", "place", "first"))
    n = partitions(spark)
    found = (dealt.repartition(n, "shard", "part").groupBy("shard", "part").cogroup(copies.repartition(n, "shard", "part").groupBy("shard", "part"))
             .applyInArrow(_probe, "row_a long, row_b long, line int"))
    dropped = stored(found.groupBy(*_ROW).agg(F.collect_set("line").alias("dropped")), "dropped-lines")

    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    rows = docs.join(dropped, _ROW, "left").select("doc_id", split.alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    size = F.size("lines")
    staying = F.array_except(F.sequence(F.lit(0), size - 1), "dropped")
    return rows.select("doc_id", size.cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
                       F.when(F.size("dropped") == 0, F.array_join("lines", "\n"))
                       .otherwise(F.array_join(F.transform(staying, lambda i: F.element_at("lines", i + 1)), "\n")).alias("kept"))
