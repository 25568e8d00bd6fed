"""SimHash near-duplicates: popcount vectors on a grid bound the Hamming distance from below.

A 64-bit fingerprint is cut into segments; its embedding is the vector of their bit counts. Two
fingerprints that differ in r bits are at most r apart in Manhattan distance there. Every vector is
filed under all grid points within distance 1, so two vectors within distance 2 share a point: the
range join is an equality join on grid points. The Hamming distance of each candidate is then checked.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, stored, tidied
from .components import components


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, unsigned; 0 where it has no word."""
    found = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return digest(joined, seed)
    length = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(length + 1) - 1
    start = end - length
    count, n = np.zeros(64, np.int64), len(found) - words + 1
    for at in range(0, n, 1 << 16):  # long texts in pieces, to bound the bit matrix
        stop = min(n, at + (1 << 16))
        hashes = [digest(joined[a:b], seed) for a, b in zip(start[at:stop].tolist(), end[at + words - 1:stop + words - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row; a null text has no words."""
    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(x, words, seed) for x in byte_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInArrow(tidied(run), "doc_id long, fp long")


def _counts(segments: int):
    """The embedding packed into one long: the bit count of segment i at bits [i * w, (i + 1) * w)."""
    width, field = 64 // segments, _field(segments)
    mask = (1 << width) - 1
    parts = [F.shiftleft(F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))).cast("long"), i * field) for i in range(segments)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def _field(segments: int) -> int:
    return {8: 4, 16: 3, 32: 2}[segments]


def _filed(fps: DataFrame, segments: int, radius: int) -> DataFrame:
    """``cell, step, fp``: each fingerprint under its own grid point (step 0) and those one step away."""
    width, field = 64 // segments, _field(segments)
    steps, mask = list(range(-segments, segments + 1)) if radius else [0], (1 << field) - 1
    at = f"(abs(step) - 1) * {field}"
    new = F.expr(f"(shiftright(own, {at}) & {mask}) + sign(step)").cast("long")  # the bit count of the segment after the step
    moved = F.expr(f"own & ~shiftleft(CAST({mask} AS BIGINT), {at})").bitwiseOR(F.call_function("shiftleft", new, F.expr(at)))
    still = F.col("step") == 0
    return (fps.select("fp", _counts(segments).alias("own"))
            .select("fp", "own", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
            .filter(still | new.between(0, width)).select(F.when(still, F.col("own")).otherwise(moved).alias("cell"), "step", "fp"))


def near_pairs(fps: DataFrame, max_bits: int = 2, segments: int = 32) -> DataFrame:
    """``a, b``: every pair of distinct fingerprints at most ``max_bits`` (0 to 2) apart, once.

    The rows are expected to be distinct. A pair shares several grid points; it is met at one of them: at
    the own point of the first fingerprint where the vectors are at most one apart, else at the point reached by
    the lower-numbered step. More segments mean more grid points per fingerprint and fewer fingerprints per
    point: with 32, the fullest point holds about one in 130 million of random fingerprints, with 16 one in 290,000, so only 32 keep
    the candidates of a point few when there are billions of texts.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2: two grid steps reach no farther")
    left, right = _filed(fps, segments, max_bits).alias("l"), _filed(fps, segments, max_bits).alias("r")
    once = F.expr("""CASE WHEN l.step = 0 THEN true WHEN r.step = 0 THEN false
                     WHEN abs(l.step) = abs(r.step) THEN l.step = -r.step ELSE abs(l.step) < abs(r.step) END""")
    exact = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits
    # Never a broadcast: Spark takes what is filed for as large as the fingerprints, of which each is 65 rows.
    joined = left.join(right.hint("merge"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp")) & once & exact)
    return joined.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, max_bits: int = 2, segments: int = 32,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; the component is the smallest doc_id reachable.
    Work on pairs is done between distinct fingerprints only, so a group of copies counts as one whatever
    its size. Null and empty texts share the fingerprint zero and link like any other. Repeated rows give
    repeated equal rows. A row without doc_id has a fingerprint and, where no row of its group has an id, a null component.
    """
    fps = stored(fingerprints(docs, words, seed, doc_id, text), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-groups")
    pairs = near_pairs(groups.select("fp"), max_bits, segments)
    linked = stored(pairs, "fingerprint-links")
    reached = components(linked)  # over fingerprints; only those with a link
    least = (reached.join(groups.withColumnRenamed("fp", "node"), "node")
             .groupBy("component").agg(F.min("first").alias("least")))
    moved = reached.join(least, "component").select(F.col("node").alias("fp"), "least")
    # Stored, so that both sides of the last join are plain exchanges, whose large partitions AQE can split.
    owner = stored(groups.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "fingerprint-owners")
    return fps.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
