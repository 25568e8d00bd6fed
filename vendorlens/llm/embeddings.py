"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of a label are dealt into tiles of about equal size; every two tiles of a label, and each tile with
itself, are one unit of work, so a label with a third of all rows becomes many units. In a unit the int8 product
bounds every cosine from both sides; only pairs whose interval holds the threshold are computed again in double precision.
Units get int8 vectors with their scales and errors alone. A unit reports link counts and a spanning forest of its sure links, and which vectors have
an open pair; these meet again, in full, in a second unit that decides the open pairs. Pairs themselves are never reported.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, stored
from .components import components

SLACK = 1e-9  # above the rounding of double-precision sums of a few thousand terms


def quantize(x: np.ndarray):
    """(int8 values, scale, error) of each row's unit vector; error is the length of what rounding lost."""
    unit = unit_rows(x)
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return q, scale[:, 0], np.sqrt(((unit - q * scale) ** 2).sum(axis=1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; the division by the largest part first avoids overflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def intervals(x, y):
    """Lowest and highest cosine of every row of one tile with every one of another, each given as (int8 values, scale, error).

    With u, v unit vectors, s q their quantised forms and e the errors, |u.v - s q . s' q'| <= e' + e (1 + e').
    """
    (qx, sx, ex), (qy, sy, ey) = x, y
    # Integer products below 2**24 are exact in single precision, others below 2**53 in double.
    kind = np.float32 if 127 * 127 * qx.shape[1] < 1 << 24 else np.float64
    near = (qx.astype(kind) @ qy.astype(kind).T) * sx[:, None] * sy[None, :]
    bound = ey[None, :] + ex[:, None] * (1 + ey[None, :]) + SLACK + 4 * np.finfo(kind).eps
    return near - bound, near + bound


def split_links(x, y, threshold: float, same: bool):
    """(i, j) of the pairs of two tiles that surely link, and (i, j) of those that the bounds leave open; ``same``: y is x, and i < j."""
    low, high = intervals(x, y)
    maybe = high >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    sure = maybe & (low >= threshold)
    return np.nonzero(sure), np.nonzero(maybe & ~sure)


def links(x, y, threshold: float, same: bool):
    """Index arrays (i, j) of the rows of ``x`` and ``y`` with a cosine of at least ``threshold``; ``same``: y is x, and i < j."""
    sure, open_ = split_links(quantize(x), quantize(y), threshold, same)
    i, j = decided(x, y, *open_, threshold)
    return np.concatenate([sure[0], i]), np.concatenate([sure[1], j])


def decided(x, y, i, j, threshold: float):
    """Those of the pairs whose cosine in double precision is at least ``threshold``."""
    kept = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        part = slice(at, at + (1 << 14))
        kept[part] = (unit_rows(x[i[part]]) * unit_rows(y[j[part]])).sum(axis=1) >= threshold
    return i[kept], j[kept]


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Edges (id, id) that connect the same ids as the links between places i and j do, at most one per id."""
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return ids[tied], ids[root[tied]]


_UNIT = ["label", "dim", "low", "high"]
COUNT, EDGE, OPEN = range(3)  # kinds of rows that a unit reports


def _vectors(table: pa.Table) -> np.ndarray:
    return table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _pack(table: pa.Table) -> pa.Table:
    """One row for a tile: its ids and its quantised vectors."""
    first = {c: table.column(c)[:1].combine_chunks() for c in ("label", "dim", "tile", "tiles")}
    q, scale, error = quantize(_vectors(table))
    raw = {"ids": table.column("vec_id").to_numpy().astype("<i8"), "small": q, "scale": scale, "error": error}
    return pa.table({**first, **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in raw.items()}})


def _unpack(row):
    return (np.frombuffer(row["ids"], "<i8"), (np.frombuffer(row["small"], np.int8).reshape(-1, row["dim"]), np.frombuffer(row["scale"]), np.frombuffer(row["error"])))


def _report(table: pa.Table, every: np.ndarray, i: np.ndarray, j: np.ndarray, open_: np.ndarray) -> pa.Table:
    """Counts and forest of the links between places i and j, and the vectors at open places, with the unit they are of."""
    counts = np.bincount(np.concatenate([i, j]), minlength=len(every))
    counted = np.flatnonzero(counts)
    a, b = forest(every, i, j)
    kinds = np.repeat([COUNT, EDGE, OPEN], [len(counted), len(a), len(open_)]).astype(np.int32)
    unit = {c: pa.repeat(table.column(c)[0], len(kinds)) for c in _UNIT}
    return pa.table({**unit, "kind": pa.array(kinds), "a": pa.array(np.concatenate([every[counted], a, every[open_]]).astype(np.int64)),
                     "b": pa.array(np.concatenate([counts[counted], b, np.zeros(len(open_))]).astype(np.int64))})


def _unit(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        tiles = [_unpack(r) for r in table.to_pylist()]
        (ids, x), (ids_y, y) = tiles[0], tiles[-1]
        same = len(tiles) == 1
        (i, j), (p, q) = split_links(x, y, threshold, same)
        every, add = (ids, 0) if same else (np.concatenate([ids, ids_y]), len(ids))
        return _report(table, every, i, j + add, np.unique(np.concatenate([p, q + add])))
    return run


def _open_unit(threshold: float):
    """The vectors of a unit that have an open pair, in full: only the pairs that the bounds leave open are decided here."""
    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _vectors(table)
        right = table.column("tile").to_numpy() != table.column("low").to_numpy()
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        left, other = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        none = np.zeros(0, np.int64)
        if not len(left) or not len(other):
            return _report(table, ids, none, none, none)
        _, (i, j) = split_links(quantize(x[left]), quantize(x[other]), threshold, same)
        i, j = decided(x[left], x[other], i, j, threshold)
        return _report(table, ids, left[i], other[j], none)
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = 1024,
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per vec_id.

    Vectors of one label and one length link where their cosine, in double precision, is at least ``threshold`` (above 0).
    Null labels, null, empty or zero vectors and those with null or non-finite parts link with nothing. Rows that
    repeat a vec_id are one vector (the least by label, then values); rows without vec_id are left out. The
    component is the smallest vec_id reachable by links; ``kept`` is true for it alone.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    one = (vectors.filter(F.col(vec_id).isNotNull())
           .groupBy(F.col(vec_id).cast("long").alias("vec_id"))
           .agg(F.min(F.struct(F.col(label).alias("label"), F.col(embedding).alias("embedding"))).alias("v")))
    one = stored(one.select("vec_id", "v.label", "v.embedding"), "vectors")
    usable = one.filter("""label IS NOT NULL AND size(embedding) > 0
        AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)""")
    usable = usable.withColumn("dim", F.size("embedding"))
    tiles = usable.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = usable.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    label_sql = usable.schema["label"].dataType.simpleString()
    dealt = dealt.select("vec_id", "label", "embedding", "dim", "tile", "tiles")
    packed = stored(dealt.groupBy("label", "dim", "tile").applyInArrow(
        _pack, f"label {label_sql}, dim int, tile int, tiles int, ids binary, small binary, scale binary, error binary"), "tiles")
    # A tile goes to the units it is part of: one per tile of its label.
    units = (packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
             .drop("tile", "tiles", "other").repartition(partitions(spark), *_UNIT))
    schema = f"label {label_sql}, dim int, low int, high int, kind int, a long, b long"
    sure = stored(units.groupBy(*_UNIT).applyInArrow(_unit(threshold), schema), "vector-links")
    again = (sure.filter(F.col("kind") == OPEN).select(F.col("a").alias("vec_id"), "low", "high")
             .join(dealt.drop("tiles"), "vec_id").repartition(partitions(spark), *_UNIT))
    found = sure.filter(F.col("kind") != OPEN).unionByName(stored(again.groupBy(*_UNIT).applyInArrow(_open_unit(threshold), schema), "vector-open-links"))
    counts = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("vec_id")).agg(F.sum("b").alias("n_links"))
    reached = components(found.filter(F.col("kind") == EDGE).select("a", "b")).withColumnRenamed("node", "vec_id")
    return (one.select("vec_id").join(counts, "vec_id", "left").join(reached, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
