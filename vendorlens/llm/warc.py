"""WARC fixity audit with Merkle trees.

Records lie one after another at byte offsets. Leaves are the SHA-256 of records; a node is the SHA-256 of
the digests of up to ``fan`` neighbours and so stands for one range of offsets. Two replicas with equal roots are
equal. Otherwise the audit goes down level by level and looks only at children of nodes that differ.
All steps are joins and groupings on node numbers.
"""

from pyspark.sql import DataFrame, functions as F

from .common import stored
from .sharding import prefix_sums


def to_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record_id, payload``: each page as the bytes of a WARC resource record. Null parts are written as empty ones."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(page_id).alias("record_id"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("payload"))


def lay_out(records: DataFrame, volume_bytes: int = 1 << 30) -> DataFrame:
    """``record_id, payload, size, leaf, offset, volume``, stored: records in order of id, then digest.

    ``offset`` counts bytes from the start of the collection and ``leaf`` records; a volume takes the records that start in its range.
    """
    sized = records.select("record_id", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    placed, _ = prefix_sums(sized, ["record_id", "digest"], "warc-records")
    return placed.select("record_id", "payload", "size", F.col("rows_before").alias("leaf"), F.col("bytes_before").alias("offset"),
                         F.floor(F.col("bytes_before") / volume_bytes).cast("long").alias("volume"))


def leaves(replica: DataFrame) -> DataFrame:
    """``node, digest, start, stop``: the lowest level of a replica's tree, from its ``leaf``, ``offset`` and ``payload``."""
    start = F.col("offset")
    return replica.select(F.col("leaf").alias("node"), F.sha2("payload", 256).alias("digest"), start.alias("start"),
                          (start + F.octet_length("payload")).alias("stop"))


def tree(lowest: DataFrame, fan: int, name: str) -> list:
    """All levels, lowest first; the last one has one node (an empty replica: none)."""
    levels = [stored(lowest, name)]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        # At most ``fan`` digests meet in a group; a digest names its place, so a gap is not mistaken for a shift.
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        joined = F.array_join(F.transform(children, lambda c: F.concat_ws(":", (c["node"] % fan).cast("string"), c["digest"])), ",")
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("node") / fan).cast("long").alias("node"))
                             .agg(F.sha2(joined, 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop")), name))
        top //= fan
    return levels


def audit(first: DataFrame, second: DataFrame, fan: int = 16) -> DataFrame:
    """``leaf, state``: where two laid-out replicas differ; no rows where their roots agree.

    ``state``: ``changed``, ``missing`` (not in the second) or ``extra`` (not in the first). Each replica has at most one record for
    a leaf. Null payloads are changed against any other. Both trees are built over all records; the descent reads only
    children of differing nodes.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    one, two = tree(leaves(first), fan, "warc-tree"), tree(leaves(second), fan, "warc-tree")
    height = max(len(one), len(two))
    differ = None
    for level in reversed(range(height)):
        a, b = (t[level] if level < len(t) else t[0].filter("false") for t in (one, two))
        if differ is not None:
            a, b = (x.join(differ, F.floor(x["node"] / fan) == differ["parent"], "left_semi") for x in (a, b))
        both = (a.select("node", F.col("digest").alias("left")).withColumn("in_first", F.lit(True))
                .join(b.select("node", F.col("digest").alias("right")).withColumn("in_second", F.lit(True)), "node", "full"))
        found = both.filter("NOT (left <=> right) OR in_first IS NULL OR in_second IS NULL")
        if level == 0:
            state = F.when(F.col("in_second").isNull(), "missing").when(F.col("in_first").isNull(), "extra").otherwise("changed")
            return found.select(F.col("node").alias("leaf"), state.alias("state"))
        if min(len(one), len(two)) > level:  # else one tree is lower: all of the taller one's nodes may differ
            differ = stored(found.select(F.col("node").alias("parent")), "warc-differ")


def bit_rot(records: DataFrame, hit) -> DataFrame:
    """A replica with one wrong byte in the middle of the payloads that ``hit`` (a column) is true for."""
    half = (F.octet_length("payload") / 2).cast("int")
    wrong = F.overlay("payload", F.lit(b"\x00"), half + 1, F.lit(1))
    return records.withColumn("payload", F.when(hit, wrong).otherwise(F.col("payload")))
