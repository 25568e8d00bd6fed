"""What Spark takes for smaller than it is, what the driver is sent, and what stays on disk."""

import re
import time

from pyspark.sql import functions as F

import corpus_pipeline
from vendorlens.llm import similar, simhash
from vendorlens.llm.common import stored

from test_similar import planted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_filed_fingerprints_are_never_broadcast(spark):
    """Each fingerprint is filed in 65 rows, so a small table of them makes a large one."""
    fps = stored(spark.createDataFrame([(x,) for x in (0, 1, 3, 12, 1 << 40)], "fp long"), "test-fingerprints")
    pairs = simhash.near_pairs(fps)
    assert "BroadcastHashJoin" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
    assert {tuple(r) for r in pairs.collect()} == {(0, 1), (0, 3), (1, 3), (0, 12), (0, 1 << 40), (1, 1 << 40)}


def test_exploded_shingles_are_never_broadcast(spark, monkeypatch):
    plans, plain = {}, similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, name, **options: (plans.update({name: plan(df)}), plain(df, name, **options))[1])
    similar.near_copies(spark.createDataFrame(planted(), "doc_id long, text string"))
    assert "BroadcastHashJoin" not in plans["shingle-units"] and "SortMergeJoin" in plans["shingle-units"]
    assert "TakeOrderedAndProject" in plans["shingle-frequent"]  # the limit ends in tasks, the driver gets its rows alone


def test_pairs_of_tiles_are_never_broadcast(spark):
    members = spark.range(40).selectExpr("1L AS unit", "id AS key", "600 AS size", "id % 20 AS cluster")
    tiles = similar._tile_pairs(members, 1_000)
    assert tiles.count() > 40
    tiles.collect()
    assert re.findall("SortMergeJoin|BroadcastHashJoin", plan(tiles))[0] == "SortMergeJoin"  # the join of the pairs stands at the top


def test_shuffle_files_go_with_the_write(spark):
    """A job of many stored tables holds the shuffle files of one of them, not of all."""
    before = shuffle_files(spark)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    out = stored(spark.range(20_000).groupBy(F.pmod("id", F.lit(7_000)).alias("k")).count(), "test-shuffled")
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and spark.conf.get(setting) == kept
    assert out.count() == 7_000 and out.agg(F.sum("count")).first()[0] == 20_000


def test_every_group_keeps_its_smallest_document(spark, sf):
    """Document 5 is a copy by one of its texts and the first of its group by the other."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (7, two + " end"), (8, one), (8, two), (9, three), (9, three), (None, two)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, one), (5, one), (5, two), (9, three), (9, three), (None, two)], key=str)
