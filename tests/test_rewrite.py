"""State changes of a stored table write the partitions they touch, and no others."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from vendorlens.operators import rewrite, state
from vendorlens.sources.sinks import write_table

SCHEMA = "account_id string, message_id string, vendor_key string, type string, status string, size_bytes long, unsubscribe_url string, bucket int, month string"
PARTITION = ["bucket", "month"]


def table(spark, path):
    rows = [(f"a{k % 4}", f"m{k}", f"v{k % 5}", "bulk" if k % 2 else "order", None, k, "u" if k % 3 else None, k % 4, None if k % 11 == 0 else f"2024-0{k % 3 + 1}") for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    write_table(frame, path, PARTITION)
    return frame


def files(path):
    return {str(p): (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted(map(str, df.select(*[f.split()[0] for f in SCHEMA.split(", ")]).collect()))


def stored(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    base, before = table(spark, path), None
    ids = base.filter("message_id IN ('m5', 'm17', 'm33', 'nothing')").select(*state.ID)
    before = files(path)
    assert rewrite.delete_ids(spark, path, SCHEMA, PARTITION, ids) == 2
    after = files(path)
    touched = {(r["bucket"], r["month"]) for r in base.join(ids, state.ID, "left_semi").collect()}
    names = {f"bucket={b}/month={m or '__HIVE_DEFAULT_PARTITION__'}/" for b, m in touched}
    kept = {f: v for f, v in before.items() if not any(n in f for n in names)}
    assert kept and kept == {f: v for f, v in after.items() if not any(n in f for n in names)}
    assert rows(stored(spark, path)) == rows(state.delete_ids(base, ids))


def test_partitions_may_lose_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    base = table(spark, path)
    gone = base.filter("account_id = 'a1' OR month IS NULL").select(*state.ID)
    assert rewrite.delete_ids(spark, path, SCHEMA, PARTITION, gone) == 7
    assert rows(stored(spark, path)) == rows(state.delete_ids(base, gone))
    accounts = spark.createDataFrame([("a2",), ("none",)], "account_id string")
    rewrite.reset_accounts(spark, path, SCHEMA, PARTITION, accounts)
    assert rows(stored(spark, path)) == rows(state.delete_ids(base, gone).filter("account_id <> 'a2'"))


def test_marks_and_nothing_to_do(spark, tmp_path):
    path = str(tmp_path / "t")
    base, keys = table(spark, path), spark.createDataFrame([("a0", "v1"), ("a3", "v2")], "account_id string, vendor_key string")
    before = files(path)
    assert rewrite.mark_unsubscribed(spark, path, SCHEMA, PARTITION, keys.limit(0)) == 0 and files(path) == before
    rewrite.mark_unsubscribed(spark, path, SCHEMA, PARTITION, keys)
    assert rows(stored(spark, path)) == rows(state.mark_unsubscribed(base, keys))
    changes = base.limit(3).select(*state.ID, F.lit("seen").alias("status"))
    left, _ = state.delete_by_vendor(state.set_status(state.mark_unsubscribed(base, keys), changes, state.ID), keys, ["bulk"])
    rewrite.set_status(spark, path, SCHEMA, PARTITION, changes, state.ID)
    rewrite.delete_by_vendor(spark, path, SCHEMA, PARTITION, keys, ["bulk"])
    assert rows(stored(spark, path)) == rows(left)
