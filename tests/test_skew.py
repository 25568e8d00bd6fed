"""A third of all rows on one key, no broadcast: results stay whole and tasks stay small."""

import pytest
from pyspark.sql import functions as F

from vendorlens.operators import breaches, rollups, topk, whitelist
from vendorlens.operators.joins import spread_join
import sqlcheck as check


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hot_messages(spark, n=30_000):
    """Mail of many vendors; one vendor and its one sender hold a third of it."""
    k = F.col("id")
    hot = k % 3 == 0
    return spark.range(n).select(
        F.lit("a").alias("account_id"), F.concat(F.lit("m"), k).alias("message_id"),
        F.when(hot, "hot.com").otherwise(F.concat(F.lit("v"), k % 500, F.lit(".com"))).alias("vendor_key"),
        F.when(hot, "x@hot.com").otherwise(F.concat(F.lit("x@v"), k % 500, F.lit(".com"))).alias("sender_email"),
        F.lit("n").alias("sender_name"), F.lit("s").alias("subject"), k.alias("date_ms"), F.lit("bulk").alias("type"),
        F.lit("https://u").alias("unsubscribe_url"), F.lit("rfc8058").alias("unsubscribe_method"),
        F.lit(None).cast("string").alias("status"), F.lit(1).cast("bigint").alias("size_bytes"))


def test_hot_key_is_spread_over_tasks(no_broadcast):
    spark = no_broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.createDataFrame([("hot.com", 1)], "vendor_key string, flag int")
        joined = spread_join(hot_messages(spark), right, "vendor_key", "inner", ["message_id"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 10_000 and len(sizes) >= 4 and max(sizes) < 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_vendor_keeps_every_row(no_broadcast):
    messages = hot_messages(no_broadcast)
    listed = no_broadcast.createDataFrame([("a", "hot.com")], "account_id string, value string")
    assert whitelist.not_whitelisted(messages, listed).count() == 20_000
    actions = no_broadcast.createDataFrame([("a", "hot.com", "unsubscribed")], "account_id string, vendor_key string, action_type string")
    features = {r["vendor_key"]: r for r in rollups.vendor_features(messages, listed, actions, 0).collect()}
    assert features["hot.com"]["message_count"] == 10_000 and not features["hot.com"]["has_unwhitelisted"]
    assert sum(r["message_count"] for r in features.values()) == 30_000
    newest = topk.latest_messages(messages, None, 20).filter("vendor_key = 'hot.com'")
    assert sorted(int(r["message_id"][1:]) for r in newest.collect()) == list(range(29_940, 30_000, 3))


def test_hot_suffix(no_broadcast):
    keys = no_broadcast.range(9_000).select(F.concat(F.lit("s"), "id", F.lit(".hot.com")).alias("vendor_key"))
    listed = no_broadcast.createDataFrame([("hot.com",), ("com",)], "domain string")
    assert breaches.suffix_pairs(keys, "vendor_key", listed, "domain").count() == 18_000


@pytest.mark.parametrize("key", [
    "join_company_domain", "join_company_name", "match_vendor_companies", "join_breach_suffix", "breach_related", "whitelist_anti",
    "whitelist_scope", "vendor_features", "dashboard_stats", "enf_company_match", "company_search", "request_batch",
    "recommended_actions", "mark_unsubscribed", "upsert_messages", "src_backfill"])
def test_sort_merge_plans_give_the_same(no_broadcast, sf, key):
    ok, message = check.compare(no_broadcast, check.connect(sf), sf, key)
    assert ok, message


