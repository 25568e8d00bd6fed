"""Streams: same result as the batch, whatever is repeated."""

from pyspark.sql import functions as F

from vendorlens.operators import rollups, stats
from vendorlens.plans import vendor_query as vq
from vendorlens.streaming import daily, ingest
from vendorlens.verify import tables as t


def landing(spark, sf):
    return t.raw_messages(spark, sf).withColumns({
        "op": F.lit("add"), "seq": F.substring("id", 2, 20).cast("bigint")})


def keys(df):
    return sorted((r["account_id"], r["message_id"], r["type"]) for r in df.collect())


def test_many_batches_equal_one_pass(spark, sf, tmp_path):
    rows = landing(spark, sf)
    rows.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    tables = ingest.Tables(str(tmp_path / "store"))
    ingest.start_ingest(
        spark, str(tmp_path / "in"), tables, str(tmp_path / "ck"), files_per_batch=1).awaitTermination()
    live = ingest.live_messages(spark, tables)
    batch = t.messages(spark, sf)
    assert keys(live) == keys(batch)
    want = {(r["account_id"], r["vendor_key"]): tuple(r)[2:] for r in rollups.vendor_stats(batch).collect()}
    got = {(r["account_id"], r["vendor_key"]): (r["message_count"], r["sender_count"], r["first_seen"], r["last_seen"])
           for r in ingest.current_vendors(spark, tables).collect()}
    assert got == want


def test_batch_run_twice_changes_nothing(spark, sf, tmp_path):
    rows = landing(spark, sf)
    tables = ingest.Tables(str(tmp_path / "store"))
    ingest.apply_batch(rows, 0, tables)
    once = keys(ingest.live_messages(spark, tables))
    ingest.apply_batch(rows, 0, tables)
    assert keys(ingest.live_messages(spark, tables)) == once
    ingest.apply_batch(rows, 1, tables)
    assert keys(ingest.live_messages(spark, tables)) == once


def test_delete_and_add_again(spark, sf, tmp_path):
    rows = landing(spark, sf).filter("seq < 200")
    gone = rows.withColumns({"op": F.lit("delete"), "seq": F.col("seq") + 1000})
    tables = ingest.Tables(str(tmp_path / "store"))
    ingest.apply_batch(rows, 0, tables)
    first = keys(ingest.live_messages(spark, tables))
    ingest.apply_batch(gone, 1, tables)
    assert ingest.live_messages(spark, tables).count() == 0
    assert {r["message_count"] for r in ingest.current_vendors(spark, tables).collect()} == {0}
    ingest.apply_batch(rows, 2, tables)
    assert keys(ingest.live_messages(spark, tables)) == first
    small = ingest.Tables(str(tmp_path / "small"))
    vendors = sorted(map(str, ingest.current_vendors(spark, tables).collect()))
    ingest.compact(spark, tables, small)
    assert keys(ingest.live_messages(spark, small)) == first
    assert sorted(map(str, ingest.current_vendors(spark, small).collect())) == vendors
    tables = small
    # Within a batch the last operation of an id counts.
    ingest.apply_batch(gone.unionByName(rows.withColumn("seq", F.col("seq") + 5000)), 3, tables)
    assert keys(ingest.live_messages(spark, tables)) == first


def test_a_batch_of_additions_reads_no_message_again(spark, sf, tmp_path, monkeypatch):
    rows, tables = landing(spark, sf), ingest.Tables(str(tmp_path / "store"), buckets=4)
    ingest.apply_batch(rows.filter("seq < 400"), 0, tables, companies=t.companies(spark, sf))
    monkeypatch.setattr(ingest, "live_messages", None)
    ingest.apply_batch(rows.filter("seq >= 400"), 1, tables, companies=t.companies(spark, sf))
    monkeypatch.undo()
    assert keys(ingest.live_messages(spark, tables)) == keys(t.messages(spark, sf))


def facts(df, *names):
    return sorted(tuple(str(r[n]) for n in ("account_id", "vendor_key", *names)) for r in df.collect())


FACTS = ("message_count", "sender_count", "bulk_count", "first_seen", "last_seen", "name", "company_slug", "category_id", "risk_level")


def test_streamed_vendors_serve_the_vendor_query_and_the_dashboard(spark, sf, tmp_path):
    rows, tables = landing(spark, sf), ingest.Tables(str(tmp_path / "store"), buckets=4)
    for n in range(3):
        ingest.apply_batch(rows.filter(f"seq % 3 = {n}"), n, tables, companies=t.companies(spark, sf))
    states = t.messages(spark, sf).filter("status IS NOT NULL").select("account_id", "message_id", "status")
    ingest.user_changes(spark, tables, marks=states, vendor_status=t.vendor_status(spark, sf))
    streamed = ingest.vendor_table(spark, tables, t.whitelist(spark, sf), t.actions(spark, sf), t.breaches(spark, sf), t.AS_OF_MS)
    built = t.vendors(spark, sf)
    assert sorted(streamed.columns) == sorted(built.columns)
    flags = sorted(c for c in built.columns if c.startswith(("has_", "on_", "is_")))
    assert facts(streamed, *FACTS, "status", *flags) == facts(built, *FACTS, "status", *flags)
    query = vq.VendorQuery(limit=20)
    assert facts(vq.vendor_query(streamed, query, t.AS_OF_MS), "rank") == facts(vq.vendor_query(built, query, t.AS_OF_MS), "rank")
    a, b = (sorted(map(tuple, stats.dashboard(v, t.messages(spark, sf), t.actions(spark, sf)).collect())) for v in (streamed, built))
    assert a == b


def test_user_changes(spark, sf, tmp_path):
    rows, tables = landing(spark, sf), ingest.Tables(str(tmp_path / "store"), buckets=4)
    ingest.apply_batch(rows, 0, tables, companies=t.companies(spark, sf))
    before = {(r["account_id"], r["vendor_key"]): r for r in ingest.current_vendors(spark, tables).collect()}
    mail = t.messages(spark, sf)
    key = mail.select("account_id", "vendor_key").orderBy("account_id", "vendor_key").first()
    mine = mail.filter((F.col("account_id") == key["account_id"]) & (F.col("vendor_key") == key["vendor_key"]))
    first = ingest.user_changes(spark, tables, marks=mine.select("account_id", "message_id", F.lit("unsubscribed").alias("status")))
    second = ingest.user_changes(spark, tables, delete=mine, vendor_status=spark.createDataFrame(
        [(key["account_id"], key["vendor_key"], "reviewed"), ("nobody", "x.com", "reviewed")], "account_id string, vendor_key string, status string"))
    assert (first, second) == (1, 2) and ingest.next_batch(spark, tables) == 1
    after = {(r["account_id"], r["vendor_key"]): r for r in ingest.current_vendors(spark, tables).collect()}
    lost, old = after[tuple(key)], before[tuple(key)]
    assert lost["message_count"] == 0 and not lost["has_marketing"] and lost["status"] == "reviewed"
    assert (lost["name"], lost["company_slug"], lost["category_id"]) == (old["name"], old["company_slug"], old["category_id"])
    assert {k: v for k, v in after.items() if k != tuple(key)} == {k: v for k, v in before.items() if k != tuple(key)}
    # Mail that comes again after its deletion has no status of before.
    again = rows.join(mine.select("account_id", F.col("message_id").alias("id")), ["account_id", "id"], "left_semi").withColumn("seq", F.col("seq") + 10_000)
    ingest.apply_batch(again.select(*rows.columns), 1, tables, companies=t.companies(spark, sf))
    live = ingest.live_messages(spark, tables)
    assert live.count() == mail.count() and live.filter("status IS NOT NULL").count() == 0
    now = {(r["account_id"], r["vendor_key"]): r for r in ingest.current_vendors(spark, tables).collect()}
    assert now[tuple(key)]["message_count"] == old["message_count"] and now[tuple(key)]["status"] == "reviewed"


def test_late_days_are_counted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for day in ("2024-01-30", "2024-01-31", "2023-10-30", "2024-01-30"):
        spark.createDataFrame([("a", f"{day} 10:00:00")], "account_id string, ts string").select(
            "account_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(source)
        daily.start_daily(spark.readStream.schema("account_id string, ts timestamp").parquet(source), out, checkpoint).awaitTermination()
    got = sorted((str(r["day"]), r["n"]) for r in daily.current_days(spark, out).collect())
    assert got == [("2023-10-30", 1), ("2024-01-30", 2), ("2024-01-31", 1)]


def test_changes_delivered_again_reach_no_batch(spark, sf, tmp_path, monkeypatch):
    """A file that comes twice, and one that repeats changes with other bodies: the state of the stream drops them before a batch sees them."""
    seen, plain = [], ingest.apply_batch
    monkeypatch.setattr(ingest, "apply_batch", lambda df, n, *a: seen.append(df.count()) or plain(df, n, *a))
    rows, tables = landing(spark, sf).filter("seq < 120"), ingest.Tables(str(tmp_path / "store"), buckets=2)
    n = rows.count()
    for again in (rows, rows.withColumn("subject", F.lit("again")), rows.withColumn("seq", F.col("seq") + 1000)):
        again.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start_ingest(spark, str(tmp_path / "in"), tables, str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 2 * n  # other change numbers are other changes; their ids are stored already
    live = ingest.live_messages(spark, tables)
    assert live.count() == live.select("account_id", "message_id").distinct().count() and live.filter("subject = 'again'").count() == 0


def test_a_batch_that_fails_in_its_middle_gives_equal_rows(spark, sf, tmp_path, monkeypatch):
    rows, tables = landing(spark, sf), ingest.Tables(str(tmp_path / "store"), buckets=2)
    rows.write.parquet(str(tmp_path / "in"))
    plain, calls = ingest._refresh, []

    def fails_once(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return plain(*args)

    monkeypatch.setattr(ingest, "_refresh", fails_once)
    for _ in range(2):
        try:
            ingest.start_ingest(spark, str(tmp_path / "in"), tables, str(tmp_path / "ck"), companies=t.companies(spark, sf)).awaitTermination()
        except Exception:
            assert len(calls) == 1
    assert len(calls) == 2 and keys(ingest.live_messages(spark, tables)) == keys(t.messages(spark, sf))
    assert facts(ingest.current_vendors(spark, tables), *FACTS) == facts(t.vendors(spark, sf), *FACTS)


def test_a_new_company_matches_vendors_without_new_mail(spark, sf, tmp_path):
    rows, tables = landing(spark, sf), ingest.Tables(str(tmp_path / "store"), buckets=4)
    companies = t.companies(spark, sf)
    ingest.apply_batch(rows.filter("seq < 900"), 0, tables, companies=companies.filter("ord < 4"))
    open_before = ingest.current_vendors(spark, tables).filter("company_slug IS NULL").count()
    ingest.apply_batch(rows.filter("seq >= 900"), 1, tables, companies=companies)
    now = ingest.current_vendors(spark, tables)
    assert facts(now, *FACTS) == facts(t.vendors(spark, sf), *FACTS) and now.filter("company_slug IS NULL").count() < open_before


def test_changes_have_no_limit_and_need_no_feed(spark, sf, tmp_path):
    tables = ingest.Tables(str(tmp_path / "store"), buckets=2)
    status = spark.createDataFrame([("a", "x.com", "reviewed")], "account_id string, vendor_key string, status string")
    assert ingest.user_changes(spark, tables, vendor_status=status) == 0 + 1
    assert ingest.current_vendors(spark, tables).count() == 0 and ingest.next_batch(spark, tables) == 0
    ingest.apply_batch(landing(spark, sf).filter("seq < 50"), 0, tables)
    one = ingest.live_messages(spark, tables).limit(1).select("account_id", "message_id").collect()
    ids = spark.createDataFrame(one)
    ingest._write(spark.createDataFrame([("a", "m", "v", "mark", "x")], ingest.SCHEMAS["changes"]), tables, "changes", (0, 5000))
    assert ingest.user_changes(spark, tables, delete=ids) == 5001
    assert ingest.live_messages(spark, tables).join(ids, ["account_id", "message_id"]).count() == 0
