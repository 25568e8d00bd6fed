"""What plans read, broadcast and rank."""

import pytest
from pyspark.sql import Window, functions as F

from vendorlens.operators import breaches, contains, deep_pages, ingest, matching, stats, topk
from vendorlens.operators.joins import spread_join
from vendorlens.plans import vendor_detail
from vendorlens.sources.scratch import scratch_path
from vendorlens.verify import joins, sources, tables as t


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def message_scans(df):
    """Leaves of the plan that read the message table."""
    return sum("unsubscribe_method#" in line and "parquet" in line for line in optimized(df).splitlines() if "Relation" in line)


def test_vendor_build_reads_messages_once_beside_the_rollup(spark, sf):
    assert message_scans(t.built_vendors(spark, sf)) == 1


def test_stored_vendors_equal_those_of_one_plan(spark, sf):
    """The stored table is joined from stored parts, so that no stage holds the sorts of all its joins at once."""
    plan = optimized(t.built_vendors(spark, sf)).count("Join")
    parts = [t.vendor_plans.build_vendors(t.messages(spark, sf), t.companies(spark, sf), t.vendor_status(spark, sf), t.senders(spark, sf), t.matched_vendors(spark, sf)),
             t.vendor_plans.with_lists(t.base_vendors(spark, sf), t.senders(spark, sf), t.whitelist(spark, sf), t.actions(spark, sf), t.breaches(spark, sf), t.AS_OF_MS)]
    assert all(optimized(part).count("Join") < plan - 4 for part in parts)
    columns = sorted(t.vendors(spark, sf).columns)
    assert sorted(map(str, t.vendors(spark, sf).select(columns).collect())) == sorted(map(str, t.built_vendors(spark, sf).select(columns).collect()))


def test_vendor_mail_is_cut_by_one_look_at_the_address(spark):
    mail = spark.createDataFrame([("a@x.org",), ("no address",), ("a@gmail.com",), (None,), ("a@mail.gmail.com",)], "sender_email string")
    kept = ingest.keep_vendor_mail(mail.select(F.concat_ws("@", F.split("sender_email", "@")).alias("sender_email")))
    (line,) = [x for x in optimized(kept).splitlines() if "Filter" in x]
    assert line.count("concat_ws") == 1
    assert [r[0] for r in kept.collect()] == ["a@x.org"]


def test_detail_lists_read_messages_once_for_all_message_lists(spark, sf):
    """And for the senders: their counts, and how many parts these need, from one exchange."""
    sections = vendor_detail.detail_sections(
        t.vendors(spark, sf), t.messages(spark, sf), t.actions(spark, sf), t.breaches(spark, sf), everyone=True)
    assert message_scans(sections) == 3


@pytest.fixture
def small_threshold(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_side_above_the_threshold_is_not_broadcast(small_threshold, tmp_path):
    spark = small_threshold
    spark.range(30_000).select(F.concat(F.lit("v"), "id", F.lit(".com")).alias("vendor_key"), "id").write.parquet(str(tmp_path / "r"))
    right = spark.read.parquet(str(tmp_path / "r"))
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "v1.com").otherwise(F.concat(F.lit("v"), "id", F.lit(".com"))).alias("vendor_key"), F.col("id").alias("n"))
    for joined in (spread_join(left, right, "vendor_key", "left", ["n"]), left.join(right, "vendor_key", "left"),
                   breaches.suffix_pairs(left, "vendor_key", right.withColumnRenamed("vendor_key", "domain"), "domain")):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "BuildRight" not in plan
        assert joined.count() == 3000
    # Only the right row of the hot key is copied.
    copies = spread_join(left, right, "vendor_key", "inner", ["n"])
    assert "ELSE [0] END" in optimized(copies)


def test_no_copies_without_hot_keys(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    assert "explode" not in optimized(spread_join(left, left, "k", "inner", ["k"]))


def test_texts_are_shuffled_once(spark):
    needles = spark.createDataFrame([("abc",)], "needle string")
    texts = spark.createDataFrame([("xxabcx", "payload")], "text string, big string")
    lines = [line for line in optimized(contains.contains_join(needles, texts, 3)).splitlines() if "gram#" in line and "Join" not in line]
    assert lines and all("big#" not in line for line in lines)


@pytest.mark.parametrize("few", [0, 16])
def test_contains_as_every_pair(spark, monkeypatch, few):
    """Many buckets, grams of all texts, needles longer than texts, other signs, repeated texts, needles without a text."""
    monkeypatch.setattr(contains, "FEW", few)
    texts = spark.range(70_000).select(F.concat(F.lit("t"), F.conv(F.col("id") * 7919 % 65_536, 10, 16)).alias("text"), "id").union(
        spark.createDataFrame([("ÄÖ ß 😀 ü", -1), (None, -2), ("", -3), ("t1", -4), ("ab" * 50, -5)], "text string, id long")).repartition(7)
    needles = spark.createDataFrame([(x,) for x in ("t1", "tAB", "FFF", "t12345678", "ß 😀", "baba", "zz", "t")], "needle string")
    got = contains.contains_join(needles.filter("length(needle) > 1"), texts, 2).select("needle", "id")
    want = needles.filter("length(needle) > 1").join(texts, F.contains("text", "needle")).select("needle", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_candidates_hold_all_grams_of_a_needle(spark):
    """Every gram of the needle is in a third of the texts, all of them in few."""
    texts = spark.range(3000).select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("ab", "bc", "cd")]), (F.col("id") % 3 + 1).cast("int")), F.lit("-"), "id").alias("text"))
    texts = texts.union(spark.createDataFrame([("xabcd",), ("ab bc cd",)], "text string"))
    index = contains.write_index(texts, 2)
    needle = spark.createDataFrame([("abcd",)], "needle string")
    assert index.postings.filter("gram IN ('ab', 'bc', 'cd')").agg(F.min("df")).first()[0] > 1000
    assert contains.candidates(needle, index).count() == 2
    assert [r["text"] for r in contains.contains_join(needle, texts, 2, index).collect()] == ["xabcd"]


@pytest.mark.parametrize("rows", [0, 128])
def test_contains_by_blocks_or_bitmaps_as_every_pair(spark, monkeypatch, rows):
    """Needles of every length from n to beyond the longest block; ``rows`` 0 sends all to the bitmaps."""
    monkeypatch.setattr(contains, "ROWS", rows)
    texts = spark.range(300).select(F.concat(F.lit("shop"), "id", F.lit(" ltd. "), F.repeat(F.lit("äb😀"), (F.col("id") % 30).cast("int"))).alias("text"), "id")
    cut = F.explode(F.transform(F.array(*[F.lit(k) for k in (2, 3, 4, 5, 7, 8, 9, 15, 17, 33, 70)]), lambda k: F.substr(F.col("text"), F.lit(3), k)))
    needles = texts.select(cut.alias("needle")).union(spark.createDataFrame([("op1 ltd. äb😀ä😀",), ("zz",), ("shop300",)], "needle string")).distinct()
    got = contains.contains_join(needles, texts, 2).select("needle", "id")
    want = needles.join(texts, F.contains("text", "needle")).select("needle", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_needles_meet_few_texts_beside_those_that_hold_them(spark):
    """Every gram of every needle is in many texts, the needles are in few."""
    texts = spark.range(20_000).select(F.concat(F.lit("shop"), "id", F.lit(" ltd.")).alias("text"))
    needles = spark.range(10_000, 30_000).select(F.concat(F.lit("shop"), "id").alias("needle"))
    index = contains.write_index(texts, 2)
    assert index.postings.filter("gram IN ('sh', 'ho', 'op', '10')").agg(F.min("df")).first()[0] > 500
    # 10,000 needles have a text each; the others have blocks that no text holds, or few do.
    assert contains.looked_up(needles, index).count() < 30_000
    assert contains.contains_join(needles, texts, 2, index).count() == 10_000


def test_one_index_serves_match_and_search(spark, sf, tmp_path):
    companies, vendors = t.companies(spark, sf), t.vendors(spark, sf)
    queries = spark.createDataFrame([("shop1",), ("p3.co",), ("Ltd",)], "query string")
    path = str(tmp_path / "index")
    matching.company_index(companies, path)
    index = contains.read_index(spark, path, 2)
    for with_index, without in ((matching.match_by_name(vendors, companies, index), matching.match_by_name(vendors, companies)),
                                (matching.company_search(queries, companies, index=index), matching.company_search(queries, companies))):
        assert sorted(map(str, with_index.collect())) == sorted(map(str, without.collect()))


@pytest.mark.parametrize("few, columns", [(50_000, "v id"), (20, "v id"), (20, "name id"), (20, "same name id"), (20, "at name")])
def test_deep_ranks_equal_a_window(spark, monkeypatch, few, columns):
    """Ties that fill most of a group, nulls, texts that differ late, groups of different size; nothing is written but a row per group."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 < 3, "hot").otherwise("cold").alias("k"), F.when(F.col("id") % 10 < 7, 50).otherwise(F.col("id") * 7919 % 97).alias("v"), "id",
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("a name of some length "), (F.col("id") * 31 % 1000).cast("string"))).alias("name"),
        F.lit(None).cast("int").alias("same"), F.timestamp_seconds(F.col("id") * 7 % 500).alias("at"))
    order = [(c, n % 2 == 0) for n, c in enumerate(columns.split())]
    order += [("id", False)] if "id" not in columns else []
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*deep_pages.sort_of(order)))).select("k", "id", "rank").collect()
    monkeypatch.setattr(topk, "NEAR_RANK", 10)
    monkeypatch.setattr(deep_pages, "FEW", few)
    written, kept = [], deep_pages.kept
    monkeypatch.setattr(deep_pages, "kept", lambda df, name: written.append(kept(df, name)) or written[-1])
    for first, last in ((995, 1005), (2950, 3100), (4000, 4010)) if few == 20 else ((0, 20), (2950, 3100)):
        got = topk.ranked_between(rows, ["k"], order, first, last).select("k", "id", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want if first < r["rank"] <= last)
    assert all(df.count() <= 2 for df in written) and (few > 20 or len(written) > 3)


def test_a_deep_page_ranks_few_rows(spark, monkeypatch):
    rows = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 100_003).alias("v"), "id")
    monkeypatch.setattr(deep_pages, "FEW", 1000)
    near, earlier = deep_pages.narrowed(rows, ["k"], [("v", False), ("id", False)], 120_000, 120_050)
    at = earlier.first()["_earlier"]
    assert 50 <= near.count() < 10_000 and 110_000 < at <= 120_000


def test_backfill_stops_after_empty_ranges(spark):
    day = 86_400_000
    rows = [("a", f"m{i}", d * day) for i, d in enumerate((995, 905, 815, 540, 1))] + [("b", "n1", 995 * day), ("b", "n2", 540 * day)]
    found = stats.backfill_ranges(spark.createDataFrame(rows, "account_id string, message_id string, date_ms long"), 1000 * day, 0)
    assert sorted((r["message_id"], r["range"]) for r in found.collect()) == [("m0", 0), ("m1", 1), ("m2", 2), ("m3", 5), ("n1", 0)]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        scratch_path(Cluster, "x")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_values_out_of_range_are_refused(spark, sf):
    with pytest.raises(ValueError):
        stats.daily_trend(t.messages(spark, sf), t.accounts(spark, sf), t.AS_OF_MS, 366)
    with pytest.raises(ValueError):
        matching.company_search(spark.createDataFrame([("x",)], "query string"), t.companies(spark, sf), 21)


def test_search_ranks_all_hits(spark):
    companies = spark.createDataFrame([(f"s{i}", f"A{i:02d} needle", []) for i in range(60)] + [("z", "Needle Ltd", [])], "slug string, name string, domains array<string>")
    query = spark.createDataFrame([("needle",)], "query string")
    assert matching.company_search(query, companies, 3).orderBy("rank").first()["slug"] == "z"
    assert matching.company_search(query, companies, 3, scan=12).filter("slug = 'z'").count() == 0


def test_vendor_keys_need_no_message_table(spark, tmp_path):
    """A query of vendor keys ingests two columns and doesn't write the messages; once these are stored, it reads them. Rows repeat, or have no user or type."""
    sf = str(tmp_path)
    rows = [(1, 1, "view"), (1, 1, "view"), (2, 8, "click"), (3, 5, None), (4, None, "purchase"), (5, 3, "error")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumns(
        {"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "value": F.lit(1.0)}).write.parquet(f"{sf}/events.parquet")
    spark.createDataFrame([(1, "text")], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(2, "<p>page</p>")], "page_id long, html string").write.parquet(f"{sf}/pages.parquet")
    found = sorted(tuple(r) for r in joins.vendor_keys(spark, sf).collect())
    assert (spark.sparkContext.applicationId, sf, "messages") not in t._STORED
    assert sum(1 for _ in t.message_vendors(spark, sf).collect()) == t.messages(spark, sf).count()
    assert found and found == sorted(tuple(r) for r in t.messages(spark, sf).select("account_id", "vendor_key").distinct().collect())
    assert "messages-" in t.message_vendors(spark, sf).inputFiles()[0]


def test_mail_parses_each_sender_once(spark, sf):
    """The filter by the address must not be pushed below the parsing, where it would repeat it."""
    plan = optimized(ingest.ingest(t.raw_messages(spark, sf)))
    assert plan.count(r"<([^>]+)>\z, 2)") == 1


def test_stored_name_matches_leave_the_lookup_out_of_the_match(spark, sf):
    senders, companies = t.senders(spark, sf), t.companies(spark, sf)
    whole = t.vendor_plans.matched_vendors(senders, companies)
    split = t.vendor_plans.matched_vendors(senders, companies, t.named_vendors(spark, sf), t.name_matches(spark, sf))
    assert optimized(split).count("Join") < optimized(whole).count("Join") / 2
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.select(split.columns).collect()))


def test_breach_documents_read_matched_fines_that_are_stored(spark, sf):
    """Lists, their lengths and totals don't match the fines again each; columns that no document shows aren't parsed."""
    docs = sources.docs(spark, sf)
    assert "o_orderpriority" not in optimized(docs)
    shown = t.stored(spark, sf, "fines-shown", None)
    assert not {"articles_violated", "violation_type", "description", "sector"} & set(shown.columns)
    plain = sources.pages.build_breach_docs(t.companies(spark, sf), t.breaches(spark, sf), joins.resolved(spark, sf))
    assert sorted(map(str, docs.collect())) == sorted(map(str, plain.collect()))
