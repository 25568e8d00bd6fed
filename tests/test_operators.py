"""Small tables worked by hand, and properties that hold on any table."""

from pyspark.sql import functions as F

from vendorlens.operators import breaches, contains, enforcement, matching, rollups, state, stats, topk, whitelist
from vendorlens.operators.joins import chunked_lists, spread_join
from vendorlens.plans import vendor_query as vq
from vendorlens.plans.vendors import with_features


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_spread_join_keeps_join_results(spark):
    left = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    right = frame(spark, "k int, v string", (1, "a"), (1, "b"), (2, "c"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(spread_join(left, right, "k", how, ["id"])) == rows(left.join(right, "k", how))


def test_chunked_lists_hold_every_row_in_bounded_parts(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, "hot").otherwise("cold").alias("k"), "id")
    parts = chunked_lists(df, ["k"], "id", per_part=100, by=["id"]).select("k", F.size("items").alias("n")).collect()
    assert sum(p["n"] for p in parts) == 5000 and max(p["n"] for p in parts) < 300
    assert len([p for p in parts if p["k"] == "cold"]) == 1


def test_contains_join_equals_pairwise(spark):
    needles = ["abc", "bca", "cab x", "aaa", "zzz", "ab", "x"]
    texts = [(i, s) for i, s in enumerate(["xxabcab x", "aaaa", "bcabca", "", "ab", "zz"])]
    found = contains.contains_join(
        frame(spark, "needle string", *[(n,) for n in needles if len(n) >= 2]), frame(spark, "n int, text string", *texts), 2)
    want = sorted((n, i) for n in needles if len(n) >= 2 for i, s in texts if n in s)
    assert sorted((r["needle"], r["n"]) for r in found.collect()) == want


def test_suffix_join_equals_endswith(spark):
    keys = frame(spark, "vendor_key string", ("a.b.com",), ("b.com",), ("xb.com",), ("com",), ("b.com.au",))
    listed = frame(spark, "domain string", ("b.com",), ("com",), ("a.b.com",))
    got = rows(breaches.suffix_pairs(keys, "vendor_key", listed, "domain").select("vendor_key", "domain"))
    want = sorted((k[0], d[0]) for k in keys.collect() for d in listed.collect()
                  if k[0] == d[0] or k[0].endswith("." + d[0]))
    assert got == want


def test_whitelist_does_not_cover_a_look_alike(spark):
    messages = frame(spark, "account_id string, message_id string, sender_email string",
                     ("a", "1", "x@shop6.com"), ("a", "2", "x@mail.shop6.com"), ("a", "3", "x@xshop6.com"),
                     ("b", "4", "x@shop6.com"), ("a", "5", "n@other.com"), ("a", "6", "m@other.com"))
    listed = frame(spark, "account_id string, value string", ("a", "Shop6.com"), ("a", "n@other.com"))
    assert [r[0] for r in rows(whitelist.not_whitelisted(messages, listed).select("message_id"))] == ["3", "4", "6"]


COMPANIES = "ord long, slug string, name string, runs array<string>, domains array<string>, categories array<string>"


def test_match_order_and_webmail(spark):
    companies = frame(
        spark, COMPANIES, (2, "two", "Beta Corp", None, ["x.com"], None), (1, "one", "Alpha Beta", ["Gamma"], ["x.com"], None))
    vendors = frame(spark, "account_id string, vendor_key string, name string, company_slug string",
                    ("a", "x.com", "Zed", None), ("a", "y.com", "beta", None), ("a", "z.com", "GAMMA", None),
                    ("a", "gmail.com", "beta", None), ("a", "w.com", "be", None), ("a", "v.com", "beta", "kept"))
    got = dict(rows(matching.match_companies(vendors, companies).select("vendor_key", "company_slug")))
    assert got == {"x.com": "one", "y.com": "one", "z.com": "one", "gmail.com": None, "w.com": None, "v.com": "kept"}


def test_controller_tiers(spark):
    companies = frame(
        spark, "slug string, name string", ("meta", "Meta Platforms"), ("meta-pay", "Meta Pay"), ("free-fr", "Free"),
        ("piraeusbank", "Piraeus Bank"), ("soundcloudapp", "Soundcloud"), ("o1", "Orange"), ("t1", "Twin"), ("t2", "Twin"), ("t3", "Twin"))
    slugs = ["meta", "meta-platforms", "meta-pay-x", "free", "piraeus-bank", "soundcloud-x", "orange-x", "orange", "twin", ""]
    got = dict(rows(enforcement.resolve_controllers(
        frame(spark, "controller_slug string", *[(s,) for s in slugs]), companies).select("controller_slug", "auto_slug")))
    assert got == {"meta": "meta", "meta-platforms": "meta", "meta-pay-x": "meta-pay", "piraeus-bank": "piraeusbank",
                   "soundcloud-x": "soundcloudapp", "orange": "o1"}


def test_overrides_and_confidence(spark):
    resolved = frame(spark, "etid string, auto_slug string, tier int", ("1", "a", 1), ("2", "b", 3), ("3", "c", 1), ("4", None, None), ("5", "n", 4))
    overrides = frame(spark, "etid string, company_slug string", ("2", "forced"), ("3", None))
    got = rows(enforcement.match_confidence(enforcement.apply_overrides(resolved, overrides)).select(
        "etid", "company_slug", "match_confidence"))
    assert got == [("1", "a", "high"), ("2", "forced", "high"), ("5", "n", "medium")]


def test_related_breaches_leave_out_the_company_itself(spark):
    """A hot attribution: the cut group must still hold three rows of others for everyone."""
    companies = frame(spark, COMPANIES, *[(i, f"s{i}", f"N{i}", None, [f"d{i}.com"], None) for i in range(12)])
    listed = frame(
        spark, "name string, title string, domain string, breach_date string, pwn_count long, attribution string",
        *[(f"b{i}-{j}", "t", f"d{i}.com", f"2024-01-{28 - i - j:02d}", 10 + j, "G") for i in range(12) for j in range(3)])
    got = rows(breaches.related_breaches(companies, listed, "2024-01-31").select("slug", "company"))
    per = {}
    for slug, company in got:
        per.setdefault(slug, []).append(company)
        assert slug[1:] != company[1:]
    assert len(per) == 12 and all(1 <= len(v) <= 3 for v in per.values())


MESSAGE = ("account_id string, message_id string, vendor_key string, sender_email string, sender_name string, subject string, "
           "date_ms long, type string, unsubscribe_url string, unsubscribe_method string, status string, size_bytes long")


def message(i, vendor="v.com", sender="s@v.com", name="S", date=1000, kind="bulk", url="https://u", method="rfc8058", status=None):
    return ("a", f"m{i}", vendor, sender, name, f"subject {i}", date, kind, url, method, status, 10)


def test_vendor_without_messages_stays_cleared(spark):
    messages = frame(spark, MESSAGE, message(1))
    stored = frame(spark, "account_id string, vendor_key string", ("a", "v.com"), ("a", "gone.com"))
    got = rows(rollups.vendor_stats(messages, stored), "vendor_key")
    assert got == [("a", "gone.com", 0, 0, None, None), ("a", "v.com", 1, 1, 1000, 1000)]
    features = rollups.vendor_features(
        messages, frame(spark, "account_id string, value string"), frame(spark, "account_id string, vendor_key string, action_type string",
                                                                       ("a", "gone.com", "unsubscribed")), 5000)
    full = {r["vendor_key"]: r for r in with_features(stored, features, frame(
        spark, "account_id string, vendor_key string, action_type string", ("a", "gone.com", "unsubscribed"))).collect()}
    assert full["gone.com"]["has_action"] and not full["gone.com"]["has_marketing"]


def test_vendor_name_prefers_newest_bulk(spark):
    messages = frame(
        spark, MESSAGE, message(1, name="Old bulk", date=1), message(2, name="New bulk", date=2), message(3, name="", date=3),
        message(4, name="Personal", date=9, kind="personal"))
    assert rollups.vendor_names(messages).first()["sender_name"] == "New bulk"


def test_methods_take_the_newest_open_mail(spark):
    messages = frame(
        spark, MESSAGE, message(1, url="https://1", date=1), message(2, url="https://2", date=2, status="unsubscribed"),
        message(3, url="https://3", date=1, method="footer"), message(4, url="", date=5), message(5, kind="order", date=9))
    methods = topk.unsub_methods(messages)
    assert rows(methods.select("method", "url")) == [("footer", "https://3"), ("rfc8058", "https://1")]
    assert topk.best_unsub(methods).first()["method"] == "rfc8058"


def test_trend_change_rounding(spark):
    def change(values):
        df = frame(spark, "account_id string, day string, n long", *[("a", f"{i:03d}", v) for i, v in enumerate(values)])
        return tuple(stats.trend_change(df).first())[1:]
    assert change([200] * 7 + [199] * 7) == ("flat", 0)      # -0.5 % rounds up to 0
    assert change([100] * 7 + [97] * 7) == ("down", 3)
    assert change([0] * 7 + [5] * 7) == ("up", 100)
    assert change([0] * 14) == ("flat", 0) and change([1] * 13) == ("flat", 0)


def test_risk_filter_differs_from_computed_risk(spark):
    df = frame(spark, "category_id string, has_orders boolean, has_account boolean", ("unknown", False, True), (None, False, False))
    assert df.filter(vq.risk_predicate("medium")).count() == 0
    assert df.filter(vq.risk_predicate("other")).count() == 2


def test_activity_ends_overlap(spark):
    day = 86_400_000
    df = frame(spark, "last_seen long", (1000 * day - 90 * day,))
    assert all(df.filter(vq.activity_predicate(n, 1000 * day)).count() == 1 for n in ("recent", "active"))


def test_page_ties_do_not_overlap(spark):
    df = frame(spark, "account_id string, vendor_key string, message_count long", *[("a", f"v{i}", 5) for i in range(10)])
    pages = [rows(vq.vendor_page(df, vq.VendorQuery(page=p, limit=4)).select("vendor_key")) for p in (1, 2, 3)]
    assert [len(p) for p in pages] == [4, 4, 2] and len({k for p in pages for k in p}) == 10


def test_add_delete_add(spark):
    feed = frame(spark, "account_id string, message_id string, seq long, op string",
                 ("a", "m", 1, "add"), ("a", "m", 2, "delete"), ("a", "m", 3, "add"), ("a", "n", 1, "add"), ("a", "n", 2, "delete"))
    assert rows(state.net_changes(feed)) == [("a", "m", "add"), ("a", "n", "delete")]
    assert rows(state.net_plain_changes(feed)) == [("a", "m", "delete"), ("a", "n", "delete")]


def test_first_write_wins_and_replay_changes_nothing(spark):
    stored = frame(spark, "account_id string, message_id string, subject string", ("a", "1", "old"))
    batch = frame(spark, "account_id string, message_id string, subject string, arrival int",
                  ("a", "1", "new", 1), ("a", "2", "second", 2), ("a", "2", "first", 1))
    once = state.append_new(stored, batch)
    assert rows(once) == [("a", "1", "old"), ("a", "2", "first")]
    assert rows(state.append_new(once, batch)) == rows(once)


def test_top_n_is_cut_before_the_shuffle(spark, sf):
    from vendorlens.verify import tables as t
    plan = topk.latest_messages(t.messages(spark, sf), None, 20)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_ranges_reach_the_scan(spark, sf, tmp_path):
    from vendorlens.sources import readers, sinks
    from vendorlens.verify import tables as t
    path = str(tmp_path / "mail")
    sinks.write_table(sinks.with_month(t.messages(spark, sf)), path, ["msg_month"])
    found = readers.read_messages(spark, path, 1_690_000_000_000, 1_700_000_000_000, headers_only=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_ms" in plan and "msg_month" in plan.split("PartitionFilters")[1][:200]
    assert "body_preview" not in plan.split("ReadSchema")[1]
