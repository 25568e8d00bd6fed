"""Kept numbers and lists equal the batch operators after any changes."""

import random

import pytest
from pyspark.sql import functions as F

from vendorlens.operators import deltas, stats, topk, topk_views
from vendorlens.operators.rollups import VENDOR
from vendorlens.plans import vendors as plans
from vendorlens.verify import tables as t


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def touched(df, *sets):
    """Rows of the vendors that any of the sets names."""
    keys = sets[0].select(*VENDOR)
    for s in sets[1:]:
        keys = keys.unionByName(s.select(*VENDOR))
    return df.join(keys.distinct(), VENDOR, "left_semi")


def test_signed_sums_equal_the_batch_after_changes_in_any_order(spark, sf, tmp_path):
    path = str(tmp_path / "deltas")
    messages, actions, companies = t.messages(spark, sf), t.actions(spark, sf), t.companies(spark, sf)
    base = plans.build_vendors(messages, companies, t.vendor_status(spark, sf)).cache()

    def vendors(mail, log, status=None):
        own = base if status is None else base.withColumn("status", status)
        return plans.with_lists(own, plans.rollups.sender_rollup(mail), t.whitelist(spark, sf), log, t.breaches(spark, sf), t.AS_OF_MS)

    half = messages.filter("hash(message_id) % 2 = 0")
    gone = messages.filter("type = 'order' AND hash(message_id) % 3 = 0")
    left = messages.join(gone, ["account_id", "message_id"], "left_anti")
    marked = left.withColumn("status", F.when(F.col("type") == "bulk", "unsubscribed").otherwise(F.col("status")))
    log = actions.filter("action_type <> 'trashed'")
    reviewed = F.when(F.col("vendor_key").startswith("shop"), "reviewed").otherwise(F.col("status"))
    states = [(half, log, None), (messages, log, None), (left, log, None), (marked, actions, None), (marked, actions, reviewed)]
    every = []
    for (mail, acts, status), before in zip(states, [None, *states]):
        after = vendors(mail, acts, status)
        if before is None:
            every.append(deltas.delta(deltas.of_vendors(after).union(deltas.of_messages(mail)).union(deltas.of_actions(acts))))
            continue
        old = vendors(*before)
        added, removed = (a.join(b.select("account_id", "message_id"), ["account_id", "message_id"], "left_anti") for a, b in ((mail, before[0]), (before[0], mail)))
        acted = acts.join(before[1].select("action_id"), "action_id", "left_anti")
        changed = messages.filter("type = 'bulk'") if mail is marked else added.unionByName(removed)
        here = touched(after, changed, acted, base.filter("vendor_key LIKE 'shop%'")), touched(old, changed, acted, base.filter("vendor_key LIKE 'shop%'"))
        every.append(deltas.delta(deltas.of_vendors(here[0]).union(deltas.of_messages(added)).union(deltas.of_actions(acted)),
                                  deltas.of_vendors(here[1]).union(deltas.of_messages(removed))))
    order = list(enumerate(every))
    random.Random(2).shuffle(order)
    for n, delta in [*order, order[0]]:  # in any order, and one again
        deltas.write_delta(delta, path, n)
    kept, final = deltas.read_deltas(spark, path), vendors(marked, actions, reviewed)
    assert rows(deltas.dashboard(kept)) == rows(stats.dashboard(final, marked, actions))
    assert rows(deltas.risk_counts(kept)) == rows(stats.risk_counts(final))
    assert rows(deltas.impact(kept)) == rows(stats.impact(actions))
    # A reset takes away all that an account has.
    mine = [df.filter("account_id = 'a1'") for df in (final, marked, actions)]
    deltas.write_delta(deltas.delta(None, deltas.of_vendors(mine[0]).union(deltas.of_messages(mine[1])).union(deltas.of_actions(mine[2]))), path, 99)
    kept = deltas.read_deltas(spark, path)
    rest = [df.filter("account_id <> 'a1'") for df in (final, marked, actions)]
    assert rows(deltas.dashboard(kept)) == rows(stats.dashboard(*rest)) and rows(deltas.impact(kept)) == rows(stats.impact(rest[2]))
    assert rows(deltas.risk_counts(kept)) == rows(stats.risk_counts(rest[0]))


def test_summing_reads_the_deltas_only(spark, tmp_path):
    path = str(tmp_path / "d")
    deltas.write_delta(spark.createDataFrame([("a", "vendors", 2)], deltas.SCHEMA), path, 0)
    plan = deltas.dashboard(deltas.read_deltas(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


MAIL = "account_id string, vendor_key string, message_id string, date_ms long, subject string, sender_email string, type string, unsubscribe_url string, unsubscribe_method string, status string"


def mail(pick, n, first=0):
    out = []
    for k in range(first, first + n):
        vendor = pick.choice(["hot"] * 6 + ["b", "c", "d", None])
        bulk = pick.random() < 0.7
        out.append(("a", vendor, f"m{k:05d}", pick.choice([None, *range(40)]), pick.choice([None, f"s{k}"]), f"x{k % 3}", "bulk" if bulk else "order",
                    f"u{k}" if bulk else None, pick.choice(["rfc8058", "footer", "list-unsubscribe"]) if bulk else "none", None))
    return out


SPECS = {
    "latest": (topk_views.latest(5, 3), lambda v, s: s.first(v).select(*VENDOR, "message_id", "rank"),
               lambda m: topk.latest_messages(m, None, 5).select(*VENDOR, "message_id", F.col("rank").cast("bigint").alias("rank"))),
    "subjects": (topk_views.first_subjects(4, 2), lambda v, s: topk_views.subjects_of(v, s), lambda m: topk.subjects_sample(m, 4)),
    "methods": (topk_views.methods(2), lambda v, s: topk_views.best_of(v, s), lambda m: topk.best_unsub(topk.unsub_methods(m))),
}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_lists_equal_the_batch_after_additions_and_deletions(spark, name):
    """Additions old and new, deletions from the top, of whole keys and at random, marks; keys are read again only when their reserve is used up."""
    spec, kept, batch = SPECS[name]
    pick, stored = random.Random(name), {}

    def frame(values):
        return spark.createDataFrame(sorted(values, key=str), MAIL).coalesce(2)

    now = mail(pick, 150)
    stored = {r[2]: r for r in now}
    view, refills = spec.build(frame(now)), []
    view = spark.createDataFrame(view.collect(), view.schema)
    for step in range(5):
        if step == 3:  # all of one vendor, and what stands first of the hot one
            out = [r for r in stored.values() if r[1] == "b"] + sorted((r for r in stored.values() if r[1] == "hot"), key=lambda r: (r[3] or -1, r[2]))[-12:]
        else:
            out = pick.sample(sorted(stored.values(), key=str), 3)
        new = mail(pick, 4 if step != 3 else 0, 1000 * (step + 1))
        marked = [r[:9] + ("unsubscribed",) for r in pick.sample(sorted(set(stored.values()) - set(out), key=str), 3)]
        was = [stored[r[2]] for r in marked]
        for r in out:
            stored.pop(r[2])
        stored.update({r[2]: r for r in new + marked})
        messages = frame(stored.values())
        after, again = spec.apply(view, frame(new + marked), frame(out + was), messages)
        refills.append(again.count())
        view = spark.createDataFrame(after.collect(), after.schema)
        assert rows(kept(view, spec)) == rows(batch(messages.filter("vendor_key IS NOT NULL"))), (name, step)
        assert all(len(r["items"]) <= spec.k + spec.reserve for r in view.collect())
    assert sum(refills) < 8 and (refills[3] > 0 or name == "methods")


def test_a_small_deletion_reads_no_base_rows(spark):
    spec = topk_views.latest(5, 5)
    base = spark.createDataFrame(mail(random.Random(1), 300), MAIL)
    view = spec.build(base)
    first = spec.first(view).filter("vendor_key = 'hot' AND rank <= 3").select("message_id")
    gone = base.join(first, "message_id", "left_semi")
    _, again = spec.apply(view, base.limit(0), gone, base.join(gone, "message_id", "left_anti"))
    assert again.count() == 0


def test_changed_lists_are_worked_out_once(spark):
    """The lists after a batch serve the keys that ran out and the others: they are stored, so only what is read again is ranked anew."""
    spec = topk_views.latest(5, 5)
    base = spark.createDataFrame(mail(random.Random(1), 60), MAIL)
    view = spec.build(base)
    view = spark.createDataFrame(view.collect(), view.schema)
    after, _ = spec.apply(view, base.limit(0), base.limit(2), base)
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
