"""Merges, edits, decisions, the log and the skew-safe idioms."""
import datetime as dt
import hashlib
import json
import random

import pytest

from pyspark.sql import functions as F

from licmatch import rules
from licmatch.operators import audit, decision_fold, decisions, frames, hash_tree, ingest, people
from licmatch.operators import store as st
from licmatch.operators import views
from tests.test_sources import posting, postings

TODAY = "2026-08-14"


def test_insert_only_merge_keeps_hand_edits(spark):
    store = postings(spark, posting(1, status="applied", notes="mine"))
    batch = postings(spark, posting(5, id="1"), posting(6, id="2", title="first"),
                     posting(7, id="2", title="second"), posting(8, id=""))
    merged = {r["id"]: r for r in st.merge(store, batch).collect()}
    assert set(merged) == {"1", "2"}
    assert merged["1"]["notes"] == "mine" and merged["2"]["title"] == "first"


def test_harvest_never_reverts_a_row(spark):
    store = postings(spark, posting(1, status="interview", notes="keep"),
                     posting(2, company="Beta Ltd", title="AI Engineer"))
    view = postings(spark, posting(1, id="1.0", status="new", notes=""),
                    posting(2, id="", company="Beta", title="AI Engineer!", status="applied",
                            applied_via="email"))
    found = {r["id"]: r for r in st.harvest_edits(store, view).collect()}
    assert (found["1"]["status"], found["1"]["notes"], found["1"]["cells_changed"]) == (
        "interview", "keep", 0)
    assert (found["2"]["status"], found["2"]["applied_via"], found["2"]["cells_changed"]) == (
        "applied", "email", 2)


def test_closures_only_for_fetched_boards(spark):
    store = postings(spark, posting(1, id="gh:1", company="A"), posting(2, id="gh:2",
                     company="A"), posting(3, id="lever:3", company="B"), posting(4, id="9"),
                     posting(5, id="gh:5", company="A"))
    feed = postings(spark, posting(1, id="gh:1", company="A"))
    boards = spark.createDataFrame([("A", "greenhouse")], "company string, ats string")
    closed = spark.createDataFrame([("gh:5",)], "id string")
    found = st.closures(store, feed, boards, closed, TODAY).collect()
    assert [tuple(r) for r in found] == [("gh:2", TODAY, "absent from greenhouse feed")]


def test_mutations_touch_only_named_fields(spark):
    store = postings(spark, posting(1), posting(2))
    changes = spark.createDataFrame(
        [("1", "status", "applied", 1), ("1", "status", "offer", 2), ("1", "bogus", "x", 3),
         ("9", "status", "x", 4), ("2", "status", "new", 5), ("2", "salary_max", "50000", 6)],
        "id string, field string, value string, ord bigint")
    found = {r["id"]: r for r in st.apply_mutations(store, changes).collect()}
    assert found["1"]["status"] == "offer" and found["1"]["changed"]
    assert found["2"]["salary_max"] == 50000.0 and found["2"]["status"] == "new"
    assert set(found) == {"1", "2"}


def test_rescore_touches_only_licence_columns(spark):
    store = postings(spark, posting(1, company="Monzo", sponsor_match="no", notes="keep",
                                    status="applied"),
                     posting(2, company="Other", sponsor_match="no"))
    lookup = spark.createDataFrame([("MONZO BANK", "B", 1)], "key string, rating string, "
                                                             "ord bigint")
    aliases = spark.createDataFrame([("monzo ltd", "MONZO BANK", "A", 1)],
                                    "company string, register_name string, rating string, "
                                    "ord bigint")
    found = {r["id"]: r for r in st.rescore(store, lookup, aliases).collect()}
    one = found["1"]
    assert (one["sponsor_match"], one["sponsor_rating"], one["notes"], one["status"]) == (
        "yes", "B", "keep", "applied")
    assert found["2"]["sponsor_match"] == "no" and not found["2"]["changed"]


def test_resolution_preview_equals_apply(spark):
    store = postings(spark, posting(1, company="Monzo", sponsor_match="no"),
                     posting(2, company="Monzo Ltd", sponsor_match="no", title="Chef"),
                     posting(3, company="Monzo", sponsor_match="yes"))
    lookup = spark.createDataFrame([("MONZO BANK", "A", 1)], "key string, rating string, "
                                                             "ord bigint")
    aliases = spark.createDataFrame([("Beta", "OLD", "A", 1)],
                                    "company string, register_name string, rating string, "
                                    "ord bigint")
    proposals = spark.createDataFrame(
        [(1, "Monzo", "Monzo Bank", "same registered address", False, False),
         (2, "Ghost", "Monzo Bank", "same registered address", False, False),
         (3, "Monzo", "Nope", "same registered address", False, False),
         (4, "Monzo", "Monzo Bank", "short", False, False)],
        "ord int, company string, register_name string, rationale string, "
        "supersede boolean, acknowledge_agency boolean")
    judged = decisions.judge_resolutions(proposals, store, lookup, aliases)
    found = {r["ord"]: r for r in judged.collect()}
    assert [found[i]["code"] for i in (1, 2, 3, 4)] == [
        "", "not_found", "register_entry_not_found", "rationale_required"]
    assert (found[1]["rows_changed"], found[1]["shortlist_delta"]) == (2, 1)
    assert [v["result"] for v in found[3]["validations"]] == ["pass", "fail"]
    applied = st.apply_mutations(store, decisions.resolution_mutations(judged, store))
    assert applied.filter("changed").count() == found[1]["rows_changed"]
    assert {r["sponsor_rating"] for r in applied.filter("changed").collect()} == {"A"}
    assert decisions.accepted_aliases(judged, TODAY).count() == 1


def test_application_rules(spark):
    store = postings(spark, posting(1, sponsor_match="yes"), posting(2, status="applied"),
                     posting(3, title="Senior Data Engineer", sponsor_match="yes"))
    asks = [("1", "email", "", ""), ("2", "email", "", ""), ("1", "pigeon", "", ""),
            ("1", "email", "2026-08-15", ""), ("1", "email", "soon", ""),
            ("3", "email", "", ""), ("3", "email", "", "they asked"), ("7", "email", "", "")]
    proposals = spark.createDataFrame(
        [(i, j, v, d, "", o) for i, (j, v, d, o) in enumerate(asks)],
        "ord int, job_id string, applied_via string, date_applied string, notes string, "
        "override_reason string")
    judged = decisions.judge_applications(proposals, store, TODAY)
    rows = judged.orderBy("ord").collect()
    assert [r["code"] for r in rows] == ["", "already_actioned", "unknown_method",
                                         "ineligible", "ineligible", "ineligible", "",
                                         "not_found"]
    assert rows[0]["applied_on"] == TODAY
    assert rows[6]["validations"][-1]["override_reason"] == "they asked"
    done = {r["id"]: r for r in st.apply_mutations(
        store, decisions.application_mutations(judged)).collect()}
    assert done["1"]["status"] == "applied" and done["1"]["applied_via"] == "email"


def test_status_rules(spark):
    store = postings(spark, posting(1), posting(2, status="applied", notes="old"))
    proposals = spark.createDataFrame(
        [(0, "1", "Applied", ""), (1, "1", "hired", ""), (2, "2", "applied", ""),
         (3, "2", "screening", "call")], "ord int, job_id string, status string, note string")
    judged = decisions.judge_status_changes(proposals, store, TODAY)
    rows = judged.orderBy("ord").collect()
    assert [r["code"] for r in rows] == ["", "unknown_status", "already_actioned", ""]
    assert rows[0]["new_date_applied"] == TODAY
    assert rows[3]["new_notes"] == f"old\n{TODAY}: call"
    done = {r["id"]: r["status"] for r in st.apply_mutations(
        store, decisions.status_mutations(judged)).collect()}
    assert done == {"1": "applied", "2": "screening"}
    logged = decisions.log_rows(judged, rules.STATUS_SET, at="t").collect()
    assert {r["rationale"] for r in logged} == {"Moved from new to applied.", "call"}


def sealed(spark, n, chunk):
    entries = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.concat(
        F.lit("body "), F.col("id").cast("string")).alias("body"))
    return audit.chain(entries, chunk=chunk)


def test_chain_links_and_tampering(spark):
    log = sealed(spark, 25, 10)
    rows = {r["seq"]: r for r in log.collect()}
    assert rows[1]["prev_hash"] == rules.GENESIS
    want = "sha256:" + hashlib.sha256((rows[4]["hash"] + "\nbody 5").encode()).hexdigest()
    assert rows[5]["prev_hash"] == rows[4]["hash"] and rows[5]["hash"] == want
    report = lambda frame: audit.chain_report(
        audit.verify_chain(frame, body="body", chunk=10)).first()
    assert tuple(report(log)) == (True, None, 25)
    forged = log.withColumn("body", F.when(F.col("seq") == 13, "x").otherwise(F.col("body")))
    assert tuple(report(forged)) == (False, 13, 25)
    assert tuple(report(log.filter("seq <> 7"))) == (False, 8, 24)
    assert tuple(report(log.filter("seq <= 10 or seq > 20"))) == (False, 21, 15)
    assert tuple(report(log.filter("seq <= 7 or seq > 10"))) == (False, 11, 22)
    assert tuple(report(log.filter("seq > 10"))) == (False, 11, 15)
    assert tuple(report(log.unionByName(log.filter("seq = 4")))) == (False, 4, 26)
    # Whoever deletes a chunk and numbers the rest anew cannot make the next start fit.
    moved = log.filter("seq <= 10").unionByName(
        log.filter("seq > 20").withColumn("seq", F.col("seq") - 10))
    assert tuple(report(moved)) == (False, 11, 15)


def test_unbroken_chain_can_be_continued(spark):
    log = sealed(spark, 7, 2**62)
    batch = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")],
                                  "ord bigint, action_id string, ts string")
    new = audit.append(log, batch, ["action_id", "ts"], chunk=None)
    whole = log.unionByName(new.select(*log.columns))
    report = audit.chain_report(audit.verify_chain(whole, body="body", chunk=None)).first()
    assert tuple(report) == (True, None, 9)


def test_long_unbroken_chain_in_bounded_rows(spark):
    log = spark.createDataFrame([(1, "", "x", "")], "seq long, prev_hash string, hash string, "
                                "body string")
    batch = spark.range(1, 30001).select(F.col("id").alias("ord"), F.lit("a").alias("action_id"),
                                         F.lit("t").alias("ts"))
    new = audit.append(log, batch, ["action_id", "ts"], chunk=None)
    # No row of the plan holds the entries of the chain.
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    last, rows = "x", new.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(2, 30002))
    for r in rows:
        assert r["prev_hash"] == last
        last = "sha256:" + hashlib.sha256((last + "\n" + r["body"]).encode()).hexdigest()
        assert r["hash"] == last


def test_append_continues_an_open_chunk(spark):
    log = sealed(spark, 5, 10)
    batch = spark.createDataFrame([(70, "a", "t", "x"), (90, "b", "t", "x"), (80, "c", "t",
                                                                           "x")],
                                  "ord bigint, action_id string, ts string, type string")
    new = audit.append(log, batch, ["action_id", "ts", "type"], chunk=10)
    rows = new.orderBy("seq").collect()
    assert [(r["seq"], r["action_id"]) for r in rows] == [(6, "a"), (7, "c"), (8, "b")]
    assert rows[0]["prev_hash"] == log.filter("seq = 5").first()["hash"]
    assert rows[2]["prev_hash"] == rows[1]["hash"]
    whole = log.unionByName(new.select(*log.columns))
    assert audit.chain_report(audit.verify_chain(whole, body="body", chunk=10)).first()[0]
    grown = audit.append(whole, batch.withColumn("ord", F.col("ord") + 100),
                         ["action_id", "ts", "type"], chunk=4)
    assert grown.count() == 3
    with pytest.raises(Exception, match="the log is full"):
        audit.append(log, batch, ["action_id"], max_entries=6, chunk=10).collect()


def test_replay_and_undo(spark):
    rows = [(1, "e1", "alias.confirm", "A", "X", ""), (2, "e2", "alias.confirm", "B", "Y", ""),
            (3, "e3", "alias.reject", "A", "", ""), (4, "e4", "alias.confirm", "C", "Z", ""),
            (5, "e5", "alias.confirm.undone", "C", "", "e4"),
            (6, "e6", "alias.confirm.failed", "D", "W", "")]
    log = spark.createDataFrame(
        [(*r, "A", "d", "me", "why") for r in rows],
        "seq bigint, id string, type string, company string, register_name string, "
        "target_id string, rating string, day string, actor string, rationale string")
    live = audit.replay_aliases(log)
    assert [r["company"] for r in live.collect()] == ["B"]
    disk = spark.createDataFrame([("B", "OTHER"), ("E", "Q")],
                                 "company string, register_name string")
    assert {tuple(r) for r in audit.alias_drift(disk, live).collect()} == {
        ("B", "drift"), ("E", "unattributed")}


def test_replayed_actions(spark):
    log = spark.createDataFrame([("a", "e1", 1)], "action_id string, id string, seq bigint")
    asks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, ""), (5, "")],
                                 "ord int, action_id string")
    found = {r["ord"]: r["replayed"] for r in decisions.replay(asks, log).collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_carry_forward_over_chunks(spark):
    rows = [("k", i, "v%d" % i if i % 50 == 3 else None) for i in range(400)] \
        + [("z", i, None) for i in range(5)]
    frame = spark.createDataFrame(rows, "k string, i int, v string")
    found = {(r["k"], r["i"]): r["last"] for r in
             frames.carry_forward(frame, ["k"], "i", "v", "last", chunk=7).collect()}
    last = None
    for _, i, v in rows[:400]:
        last = v or last
        assert found["k", i] == last
    assert found["z", 4] is None


def test_dense_sequence(spark):
    frame = spark.range(0, 5000, 7).repartition(5)
    found = {r["id"]: r["n"] for r in
             frames.dense_sequence(frame, "id", "n", start=11, chunk=100).collect()}
    assert all(found[v] == i + 11 for i, v in enumerate(range(0, 5000, 7)))


def test_daily_budget(spark):
    calls = spark.createDataFrame([("d%d" % (i % 2), i) for i in range(20)],
                                  "day string, ord int")
    assert sorted(r["ord"] for r in ingest.admitted(calls, cap=3).collect()) == [
        0, 1, 2, 3, 4, 5]


def test_contacts(spark):
    saves = spark.createDataFrame(
        [(1, "Acme", "h1", "Jane", "manual", "", "", "j1", "met", [], "d"),
         (2, "acme ", "H1", "Jane D", "github", "http://u", "", "j2", "", ["x"], "d"),
         (3, "Acme", "h1", "", "m", "http://late", "Leeds", "j1", "again", [], "d")],
        "ord int, company string, handle string, name string, source string, url string, "
        "location string, job_id string, notes string, routes array<string>, found_on string")
    one = people.upsert_contacts(saves).first()
    assert (one["name"], one["url"], one["location"], one["source"], one["routes"]) == (
        "Jane", "http://u", "Leeds", "manual", ["x"])
    assert people.contact_jobs(saves).count() == 2
    assert people.rendered_notes(people.contact_notes(saves), "ACME", "h1").first()[0] == \
        "met\nagain"
    contacts = spark.createDataFrame(
        [("1", "contacted", "2026-08-05"), ("2", "contacted", "2026-08-12"),
         ("3", "replied", "2026-07-01"), ("4", "contacted", "")],
        "id string, status string, contacted_on string")
    due = people.due_contacts(contacts, TODAY).collect()
    assert [(r["id"], r["days"], r["touch"]) for r in due] == [("1", 9, 9)]
    moved = decisions.contact_status_changes(
        spark.createDataFrame([("1", "found", "", "")], "id string, status string, "
                              "contacted_on string, notes string"),
        spark.createDataFrame([("1", "Contacted", "hi", 1)], "id string, status string, "
                              "note string, ord int"), TODAY).first()
    assert tuple(moved) == ("1", "contacted", TODAY, f"{TODAY}: hi")


def test_follow_ups_report_unknown_dates(spark):
    rows = postings(spark, posting(1, status="applied", date_applied="2026-08-01"),
                    posting(2, status="applied"), posting(3, status="applied",
                                                          date_applied="2026-08-13"))
    found = [(r["id"], r["days"]) for r in views.follow_ups(rows, TODAY).collect()]
    assert found == [("1", 13), ("2", None)]
    assert dt.date.fromisoformat(TODAY) > dt.date(2026, 8, 1)


def test_later_decisions_of_a_batch_see_the_earlier_ones(spark):
    store = postings(spark, posting(1, title="Graduate Developer", location="London"),
                     posting(2, status="new", notes=""))
    moves = spark.createDataFrame(
        [(1, "2", "screening", "first"), (2, "2", "screening", "again"), (3, "2", "applied", ""),
         (4, "2", "applied", "x"), (5, "2", "closed", "last")],
        "ord int, job_id string, status string, note string")
    judged = decisions.judge_status_changes(moves, store, TODAY)
    rows = {r["ord"]: r for r in judged.collect()}
    assert [rows[k]["code"] for k in range(1, 6)] == ["", "already_actioned", "",
                                                      "already_actioned", ""]
    assert rows[5]["new_notes"] == f"{TODAY}: first\n{TODAY}: last"
    assert rows[3]["new_date_applied"] == str(TODAY) and rows[5]["status_before"] == "applied"
    twice = spark.createDataFrame(
        [(1, "1", "company site", "", "", "they asked"), (2, "1", "company site", "", "", "ok")],
        "ord int, job_id string, applied_via string, date_applied string, notes string, "
        "override_reason string")
    found = {r["ord"]: r["code"] for r in
             decisions.judge_applications(twice, store, TODAY).collect()}
    assert found == {1: "", 2: "already_actioned"}


def test_numbers_by_range_with_hot_ties(spark):
    rows = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"))
    got = frames.number_by_range(rows.repartition(5), ["k"], "n", start=11, partitions=16)
    found = got.orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(11, 6011))
    assert [r["k"] for r in found] == sorted(r["k"] for r in found)
    assert {r["v"] for r in found} == set(range(6000))
    # The hot value is dealt out over several partitions, so no task holds a third of the rows.
    placed = frames.staged(rows.repartitionByRange(16, "k", F.xxhash64("k", "v")))
    assert max(r["count"] for r in placed.groupBy(F.input_file_name().alias("f")).count()
               .collect()) < 1500
    assert frames.number_by_range(rows.limit(0), ["k"], "n").count() == 0
    repeated = spark.createDataFrame([(1,), (1,), (None,), (0,)], "k int")
    assert sorted((r["n"], r["k"]) for r in frames.number_by_range(
        repeated, ["k"], "n").collect()) == [(1, None), (2, 0), (3, 1), (4, 1)]


def test_dense_sequence_over_far_numbers(spark):
    far = [0, 5, 2 ** 20, 2 ** 33, 2 ** 33 + 1, 2 ** 50, 2 ** 62]
    frame = spark.createDataFrame([(v,) for v in far], "id bigint")
    found = {r["id"]: r["n"] for r in
             frames.dense_sequence(frame, "id", "n", chunk=16).collect()}
    assert found == {v: i + 1 for i, v in enumerate(far)}


def in_order(digests, fan=hash_tree.FAN):
    """Starts of all leaves by one walk from left to right over the whole tree."""
    def fold(items):
        text = ""
        for item in items:
            text = hashlib.sha256((text + item).encode()).hexdigest()
        return text

    nodes, levels = list(digests), []
    while True:
        levels.append(nodes)
        if len(nodes) == 1:
            break
        nodes = [fold(nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
    starts = [rules.GENESIS]
    for below in reversed(levels[:-1]):
        out = []
        for i in range(len(below)):
            before, start = fold(below[i - i % fan:i]), starts[i // fan]
            out.append("sha256:" + hashlib.sha256(f"{start}\n{before}".encode()).hexdigest()
                       if before else start)
        starts = out
    return starts


def test_hash_tree_starts(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(700)]
    leaves = spark.createDataFrame(list(enumerate(digests)), "node bigint, digest string")
    want = dict(enumerate(in_order(digests)))
    assert dict(map(tuple, hash_tree.starts(leaves).collect())) == want
    # The number of levels changes no start; rows beyond it are an error.
    assert dict(map(tuple, hash_tree.starts(leaves, depth=2).collect())) == want
    with pytest.raises(Exception, match="more than 256"):
        hash_tree.starts(leaves, depth=1).collect()
    # Every digest before a leaf counts for its start, none after it.
    other = leaves.withColumn("digest", F.when(F.col("node") == 300, "x")
                              .otherwise(F.col("digest")))
    changed = {n for n, s in map(tuple, hash_tree.starts(other).collect()) if want[n] != s}
    assert changed == set(range(301, 700))


@pytest.mark.parametrize("cut", [255, 512, 699])
def test_hash_tree_goes_on_from_its_right_edge(spark, cut):
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(700)]
    leaves = spark.createDataFrame(list(enumerate(digests)), "node bigint, digest string")
    want = dict(enumerate(in_order(digests)))
    edge = hash_tree.right_edge(leaves.filter(F.col("node") < cut))
    assert edge.count() <= hash_tree.DEPTH
    later = hash_tree.starts(leaves.filter(F.col("node") >= cut), edge=edge)
    assert dict(map(tuple, later.collect())) == {n: want[n] for n in range(cut, 700)}
    grown = hash_tree.right_edge(leaves.filter(F.col("node") >= cut), edge=edge)
    assert set(map(tuple, grown.collect())) == set(
        map(tuple, hash_tree.right_edge(leaves).collect()))


def test_a_million_chunk_digests(spark):
    leaves = spark.range(10 ** 6).select(F.col("id").alias("node"), F.sha2(
        F.col("id").cast("string"), 256).alias("digest"))
    starts = hash_tree.starts(leaves)
    row = starts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("d")).first()
    assert tuple(row) == (10 ** 6, 10 ** 6)


def test_chain_plans_collect_by_key_only(spark):
    log = sealed(spark, 1000, 10)
    plan = audit.verify_chain(log, body="body", chunk=10)._jdf.queryExecution() \
        .optimizedPlan().toString()
    collects = [line for line in plan.splitlines() if "collect_list" in line]
    assert collects and all("Aggregate [" in line and "Aggregate [collect_list" not in line
                            and "Aggregate [array" not in line for line in collects)


def test_append_needs_the_open_chunk_and_the_edge_only(spark):
    ask = spark.range(1, 1201).select(F.col("id").alias("ord"), F.lit("a").alias("action_id"),
                                      F.lit("t").alias("ts"))
    none = sealed(spark, 0, 4)
    whole = frames.staged(audit.append(none, ask, ["action_id", "ts"], chunk=4)
                          .select("seq", "prev_hash", "hash", "body"))
    assert audit.chain_report(audit.verify_chain(whole, body="body", chunk=4)).first()[0]
    want = {r["seq"]: r["hash"] for r in whole.collect()}
    for cut in (4, 1030):
        before = whole.filter(F.col("seq") <= cut)
        edge = audit.log_edge(before, chunk=4)
        tail = before.filter(F.col("seq") > cut - cut % 4 - 1)  # the rest of the log is not read
        new = audit.append(tail, ask.filter(F.col("ord") > cut), ["action_id", "ts"], chunk=4,
                           edge=edge)
        assert {r["seq"]: r["hash"] for r in new.collect()} == {
            n: h for n, h in want.items() if n > cut}, cut
        grown = audit.log_edge(whole.filter(F.col("seq") > cut - cut % 4), chunk=4, edge=edge)
        assert set(map(tuple, grown.collect())) == set(
            map(tuple, audit.log_edge(whole, chunk=4).collect()))


def test_verify_log_in_one_row(spark):
    log = sealed(spark, 9, 4)
    live = spark.createDataFrame([("B", "X"), ("C", "Y"), ("D", "Z")],
                                 "company string, register_name string")
    disk = spark.createDataFrame([("B", "OTHER"), ("C", "Y"), ("E", "Q")],
                                 "company string, register_name string")
    row = audit.verify_log(log, "body", chunk=4, alias_file=disk, replayed=live).first()
    assert tuple(row) == (True, None, 9, 2, 1, False)
    assert tuple(audit.verify_log(log, "body", chunk=4).first()) == (True, None, 9, 0, 0, True)


def walked(store_open, stored, asks):
    """Codes, rows and superseded names of proposals for one company, one after another."""
    name, opened, answers, out = stored, store_open, {}, []
    for ask, register_name, supersede, action in asks:
        if action and action in answers:
            out.append(("", 0, True))
            continue
        if name is not None and name != register_name and not supersede:
            out.append(("already_resolved", 0, False))
            continue
        out.append(("", opened, False))
        name, opened = register_name, 0
        if action:
            answers[action] = ask
    return out


def test_resolutions_are_a_state_machine(spark):
    rng = random.Random(8)
    lookup = spark.createDataFrame([(n, "A", i) for i, n in enumerate(("N ONE", "N TWO", "N SIX"))],
                                   "key string, rating string, ord int")
    companies = [f"C{i}" for i in range(12)]
    store = postings(spark, *[posting(3 * i + k, company=c, sponsor_match="yes" if k == 2 else "no")
                              for i, c in enumerate(companies) for k in range(3)])
    stored = {c: "N TWO" for c in companies[:4]}
    aliases = spark.createDataFrame([(c, n, "B", 1) for c, n in stored.items()],
                                    "company string, register_name string, rating string, "
                                    "ord bigint")
    asks = {c: [(0, rng.choice(["N ONE", "N TWO", "N SIX"]), rng.random() < .3,
                 rng.choice(["", f"{c}-1", f"{c}-2"])) for _ in range(9)] for c in companies}
    rows, want = [], {}
    for k in range(9):
        for c in companies:
            _, name, supersede, action = asks[c][k]
            rows.append((len(rows), c, name, "same registered address", supersede, False, action))
    for c in companies:
        ords = [r[0] for r in rows if r[1] == c]
        want |= dict(zip(ords, walked(2, stored.get(c), asks[c])))
    proposals = spark.createDataFrame(
        rows, "ord int, company string, register_name string, rationale string, "
        "supersede boolean, acknowledge_agency boolean, action_id string").repartition(5)
    judged = decisions.judge_resolutions(proposals, store, lookup, aliases)
    found = judged.collect()
    assert {r["ord"]: (r["code"], r["rows_changed"], r["replayed"]) for r in found} == want
    # A repeat has the validations of the first answer.
    by_ord = {r["ord"]: r for r in found}
    for r in found:
        if r["replayed"]:
            first = min((x for x in found if x["action_id"] == r["action_id"]
                         and x["code"] == "" and not x["replayed"]), key=lambda x: x["ord"])
            assert r["validations"] == by_ord[first["ord"]]["validations"]
            assert r["rating"] == first["rating"] and r["log_entry_id"] is None
    fresh = {r["ord"] for r in found if r["code"] == "" and not r["replayed"]}
    entries = decisions.log_rows(judged, rules.CONFIRM, at="t", changes=decisions
                                 .resolution_changes(judged, store)).collect()
    assert {e["ord"] for e in entries} == fresh
    for e in entries:
        ids = json.loads(e["effects"]["job_ids"])
        assert len(ids) == int(e["effects"]["rows_changed"]) == len(e["before"]) == len(e["after"])
        assert all(json.loads(v) == {"sponsor_match": "yes"} for v in e["after"].values())
        assert all(json.loads(v) == {"sponsor_match": "no"} for v in e["before"].values())


def test_repeated_status_and_application_actions(spark):
    store = postings(spark, posting(1, title="Graduate Developer", sponsor_match="yes"),
                     posting(2, status="new", notes=""))
    moves = spark.createDataFrame(
        [(1, "2", "screening", "first", "x"), (2, "2", "closed", "", "y"),
         (3, "2", "screening", "first", "x"), (4, "2", "closed", "again", "z"),
         (5, "2", "screening", "", "z")],
        "ord int, job_id string, status string, note string, action_id string")
    judged = decisions.judge_status_changes(moves, store, TODAY)
    rows = {r["ord"]: r for r in judged.collect()}
    assert [(rows[k]["code"], rows[k]["replayed"], rows[k]["rows_changed"])
            for k in range(1, 6)] == [("", False, 1), ("", False, 1), ("", True, 0),
                                      ("already_actioned", False, 0), ("", False, 1)]
    done = {r["id"]: (r["status"], r["notes"]) for r in st.apply_mutations(
        store, decisions.status_mutations(judged)).collect()}
    assert done["2"] == ("screening", f"{TODAY}: first")
    logged = decisions.log_rows(judged, rules.STATUS_SET, at="t").orderBy("ord").collect()
    assert [e["ord"] for e in logged] == [1, 2, 5]
    assert json.loads(logged[1]["before"]["2"]) == {"status": "screening"}
    assert json.loads(logged[1]["after"]["2"]) == {"status": "closed"}
    log = spark.createDataFrame(
        [("x", "e9", 4, [], {"status_before": "a", "status_after": "b", "rows_changed": "1"})],
        "action_id string, id string, seq bigint, validations " +
        dict(judged.dtypes)["validations"] + ", effects map<string,string>")
    again = {r["ord"]: r for r in
             decisions.judge_status_changes(moves, store, TODAY, log).collect()}
    assert [(again[k]["code"], again[k]["log_entry_id"], again[k]["rows_changed"])
            for k in (1, 2, 3)] == [("", "e9", 0), ("", None, 1), ("", "e9", 0)]
    assert again[1]["status_after"] == "b" and again[2]["status_before"] == "new"
    asks = spark.createDataFrame(
        [(1, "1", "email", "", "", "", "p"), (2, "1", "email", "", "", "", "p"),
         (3, "1", "email", "", "", "", "q")],
        "ord int, job_id string, applied_via string, date_applied string, notes string, "
        "override_reason string, action_id string")
    judged = decisions.judge_applications(asks, store, TODAY)
    rows = {r["ord"]: r for r in judged.collect()}
    assert [(rows[k]["code"], rows[k]["replayed"], rows[k]["applied_on"]) for k in (1, 2, 3)] == [
        ("", False, TODAY), ("", True, TODAY), ("already_actioned", False, "")]
    entry = decisions.log_rows(judged, rules.APPLICATION, at="t").collect()
    assert len(entry) == 1 and json.loads(entry[0]["effects"]["job_ids"]) == ["1"]


def test_proposals_that_repeat_nothing_are_dealt_out(spark):
    """A null in ``repeats`` must not send the whole batch to one partition."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        judged = spark.range(400).select(
            F.col("id").alias("ord"), F.lit("").alias("code"),
            decisions.no_validations().alias("validations"), F.lit(1).alias("rows_changed"),
            F.when(F.col("id") == 7, F.lit(3)).cast("bigint").alias("repeats"))
        done = decisions.answered(judged, [], ["rows_changed"])
        assert [r["ord"] for r in done.filter("replayed").collect()] == [7]
        sizes = [r["count"] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 and max(sizes) < 200
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_proposals_for_missing_jobs_are_not_walked(spark, monkeypatch):
    def walk(rule):
        def found_only(batches):
            import pandas as pd
            for batch in batches:
                assert batch["stored"].notna().all()
                yield pd.DataFrame({"_ord": batch["ord"], "state_before": batch["stored"],
                                    "accepted_before": 0, "repeats": None})
        return found_only
    monkeypatch.setattr(decision_fold, "_walk", walk)
    store = postings(spark, posting(1, status="new"))
    moves = spark.createDataFrame(
        [(i, "zz", "applied", "x") for i in range(5)] + [(9, "1", "applied", "x")],
        "ord int, job_id string, status string, note string")
    codes = {r["ord"]: r["code"] for r in
             decisions.judge_status_changes(moves, store, TODAY).collect()}
    assert codes == {**{i: "not_found" for i in range(5)}, 9: ""}


def test_many_notes_of_a_contact_are_joined_at_once(spark):
    """Appending note by note copies all that is there for each of them."""
    contacts_ = spark.createDataFrame(
        [("1", "found", "", " old "), ("2", "found", "", " old "), ("3", "found", "", "")],
        "id string, status string, contacted_on string, notes string")
    changes = spark.createDataFrame(
        [("1", "found", f" n{i} " if i % 3 else "  ", i) for i in range(9)]
        + [("2", "found", " ", 20), ("3", "found", "only", 21)],
        "id string, status string, note string, ord int")
    moved = decisions.contact_status_changes(contacts_, changes, TODAY)
    lines = "\n".join(f"{TODAY}: n{i}" for i in range(9) if i % 3)
    assert {r["id"]: r["notes"] for r in moved.collect()} == {
        "1": f"old\n{lines}", "2": " old ", "3": f"{TODAY}: only"}
    assert "aggregate(" not in moved._jdf.queryExecution().optimizedPlan().toString()


def test_unbroken_chain_is_folded_in_steps(spark, monkeypatch):
    """No task sorts more than a step; the last hash goes on to the next."""
    monkeypatch.setattr(audit, "FOLD_STEP", 4)
    log = spark.createDataFrame([(2, "", "x", "")], "seq long, prev_hash string, hash string, "
                                "body string")
    batch = spark.range(1, 12).select(F.col("id").alias("ord"), F.lit("a").alias("action_id"),
                                      F.lit("t").alias("ts"))
    new = audit.append(log, batch, ["action_id", "ts"], chunk=None)
    last, rows = "x", new.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(3, 14))
    for r in rows:
        assert r["prev_hash"] == last
        last = "sha256:" + hashlib.sha256((last + "\n" + r["body"]).encode()).hexdigest()
        assert r["hash"] == last
    assert "MapInPandas" not in new._jdf.queryExecution().executedPlan().toString()
    assert audit.append(log, batch.limit(0), ["action_id", "ts"], chunk=None).count() == 0
