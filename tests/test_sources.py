"""Files, payloads and reports."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from licmatch import schema
from licmatch.operators import audit, review
from licmatch.plans.fixtures import Tables
from licmatch.plans.registry import QUERIES, split_bytes
from licmatch.sources import csv_records, feeds, reports, searches, tables

TODAY = "2026-08-14"
GREENHOUSE = {
    "id": 4410277, "title": "Data Engineer, Search",
    "location": {"name": "Bristol, UK"},
    "absolute_url": "https://b.example/4410277", "updated_at": "2026-06-30T20:01:02Z",
    "first_published": "2026-06-11T07:45:00+01:00", "application_deadline": "",
    "content": "&lt;p&gt;Come &lt;strong&gt;build&lt;/strong&gt;.&lt;/p&gt;",
    "departments": [{"name": "Systems"}, {"name": "Tools"}], "company_name": "Jobs at X",
    "employment_type": "FullTime"}
ASHBY = {
    "id": "k77a", "title": "Backend Engineer, Ledger", "department": "Payments",
    "team": "Ledger", "employmentType": "FullTime", "location": "Leeds, UK",
    "secondaryLocations": [{"location": "Remote (UK)"}, "Hull"],
    "publishedAt": "2026-05-19T08:30:00.125+00:00", "isListed": True, "isRemote": False,
    "jobUrl": "https://a.example/k77a", "descriptionHtml": "<p>Build <b>things</b>.</p>"}
LEVER = {
    "id": "m2q9", "text": "Graduate Software Engineer",
    "categories": {"location": "York", "team": "Apps", "commitment": "Full-time"},
    "createdAt": 1760054400000, "hostedUrl": "https://l.example/m2q9",
    "descriptionPlain": "Join the team."}


def fetches(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "ord bigint, ats string, company string, http_status int, "
                                 "body string")


def test_three_families_one_schema(spark):
    log = fetches(spark, ("greenhouse", "Monzo", 200, json.dumps({"jobs": [GREENHOUSE]})),
                  ("ashby", "Acme", 200, json.dumps({"jobs": [ASHBY]})),
                  ("lever", "Beta", 200, json.dumps([LEVER])))
    rows = feeds.board_rows(log, TODAY)
    assert rows.columns == [*schema.POSTING_FIELDS, "ord"]
    found = {r["source"]: r for r in rows.collect()}
    gh, ashby, lever = found["gh"], found["ashby"], found["lever"]
    assert (gh["id"], gh["company"], gh["posted_date"], gh["category"], gh["tier"]) == (
        "gh:4410277", "Monzo", "2026-06-11", "Systems, Tools", "4")
    assert gh["description"] == "Come build ." and gh["contract_type"] == "permanent"
    assert ashby["location"] == "Leeds, UK; Remote (UK), Hull"
    assert ashby["posted_date"] == "2026-05-19" and ashby["category"] == "Payments"
    assert (lever["posted_date"], lever["tier"], lever["location"]) == (
        "2025-10-10", "2", "York")
    assert all(r["date_first_seen"] == TODAY and r["status"] == "new" for r in found.values())


def test_unknown_family_fails_loudly(spark):
    log = fetches(spark, ("workday", "X", 200, "{}"))
    with pytest.raises(Exception, match="no mapper"):
        feeds.board_rows(log, TODAY).collect()


def test_one_read_of_the_payloads(spark):
    log = fetches(spark, ("lever", "Beta", 200, json.dumps([LEVER])))
    plan = feeds.board_rows(log, TODAY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("AS _payload") == 1


def test_stamps_of_every_kind(spark):
    stamps = {"1700000000": "2023-11-14", "1700000000000": "2023-11-14", "1.7e9": "2023-11-14",
              "1700000000.5": "2023-11-14", "86400": "1970-01-02", "7": "1970-01-01",
              '"2026-01-02T03:04:05Z"': "2026-01-02", '"1700000000"': "", '"3 May 2026"':
              "2026-05-03", "true": "", "null": "", "[1]": "", '{"a": 1}': "", '""': "",
              "1e300": "", "-86400": "1969-12-31"}
    log = fetches(spark, *[("lever", "B", 200, f'[{{"id":"{i}","createdAt":{s}}}]')
                           for i, s in enumerate(stamps)])
    found = {r["id"]: r["posted_date"] for r in feeds.board_rows(log, TODAY).collect()}
    assert found == {f"lever:{i}": day for i, day in enumerate(stamps.values())}


def test_order_of_jobs_in_large_logs(spark):
    jobs = json.dumps([{"id": "a"}, {"id": "b"}])
    log = spark.createDataFrame(
        [(n, "lever", "B", 200, jobs) for n in (1, 2 ** 33, 2 ** 62)],
        "ord bigint, ats string, company string, http_status int, body string")
    rows = feeds.board_rows(log, TODAY).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["lever:a", "lever:b"] * 3
    assert len({r["ord"] for r in rows}) == 6


def test_payloads_of_odd_shapes(spark):
    bodies = ['{"jobs":[null,5,{"id":3,"departments":[null,{"name":"D"},7],"location":null}]}',
              '{"jobs":{}}', "{}", "[]", "broken", None]
    log = fetches(spark, *[("greenhouse", "B", 200, b) for b in bodies])
    rows = feeds.board_rows(log, TODAY).filter("id <> 'gh:'").collect()
    assert [(r["id"], r["category"], r["title"]) for r in rows] == [("gh:3", "D", "")]
    mixed = dict(ASHBY, secondaryLocations=[{"location": None}, "Leeds", {"x": 1}], isListed=False)
    log = fetches(spark, ("ashby", "A", 200, json.dumps({"jobs": [mixed, ASHBY]})))
    assert feeds.board_rows(log, TODAY).count() == 2
    assert feeds.board_rows(log, TODAY, listed_only=True).count() == 1


def test_fetch_log_from_files(spark, folder):
    for ats, slug, body in (("lever", "b-1", json.dumps([LEVER])), ("ashby", "x", "{}")):
        os.makedirs(os.path.join(folder, "in", ats), exist_ok=True)
        write(folder, f"in/{ats}/{slug}.json", body)
    boards = spark.createDataFrame([("Beta", "lever", "b-1", 4)],
                                   "company string, ats string, slug string, ord bigint")
    log = feeds.read_fetch_log(spark, f"{folder}/in", boards).orderBy("ord").collect()
    assert [(r["ats"], r["slug"], r["company"]) for r in log] == [
        ("lever", "b-1", "Beta"), ("ashby", "x", "x")]
    assert log[0]["ord"] == 4 and log[1]["ord"] > 4


def test_fetch_outcomes(spark):
    cases = [("greenhouse", 404, "{}", "not_found"), ("greenhouse", 503, "", "transient"),
             ("lever", 429, "[]", "transient"), ("greenhouse", 200, '{"jobs":[]}', "empty"),
             ("greenhouse", 200, '{"jobs":[{"id":1}]}', "active"),
             ("greenhouse", 200, "{broken", "transient"),
             ("ashby", 200, '{"error":"x"}', "not_found"),
             ("ashby", 200, '{"jobs":[]}', "empty"), ("ashby", 200, '{"jobs":null}', "empty"),
             ("lever", 200, '{"ok":false}', "not_found"), ("lever", 200, "[]", "empty"),
             ("lever", 200, '[{"id":"a"}]', "active"), ("lever", None, None, "transient")]
    log = fetches(spark, *[(f, "c", s, b) for f, s, b, _ in cases])
    found = [r["outcome"] for r in feeds.fetch_outcomes(log).orderBy("ord").collect()]
    assert found == [c[3] for c in cases]


def write(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(content)
    return path


def test_register_csv_with_byte_order_mark(spark, folder):
    path = write(folder, "r.csv", '﻿Organisation Name,Town/City,County,Type & Rating,'
                 'Route\n"Acme, ""The"" Ltd",London,,Worker (A rating),Skilled Worker\n'
                 'Beta,Leeds,W,Worker (B rating),Scale-up Worker\n')
    rows = tables.read_register(spark, path).orderBy("ord").collect()
    assert [r["org"] for r in rows] == ['Acme, "The" Ltd', "Beta"]
    assert rows[0]["type_rating"] == "Worker (A rating)" and rows[1]["county"] == "W"


def test_board_registry_round_trip(spark, folder):
    head = "company,ats,slug,register_name,status,last_ok,notes\n"
    path = write(folder, "b.csv", head + "Monzo ,greenhouse, monzo,MONZO BANK,active,,\n"
                 "#Old,lever,old,,active,,\nNoSlug,lever,,,active,,\nEmpty,ashby,e,,empty,,\n"
                 "Off,ashby,o,,paused,,\n")
    boards = tables.read_boards(spark, path)
    assert sorted(r["slug"] for r in boards.collect()) == ["e", "monzo", "o"]
    assert sorted(r["slug"] for r in tables.active_boards(boards).collect()) == ["e", "monzo"]
    out = os.path.join(folder, "out")
    tables.write_boards(boards, out)
    again = tables.read_boards(spark, out)
    assert {tuple(r) for r in again.drop("ord").collect()} == {
        tuple(r) for r in boards.drop("ord").collect()}


def test_outage_never_demotes_a_board(spark):
    boards = spark.createDataFrame([("A", "lever", "a", "", "active", "d0", "n0"),
                                    ("B", "lever", "b", "", "active", "d0", "n0")],
                                   schema.BOARD)
    outcomes = spark.createDataFrame([("lever", "a", "transient", "boom"),
                                      ("lever", "b", "not_found", "404")],
                                     "ats string, slug string, outcome string, note string")
    found = {r["slug"]: (r["status"], r["last_ok"], r["notes"]) for r in
             tables.merge_outcomes(boards, outcomes, TODAY).collect()}
    assert found == {"a": ("active", "d0", "n0"), "b": ("not_found", "d0", "404")}


def test_overlays(spark, folder):
    good = write(folder, "a.json", json.dumps({"Monzo": {"register_name": "MONZO BANK",
                                                         "rating": "A"}}, indent=2))
    bad = write(folder, "bad.json", "{not json")
    rows = tables.read_aliases(spark, good).collect()
    assert [(r["company"], r["register_name"]) for r in rows] == [("Monzo", "MONZO BANK")]
    assert tables.read_aliases(spark, bad).count() == 0
    rejected = write(folder, "r.json", json.dumps({"Acme Ltd": ["X", "Y"]}))
    assert {tuple(r) for r in tables.read_rejections(spark, rejected).collect()} == {
        ("ACME", "X"), ("ACME", "Y")}
    ruled = write(folder, "d.json", json.dumps({
        "companies": {"Acme": {"verdict": "CUT", "reason": "x"}},
        "roles": {"Acme::Dev": {"verdict": "KEEP", "verified": "d"}}}))
    assert {(r["kind"], r["ruling_key"], r["verdict"]) for r in
            tables.read_rulings(spark, ruled).collect()} == {
        ("company", "Acme", "CUT"), ("role", "Acme::Dev", "KEEP")}
    for shape in ([{"id": "1", "name": "P"}], {"contacts": [{"id": "1", "name": "P"}]}):
        path = write(folder, f"c{len(str(shape))}.json", json.dumps(shape))
        assert [r["name"] for r in tables.read_contacts(spark, path).collect()] == ["P"]
    table = tables.read_aliases(spark, good)
    exported = json.loads(tables.overlay_json(table, "company").first()["value"])
    assert exported["Monzo"]["register_name"] == "MONZO BANK"
    out = os.path.join(folder, "rows")
    tables.write_overlay(table, out, "company")
    again = tables.read_overlay(spark, out, schema.ALIAS)
    assert [(r["company"], r["rating"]) for r in again.collect()] == [("Monzo", "A")]


def posting(i, **over):
    row = {f: "" for f in schema.POSTING_FIELDS}
    row.update(id=str(i), title="Data Engineer", company="Acme", location="London",
               salary_min=None, salary_max=float(40000 + i), status="new", ord=i)
    row.update(over)
    return row


def postings(spark, *rows):
    columns = schema.struct(*[(f.name, f.dataType) for f in schema.POSTING],
                            ("ord", schema.L))
    return spark.createDataFrame([tuple(r[c] for c in columns.names) for r in rows], columns)


def test_store_snapshot_round_trip(spark, folder):
    rows = postings(spark, posting(1), posting(2, id="gh:4567890", source="gh"),
                    posting(3, id="7.0"))
    tables.write_snapshot(rows, folder, "001")
    tables.write_snapshot(rows.filter("ord < 3"), folder, "002")
    os.makedirs(os.path.join(folder, "v=003"))          # a write that never completed
    loaded = {r["id"]: r["source"] for r in tables.load_store(spark, folder).collect()}
    assert loaded == {"1": "adzuna", "gh:4567890": "gh"}


def test_log_scan_skips_broken_lines(spark, folder):
    entry = {"seq": 1, "id": "e1", "type": "alias.confirm", "ts": "2026-08-16T01:00:00Z",
             "input": {"company": "Acme", "register_name": "ACME UK"},
             "effects": {"rating": "A"}, "actor": {"id": "me"}, "rationale": "é why",
             "prev_hash": "x"}
    path = write(folder, "log.jsonl", json.dumps(entry) + "\n\n{\"seq\": 2, \"id\n")
    entries = tables.read_log(spark, path)
    assert entries.count() == 1
    live = audit.replay_aliases(audit.flatten_log(entries)).collect()
    assert [(r["company"], r["register_name"], r["rating"]) for r in live] == [
        ("Acme", "ACME UK", "A")]
    import hashlib
    want = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":"),
                                     ensure_ascii=False).encode()).hexdigest()
    assert entries.select(audit.line_digest("raw")).first()[0] == "sha256:" + want


def test_ticked_review_file(spark, folder):
    body = "\n".join(["# Sponsor review", "", "## Worth deciding (2)", "", "### Monzo",
                      "*3 role(s) tracked, tier 1*", "  - Backend Engineer",
                      "- [x] `MONZO BANK` (A, prefix)", "", "### Amazon",
                      "- [ ] `AMAZON CHARITABLE TRUST` (A, prefix)",
                      "- [X] `AMAZON UK SERVICES` (A, prefix)", "- [x] `LATER` (A, prefix)", "",
                      "## Probably not worth it (1)", "", "### Avanti",
                      "- [ ] `AVANTI CARE SERVICES` (A, prefix)", ""])
    path = write(folder, "review.md", body)
    found = reports.read_ticks(reports.read_review_blocks(spark, path), ["doc", "ord"])
    assert {tuple(r) for r in found.collect()} == {("Monzo", "MONZO BANK"),
                                                  ("Amazon", "AMAZON UK SERVICES")}


def test_written_review_reads_back_unticked(spark, folder):
    lookup = spark.createDataFrame([("ACME UK", "A", 1)], "key string, rating string, "
                                                          "ord bigint")
    rows = postings(spark, posting(1, sponsor_match="no", tier="1"))
    entries = review.review_candidates(rows, lookup)
    out = os.path.join(folder, "review")
    reports.write_review(entries, out)
    blocks = reports.read_review_blocks(spark, out)
    text = blocks.first()["block"]
    assert text.startswith("### Acme\n*1 role(s) tracked, tier 1*\n  - Data Engineer\n"
                           "- [ ] `ACME UK` (A, prefix)")
    assert reports.read_ticks(blocks, ["doc", "ord"]).count() == 0


def test_search_plan(spark):
    plan = searches.search_plan(spark)
    assert plan.count() == 23
    assert plan.filter("tier = '2'").count() == 8
    assert plan.filter(F.col("tier") == "5-watch").count() == 2


def test_synthetic_shapes_follow_their_shares(spark):
    counts = {r["shape"]: r["count"] for r in searches.synthetic_shapes(spark.range(1000))
              .groupBy("shape").count().collect()}
    assert counts == {name: share * 10 for name, share in searches.SHAPES}
    register = searches.synthetic_register(spark.range(1000))
    assert register.count() >= 4000 and register.filter("shape = 'trap'").count() == 600


def odd_csv(rng, rows):
    """A file with line breaks, quotes and commas in fields, and its rows."""
    bits = ["a", "b,", '""', "\n", " ", "é", "\n\n", "long text " * 9, ""]
    lines, want = ["name,note,n"], []
    for i in range(rows):
        fields = ["".join(rng.choices(bits, k=rng.randrange(6))) for _ in range(2)]
        lines.append(",".join([f'"{f}"' for f in fields] + [str(i)]))
        want.append((*[f.replace('""', '"') for f in fields], str(i)))
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("split", [700, 65536])
def test_quoted_records_over_splits(spark, folder, split):
    text, want = odd_csv(random.Random(split), 3000)
    path = write(folder, "r.csv", text)
    with split_bytes(spark, split):
        raw = spark.read.text(path)
        assert raw.rdd.getNumPartitions() > 1
        rows = csv_records.read_csv(spark, path).orderBy("ord").collect()
    assert [(r["name"] or "", r["note"] or "", r["n"]) for r in rows] == want
    assert [r["ord"] for r in rows] == list(range(len(want)))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .csv(path)
    got = sorted((r["name"], r["note"], r["n"]) for r in rows if r["name"] and r["note"])
    assert got == sorted(tuple(r) for r in whole.collect() if r["name"] and r["note"])


def test_one_record_over_many_splits(spark, folder):
    long = "\n".join(f"line {i}, of a text" for i in range(2000))
    path = write(folder, "r.csv", f'a,b\r\n1,"{long}"\r\n2,x\r\n')
    with split_bytes(spark, 900):
        rows = csv_records.read_csv(spark, path).orderBy("ord").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", long), ("2", "x")]


def test_csv_of_several_and_no_files(spark, folder):
    os.makedirs(os.path.join(folder, "in"))
    write(folder, "in/1.csv", "a,b\n1,2\n\n3,\"x\ny\"\n")
    write(folder, "in/2.csv", "a,b\n5,6")
    rows = csv_records.read_csv(spark, f"{folder}/in").orderBy("ord").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", "2"), ("3", "x\ny"), ("5", "6")]
    assert csv_records.read_csv(spark, write(folder, "e.csv", "")).count() == 0
    assert csv_records.read_csv(spark, write(folder, "h.csv", "a,b\n")).columns == ["a", "b", "ord"]


def test_legacy_store_with_line_breaks(spark, folder):
    path = write(folder, "old.csv", 'id,title,notes\n1,A,"one\ntwo"\n2,B,\n1,C,"x ""y"""\n')
    rows = {r["id"]: (r["title"], r["notes"]) for r in
            tables.read_csv_store(spark, path).collect()}
    assert rows == {"1": ("C", 'x "y"'), "2": ("B", "")}


def test_rows_of_several_csv_files_are_numbered_on(spark, folder):
    os.makedirs(os.path.join(folder, "in"))
    for name, text in (("1", "a\n1\n2\n"), ("2", "a\n"), ("3", "a\n3\n"), ("4", "a\n4\n5\n")):
        write(folder, f"in/{name}.csv", text)
    rows = csv_records.read_csv(spark, f"{folder}/in").collect()
    assert {r["a"]: r["ord"] for r in rows} == {str(i + 1): i for i in range(5)}


def _given(spark, folder):
    """Customers, orders and parts for the queries that read the derived tables."""
    for name, columns, n in (("customer", ["id AS c_custkey"], 30), ("part", [
            "id AS p_partkey", "'steel' AS p_name"], 5), ("orders", [
            "id AS o_orderkey", "id % 30 AS o_custkey"], 200)):
        spark.range(n).selectExpr(*columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name, reader", [("s11_legacy_store", "read_csv_store"),
                                          ("s1_register_file", "read_register")])
def test_old_files_are_written_by_several_tasks(spark, folder, monkeypatch, name, reader):
    from licmatch.plans import queries_scan
    seen, read = [], getattr(tables, reader)

    def counted(session, path, *rest):
        seen.append(len([f for f in os.listdir(path) if f.endswith(".csv")]))
        return read(session, path, *rest)
    monkeypatch.setattr(queries_scan.tables, reader, counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES[name](spark, _given(spark, folder)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    t = Tables(spark, folder)
    if name == "s11_legacy_store":
        want = {r["company"]: r["title"] for r in t.postings.orderBy("ord").collect()}
        assert {r["id"]: r["title"] for r in found} == want
    else:
        towns = [r["town_city"] + ('\n"\nx' if r["ord"] % 7 == 0 else "")
                 for r in t.register.orderBy("ord").collect()]
        assert found[0]["rows"] == len(towns)
        assert found[0]["ordered"] == sum(i * len(x) for i, x in enumerate(towns, 1))
    assert seen[0] > 1


def test_log_entries_judge_their_proposals_once(spark, folder):
    from licmatch.plans import queries_decide  # noqa: F401
    found = QUERIES["d1_log_entries"](spark, _given(spark, folder))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("jobs > 0 AND job_ids <> ''").count() > 0
