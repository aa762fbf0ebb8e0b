"""Licence lookup, suggestions, rulings: literal cases and equivalence with plain scans."""
import random
import re

import pytest
from pyspark.sql import functions as F

from licmatch.operators import contacts, licence, review, search_index, shortlist

ENTRIES = {"MONZO BANK": "A", "ROOFOODS LTD T A DELIVEROO": "A", "AMENTUM UK": "A",
           "AMAZON CHARITABLE TRUST": "A", "AMAZON UK SERVICES": "A", "SYNTASSO": "A",
           "NEARFORM UK": "B", "BOOTH WELSH AUTOMATION": "A"}


def lookup_of(spark, entries):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(entries.items())],
                                 "key string, rating string, ord bigint")


def suggestions(spark, names, entries=ENTRIES):
    lookup = lookup_of(spark, entries)
    companies = spark.createDataFrame([(n,) for n in names], "company string")
    hits = licence.suggest(licence.open_keys(companies, lookup), lookup)
    found = {}
    for row in hits.orderBy("key", "rule", "ord").collect():
        found.setdefault(row["key"], []).append((row["candidate"], row["rating"], row["why"]))
    return found


def test_suggestion_rules(spark):
    found = suggestions(spark, ["Monzo", "Deliveroo", "Booth Wel", "Booth Welsh", "Syntasso",
                                "BT", "EY", "Amazon", "Roofoods", "Amentumx"])
    assert found == {
        "MONZO": [("MONZO BANK", "A", "prefix")],
        "DELIVEROO": [("ROOFOODS LTD T A DELIVEROO", "A", "trading-as")],
        "BOOTH WELSH": [("BOOTH WELSH AUTOMATION", "A", "prefix")],
        "AMAZON": [("AMAZON CHARITABLE TRUST", "A", "prefix"),
                   ("AMAZON UK SERVICES", "A", "prefix")],
        "ROOFOODS": [("ROOFOODS LTD T A DELIVEROO", "A", "prefix")]}


def plain_scan(key, entries, limit=3):
    """The two rules by scanning every entry."""
    if len(key) < 4 or key in entries:
        return []
    first = key.split(" ")[0]
    prefix = [c for c in entries if c.split(" ")[0] == first
              and re.match(r"%s\b" % re.escape(key), c)]
    trading = [c for c in entries if " T A " in c
               and c.partition(" T A ")[2].split(" ")[0] == first
               and re.search(r"\bT A %s\b" % re.escape(key), c)]
    return [(c, entries[c], "prefix") for c in prefix][:limit] \
        + [(c, entries[c], "trading-as") for c in trading][:max(0, limit - len(prefix))]


def test_suggestions_equal_a_plain_scan(spark):
    rng = random.Random(7)
    words = ["ACME", "TECH", "T", "A", "UK", "DATA", "NORTH"]
    entries = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))):
               rng.choice(["A", "B", ""]) for _ in range(400)}
    keys = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(80)}
    found = suggestions(spark, keys, entries)
    for key in keys:
        assert found.get(key, []) == plain_scan(key, entries), key


def test_hot_prefix_keeps_register_order(spark):
    entries = {f"ACME UNIT {i:04d}": "A" for i in range(3000)}
    assert suggestions(spark, ["Acme"], entries)["ACME"] == [
        (f"ACME UNIT {i:04d}", "A", "prefix") for i in range(3)]


def test_lookup_rating_rules(spark):
    rows = [("Acme Ltd", "Worker (B rating)", "Skilled Worker", 1),
            ("ACME", "Worker (A rating)", " Skilled Worker ", 2),
            ("Beta", "Provisional", "Skilled Worker", 3),
            ("Beta plc", "Worker (B rating)", "Skilled Worker", 4),
            ("Gamma", "Worker (A rating)", "Scale-up Worker", 5),
            ("Ltd", "Worker (A rating)", "Skilled Worker", 6)]
    register = spark.createDataFrame(
        rows, "org string, type_rating string, route string, ord bigint")
    found = {r["key"]: (r["rating"], r["ord"]) for r in
             licence.licence_lookup(register).collect()}
    # A wins; otherwise the first-seen rating stays, even when it is blank.
    assert found == {"ACME": ("A", 1), "BETA": ("", 3)}


def stamped(spark, names, aliases=None, lookup=True):
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                 "company string, ord int")
    overlay = None if aliases is None else spark.createDataFrame(
        [(c, n, r, i) for i, (c, n, r) in enumerate(aliases)],
        "company string, register_name string, rating string, ord bigint")
    found = licence.match_companies(rows, lookup_of(spark, ENTRIES) if lookup else None,
                                    overlay)
    return [tuple(r)[2:] for r in found.orderBy("ord").collect()]


def test_matching(spark):
    assert stamped(spark, ["Syntasso Ltd", "Monzo", "", None]) == [
        ("yes", "A", "Skilled Worker"), ("no", "", ""), ("unconfirmed", "", ""),
        ("unconfirmed", "", "")]
    assert stamped(spark, ["Monzo"], lookup=False) == [("unconfirmed", "", "")]


def test_alias_overlay(spark):
    aliases = [("Monzo Ltd", "MONZO BANK", ""), ("Nearform", "NEARFORM UK", "A"),
               ("Ghost", "NOT THERE", "B")]
    assert stamped(spark, ["monzo", "MONZO LIMITED", "Nearform", "ghost"], aliases) == [
        ("yes", "A", "Skilled Worker"), ("yes", "A", "Skilled Worker"),
        ("yes", "B", "Skilled Worker"), ("yes", "B", "Skilled Worker")]


def test_resolution_precedence(spark):
    lookup = lookup_of(spark, ENTRIES)
    aliases = spark.createDataFrame(
        [("Monzo", "MONZO BANK", "A", "2026-08-14", "me", "checked", "e1", 0)],
        "company string, register_name string, rating string, confirmed string, "
        "actor string, rationale string, log_entry_id string, ord bigint")
    boards = spark.createDataFrame([("Monzo", "X", "", 0), ("Amentum", "AMENTUM UK", "", 1)],
                                   "company string, register_name string, ats string, "
                                   "ord bigint")
    rows = spark.createDataFrame([("monzo",), ("Amentum",), ("Syntasso",), ("Zzz",)],
                                 "company string")
    found = {r["company"]: (r["resolution"]["method"], r["resolution"]["register_name"],
                            r["resolution"]["rating"])
             for r in licence.resolve(rows, lookup, aliases, boards).collect()}
    assert found == {"monzo": ("alias", "MONZO BANK", "A"),
                     "Amentum": ("board", "AMENTUM UK", "A"),
                     "Syntasso": ("exact", "SYNTASSO", "A"), "Zzz": ("none", "", "")}


@pytest.mark.parametrize("query,limit,expected", [
    ("amazon", 20, ["AMAZON CHARITABLE TRUST", "AMAZON UK SERVICES"]),
    ("UK", 20, ["AMAZON UK SERVICES", "AMENTUM UK", "NEARFORM UK"]), ("a", 20, []),
    ("amazon", 1, ["AMAZON CHARITABLE TRUST"])])
def test_register_search(spark, query, limit, expected):
    found = licence.register_search(lookup_of(spark, ENTRIES), query, limit).collect()
    assert [r["register_name"] for r in found] == expected


def test_register_search_by_index(spark):
    index = search_index.register_index(lookup_of(spark, ENTRIES))
    for query, limit, expected in [
            ("amazon", 20, ["AMAZON CHARITABLE TRUST", "AMAZON UK SERVICES"]),
            ("UK", 20, ["AMAZON UK SERVICES", "AMENTUM UK", "NEARFORM UK"]), ("a", 20, []),
            ("", 20, []), ("zzzz", 20, []), ("amazon", 1, ["AMAZON CHARITABLE TRUST"])]:
        found = search_index.register_search(index, query, limit).collect()
        assert [r["register_name"] for r in found] == expected, query


def test_index_equals_a_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é", k=rng.randrange(12))) for _ in range(1500)]
    texts += ["aaaa common"] * 900 + ["", "x", None]      # one text that a third of the rows have
    rows = spark.createDataFrame(list(enumerate(texts)), "v bigint, t string").repartition(4)
    index = search_index.build(rows, "t", ["t", "v"], block=100)
    for query in ("a", "ab", "aab", "aaaa", "é a", "b b ba", " ", "common", "zzz", "x"):
        want = {i for i, t in enumerate(texts) if t is not None and query in t}
        assert {r["v"] for r in search_index.containing(index, query).collect()} == want, query
        want = {i for i, t in enumerate(texts) if t is not None and t.startswith(query)}
        assert {r["v"] for r in search_index.starting(index, query).collect()} == want, query
    assert max(len(r["numbers"]) for r in index.grams().collect()) <= 100
    # The grams of a query reach the scan of the index.
    plan = search_index.candidates(index, "aab")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [aab])" in plan or "EqualTo(gram,aab)" in plan
    assert search_index.containing(search_index.build(rows.limit(0), "t", ["t"]), "a").count() == 0


def test_rulings_equal_a_plain_scan(spark):
    norm = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    rules = [("role", "Acme::Data", "CUT"), ("role", "Data", "KEEP"), ("role", "::nurse", "X"),
             ("company", "acme", "C1"), ("company", "me l", "C2"), ("company", "Zed", "C3"),
             ("role", "ac::eng", "LATE")]
    rows = [(i, c, t) for i, (c, t) in enumerate(
        (c, t) for c in ["Acme Ltd", "ACME", "Zed-Data", "Other", "Same L"]
        for t in ["Data Engineer", "Nurse", "Chef", "Lead Eng."])]
    rulings = spark.createDataFrame(
        [(k, key, v, "r", "d", i) for i, (k, key, v) in enumerate(rules)],
        "kind string, ruling_key string, verdict string, reason string, verified string, "
        "ord bigint")
    frame = spark.createDataFrame(rows, "ord int, company string, title string")
    found = {r["ord"]: r["ruling_verdict"] for r in
             shortlist.attach_rulings(frame, rulings).collect()}
    for i, company, title in rows:
        c, t = norm(company), norm(title)
        want = next((v for k, key, v in rules if k == "role"
                     and norm(key.partition("::")[0]) in c
                     and norm(key.partition("::")[2]) in t), None)
        want = want or next((v for k, key, v in rules if k == "company" and norm(key) in c),
                            None)
        assert found[i] == want, (company, title)


def test_only_substrings_that_may_be_ruled_on_leave_the_expansion(spark):
    """Ruling parts of many lengths: a name meets those it contains, not all its substrings."""
    word = lambda i: "".join(chr(97 + i * k % 26) for k in (1, 3, 7, 11, 5, 9, 15, 17))
    parts = [" ".join(word(i * 7 + j) for j in range(3))[:6 + i % 18] for i in range(60)]
    rulings = spark.createDataFrame(
        [("company", p, "CUT", "r", "d", i) for i, p in enumerate(parts)],
        "kind string, ruling_key string, verdict string, reason string, verified string, "
        "ord bigint")
    known = shortlist.normal_rulings(rulings)
    names = [" ".join(word(i * 5 + j) for j in range(4)) for i in range(100)]
    texts = spark.createDataFrame([(n,) for n in names], "name string")
    lengths = F.array(*[F.lit(n) for n in sorted({len(p.strip()) for p in parts})])
    found = shortlist._with_parts(texts, "name", lengths, shortlist._sketch(
        F.col("company_part"), known), "company_part").distinct().collect()
    want = {(n, p.strip()) for n in names for p in parts if p.strip() in n}
    assert want and want <= {tuple(r) for r in found}
    assert len(found) < len(want) + 20


def test_age_limit_stands_down_when_verified():
    assert shortlist.age_limit(None, True) is None
    assert shortlist.age_limit(None, False) == 30
    assert shortlist.age_limit(60, True) == 60
    assert shortlist.age_limit(0, False) is None


def test_review_queue_merges_spellings(spark):
    rows = spark.createDataFrame(
        [(0, "Booth Welsh Ltd", "Data Engineer", "1", "no"),
         (1, "Booth Welsh", "Chef", "4", "no"), (2, "Booth Welsh", "AI Engineer", "2", "no"),
         (3, "Hays", "Data Engineer", "1", "no"), (4, "Syntasso", "Data Engineer", "1", "no"),
         (5, "Amazon", "Warehouse Operative", "4", "no")],
        "ord int, company string, title string, tier string, sponsor_match string")
    rejected = spark.createDataFrame([("AMAZON", "AMAZON CHARITABLE TRUST")],
                                     "key string, register_name string")
    entries = review.review_candidates(rows, lookup_of(spark, ENTRIES), None, rejected)
    queue = {r["key"]: r for r in review.review_queue(entries).collect()}
    assert set(queue) == {"BOOTH WELSH", "AMAZON"}
    merged = queue["BOOTH WELSH"]
    assert (merged["company"], merged["rows"], merged["tiers"]) == ("Booth Welsh", 3,
                                                                    ["1", "2"])
    assert sorted(merged["tech_titles"]) == ["AI Engineer", "Data Engineer"]
    assert [s["register_name"] for s in queue["AMAZON"]["suggestions"]] == [
        "AMAZON UK SERVICES"]


def test_no_pairwise_join_in_plans(spark):
    """Suggestions and rulings must stay equi joins."""
    lookup = lookup_of(spark, ENTRIES)
    names = spark.createDataFrame([("Monzo", "Chef", 1)],
                                  "company string, title string, ord int")
    rulings = spark.createDataFrame([("role", "a::b", "CUT", "", "", 1)],
                                    "kind string, ruling_key string, verdict string, "
                                    "reason string, verified string, ord bigint")
    for frame in (licence.suggest(licence.open_keys(names, lookup), lookup),
                  shortlist.attach_rulings(names, rulings)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}


def test_hot_company_is_split(spark):
    """A third of all postings at one employer: the match join splits that partition."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        lookup = spark.range(500).select(
            F.concat(F.lit("ORG "), F.col("id").cast("string")).alias("key"),
            F.lit("A").alias("rating"), F.col("id").alias("ord"))
        rows = spark.range(0, 60000, 1, 12).select(
            F.col("id").alias("ord"), F.concat(F.lit("Org "), F.when(
                F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 700).cast("string"))
            .alias("company"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        found = licence.match_companies(rows, lookup)
        result = found.filter("sponsor_match = 'yes'")
        total = len(result.collect())
        assert total == sum(1 for i in range(60000) if i % 3 == 0 or i % 700 < 500)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_overlay_is_laid_over_the_register(spark):
    lookup = spark.createDataFrame([("A", "A", 1), ("B", "B", 2), ("C UK", "A", 3)],
                                   "key string, rating string, ord int")
    aliases = spark.createDataFrame(
        [("B", "C UK", "X", 1), ("new", "C UK", "X", 2), ("other", "gone", "Y", 3),
         ("plain", "gone", None, 4)],
        "company string, register_name string, rating string, ord bigint")
    found = {tuple(x) for x in licence.effective_lookup(lookup, aliases).collect()}
    assert found == {("A", "A"), ("B", "A"), ("C UK", "A"), ("NEW", "A"), ("OTHER", "Y"),
                     ("PLAIN", "")}
    plan = licence.effective_lookup(lookup, aliases)._jdf.queryExecution().optimizedPlan()
    assert "FullOuter" not in plan.toString()


def test_boards_by_slug(spark):
    boards = spark.createDataFrame(
        [("Acme", "lever", "one", "ACME ONE", 1), ("Acme", "lever", "two", "ACME TWO", 2)],
        "company string, ats string, slug string, register_name string, ord bigint")
    rows = spark.createDataFrame([("1", "Acme", "lever", "one"), ("2", "Acme", "lever", "two"),
                                  ("3", "Acme", "lever", None)],
                                 "id string, company string, source string, slug string")
    lookup = spark.createDataFrame([("ACME TWO", "A", 1)], "key string, rating string, ord int")
    found = {r["id"]: r["sponsor_match"] for r in
             licence.match_board_rows(rows, boards, lookup).collect()}
    assert found == {"1": "no", "2": "yes", "3": "no"}
    assert "slug" not in licence.match_board_rows(rows, boards, lookup).columns


def test_contacts_fold_in_any_order(spark):
    rng = random.Random(4)
    saves = [(i, rng.choice(["Acme", " acme", "Beta"]), rng.choice(["", "h1", "H1", "h2"]),
              rng.choice(["", "Jane", "Bob"]), "manual", rng.choice(["", f"http://{i}"]),
              rng.choice(["", f"L{i}"]), rng.choice(["", "j1", "j2", f"j{i}"]),
              rng.choice(["", f" note {i} "]),
              [("site", f"v{i}", "", "")] if rng.random() < .3 else []) for i in range(60)]
    columns = ("ord int, company string, handle string, name string, source string, url string, "
               "location string, job_id string, notes string, "
               "routes array<struct<kind:string,value:string,url:string,note:string>>")
    want, today = {}, "2026-08-14"
    for _, company, handle, name, source, url, location, job, notes, routes in saves:
        key = (company.strip().lower(), (handle or name).strip().lower())
        if key not in want:
            want[key] = {"name": name or handle, "handle": handle, "url": url, "routes": routes,
                         "location": location, "job_ids": [job] if job else [],
                         "notes": notes.strip(), "company": company.strip(),
                         "status": "found", "found_on": today, "contacted_on": ""}
            continue
        old = want[key]
        if job and job not in old["job_ids"]:
            old["job_ids"].append(job)
        if notes.strip():
            old["notes"] = f"{old['notes']}\n{notes.strip()}".strip()
        for field, value in (("url", url), ("location", location), ("name", name)):
            old[field] = old[field] or value
        old["routes"] = routes or old["routes"]
    frame = spark.createDataFrame(saves, columns)
    whole = contacts.contacts(contacts.from_saves(frame, today))
    stored = contacts.contacts(contacts.from_saves(frame.filter("ord < 20"), today))
    late, early = (contacts.from_saves(frame.filter(c), today) for c in ("ord >= 40", "ord >= 20 "
                                                                          "and ord < 40"))
    folded = contacts.contacts(contacts.merge(late, contacts.merge(
        early, contacts.from_contacts(stored))))
    for result in (whole, folded):
        got = {(r["company_key"], r["who_key"]): r for r in result.collect()}
        assert set(got) == set(want)
        for key, fields in want.items():
            for name, value in fields.items():
                found = [tuple(x) for x in got[key][name]] if name == "routes" else got[key][name]
                assert found == value, (key, name)
    assert {r["id"] for r in whole.collect()} == {r["id"] for r in folded.collect()}


def test_index_keeps_a_block_in_one_task(spark):
    """Texts are shuffled by block and their trigrams folded there, never shuffled."""
    rows = spark.range(400).select(F.col("id").alias("v"), F.concat(
        F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("t")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = search_index.build(rows, "t", ["t"], block=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = index.grams().select("_block", F.input_file_name().alias("file")).distinct()
    assert files.count() == 4
    assert search_index.containing(index, "text").count() == 400


def test_review_rules_run_once_over_the_rows(spark):
    """Counts, titles and suggestions read the same written facts."""
    rows = spark.createDataFrame(
        [(0, "Booth Welsh", "Data Engineer", "3", "no"), (1, "Booth Welsh", "Chef", "4", "yes"),
         (2, "Booth Welsh ", "AI Engineer", "1", "no"), (3, None, "AI Engineer", "1", "no"),
         (4, "Booth Welsh", "Data Engineer", "1", None)],
        "ord int, company string, title string, tier string, sponsor_match string")
    found = review.review_candidates(rows, lookup_of(spark, ENTRIES))
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    only, = found.collect()
    assert (only["company"], only["rows"], only["tiers"], only["tech_rows"], only["tech_titles"]) \
        == ("Booth Welsh", 4, ["1", "3"], 3, ["Data Engineer", "AI Engineer", "Data Engineer"])
