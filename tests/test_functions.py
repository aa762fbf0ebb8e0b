"""Single rules on small literal inputs."""
import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from licmatch import rules
from licmatch.functions import dates, gates, people, text


def apply(spark, values, function, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(function("x")).collect()]


def table(spark, cases, function):
    assert apply(spark, [c[0] for c in cases], function) == [c[1] for c in cases]


def test_normalize_name(spark):
    table(spark, [
        ("Monzo Ltd", "MONZO"), ("MONZO LIMITED", "MONZO"), ("The THE Co Ltd", "THE"),
        ("THE LTD", ""), ("Booth & Welsh (UK) plc", "BOOTH AND WELSH UK"), (None, ""),
        ("ROOFOODS LTD T/A DELIVEROO", "ROOFOODS LTD T A DELIVEROO"), ("Straße", "STRASSE"),
        ("  A.B.C.  Company Inc. ", "A B C")], text.normalize_name)


def test_parse_rating(spark):
    table(spark, [("Worker (A rating)", "A"), ("Worker (b rating)", "B"),
                  ("Worker (A (Premium))", "A"), ("Worker (A (SME+))", "A"),
                  ("UK Expansion Worker: Provisional", ""), (None, "")], text.parse_rating)


def test_keys(spark):
    table(spark, [("C++/Go Engineer!", "c go engineer"), ("  ", "")], text.normalise)
    table(spark, [("Acme UK Group Ltd.", "acme"), ("A-B plc", "ab")], text.twin_key)
    table(spark, [("123", "adzuna"), ("gh:1", "gh"), ("lever:a:b", "lever"), (None, "adzuna")],
          text.source_of)
    table(spark, [("123.0", "123"), ("gh:1.0x", "gh:1.0x"), (None, "")], text.clean_id)


def test_as_int(spark):
    table(spark, [("12.9", 12), ("-3.9", -3), ("1e3", 1000), ("nan", 0), ("inf", 0),
                  ("", 0), (None, 0), ("n/a", 0)], text.as_int)


def test_contract_type(spark):
    table(spark, [("Full Time", "permanent"), ("FullTime", "permanent"),
                  ("part-time", "part_time"), ("Temporary", "contract"),
                  ("Intern", "internship"), ("?", ""), (None, "")], text.contract_type)


def test_markup(spark):
    table(spark, [("&lt;p&gt;We are &lt;strong&gt;hiring&lt;/strong&gt;.&lt;/p&gt;",
                   "We are hiring ."), ("<p>Hello <b>world</b></p>", "Hello world"),
                  (None, "")], text.clean_html)
    samples = ["&eacute;&#233;&#xe9; &nope; &amp;lt;", "plain", "&nbsp;x", None]
    assert apply(spark, samples, text.decode_entities) == [
        html.unescape(s) if s else s for s in samples]


def test_strip_knows_every_kind_of_space(spark):
    samples = ["  a ", "\x1c b \t", "c", "", " 　", "é"]
    assert apply(spark, samples, text.strip) == [s.strip() for s in samples]


def test_text_helpers(spark):
    table(spark, [("Acme Ltd / Jane Doe!", "acme-ltd-jane-doe"), ("--", "")], text.slug)
    table(spark, [("Priya K", "Priya"), ("Jean-Baptiste X", "Jean-Baptiste"),
                  ("xX_dev_Xx", ""), ("李 伟", "李"), ("", "")], text.first_name)
    from urllib.parse import quote_plus
    samples = ["a b*c~d", "é&?", '"x" OR (y)', "-inurl:dir"]
    assert apply(spark, samples, text.url_quote_plus) == [quote_plus(s) for s in samples]


def test_feed_dates(spark):
    table(spark, [("2026-08-03T05:57:20-04:00", "2026-08-03"),
                  ("2026-04-07T17:12:35.753+00:00", "2026-04-07"),
                  ("2026-08-14", "2026-08-14"), ("1754784000000", "2025-08-10"),
                  ("1754784000", "2025-08-10"), ("2026-13-45", "2026-13-45"),
                  ("03/04/2026", "2026-04-03"), ("12/25/2026", "2026-12-25"),
                  ("4 July 2026", "2026-07-04"), ("July 4, 2026", "2026-07-04"),
                  ("not a date", ""), ("", ""), (None, "")], dates.mixed_date)


def test_parse_day_and_age(spark):
    table(spark, [("2026-01-02", dt.date(2026, 1, 2)), ("2026-1-2", dt.date(2026, 1, 2)),
                  ("2026-01-02T10:00:00Z", dt.date(2026, 1, 2)),
                  ("2026-01-02 25:00:00", None), ("31/12/2025", dt.date(2025, 12, 31)),
                  ("12/31/2025", None), ("2026-13-45", None), ("x", None), (None, None)],
          dates.parse_day)
    table(spark, [("2026-01-02", 8), ("2026-01-02T00:00:01", 7), ("2026-01-20", -10),
                  (None, None)], lambda c: dates.days_since(c, "2026-01-10"))


NON_UK = ["Remote India", "Remote - Singapore", "San Francisco, CA", "New York City, NY",
          "San Francisco, CA | New York City, NY", "Cambridge, MA", "Birmingham, AL",
          "Boston, MA | Seattle, WA", "Austin, TX", "Remote - Denver, CO", "Somewhereville",
          "São Paulo"]
UK = ["Remote", "Anywhere", "", "London, UK", "Cardiff, London or Remote (UK)",
      "Cambridge, UK", "London, UK; Dublin, Ireland",
      "London, UK; Ontario, CAN; San Francisco, CA", "Cambridge", "York", "Birmingham",
      "Newcastle upon Tyne", "Hybrid", "Flexible", "On-site", "New South Wales"]


def test_location_gate(spark):
    gate = lambda c: gates.uk_location_reason(c, F.lit(""))
    assert all(apply(spark, NON_UK, gate))
    assert apply(spark, UK, gate) == [None] * len(UK)
    titles = ["Customer Engineer (Pre-Sales), Korea (Based in Seoul)",
              "Enterprise Customer Engineer, Thailand",
              "Presales Customer Engineer, Enterprise (based in Melbourne)",
              "Forward Deployed Engineer, Hebrew speaker", "Software Engineer, London"]
    found = apply(spark, titles, lambda c: gates.uk_location_reason(F.lit("Hybrid"), c))
    assert [bool(f) for f in found] == [True] * 4 + [False]
    assert apply(spark, ["Austin, TX"], gate) == ["not a UK location (Austin)"]
    assert apply(spark, ["x, TX"], gate) == ["not a UK location (TX)"]


def test_tiers(spark):
    table(spark, [("Forward Deployed Engineer", "1"), ("Solutions Engineer", "1"),
                  ("AI Research Engineer", "3"), ("Graduate Software Engineer", "2"),
                  ("Platform Engineer", "4"), ("Benefits Specialist", "")],
          gates.tier_for_title)


def test_title_boundaries(spark):
    """A boundary after a character that is no word character does not match."""
    table(spark, [("10+ years", False), ("10+years", True), ("Senior Dev", True),
                  ("Sr. Dev", True), ("CTO", True), ("leading", False)],
          lambda c: text.has(c, rules.SENIORITY_PATTERN))
    table(spark, [("C++ dev", True), ("C++ role", False), (".NET x", False),
                  ("ASP.net", True), ("éai", False), ("ai x", True)],
          lambda c: text.has(c, rules.TECH_SIGNAL_PATTERN))


@pytest.mark.parametrize("names,expected", [
    (["Salt", "Sanderson", "Oliver James", "Hays", "Robert Walters", "Freedom Ltd",
      "Acme Recruitment", "Talent Bridge"], True),
    (["Palantir", "Monzo", "Snowflake", "", None, "Researcher Ltd"], False)])
def test_agencies(spark, names, expected):
    """Names match anywhere in the company name: 'reed' is in Freedom."""
    assert set(apply(spark, names, gates.is_agency)) == {expected}


POSTING = dict(id="1", title="Solutions Engineer", company="Northwind Systems",
               location="London", tier="1", status="new", sponsor_match="yes",
               sponsor_rating="A", posted_date="2026-08-10", date_first_seen="2026-08-10",
               salary_min="", source="adzuna", description="", apply_deadline="")


def posting(spark, *overrides):
    rows = [{**POSTING, **o, "n": i} for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows).orderBy("n")


def reasons(spark, overrides, max_age=None):
    frame = posting(spark, *overrides).select(gates.disqualify("2026-08-15", max_age))
    return [r[0] for r in frame.collect()]


def test_age_gate(spark):
    old = {"posted_date": "2026-06-29"}
    found = reasons(spark, [old, {}, {**old, "id": "gh:1", "source": "gh"},
                            {"posted_date": "", "date_first_seen": ""},
                            {**old, "title": "Senior Solutions Engineer"}], 30)
    assert found[0] == "older than 30d (likely closed)"
    assert found[1:4] == [None, None, None]
    assert found[4].startswith("older than")
    assert reasons(spark, [{"posted_date": "2020-01-01"}]) == [None]


def test_disqualifiers(spark):
    clearance = ["Forward Deployed Software Engineer - UK Government",
                 "Forward Deployed Software Engineer - NATO", "Software Engineer - eDV",
                 "Platform Engineer (SC Cleared)", "Developer, Developed Vetting required"]
    early = ["Software Engineer, Internship",
             "Digital and Technology Solutions Apprenticeship Level 6",
             "Graduate Placement Programme"]
    fine = ["Forward Deployed Software Engineer, New Grad - Commercial",
            "Associate Solution Engineer", "Graduate Software Engineer",
            "Machine Learning Engineer"]
    found = reasons(spark, [{"title": t} for t in clearance + early + fine])
    assert all("clearance" in f for f in found[:5])
    assert all(found[5:8])
    # "Solution Engineer" in the singular is a tech title too.
    assert found[8:] == [None] * 4
    assert reasons(spark, [{"status": " Applied "}, {"sponsor_match": "no"}]) == [
        "already actioned (status=applied)", "no sponsor-register match"]


def test_score_and_reasons(spark):
    frame = posting(
        spark, {}, {"salary_min": "95000", "title": "Junior AI Developer", "tier": "5-watch",
                    "location": "Leeds", "sponsor_rating": "", "date_first_seen": "2026-06-01"},
        {"company": "Hays", "date_first_seen": "", "posted_date": ""})
    rows = frame.select(gates.score("2026-08-15"), gates.score_reasons("2026-08-15")).collect()
    assert rows[0][0] == 50 + 30 + 10 + 10 + 10
    assert rows[0][1] == ["tier 1", "forward-deployed/solutions title", "A-rated sponsor",
                          "London", "posted this week"]
    assert rows[1][0] == 20 + 10 - 20 - 10
    assert rows[1][1] == ["early-career title", "AI/ML title",
                          "salary floor £95,000 suggests senior", "75d old"]
    assert rows[2][0] == 50 + 30 + 10 + 10 - 25


def test_deadline(spark):
    frame = posting(spark, {"apply_deadline": "2026-08-01"}, {"apply_deadline": "2099-01-01"},
                    {}, {"title": "Tech Recruiter"}, {"title": "Engineering Director, EU"})
    found = [r[0] for r in frame.select(gates.drop_reason("2026-08-14")).collect()]
    assert found == ["deadline passed (2026-08-01)", None, None, "non-software role",
                     "too senior"]


def test_signals(spark):
    table(spark, [("London, UK", ["london"]), ("Mumbai, India", ["maharashtra"]),
                  ("Wales", ["uk"]), ("Hindi and Marathi", ["marathi", "hindi"]),
                  ("UoN alumni in India", ["nottingham"]), ("", []), (None, [])],
          people.matched_signals)


def test_evidence_is_the_field_that_fired(spark):
    frame = spark.createDataFrame([("London,  United Kingdom", "poet " * 40 + "Hindi")],
                                  "location string, bio string")
    tagged = frame.withColumn("s", people.matched_signals("location", "bio"))
    found = tagged.select(people.signal_evidence("s", {"location": "location",
                                                       "bio": "bio"})).first()[0]
    assert found["london"] == "location: London, United Kingdom"
    assert found["hindi"].startswith("bio: poet") and found["hindi"].endswith("...")
    assert len(found["hindi"]) == len("bio: ") + 120


def test_org_slugs_refuse_traversal(spark):
    table(spark, [("Faculty", ["facultyai"]), ("Booth Welsh", ["boothwelsh", "booth-welsh",
                                                               "boothwelshhq",
                                                               "boothwelsh-oss"]),
                  ("../../user/octocat", ["useroctocat", "useroctocathq",
                                          "useroctocat-oss"]), ("..", []), ("", [])],
          people.org_slugs)


def test_routes(spark):
    frame = spark.createDataFrame([("javascript:alert(1)", "a@b.c", "me"), ("", "", "")],
                                  "blog string, email string, twitter string")
    found = frame.select(people.contact_routes()).collect()
    assert [r["url"] for r in found[0][0]] == ["https://javascript:alert(1)",
                                              "mailto:a@b.c", "https://x.com/me"]
    assert found[1][0] == []


def test_first_message_picks(spark):
    table(spark, [("AI Engineer", rules.ROLE_QUESTIONS[1][1]),
                  ("Forward-Deployed AI Engineer", rules.ROLE_QUESTIONS[0][1]),
                  ("Chef", rules.DEFAULT_QUESTION)], people.role_question)
    warned = apply(spark, ["could you refer me — please", "fine", "referee"],
                   people.lint_warnings)
    assert [len(w) for w in warned] == [2, 0, 0]
