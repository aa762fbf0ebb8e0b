"""Title, company and location rules, eligibility reasons and the score."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from licmatch import rules
from licmatch.functions import dates
from licmatch.functions.text import as_int, blank, col, has, strip


def is_noise(title="title") -> Column:
    return has(title, rules.NOISE_PATTERN)


def is_too_senior(title="title") -> Column:
    return has(title, rules.INGEST_SENIORITY_PATTERN)


def unsuitable_reason(title="title") -> Column:
    return F.when(is_noise(title), "trades/construction noise") \
        .when(is_too_senior(title), "too senior")


def is_agency(company="company") -> Column:
    """Whole-word keyword, or one of the agency names anywhere in the company name."""
    return has(company, rules.RECRUITER_KEYWORD_PATTERN) \
        | F.lower(blank(company)).rlike(rules.RECRUITER_NAME_PATTERN)


def is_tech(title="title") -> Column:
    return has(title, rules.TECH_SIGNAL_PATTERN)


def is_non_tech(title="title") -> Column:
    return has(title, rules.NON_TECH_PATTERN)


def is_tech_role(title="title") -> Column:
    return is_tech(title) & ~is_non_tech(title)


def status_of(status="status") -> Column:
    return F.lower(strip(status))


def is_confirmed(match="sponsor_match") -> Column:
    return F.lower(strip(match)) == "yes"


def is_london(location="location") -> Column:
    return F.lower(blank(location)).contains("london")


def apply_ready_reason() -> Column:
    """Why a posting does not belong on the apply shortlist; null when it does."""
    status = status_of()
    return (
        F.when(~status.isin("", "new"),
               F.concat(F.lit("already actioned ("), status, F.lit(")")))
        .when(blank("sponsor_match") != "yes", "not sponsor-confirmed")
        .when(is_agency(), "recruiter/agency posting")
        .when(is_noise(), "trades/construction noise")
        .when(is_too_senior(), "too senior")
        .when(has("title", rules.APPLY_BLOCK_PATTERN),
              "won't sponsor in practice (cleared/apprentice/intern)")
        .when(~has("title", rules.ROLE_INCLUDE_PATTERN),
              "off-target role (not software/AI/data)"))


def disqualify(as_of=None, max_age: int | None = None,
               sponsor_match: Column | str = "sponsor_match") -> Column:
    """First reason a posting is out, null to keep it.

    The age gate applies to aggregator postings only, and never to an undateable one.
    """
    status = status_of()
    reason = F.when((status != "") & (status != "new"),
                    F.concat(F.lit("already actioned (status="), status, F.lit(")")))
    if max_age is not None:
        from_aggregator = F.coalesce(col("source"), F.lit(rules.AGGREGATOR_SOURCE)) \
            == rules.AGGREGATOR_SOURCE
        reason = reason.when(from_aggregator & (dates.age_days(as_of) > max_age),
                             f"older than {max_age}d (likely closed)")
    return (
        reason
        .when(has("title", rules.SENIORITY_PATTERN), "seniority title — early-career profile")
        .when(has("title", rules.CLEARANCE_PATTERN),
              "security clearance / nationality requirement")
        .when(has("title", rules.APPLY_BLOCK_PATTERN),
              "internship/apprenticeship — needs a later graduation year")
        .when(~is_confirmed(sponsor_match), "no sponsor-register match")
        .when(is_non_tech(), "non-software trade/role (tracker tier unreliable)")
        .when(~is_tech(), "no tech signal in title"))


def tier_for_title(title="title") -> Column:
    return F.when(has(title, rules.FDE_PATTERN), "1") \
        .when(has(title, rules.AI_PATTERN), "3") \
        .when(has(title, rules.GRAD_PATTERN) & is_tech(title), "2") \
        .when(is_tech(title), "4").otherwise("")


def clearance_hint(description="description") -> Column:
    return F.regexp_extract(blank(description),
                            rules.FLAGS + rules.CLEARANCE_HINT_PATTERN, 0)


def uk_location_reason(location="location", title="title") -> Column:
    """Why a posting is not plausibly in the UK; null keeps it. Unknown is kept."""
    place = blank(location)
    combined = strip(F.concat_ws(" ", blank(title), place))
    foreign = F.regexp_extract(combined, rules.FLAGS + rules.FOREIGN_PATTERN, 0)
    state = F.regexp_extract(combined, rules.US_STATE_PATTERN, 0)
    hit = F.when(foreign != "", foreign).otherwise(state)
    bare = strip(place)
    rest = F.trim(F.regexp_replace(
        F.regexp_replace(bare, rules.FLAGS + rules.ARRANGEMENT_PATTERN, " "),
        "(?iu)[^a-z]+", " "))

    def because(what: Column) -> Column:
        return F.concat(F.lit("not a UK location ("), what, F.lit(")"))

    return F.when((combined == "") | has(combined, rules.UK_STRONG_PATTERN),
                  F.lit(None).cast("string")) \
        .when(hit != "", because(F.trim(hit, F.lit(", ")))) \
        .when(has(combined, rules.UK_WEAK_PATTERN) | (bare == "") | (rest == ""),
              F.lit(None).cast("string")) \
        .otherwise(because(F.substring(bare, 1, 40)))


def drop_reason(as_of) -> Column:
    """Ingest gate for an employer-board posting: why it does not enter the store."""
    deadline = blank("apply_deadline")
    today = dates.as_date(as_of).cast("string")
    return F.coalesce(
        unsuitable_reason(),
        F.when(is_non_tech(), "non-software role"),
        F.when(~is_tech(), "no tech signal in title"),
        uk_location_reason(),
        F.when((deadline != "") & (deadline < today),
               F.concat(F.lit("deadline passed ("), deadline, F.lit(")"))))


def _score_rules(as_of) -> list[tuple[Column, Column | int, Column | str]]:
    """(condition, points, reason) in the order the reasons are shown."""
    tier = strip("tier")
    tiers = [(tier == t, p, f"tier {t}") for t, p in rules.TIER_SCORE.items()]
    floor = as_int("salary_min")
    seen = F.when(blank("date_first_seen") != "", col("date_first_seen")) \
        .otherwise(col("posted_date"))
    age = dates.days_since(seen, as_of)
    return tiers + [
        (has("title", rules.FDE_PATTERN), rules.FDE_POINTS,
         "forward-deployed/solutions title"),
        (has("title", rules.GRAD_PATTERN), rules.GRAD_POINTS, "early-career title"),
        (has("title", rules.AI_PATTERN), rules.AI_POINTS, "AI/ML title"),
        (F.upper(strip("sponsor_rating")) == "A", rules.A_RATED_POINTS, "A-rated sponsor"),
        (is_london(), rules.LONDON_POINTS, "London"),
        (is_agency(), rules.AGENCY_POINTS, "agency listing (real employer hidden)"),
        (floor >= rules.HIGH_FLOOR, rules.HIGH_FLOOR_POINTS,
         F.concat(F.lit("salary floor £"), F.format_number(floor, 0),
                  F.lit(" suggests senior"))),
        (age <= rules.FRESH_DAYS, rules.FRESH_POINTS, "posted this week"),
        (age > rules.STALE_DAYS, rules.STALE_POINTS,
         F.concat(age.cast("string"), F.lit("d old"))),
    ]


def score(as_of) -> Column:
    points = F.lit(0)
    for condition, value, _ in _score_rules(as_of):
        points = points + F.when(condition, value).otherwise(0)
    return points


def score_reasons(as_of) -> Column:
    return F.array_compact(F.array(*[
        F.when(condition, reason if isinstance(reason, Column) else F.lit(reason))
        for condition, _, reason in _score_rules(as_of)]))
