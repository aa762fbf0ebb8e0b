"""Rules as data: word lists, patterns, weights and vocabularies.

Operators compile these into Column expressions; nothing here touches Spark.
"""
from __future__ import annotations

import re

# Java flags: U makes \b, \w, \s and case folding Unicode-aware.
FLAGS = "(?iU)"


def word_pattern(words: list[str]) -> str:
    """One whole-word alternation for a word list (no flags)."""
    return r"\b(" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-")
                             for w in words) + r")\b"


# --------------------------------------------------------------------------------------
# Fixed values. Results depend on these lists, patterns, weights and vocabularies exactly
# as they stand, so they are written out in their natural order.
# --------------------------------------------------------------------------------------

DEFAULT_MAX_AGE = 30
AGGREGATOR_SOURCE = "adzuna"
DEFAULT_STATUS = "new"
SKILLED_WORKER_ROUTE = "Skilled Worker"
LEGAL_SUFFIXES = ["LTD", "LIMITED", "PLC", "LLP", "LLC", "LP", "CIC", "CIO", "INC", "CORP",
                  "CO", "COMPANY"]
TWIN_KEY_WORDS = ["ltd", "limited", "plc", "group", "uk", "inc", "llp"]
RATING_PATTERN = r"\(([AB])(?:\s+rating\b|\s*\()"
MIN_SUGGESTION_KEY = 4
SUGGESTION_LIMIT = 3

TITLE_EXCLUDE = [
    "fire", "civil", "structural", "geotechnical", "mechanical", "electrical", "hvac",
    "plumbing", "scaffolding", "lift", "elv", "maintenance", "revit", "bim",
    "field service", "cad technician", "quantity surveyor",
]

SENIORITY_EXCLUDE = [
    "senior", "snr", "sr", "principal", "staff", "lead", "leader", "manager", "management",
    "head", "director", "vp", "vice president", "chief", "architect", "expert",
]

RECRUITER_KEYWORDS = [
    "recruit", "recruits", "recruiter", "recruiters", "recruitment", "resourcing",
    "staffing", "selection", "talent", "consultants", "consultancy", "search", "resource",
    "headhunt",
]

# Matched as substrings of the lower-cased company name.
RECRUITER_COMPANIES = [
    "hays", "robert walters", "robert half", "michael page", "reed", "harnham", "noir",
    "searchability", "henderson scott", "nigel frank", "tenth revolution", "big red",
    "nova source", "ncounter", "selby jennings", "understanding recruitment",
    "spectrum it", "microtech global", "pioneer", "proactive global", "daniel-scott",
    "dunraven", "describe.me", "transparency technology", "franklin fitch", "adecco",
    "randstad", "manpower", "experis", "lorien", "sthree", "huxley", "opus recruitment",
    "information tech consultants", "rullion", "salt", "oliver james",
    "source group international", "la fosse", "oho group", "trust in soda",
    "client server", "xcede", "darwin recruitment", "circle group",
    "in technology group", "computer futures", "progressive", "sanderson",
    "networking people", "people first", "qurated", "mthree",
]

ROLE_INCLUDE_TERMS = [
    "software", "developer", "programmer", "sde", "frontend", "front end", "front-end",
    "backend", "back end", "back-end", "full stack", "full-stack", "fullstack",
    "web developer", "data scientist", "data engineer", "data science", "data analyst",
    "machine learning", "deep learning", "artificial intelligence", "ai engineer",
    "ml engineer", "applied ai", "conversational ai", "nlp", "llm", "devops", "dev ops",
    "sre", "site reliability", "cloud engineer", "platform engineer",
    "infrastructure automation", "solutions engineer", "solution engineer", "pre-sales",
    "presales", "sales engineer", "forward deployed", "deployment engineer",
    "automation engineer", "qa engineer", "qa automation", "test engineer",
    "test automation", "systems engineer", "python", "java developer",
    "integration engineer", "technology analyst", "technology associate",
    "technology consultant", "graduate programme", "graduate scheme",
    "graduate technology",
]

APPLY_BLOCK_TERMS = [
    "apprentice", "apprenticeship", "edv", "dv cleared", "sc cleared",
    "developed vetting", "security cleared", "placement programme", "internship",
    "intern", "work experience", "no experience needed",
]

SENIORITY_PATTERN = (
    r"\b(senior|snr|sr\.?|staff|principal|lead|leader|head\s+of|director|"
    r"architect|manager|managing|vp|vice\s+president|chief|cto|cio|"
    r"expert|specialist\s+iv|iii\b|\biv\b|10\+|[5-9]\+\s*years)\b")

CLEARANCE_PATTERN = (
    r"\b(sc[\s-]?cleared|dv[\s-]?cleared|e?dv\b|security\s+clearance|"
    r"security[\s-]?cleared|developed\s+vetting|"
    r"must\s+be\s+a?\s*british|uk\s+national(s)?\s+only|nppv|mod\b|"
    r"uk\s+government|nato)\b")

CLEARANCE_HINT_PATTERN = (
    r"(may\s+need\s+to\s+be\s+eligible|eligible\s+for\s+(uk\s+)?(sc|dv|"
    r"developed\s+vetting|security\s+clearance)|willing\s+to\s+undergo)")

TECH_SIGNAL_PATTERN = (
    r"\b(software|developer|dev\b|devops|sre\b|programm\w+|coding|"
    r"data\s+(scientist|engineer|analyst)|analytics|machine\s+learning|\bml\b|"
    r"\bai\b|nlp|llm|genai|python|java\b|javascript|typescript|golang|\bc\+\+|"
    r"\.net|react|node|backend|back[\s-]end|frontend|front[\s-]end|full[\s-]?stack|"
    r"platform|cloud|aws|azure|gcp|kubernetes|infrastructure|database|\bsql\b|"
    r"\bqa\b|test\s+automation|\bsdet\b|cyber|information\s+security|appsec|"
    r"\bit\b|technology|technical|systems?\s+engineer|solutions?\s+engineer|"
    r"forward[\s-]?deployed|pre[\s-]?sales|customer\s+engineer|"
    r"integration|api\b|robotics|computer\s+vision)\b")

NON_TECH_PATTERN = (
    r"\b(multi[\s-]?skilled|maintenance|mechanical|electrical|electrician|"
    r"hvac|plumb\w*|gas\b|boiler|refrigeration|lift\s+engineer|welder|"
    r"fabricat\w+|civil|structural|site\s+engineer|quantity\s+surveyor|"
    r"estimator|building\s+services|groundwork|carpenter|"
    r"talent\s+acquisition|recruit\w*|human\s+resources|\bhr\b|payroll|"
    r"nurse|nursing|care\s+(assistant|worker)|healthcare\s+assistant|"
    r"teacher|tutor|lecturer|chef|driver|warehouse|cleaner|"
    r"security\s+officer|door\s+supervisor|retail|cashier|"
    r"account\s+manager|business\s+development|marketing|copywriter)\b")

FDE_PATTERN = (
    r"\b(forward[\s-]?deployed|solutions?\s+engineer|solution\s+architect|"
    r"customer\s+engineer|field\s+engineer|implementation\s+engineer|"
    r"sales\s+engineer|pre[\s-]?sales)\b")

GRAD_PATTERN = (
    r"\b(graduate|junior|jnr|entry[\s-]?level|associate|trainee|"
    r"early\s+careers?|new\s+grad)\b")

AI_PATTERN = r"\b(ai|ml|machine\s+learning|nlp|llm|genai|generative)\b"

TIER_SCORE = {"1": 50, "2": 30, "3": 35, "4": 15}
FDE_POINTS, GRAD_POINTS, AI_POINTS = 30, 20, 10
A_RATED_POINTS, LONDON_POINTS, AGENCY_POINTS = 10, 10, -25
HIGH_FLOOR, HIGH_FLOOR_POINTS = 90000, -20
FRESH_DAYS, FRESH_POINTS, STALE_DAYS, STALE_POINTS = 7, 10, 30, -10

UK_STRONG_PATTERN = (
    r"\b(uk|u\.k\.|united kingdom|england|scotland|wales|northern ireland|"
    r"london|gbr|manchester|glasgow|edinburgh|bristol|nottingham|sheffield|"
    r"liverpool|cardiff|belfast|leeds|brighton|coventry|southampton|"
    r"milton keynes|oxford)\b")

UK_WEAK_PATTERN = (
    r"\b(cambridge|birmingham|newcastle|reading|bath|leicester|"
    r"(?<!new )york)\b")

ARRANGEMENT_PATTERN = (
    r"\b(remote|anywhere|global|hybrid|on[\s-]?site|flexible|various)\b")

FOREIGN_PATTERN = (
    r"\b(india|mumbai|bengaluru|bangalore|delhi|korea|seoul|japan|tokyo|"
    r"singapore|thailand|bangkok|australia|melbourne|sydney|canada|toronto|"
    r"brazil|s(a|ã)o paulo|mexico|germany|berlin|munich|france|paris|spain|"
    r"madrid|barcelona|italy|milan|netherlands|amsterdam|poland|warsaw|"
    r"portugal|lisbon|ireland|dublin|sweden|stockholm|denmark|copenhagen|"
    r"norway|oslo|switzerland|zurich|austria|israel|tel aviv|hebrew|"
    r"united states|usa|u\.s\.|new york|san francisco|seattle|austin|boston|"
    r"chicago|denver|atlanta|los angeles|texas|california|emea remote|"
    r"apac|latam|china|shanghai|beijing|hong kong|taiwan|vietnam|philippines|"
    r"malaysia|indonesia|uae|dubai|saudi|qatar|egypt|nigeria|kenya|"
    r"south africa|new zealand|belfast time zone)\b")

# Case-sensitive.
US_STATE_PATTERN = (
    r",\s?(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|MD|MA|MI|"
    r"MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|"
    r"VA|WA|WV|WI|WY|DC)\b")

CONTRACT_TYPES = {
    "fulltime": "permanent", "full_time": "permanent", "full-time": "permanent",
    "regular": "permanent", "permanent": "permanent",
    "parttime": "part_time", "part_time": "part_time", "part-time": "part_time",
    "contract": "contract", "temporary": "contract",
    "intern": "internship", "internship": "internship",
}

FAMILY_PREFIXES = {"greenhouse": "gh", "ashby": "ashby", "lever": "lever"}
ACTIVE_BOARD_STATUSES = ["active", "empty", ""]

STATUS_VOCAB = ["new", "applied", "screening", "interview", "offer", "rejected", "ignored",
                "closed"]
SENT_STATUSES = ["applied", "screening", "interview", "offer"]
DECLINED_STATUSES = ["ignored", "rejected", "closed"]
APPLY_METHODS = ["company site", "greenhouse", "ashby", "lever", "linkedin", "email",
                 "other"]
MIN_RATIONALE, MAX_RATIONALE = 10, 500
CONTACT_STATUSES = ["found", "contacted", "replied", "referred", "declined"]
EDITABLE_FIELDS = ["status", "date_applied", "applied_via", "notes"]

CADENCE_STEPS = [
    (4, "gentle bump — add something useful, do not re-ask"),
    (9, "a specific question about their work"),
    (14, "the close: say you will stop, and mean it"),
]
FOLLOW_UP_AFTER_DAYS = 10

AGGREGATOR_DAILY_CAP = 240
BOARD_DAILY_CAP = 400
LIVE_TTL_DAYS = 3
RATE_WINDOW_SECONDS = 60

GENESIS = "sha256:" + "0" * 64
CONFIRM, REJECT = "alias.confirm", "alias.reject"
APPLICATION, STATUS_SET = "application.logged", "job.status_set"
UNDO_SUFFIX, FAILED_SUFFIX = ".undone", ".failed"

SEARCH_TIERS = [
    ("1", ["Forward Deployed Engineer", "Forward Deployed Software Engineer",
           "Deployment Engineer", "Solutions Engineer", "Technical Solutions Engineer"],
     [None]),
    ("2", ["Graduate Software Engineer", "Software Engineer Graduate Scheme",
           "Junior Software Engineer", "Software Engineer"],
     ["it-jobs", "graduate-jobs"]),
    ("3", ["AI Engineer", "Machine Learning Engineer Graduate", "Applied AI Engineer",
           "NLP Engineer", "Conversational AI Engineer"], [None]),
    ("4", ["Python Developer Graduate", "Automation Engineer", "Junior Data Engineer"],
     [None]),
    ("5-watch", ["GTM Engineer", "Go-to-Market Engineer"], [None]),
]
SEARCH_SHARED = {"location": "", "distance": None, "contract_type": "permanent",
                 "salary_include_unknown": True, "max_days_old": 7}

# key, label, weight, alternatives
SIGNALS = [
    ("nottingham", "also University of Nottingham", 50,
     [r"university of nottingham", r"nottingham", r"uon"]),
    ("gtu", "also Gujarat Technological University", 50,
     [r"gujarat technological university", r"gtu"]),
    ("marathi", "speaks Marathi", 40, [r"marathi"]),
    ("gujarati", "speaks Gujarati", 40, [r"gujarati"]),
    ("hindi", "speaks Hindi", 30, [r"hindi"]),
    ("maharashtra", "Maharashtra connection", 30,
     [r"maharashtra", r"mumbai", r"pune", r"nagpur"]),
    ("gujarat", "Gujarat connection", 30,
     [r"gujarat", r"ahmedabad", r"surat", r"vadodara", r"baroda"]),
    ("india", "based in India", 20,
     [r"india", r"bengaluru", r"bangalore", r"hyderabad", r"delhi", r"chennai",
      r"kolkata"]),
    ("london", "also in London", 25, [r"london"]),
    ("uk", "also in the UK", 15,
     [r"united kingdom", r"u\.k\.", r"uk", r"england", r"scotland", r"wales",
      r"britain"]),
]
PLACE_SIGNALS = ["maharashtra", "gujarat", "nottingham", "gtu"]
MEMBER_POINTS, REACHABLE_POINTS = 10, 15
PEOPLE_LIMIT = 40

ORG_OVERRIDES = {
    "faculty": "facultyai", "snowflake": "snowflakedb", "improbable": "improbable-eng",
    "elevenlabs": "elevenlabs", "the trade desk": "thetradedesk", "man group": "manahl",
    "g-research": "g-research", "starling bank": "starlingbank",
}
ORG_SLUG_PATTERN = r"^[a-z0-9](?:[a-z0-9]|-(?=[a-z0-9])){0,38}$"

PEOPLE_SEARCH_URL = "https://www.linkedin.com/search/results/people/?keywords="
WEB_SEARCH_URL = "https://www.google.com/search?q="
# key, search term
PEOPLE_SEARCH_TERMS = [
    ("alumni-nottingham", "University of Nottingham"),
    ("alumni-gtu", "Gujarat Technological University"),
    ("marathi", "Marathi"), ("gujarati", "Gujarati"), ("hindi", "Hindi"),
    ("maharashtra", "Maharashtra"), ("gujarat", "Gujarat"), ("india", "India"),
    ("recruiter", "recruiter talent acquisition"),
]
XRAY_TERMS = [
    ("xray-nottingham", "University of Nottingham"),
    ("xray-gtu", "Gujarat Technological University"),
    ("xray-marathi", "Marathi"), ("xray-gujarati", "Gujarati"), ("xray-hindi", "Hindi"),
    ("xray-maharashtra", "Maharashtra"), ("xray-gujarat", "Gujarat"),
]
XRAY_MANAGERS = '("Engineering Manager" OR "Head of Engineering" OR "Tech Lead")'

# needles, question
ROLE_QUESTIONS = [
    (["forward deployed", "forward-deployed", "solutions engineer", "solution engineer",
      "customer engineer", "field engineer"],
     "how much of the week actually ends up on the customer's side versus in the codebase"),
    (["machine learning", "ml engineer", "ai engineer", "data scientist",
      "research engineer"],
     "how much of the ML work is models versus the plumbing around them"),
    (["data engineer", "analytics", "platform"],
     "what breaks most often once the pipelines are somebody else's problem"),
]
DEFAULT_QUESTION = "what the first few months actually look like on your team"
HOOK_PRIORITY = ["nottingham", "gtu", "maharashtra", "gujarat", "marathi", "gujarati",
                 "hindi", "london"]
NOTE_LIMIT = 300
ASK_PATTERNS = [
    r"\brefer(?:ral|ring|\b)", r"\bput me forward\b", r"\bvouch\b",
    r"\bpass (?:on |along )?my (?:cv|resume)\b", r"\bget me an interview\b",
    r"\bhire me\b", r"\bany (?:openings|vacancies)\b",
]
ROUTE_SCHEMES = ["https://", "http://", "mailto:"]

# --------------------------------------------------------------------------------------
# End of fixed values; the rest is derived.
# --------------------------------------------------------------------------------------

NOISE_PATTERN = word_pattern(TITLE_EXCLUDE)
INGEST_SENIORITY_PATTERN = word_pattern(SENIORITY_EXCLUDE)
RECRUITER_KEYWORD_PATTERN = word_pattern(RECRUITER_KEYWORDS)
RECRUITER_NAME_PATTERN = "|".join(re.escape(n).replace(r"\ ", " ").replace(r"\-", "-")
                                  for n in RECRUITER_COMPANIES)
APPLY_BLOCK_PATTERN = word_pattern(APPLY_BLOCK_TERMS)
ROLE_INCLUDE_PATTERN = word_pattern(ROLE_INCLUDE_TERMS)
SIGNAL_PATTERNS = {key: r"\b(" + "|".join(alts) + r")\b" for key, _, _, alts in SIGNALS}
