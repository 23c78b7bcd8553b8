"""Fixed values.

Word lists, patterns, header names, thresholds and formats that results depend
on. They are stated here once, as plain text; every operator imports them.
"""

# --- company names -----------------------------------------------------------
COMPANY_PUNCTUATION = r"[,\.'’]"
CORPORATE_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "corporation", "co", "company", "technologies",
    "technology", "labs", "holdings", "group", "usa", "us",
)

# --- new-grad titles ---------------------------------------------------------
NEW_GRAD = (
    r"\b(new ?grad(uate)?|university grad(uate)?|entry.?level|early career|campus|"
    r"(software|swe).{0,30}(intern(ship)?\b|20(2[6-9])))\b"
)
SENIOR = r"\b(senior|staff|principal|lead|manager|director|sr\.?)\b"
DESCRIPTION_WINDOW = 2000  # the classifier's contract: leading characters only

# --- filings -----------------------------------------------------------------
FISCAL_YEAR_HEADERS = ("fiscal year", "fiscal_year", "fy")
EMPLOYER_HEADERS = (
    "employer (petitioner) name", "employer", "employer name", "petitioner name",
)
INITIAL_APPROVAL_HEADERS = ("initial approval", "initial approvals", "initial_approval")
INITIAL_DENIAL_HEADERS = ("initial denial", "initial denials", "initial_denial")
CONTINUING_APPROVAL_HEADERS = (
    "continuing approval", "continuing approvals", "continuing_approval",
)
FILING_COLUMNS = {
    "fiscal_year": FISCAL_YEAR_HEADERS, "employer": EMPLOYER_HEADERS,
    "initial_approvals": INITIAL_APPROVAL_HEADERS, "initial_denials": INITIAL_DENIAL_HEADERS,
    "continuing_approvals": CONTINUING_APPROVAL_HEADERS,
}

# --- dedup, sponsor match, score ---------------------------------------------
TITLE_THRESHOLD = 92       # percent, inclusive
DUPLICATE_WINDOW_DAYS = 14  # inclusive
CANDIDATE_DAYS = 30
MATCH_THRESHOLD = 90       # percent, inclusive
TRIGRAM_TENTHS = 3         # similarity of at least 3/10

# --- retention, alerts, details ----------------------------------------------
RETENTION_DAYS = 30
NEW_GRAD_RETENTION_DAYS = 90
ALERT_CAP = 15
DETAIL_CAPS = {"greenhouse": 25, "smartrec": 40}
BADGES = {"verified": "\U0001f7e2", "likely": "\U0001f7e1"}
DEFAULT_BADGE = "⚪"
NO_LOCATION = "location n/a"
SUSPECT_BOARD = "0 postings (token likely wrong — SR never 404s)"
SMARTRECRUITERS_URL = "https://jobs.smartrecruiters.com/"

# --- reports and planning rules ----------------------------------------------
RESPONDED = ("oa", "phone", "onsite", "offer")
INTERVIEWING = ("phone", "onsite", "offer")
NOT_POSITIVE = ("submitted", "ghosted", "rejected")
APPLY_QUEUE_SIZE = 25
FRESH_MINUTES = 60
QUEUE_FIT = 0.55
APPLIED_FOLLOW_UP_DAYS = 10
APPLIED_FOLLOW_UP_ACTION = "no response — check portal / nudge"
LINK_MARKERS = ("/jobs/view/", "myworkdayjobs.com", "/job/")
SOFTWARE_SOC_PREFIX = "15-12"
FOLLOW_UP_RULES = (
    # (event, days after, action)
    ("new_contact", 0, "send intro message (draft ready)"),
    ("outbound_no_reply", 6, "polite bump #1"),
    ("bump_no_reply", 10, "final bump, then park"),
    ("call", 1, "thank-you note"),
    ("application_with_contact", 0, "ask contact about referral"),
    ("interview_completed", 0, "thank-you to interviewer if email known"),
    ("outcome", 0, "update contact, thank for help"),
)

# A poll asks a board page after page; the next poll comes ten minutes later at the earliest.
RUN_PAUSE_MINUTES = 5
