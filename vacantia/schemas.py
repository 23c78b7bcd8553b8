"""Table schemas (Spark DDL). Timestamps are instants in a UTC session."""

LANDING = "ats string, token string, fetched_at timestamp, status int, body string"
WATCHLIST = "ats string, token string"
POSTINGS = ("source string, external_id string, title string, location string, url string, "
            "description string, posted_at timestamp, raw variant")
COMPANIES = ("id string, name string, name_normalized string, website string, ats_type string, "
             "ats_token string, hq_location string, size_bucket string, "
             "sponsor_score decimal(4,3), sponsor_status string, notes string, "
             "created_at timestamp")
JOBS = ("id string, company_id string, source string, external_id string, title string, "
        "location string, remote boolean, url string, description string, posted_at timestamp, "
        "first_seen_at timestamp, raw variant, is_new_grad boolean, fit_score decimal(4,3), "
        "fit_rationale string, keywords array<string>, visa_flag string, status string, "
        "note string")
RESUME_VERSIONS = ("id string, job_id string, base_hash string, diff_summary string, "
                   "content_json variant, pdf_path string, ats_keyword_hits int, "
                   "created_at timestamp")
APPLICATIONS = ("id string, job_id string, resume_version_id string, cover_letter_path string, "
                "channel string, referral_contact_id string, applied_at timestamp, "
                "minutes_after_posting int, status string, status_updated_at timestamp, "
                "rejection_stage string, notes string")
APPLICATION_EVENTS = ("id string, application_id string, event string, occurred_at timestamp, "
                      "detail string")
CONTACTS = ("id string, company_id string, name string, role string, relationship string, "
            "email string, linkedin_url string, school_overlap boolean, warmth int, "
            "do_not_contact boolean, created_at timestamp")
INTERACTIONS = ("id string, contact_id string, channel string, direction string, "
                "summary string, occurred_at timestamp")
FOLLOW_UPS = ("id string, application_id string, contact_id string, due_at timestamp, "
              "action string, done boolean, created_at timestamp")
INTERVIEWS = ("id string, application_id string, round string, scheduled_at timestamp, "
              "format string, outcome string, debrief string")
PREP_LOG = ("id string, kind string, ref string, result string, minutes int, "
            "next_review_at timestamp, done_at timestamp")
RUN_LOG = "source string, ok boolean, ran_at timestamp, detail string"
FILINGS = ("src string, fiscal_year int, employer_raw string, employer_norm string, "
           "initial_approvals bigint, initial_denials bigint, continuing_approvals bigint, "
           "soc_code string, job_title string, wage decimal(18,2), worksite_state string")

SMARTRECRUITERS_DETAIL = ("struct<id:string,postingUrl:string,"
                          "jobAd:struct<sections:map<string,struct<title:string,text:string>>>>")
GREENHOUSE_DETAIL = "struct<id:string,content:string>"
