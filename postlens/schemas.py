"""Explicit row types as DDL. Nothing is ever inferred from data."""

POSTING = (
    "seq long, source string, company string, board_token string, native_id string, title string, url string, locations array<string>, "
    "description string, department string, employment_type string, remote_flag boolean, posted_at timestamp, updated_at timestamp, "
    "first_seen timestamp, last_seen timestamp, raw struct<workplace_type:string,salary:string,tags:array<string>,level:string,valid_until:string,sector:string,detail_fetched:boolean>"
)
SCORE = ("role double, skill double, bonus double, total double, matched array<string>, missing array<string>, family string, elim_reason string")
GHOST = ("risk double, band string, age_days double, reasons array<string>, evidence string")
SIGHTING = ("run_id long, uid string, seq long, board_token string, title_key string, seen_at timestamp, content_hash string, updated_at timestamp, description string")
PROFILE = (
    "profile_id string, permits array<string>, max_seniority string, max_years int, forbidden array<string>, needs_sponsor boolean, languages array<string>, "
    "practitioner boolean, show_off_domain boolean, families array<struct<name:string,weight:double,titles:array<string>>>, strong map<string,double>, weak map<string,double>, "
    "sector_bonus array<struct<pattern:string,weight:double>>, remote_bonus double"
)
LEDGER = ("board string, at timestamp, status int")
PAGE_CACHE = ("url string, kind string, fetched_at timestamp, body binary")
