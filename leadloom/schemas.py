"""Row shapes and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

# ``landed_at`` is when a page or a text was fetched, in sortable text; it may be the
# partition column of the folder.  A missing one is older than all others.
PAGES = "source string, page_no int, url string, html string, landed_at string"

LISTINGS = (
    "external_id string, source string, url string, title string, company string, "
    "salary_text string, location string, page_no int, pos int"
)

JOBS = (
    "external_id string, source string, url string, title string, company string, "
    "salary_text string, location string, offer_markdown string, match_score double, "
    "match_reason string, summary string, status string, created_at string, updated_at string"
)

OFFERS = "url string, offer_markdown string, error string, landed_at string"

PROPERTY = (
    "type string, title array<struct<plain_text:string>>, rich_text array<struct<plain_text:string>>, "
    "url string, number double, select struct<name:string>, status struct<name:string>, "
    "date struct<start:string>"
)

EXTERNAL_PAGE = (
    "struct<id:string, created_time:string, last_edited_time:string, "
    "properties:map<string, struct<type:string, title:array<struct<plain_text:string>>, "
    "rich_text:array<struct<plain_text:string>>, url:string, number:double, "
    "select:struct<name:string>, status:struct<name:string>, date:struct<start:string>>>>"
)

PAGE_BATCH = f"results array<{EXTERNAL_PAGE}>, has_more boolean, next_cursor string"

CATALOG = "name string, type string"

JOB_COLUMNS = [part.split()[0] for part in JOBS.split(", ")]

# The columns a new sighting of a listing refreshes.
LISTING_COLUMNS = ["source", "url", "title", "company", "salary_text", "location"]

# Sources in precedence order, statuses, terminal statuses.
SOURCES = ["justjoinit", "nofluffjobs", "bulldogjob"]
STATUSES = [
    "discovered",
    "fetching",
    "fetched",
    "scoring",
    "scored",
    "matched",
    "rejected",
    "error",
]
TERMINAL = ["matched", "rejected"]

# Labels on a listing card which are no title, company or place.
LEAD_BADGES = ["Super offer", "1-click Apply", "New"]
META_LABELS = [
    "Remote",
    "Hybrid",
    "Office",
    "B2B",
    "Permanent",
    "Internship",
    "Mandate contract",
    "Specific-task contract",
    "Full-time",
    "Part-time",
    "Practice / Internship",
    "Freelance",
    "Junior",
    "Mid",
    "Senior",
    "Manager / C-level",
]

# Properties of the external table and the types allowed for each.
REQUIRED_PROPERTIES = {
    "Name": ["title"],
    "External ID": ["rich_text"],
    "URL": ["url"],
    "Status": ["status", "select"],
}
OPTIONAL_PROPERTIES = {
    "Source": ["select", "rich_text"],
    "Company": ["rich_text"],
    "Salary": ["rich_text"],
    "Location": ["rich_text"],
    "Match Score": ["number"],
    "Match Reason": ["rich_text"],
    "Summary": ["rich_text"],
    "Created At": ["date", "rich_text"],
    "Updated At": ["date", "rich_text"],
}

# Defaults of a run.
MATCH_THRESHOLD = 0.78
MAX_LISTINGS = 200
REPORT_SIZE = 10
TOP_MATCHES = 20


@dataclass(frozen=True)
class SourceConfig:
    """One listing source: where it lives, what to search for, how much to take."""

    source: str
    base_url: str
    filters: dict = field(default_factory=dict)
    max_listings: int = MAX_LISTINGS
    enabled: bool = True


@dataclass(frozen=True)
class RunConfig:
    sources: tuple[SourceConfig, ...]
    match_threshold: float = MATCH_THRESHOLD


def default_config() -> RunConfig:
    # Addresses of the boards; what to search for is only a default.
    return RunConfig(
        sources=(
            SourceConfig(
                "justjoinit",
                "https://justjoin.it",
                {"keyword": "javascript", "category": "javascript", "location": "warszawa"},
            ),
            SourceConfig(
                "nofluffjobs",
                "https://nofluffjobs.com",
                {"keyword": "javascript", "location": "warszawa"},
            ),
            SourceConfig("bulldogjob", "https://bulldogjob.com", {"keyword": "JavaScript"}),
        )
    )
