"""Fixed values shared by every operator.

The values below are facts of the data contract (limits, enumerations, score
tables, weights, messages); results depend on them being exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pagestrata.errors import AuditError


@dataclass(frozen=True)
class Limits:
    """Caps of one audit. A run may lower them; who wants more than the reference's values says so with ``raised``."""

    discovered: int = 5_000
    fetched: int = 250
    analyzed: int = 150
    sitemap_documents: int = 50
    redirects: int = 5
    response_bytes: int = 5 * 1024 * 1024
    messaging_bytes: int = 100 * 1024 * 1024
    messaging_characters: int = 1_000_000
    page_characters: int = 50_000
    analyzed_characters: int = 2_000_000
    analysis_batch_pages: int = 5
    analysis_batch_characters: int = 30_000

    def lowered(self, **overrides: int) -> "Limits":
        for name, value in overrides.items():
            top = getattr(self, name)
            if not 1 <= value <= top:
                raise AuditError("USAGE", f"{name} must be between 1 and {top}.")
        return replace(self, **overrides)

    def raised(self, **overrides: int) -> "Limits":
        """Other limits, higher ones too: URLs, pages and text beyond the reference's values are then kept."""
        if any(value < 1 for value in overrides.values()):
            raise AuditError("USAGE", "A limit must be at least 1.")
        return replace(self, **overrides)

    def as_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}


DEFAULT_LIMITS = Limits()

USER_AGENT = "pagestrata/0.1"
SCHEMA_VERSION = "1.0"
EVALUATION_CONTRACT_VERSION = "1.1"
APPROVAL_GATE_VERSION = "1.0"

TRACKING_PREFIX = "utm_"
TRACKING_PARAMETERS = [
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "source",
]

PAGE_TYPE_SCORES = {
    "homepage": 100,
    "pricing": 90,
    "product": 90,
    "solution": 90,
    "comparison": 90,
    "use-case": 80,
    "persona": 80,
    "industry": 80,
    "landing-page": 70,
    "customer-proof": 70,
    "resource": 45,
    "article": 25,
    "corporate": 20,
    "legal": 0,
    "careers": 0,
    "help": 0,
    "other": 30,
}
PAGE_TYPES = list(PAGE_TYPE_SCORES)
DEFAULT_PAGE_TYPE_SCORE = 30
STRATEGIC_TYPES = [
    "homepage", "pricing", "product", "solution", "use-case", "industry", "persona", "comparison",
]

LINK_PLACEMENTS = [
    "primary-nav", "utility-nav", "navigation-dropdown", "homepage-hero", "homepage-module",
    "body", "footer", "other",
]
STRUCTURAL_PLACEMENTS = [
    "primary-nav", "utility-nav", "homepage-hero", "homepage-module", "navigation-dropdown",
]
MEANINGFUL_PLACEMENTS = ["body", "homepage-module", "homepage-hero"]
MINOR_PLACEMENTS = ["footer", "sitemap"]

ACQUISITION_METHODS = [
    "owner-cms-export", "seo-crawler-export", "approved-crawl", "content-api", "manual-export",
    "public-manual-capture", "authorized-repository", "github-repository", "common-crawl",
    "wayback", "multi-archive",
]
ARCHIVE_METHODS = ["common-crawl", "wayback", "multi-archive"]
NO_AUTHORIZATION_NEEDED = ["public-manual-capture", "common-crawl", "wayback", "multi-archive"]
REPOSITORY_METHODS = ["authorized-repository", "github-repository"]

PRIORITY_WEIGHTS = {
    "messaging_impact": 0.30,
    "site_prominence": 0.25,
    "strategic_page_type": 0.15,
    "audience_relevance": 0.10,
    "funnel_importance": 0.10,
    "proof_gap": 0.05,
    "update_efficiency": 0.05,
}
PRIORITIES = ["P0", "P1", "P2", "P3"]

ANALYSIS_STATUSES = [
    "conflict", "omission", "outdated-message", "proof-gap", "incomplete", "aligned",
    "not-applicable", "analysis-failed",
]
MATERIAL_STATUSES = ["conflict", "outdated-message", "omission", "incomplete"]
URGENT_STATUSES = ["conflict", "outdated-message"]
MESSAGE_CATEGORIES = [
    "market-problem", "positioning", "value-proposition", "benefit-pillar", "proof",
    "differentiator", "audience", "capability", "exclusion", "other",
]
SECTION_ACTIONS = ["retain", "change", "add", "remove", "review"]
CONFIDENCES = ["low", "medium", "high"]

APPROVAL_ROLES = ["messaging-provenance", "claim-safety", "prioritization", "editorial-actionability"]
ADJUDICATION_DECISIONS = ["keep-quarantined", "authorize-retry", "manual-exception"]
ATTEMPT_MODES = ["initial", "targeted-repair", "human-authorized-retry"]

# Path patterns that keep a URL out of the analysis, first match wins.
EXCLUDED_PATHS = [
    (r"/(legal|privacy|terms|security|gdpr|cookies?)(/|$)", "legal"),
    (r"/(careers?|jobs?)(/|$)", "careers"),
    (r"/(login|sign-in|signin|account|search)(/|$)", "utility"),
    (r"/(docs?|documentation|help|support|knowledge-base)(/|$)", "help"),
    (r"/(tags?|authors?|page)/", "archive-or-pagination"),
]
PAGINATION_QUERY = r"([?&])(page|offset)=[0-9]+"
NON_HTML_SUFFIX = r"\.(xml|json|rss|atom|jpg|jpeg|png|gif|webp|svg|pdf|zip)$"

# Page types by words in the path, title and headings, first match wins. ``\b`` is an ASCII word edge.
PAGE_TYPE_WORDS = [
    ("pricing", r"\b(pricing|plans?)\b"),
    ("comparison", r"\b(compare|comparison|versus|vs\.?|alternative)\b"),
    ("use-case", r"\b(use[- ]?cases?|workflows?)\b"),
    ("persona", r"\b(for[- ]?(teams?|roles?)|persona|leaders?|managers?|executives?)\b"),
    ("industry", r"\b(industr(y|ies)|sectors?|verticals?)\b"),
    ("customer-proof", r"\b(customers?|case[- ]?stud(y|ies)|stories|testimonials?)\b"),
    ("solution", r"\b(solutions?|outcomes?)\b"),
    ("product", r"\b(products?|platform|features?|capabilities)\b"),
    ("landing-page", r"\b(lp|landing|campaign|demo|webinar)\b"),
    ("article", r"\b(blog|articles?|insights?|guides?|resources?)/.+"),
    ("resource", r"\b(blog|articles?|insights?|guides?|resources?)\b"),
    ("careers", r"\b(careers?|jobs?)\b"),
    ("legal", r"\b(legal|privacy|terms|cookies?|gdpr)\b"),
    ("help", r"\b(help|support|docs?|documentation|knowledge[- ]?base)\b"),
    ("corporate", r"\b(about|company|contact|partners?|press|newsroom)\b"),
]

# Repository source files.
ROUTE_EXTENSIONS = ["html", "htm", "md", "mdx", "jsx", "tsx", "js", "ts", "astro"]
IGNORED_DIRECTORIES = [".git", ".next", ".cache", ".turbo", ".vercel", "node_modules", "vendor", "coverage"]
# Fixed values of reading source files: entities, elements, labels, words of code, marks of Markdown.
SOURCE_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
SOURCE_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SOURCE_COPY = {*SOURCE_HEADINGS, "p", "li", "blockquote", "button", "a"}
SOURCE_NESTING = ("li", "blockquote")
SOURCE_NAVIGATION = ("nav", "header")
SOURCE_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SOURCE_LABELS = ("headline", "heading", "label", "eyebrow", "subheading")
SOURCE_CODE_WORDS = ("className", "return", "const", "function")
MARKDOWN_MARKS = str.maketrans("", "", "*_`>#")
ANCHOR = r"""(?is)<a\b[^>]*(?:href|to)\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
NAVIGATION_OR_ANCHOR = r"""(?is)<nav[^>]*>.*?</nav>|<header[^>]*>.*?</header>|<a\b[^>]*(?:href|to)\s*=\s*["'][^"']+["'][^>]*>.*?</a>"""
MAX_REPOSITORY_ENTRIES = 25_000
MAX_REPOSITORY_FILE_BYTES = 1_000_000
MAX_REPOSITORY_TOTAL_BYTES = 100 * 1024 * 1024

# Archives.
COMMON_CRAWL_DATA = "https://data.commoncrawl.org/"
COMMON_CRAWL_COLLECTIONS = 6
WAYBACK_HOST = "web.archive.org"
WAYBACK_NAME = "Internet Archive Wayback Machine"
WAYBACK_FIELDS = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]
MULTI_ARCHIVE_NAME = "Common Crawl + Internet Archive Wayback Machine"
INDEX_PAGE_SIZE = 1_000
MAX_INDEX_PAGES = 10
MANUAL_CAPTURE_PAGES = 250
