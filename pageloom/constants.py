"""Word lists, limits and patterns that results depend on."""

# Elements whose whole subtree is boilerplate.
STRIP_TAGS = [
    "script", "style", "noscript", "iframe", "svg",
    "head", "header", "nav", "footer", "aside", "link",
]

# id/class fragments of consent overlays.
OVERLAY_PATTERNS = [
    "onetrust", "consent", "cookie-banner", "cookie-notice",
    "gdpr", "privacy-banner", "overlay-id",
]

# Attributes kept when a page is compacted (``data-*`` is kept as well).
KEEP_ATTRS = ["class", "id", "href", "role", "type", "name", "aria-label"]

# Phrases that mark a bot wall, searched in the lower-cased body.
BLOCK_SIGNATURES = [
    "cf-ray", "just a moment", "enable javascript and cookies",
    "checking if the site connection is secure",
]
BLOCK_CODES = [403, 429, 503]

# Phrases that mark a page needing a script engine.
JS_PHRASES = [
    "javascript must be enabled", "javascript is required", "please enable javascript",
    "this site requires javascript", "enable javascript to continue",
    "requires javascript to function", "javascript needs to be enabled",
    "javascript to be enabled",
]

# Next-page controls in priority order.
NEXT_PAGE_SELECTORS = [
    'a[aria-label="Next Page"]', 'a[aria-label="Next page"]', 'button[aria-label="Next Page"]',
    'a[rel="next"]', "a.next-page", "button.next-page", ".pagination a.next",
    "a.ais-Pagination-item--nextPage",
]

# Consent buttons.
CONSENT_SELECTORS = [
    "#onetrust-accept-btn-handler", "button#onetrust-accept-btn-handler",
    "[aria-label='Accept all cookies']", "[aria-label='Accept All']",
    "button.cookie-accept", "button#accept-cookies", "#CybotCookiebotDialogBodyButtonAccept",
]

# Fetch layers from cheapest to dearest.
LAYERS = ["httpx", "playwright", "scraperapi", "zyte"]

# Request hints, first list that hits decides the intent type.
LINK_HINTS = ["links", "urls", "hrefs", "all links", "list of links", "anchor"]
DEEP_HINTS = [
    "each", "every", "all articles", "all posts", "follow", "linked pages",
    "each page", "all pages", "every article",
]
FIELD_HINTS = [
    "price", "rating", "title", "name", "salary", "company", "product", "headline", "score",
    "date", "author", "summary", "description", "location", "review",
]
# Words removed from a request to leave its target phrase.
FILLER_WORDS = [
    "get", "extract", "find", "give me", "fetch", "scrape", "show me", "list", "all", "the",
    "from", "on", "at", "of", "a", "an",
]
PAGINATE_PHRASES = [
    "paginate", "paginated", "all pages", "multiple pages", "next page", "click through",
    "page through",
]
FILE_PHRASES = [
    "in json file", "in csv file", "in a file", "to a file", "to file", "save to", "save as",
    "output to", "write to", "json file", "csv file",
]

INTENT_TYPES = ["url_list", "page_content", "structured_data", "deep_content"]
FORMATS = ["json", "csv", "md", "text"]

# Limits and defaults.
CHUNK_CHARS = 6000
VALIDATION_SAMPLES = 5
SCHEMA_SAMPLES = 10
PREVIEW_ITEMS = 5
NO_CAP = 0  # max_urls of an intent that names no number: all pages in scope
DEFAULT_DEPTH = 1
NO_DATA_ITEM = "No data extracted."
NO_DATA_MARKDOWN = "_No data extracted._"
NO_MATCH_REASON = "Selector returned 0 elements."
NO_URL_ERROR = "Could not find a URL in the query."

# Every character Python's str.strip() removes.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
