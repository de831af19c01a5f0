"""Lexicons, weights and patterns that results depend on."""

# Facility types in order of precedence, with their keywords.
FACILITY_TYPES = {
    "skilled_nursing": ("skilled nursing", "nursing home", "snf", "skilled nursing facility", "rehabilitation center", "rehab center", "post-acute care"),
    "assisted_living": ("assisted living", "assisted care", "senior living", "independent living", "residential care", "adult care home", "personal care"),
    "memory_care": ("memory care", "alzheimer", "dementia care", "cognitive care", "memory support", "alzheimer's care", "dementia support"),
    "continuing_care": ("ccrc", "continuing care retirement community", "life plan community", "retirement community", "senior community"),
}
# Substrings of URLs that list facilities, and of URLs to leave out.
LISTING_PARTS = (
    "locations", "facilities", "centers", "communities", "properties", "find-a-location", "our-locations", "care-centers", "nursing-homes",
    "assisted-living", "memory-care", "senior-living", "directory", "find-care", "location-finder", "facility-locator",
)
EXCLUDED_PARTS = (
    "careers", "jobs", "employment", "news", "blog", "events", "calendar", "resources", "forms", "documents", "pdf",
    "privacy", "terms", "legal", "sitemap", "search",
)
SEGMENT_PARTS = ("location", "facility", "center", "community", "property")
# Regular expressions.
DETAIL_URL = r"/(location|facility|center|community|property|locations|facilities)/[^/]+/?$"
PHONE = r"(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})"
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
ZIP = r"(\d{5}(?:-\d{4})?)"
BEDS = r"(\d+)\s*(?:beds?|bed)"
STREET = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Way|Circle|Cir|Court|Ct|Place|Pl"
CITY_STATE_ZIP = r"^([^,]+),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)"
# URL scoring.
URL_KEYWORDS = {"locations": 10, "facilities": 10, "communities": 8, "directory": 8, "find": 5, "search": 5, "our": 3, "contact": -5, "about": -5, "careers": -10, "news": -10}
URL_GOOD = (r"/location[s]?/", r"/facilit(y|ies)/", r"/communit(y|ies)/", r"/center[s]?/", r"/find.*location", r"/directory/")
URL_BAD = (r"/career[s]?/", r"/job[s]?/", r"/news/", r"/blog/", r"/investor[s]?/", r"/press/", r"/media/", r"\.pdf$")
DEPTH_PENALTY, MAX_DEPTH = 2, 3
# Names that are no facility's.
GENERIC_NAMES = ("our facility", "healthcare facility", "nursing home", "assisted living", "care center", "location", "facility")
# Codes of the states.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY",
    "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
# Confidence by extraction method.
METHOD_SCORES = {"llm_generated_schema": 0.9, "predefined_schema": 0.85, "regex_extraction": 0.7, "llm_fallback": 0.6}
OTHER_METHOD = 0.5
OTHER_TYPE = "Healthcare Facility"
# Selectors of the parts of a facility's page.
NAME_SELECTORS = ("h1", ".facility-name", ".location-name", ".community-name", '[class*="name"]', '[class*="title"]', ".page-title", ".main-title")
DESCRIPTION_SELECTORS = (".description", ".about", ".overview", '[class*="description"]', '[class*="about"]', 'meta[name="description"]')
CONTACT_SELECTORS = '.contact, .contact-info, .contact-details, .address, .location-info, .facility-contact, [class*="contact"], [class*="address"]'
ADDRESS_SELECTORS = {
    "address": '[itemprop="streetAddress"], .street, .street-address',
    "city": '[itemprop="addressLocality"], .city, .locality',
    "state": '[itemprop="addressRegion"], .state, .region',
    "zip_code": '[itemprop="postalCode"], .zip, .postal-code',
}
CARD_SELECTORS = '.facility-card, .location-card, .community-card, .center-card, .property-card, [class*="facility"], [class*="location"], [class*="community"]'
SERVICE_SELECTORS = '.services, .amenities, .care-services, .specialties, [class*="service"], [class*="amenity"], [class*="care"], [id*="service"], [id*="amenity"]'
SERVICE_HEADINGS = ("service", "amenity", "care", "specialty", "offer")
SERVICE_KINDS = {
    "amenities": ("amenity", "amenities"),
    "specialties": ("specialty", "specialties", "specialize"),
    "care_levels": ("care level", "level of care"),
}
NAV_LINK_SELECTORS = (
    'nav a, .navigation a, .nav a, .menu a, .main-menu a, [role="navigation"] a, .navbar a, .header-nav a, footer a, .footer a, .site-footer a'
)
NUMBERED_SELECTORS = '.pagination a, .pager a, .page-numbers a, [class*="pagination"] a, [class*="pager"] a'
NEXT_SELECTORS = 'a:contains("Next"), a:contains(">"), .next, [class*="next"]'
FORM_WORDS = ("location", "find", "search", "facility", "center")
# Patterns of facts in texts; the first that matches counts.
ADMINISTRATOR = (r"administrator[:\s]*([^,\n]+)", r"executive\s+director[:\s]*([^,\n]+)", r"facility\s+director[:\s]*([^,\n]+)")
LICENSE = (r"license\s*#?\s*([A-Z0-9-]+)", r"state\s+license[:\s]*([A-Z0-9-]+)", r"facility\s+id[:\s]*([A-Z0-9-]+)")
MEDICARE = (r"medicare\s+provider\s+(?:id|number)[:\s]*([A-Z0-9-]+)", r"cms\s+certification[:\s]*([A-Z0-9-]+)", r"provider\s+number[:\s]*([A-Z0-9-]+)")
EMAIL_FALSE = ("example", "test", "noreply")
AJAX_PATTERNS = (r"ajax.*?url.*?[\"']([^\"']+)[\"']", r"fetch\([\"']([^\"']+)[\"']", r"\.get\([\"']([^\"']+)[\"']", r"\.post\([\"']([^\"']+)[\"']")
# Patterns of facility blocks in raw HTML.
BLOCK = r"<div[^>]*(?:facility|location|community|center)[^>]*>.*?</div>"
BLOCKS = (BLOCK, r"<article[^>]*>.*?</article>", r"<section[^>]*>.*?</section>", r"<li[^>]*(?:facility|location)[^>]*>.*?</li>")
BLOCK_SPLIT = r"<(?:div|section|article|li)[^>]*>"
BLOCK_NAMES = (r"<h[1-6][^>]*>([^<]+)</h[1-6]>", r"class=\"[^\"]*(?:name|title)[^\"]*\"[^>]*>([^<]+)</[^>]+>", r"<title>([^<]+)</title>")
BLOCK_NAME_KEYED = r"<h[1-6][^>]*>([^<]*(?:care|center|living|manor|home|facility|community)[^<]*)</h[1-6]>"
BLOCK_PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
BLOCK_STREET = r"\d+\s+[A-Za-z0-9\s,.-]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Way|Circle|Cir)"
BLOCK_TYPES = {"skilled.*nursing": "Skilled Nursing", "assisted.*living": "Assisted Living", "memory.*care": "Memory Care", "senior.*living": "Senior Living"}
BLOCK_CONTEXT = r"skilled|nursing|assisted|living|memory|care|rehabilitation|senior|facility|center|home|manor|community|residence"
# Kinds of sites in order of precedence, links that lead on.
SITE_TYPES = {
    "corporate_chain": ("locations", "communities", "facilities", "find a location"),
    "individual_facility": ("about us", "services", "contact", "staff"),
    "directory": ("search", "directory", "browse", "filter"),
}
SITE_LINKS = (r'href="([^"]*(?:location|facility|community|center)[^"]*)"', r'href="([^"]*(?:find|search|directory)[^"]*)"')
# Other names of the fields of a record.
ALIASES = {
    "name": ("facility_name", "name", "title"), "facility_type": ("facility_type", "care_type", "service_type", "type"),
    "address": ("address", "street_address", "address_line_1"), "city": ("city", "locality"), "state": ("state", "region", "province"),
    "zip_code": ("zip_code", "postal_code", "zip"), "phone": ("phone", "telephone", "phone_number"), "email": ("email", "email_address"), "website": ("website", "url", "link"),
}
# Confidence by what a geocoder or a fetch answers.
GEOCODE_SCORES = {"found": 0.9, "missing": 0.2, "service_error": 0.5}
FETCH_GOOD, FETCH_OTHER, FETCH_TIMEOUT, FETCH_FAILED = 0.9, 0.3, 0.2, 0.1
# Single patterns of facts in texts.
LICENSE_SHORT = r"(?:license|lic\.?)\s*#?\s*([A-Z0-9-]+)"
MEDICARE_SHORT = r"(?:medicare|provider)\s*(?:id|number|#)\s*:?\s*([A-Z0-9-]+)"
# Weights of the declared overall quality.
QUALITY_WEIGHTS = {"completeness": 0.4, "accuracy": 0.3, "consistency": 0.2, "freshness": 0.1}

JSON_LD_TYPES = ("Organization", "LocalBusiness", "HealthAndBeautyBusiness")
JSON_LD_FIELDS = {c: c for c in ("name", "description", "url", "telephone", "email")}
JSON_LD_ADDRESS = {"street_address": "streetAddress", "city": "addressLocality", "state": "addressRegion", "zip_code": "postalCode", "country": "addressCountry"}

CATALOG_ADVISED, CATALOG_MOST, CATALOG_MEGABYTES = 1000, 10000, 50
# The addresses that a site is asked for its sitemaps at, and the name space of sitemaps.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/robots.txt")
SITEMAP_SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
# What an address must and may hold, and providers of mail for everyone.
ADDRESS_NEEDS = (r"^\d+", rf"\d+\s+([A-Za-z0-9\s]+(?:{STREET}))")
ADDRESS_MAY = (r"([A-Za-z\s]+),\s*[A-Z]{2}", r"\b[A-Z]{2}\b", r"\b\d{5}(?:-\d{4})?\b")
MAIL_PROVIDERS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")
# Selectors, words and the address pattern of the plain path over a page, and what a link to places holds.
PLAIN_NAMES = ("h1", ".facility-name", ".location-name", ".community-name", ".property-name", '[class*="name"]', "title")
PLAIN_ADDRESSES = (".address", ".location", '[class*="address"]', '[itemprop="address"]', ".contact-info")
PLAIN_SERVICES = (".services", ".amenities", ".care-services", '[class*="service"]', '[class*="amenity"]')
PLAIN_PAGERS = ('a[href*="page"]', ".pagination a", ".pager a", 'a:contains("Next")', 'a:contains("More")', 'a:contains("Load")')
WIDE_STREET = rf"(\d+\s+[A-Za-z0-9\s,.-]+(?:{STREET}))"
PLACE_TOKENS = ("/locations", "/location", "find-a-location", "facility", "affiliated-locations")
# Names of the files that a run leaves.
FILE_NAMES = {
    "individual_facility": "{corporation_name}_{timestamp}_facilities.{format}",
    "consolidated": "all_facilities_{timestamp}.{format}",
    "batch_summary": "batch_processing_summary_{batch_id}.{format}",
    "corporation_summary": "corporation_summary_{timestamp}.{format}",
    "quality_report": "data_quality_report_{timestamp}.{format}",
}
