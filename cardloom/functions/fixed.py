"""Fixed values that results depend on: word lists and patterns."""

# Terms that are never names.
NOT_NAMES = [
    "sign in", "log in", "sign up", "log out", "register", "login",
    "get help", "contact us", "about us", "view profile", "view all",
    "learn more", "read more", "see more", "show more", "load more",
    "find an agent", "find a", "search", "filter", "back to",
    "click here", "more info", "details",
    "contact", "email", "phone", "call", "text", "message",
    "website", "address", "location",
    "name", "first name", "last name", "full name",
    "your name", "enter name", "user name", "username",
    "manhattan", "brooklyn", "queens", "bronx", "staten island",
    "new york", "ny", "nyc", "city", "state", "zip",
    "menu", "home", "listings", "properties", "agents",
    "about", "services", "resources", "blog", "news",
    "compass", "compass one", "compass luxury", "compass academy", "compass plus",
    "compass cares", "private exclusives", "coming soon",
    "new development", "recently sold", "sales leadership",
    "neighborhood guides", "mortgage calculator", "external suppliers",
    "agent", "broker", "realtor", "licensed", "certified",
    "team", "group", "partners", "associates",
]
# Words of the interface that no name contains.
UI_WORDS = ["find", "agent", "last name", "first name", "register", "login", "view", "profile"]
# Mailbox names that are roles.
ROLE_WORDS = [
    "info", "contact", "admin", "support", "team", "sales",
    "help", "service", "office", "hello", "inquiries", "mail",
    "noreply", "no-reply", "webmaster", "postmaster",
    "strategies", "retail", "group", "partners", "associates",
    "realty", "properties", "homes", "listings",
]
# First names that a run-together mailbox may begin with, in order of preference.
FIRST_NAMES = [
    "nikki", "michael", "melody", "robin", "tamara", "brandon",
    "eric", "william", "robert", "jennifer", "melissa", "amanda",
    "christopher", "matthew", "daniel", "elizabeth", "jonathan",
    "ioana", "marc", "emily", "kayode", "seema", "yardena",
]
# Mail providers of private persons.
PERSONAL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "me.com", "mac.com",
    "yahoo.co.uk", "yahoo.ca", "yahoo.com.au", "yahoo.fr", "yahoo.de", "yahoo.co.jp", "yahoo.com.br", "yahoo.in",
    "live.com", "msn.com", "hotmail.co.uk", "hotmail.fr", "outlook.fr", "outlook.de", "outlook.com.au", "outlook.co.uk",
    "googlemail.com", "protonmail.com", "proton.me", "mail.com", "gmx.com", "gmx.de", "web.de", "yandex.com", "yandex.ru",
    "mail.ru", "zoho.com", "tutanota.com", "fastmail.com", "comcast.net", "verizon.net", "att.net", "sbcglobal.net",
    "cox.net", "charter.net", "earthlink.net", "btinternet.com", "virginmedia.com", "sky.com", "talktalk.net",
    "orange.fr", "free.fr", "wanadoo.fr", "laposte.net", "bellsouth.net", "optonline.net", "roadrunner.com",
    "tempmail.com", "guerrillamail.com", "mailinator.com", "10minutemail.com",
]
# Query parameters that number pages, offsets and page sizes.
PAGE_PARAMS = [
    "page", "p", "pg", "pageNum", "pageNumber", "pagingNumber", "pageNo", "currentPage", "paged", "pn", "paging",
    "pageindex", "pageIndex", "pageno", "pagenum", "page_number", "page_num",
]
OFFSET_PARAMS = ["offset", "skip", "start", "from", "startIndex", "startindex", "begin", "first"]
# Patterns.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONES = [
    r"(?:\+1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    r"(?:\+1[-.\s]?)?([0-9]{3})[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    r"([0-9]{10})",
]
NEAR_PHONES = [r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", r"\d{10}"]
NAME = r"^[A-Z][a-zA-Z'\-\.\s]{1,98}[a-zA-Z]\z"
STRICT_PHONE = r"(?:\+?1[-.\s]?)?(?:\(?[2-9]\d{2}\)?[-.\s]?)?[2-9]\d{2}[-.\s]?\d{4}"
LOOSE_PHONE = r"(?:\+?1[-.\s]?)?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})"
TITLE_SUFFIX = r"Partner|Associate|Counsel|Attorney|Director|Manager|Of Counsel|Senior Associate|Managing Director|Vice President|VP|CEO|CFO|CTO|COO|Principal|Member|Fellow|Scholar|Retired"
CREDENTIAL = r",?\s*(?:JD|MD|PhD|Esq\.?|CPA|MBA|LLM|LLB|CFA|CFP|PE|RN|DO|DDS|III|IV|Jr\.?|Sr\.?)\.?"
NAME_SPAM = r"(?i)^(View Profile|Contact Us|Learn More|Click Here|Load More|See Details|Read More|Show More|View All|Download vCard|vCard|Email|Phone|Fax|Address|Office|Location)\z"
# Titles that end names, tried in this order, first with a space before them and then run together.
TITLE_ENDS = [
    r"\s*(Senior\s+Partner|Managing\s+Partner|Senior\s+Associate|Senior\s+Counsel)",
    r"\s*(Of\s+Counsel|Special\s+Counsel|General\s+Counsel)",
    r"\s*(Co-Chair|Vice\s+Chair|Chair)",
    r"\s*(Partner|Associate|Counsel)",
    r"(Senior\s*Partner|Managing\s*Partner|Senior\s*Associate|Senior\s*Counsel)",
    r"(Of\s*Counsel|Special\s*Counsel|General\s*Counsel)",
    r"(Co-Chair|Vice\s*Chair|Chair)",
    r"(Partner|Associate|Counsel)",
]
TITLES = [
    "Partner", "Senior Partner", "Managing Partner", "Associate", "Senior Associate", "Counsel", "Of Counsel",
    "Special Counsel", "General Counsel", "Senior Counsel", "Chair", "Co-Chair", "Vice Chair",
]
LOCATION_PHONES = [
    r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"\d{10}",
]
LOCATION_LABELS = [r"(?i)\bPhone:?\s*", r"(?i)\bTel:?\s*", r"(?i)\bFax:?\s*", r"(?i)\bEmail:?\s*", r"(?i)\bOffice:?\s*"]
NOISE_UI = [
    r"(?i)^(View|Edit|Delete|Save|Cancel|Close|Submit)\s*", r"(?i)\b(Click\s+here|Read\s+more|Learn\s+more|See\s+more)\b", r"(?i)\b(Loading|Please\s+wait)\b",
    r"(?i)^(Menu|Home|Back|Next|Previous)\s*", r"(?i)\b(Sign\s+in|Log\s+in|Register|Sign\s+up)\b",
]
NOISE_LABELS = [
    r"(?i)^(Email|E-mail):?\s*", r"(?i)^(Phone|Tel|Telephone):?\s*", r"(?i)^(Fax):?\s*", r"(?i)^(Address|Location|Office):?\s*",
    r"(?i)^(Name):?\s*", r"(?i)^(Title|Position|Role):?\s*", r"(?i)^(Bio|About|Description):?\s*",
]
PRESERVED_PLACES = [r"(?i)Washington,?\s*D\.?C\.?", r"(?i)St\.\s+\w+", r"\w+,\s*[A-Z]{2}\b", r"\w+,\s*[A-Z][a-z]+"]
# Parts of addresses that are made up or belong to nobody.
FAKE_MAIL = [
    "test@", "example@", "demo@", "noreply@", "info@", "contact@", "admin@", "webmaster@", "postmaster@",
    "support@", "help@", "sales@", "marketing@", "@example.com", "@test.com", "@localhost", "@domain.com",
    "@example.org", "@fake.com",
]
# Title words that a name may carry, for mailbox forms.
NAME_TITLES = ["Partner", "Associate", "Counsel", "Of Counsel", "Senior Partner", "Managing Partner"]
# Parts of addresses of profile pages, in order of preference.
PROFILE_PARTS = [
    "/agents/", "/profile/", "/realtor/", "/team/", "/broker/", "/member/", "/lawyer/", "/Lawyers/",
    "/attorney/", "/people/", "/professionals/", "/attorneys/", "/our-team/", "/staff/", "/about/", "/bio/",
]
# Texts of links that stand for an address.
MAIL_LINKS = ["email", "e-mail", "send email", "contact email"]
# Texts that are no names on cards, and in smart fields.
CARD_NOT_NAMES = [
    "sign in", "log in", "sign up", "register", "contact us", "about us", "view profile", "learn more", "read more",
    "see more", "load more", "email", "phone", "call", "text", "message", "website", "address", "menu", "home",
    "search", "filter", "back", "next", "previous",
]
SMART_NOT_NAMES = [
    "email", "phone", "tel", "fax", "mobile", "cell", "address", "location", "city", "state", "country", "contact",
    "info", "support", "sales", "admin", "click", "here", "more", "view", "profile", "read", "next", "prev",
    "previous", "back", "home", "menu", "share", "print", "save", "edit", "delete", "remove", "loading", "please",
    "wait", "error", "success",
]
# Phones on cards, smart phones, and phones on profile pages.
CARD_PHONES = [
    r"(?:\+1[-. ]?)?\(?([0-9]{3})\)?[-. ]?([0-9]{3})[-. ]?([0-9]{4})", r"([0-9]{3})[-. ]([0-9]{3})[-. ]([0-9]{4})",
    r"\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
]
SMART_PHONES = [
    r"\+?[1-9]\d{0,2}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\d{3}[-.\s]\d{3}[-.\s]\d{4}",
]
PROFILE_PHONE = r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
LISTING_PHONE = r"[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[(]?[0-9]{1,3}[)]?[-\s\.][0-9]{3,6}[-\s\.][0-9]{3,6}"
SPELLED_MAIL = r"([a-zA-Z0-9._%+-]+)\s*[\[\(]?(?:at|AT|@)[\]\)]?\s*([a-zA-Z0-9.-]+)\s*[\[\(]?(?:dot|DOT|\.)[\]\)]?\s*([a-zA-Z]{2,})"
# Words of job titles, and signs of places.
JOB_WORDS = [
    "CEO", "CTO", "CFO", "COO", "CMO", "CIO", "CISO", "President", "Vice President", "VP", "Director", "Manager", "Lead",
    "Head", "Engineer", "Developer", "Designer", "Analyst", "Consultant", "Specialist", "Coordinator", "Associate",
    "Senior", "Junior", "Principal", "Partner", "Founder", "Owner", "Attorney", "Lawyer", "Counsel", "Doctor",
    "Professor", "Researcher",
]
PLACE_SIGNS = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "USA", "United States", "UK",
    "United Kingdom", "Canada", "Australia", "Germany", "France", "Japan", "China", "India",
]
# Attributes that hold the address of a profile, in order.
URL_ATTRIBUTES = ["data-url", "data-href", "data-link", "data-profile-url", "data-profile", "data-bio-url"]
# Words of a title that stands below a profile's heading.
HEADING_TITLES = ["partner", "associate", "counsel", "chair", "director"]
# Parts of a link's address and text that its score goes by.
LINK_PATHS = ["/profile", "/lawyer", "/attorney", "/people/", "/bio", "/team/", "/staff/", "/about/"]
LINK_WORDS = ["profile", "view", "bio", "more", "details"]
NAVIGATION_WORDS = ["menu", "navigation", "home"]
SOCIAL_SITES = ["linkedin.com", "twitter.com", "facebook.com"]
# Parts of addresses of profiles to visit, and link texts that name nobody.
VISITED_PATHS = [
    "/agents/", "/profile/", "/realtor/", "/team/", "/broker/", "/member/", "/lawyer/", "/Lawyers/", "/attorney/", "/people/",
    "/professionals/", "/attorneys/", "/our-team/", "/staff/",
]
GENERIC_LINKS = ["view", "profile", "more", "details"]
# Selectors of page controls, and of hints of endless lists.
PAGE_NAVIGATION = 'nav[aria-label*="pagination" i], nav[role="navigation"], .pagination, [class*="paginat"], [class*="Paginat"]'
NEXT_PAGE = """a[rel="next"]:not(.disabled):not([aria-disabled="true"]), a[aria-label*="next" i]:not([aria-disabled="true"]), button[aria-label*="next" i]:not([disabled]),
 a[class*="next"]:not(.disabled), button[class*="next"]:not(.disabled), a[class*="Next"]:not(.disabled), button[class*="Next"]:not(.disabled)"""
PREVIOUS_PAGE = """a[rel="prev"]:not(.disabled), a[aria-label*="prev" i]:not([aria-disabled="true"]), a[aria-label*="previous" i]:not([aria-disabled="true"]),
 button[aria-label*="prev" i]:not([disabled]), a[class*="prev"]:not(.disabled), button[class*="prev"]:not(.disabled)"""
PAGE_LINKS = 'a[aria-label*="page" i], .page-link, [class*="page-number"], [data-page], button[data-page], a.page, [class*="PageNumber"]'
CURRENT_PAGE = [".active[data-page]", '[aria-current="page"]', ".current", '[class*="active"][data-page]', ".selected[data-page]"]
LAZY = '[data-lazy], [loading="lazy"], .lazy-load, .lazy, [data-src], .lazyload'
LOAD_ZONES = "[data-load-more], .load-more-zone, #load-more-trigger, .infinite-scroll-trigger, [data-infinite], .loading-trigger"
LOAD_BUTTONS = 'button[class*="load-more"], button[class*="loadmore"], a[class*="load-more"], .show-more, #show-more, [data-action="load-more"]'
# Links that count as contacts of a page, in order.
CONTACT_LINKS = [
    'a[href*="/profile"]', 'a[href*="/people/"]', 'a[href*="/attorney"]', 'a[href*="/lawyer"]', 'a[href*="/team/"]', 'a[href*="/staff/"]',
    'a[href*="/agents/"]', 'a[href*="/professionals/"]', 'a[href*="/bio/"]',
]
