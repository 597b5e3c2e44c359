"""Word lists, host lists, patterns and tables that results depend on."""

# Link texts and paths that lead to contact details, best first
CONTACT_HINTS = [
    "contact", "contatt", "kontakt", "contacto", "contato", "impressum", "dove-siamo", "dove siamo", "chi-siamo", "chi siamo",
    "quienes-somos", "nous-joindre", "contactez", "get-in-touch", "reach", "iletisim", "fale-conosco", "about", "info", "support",
    "connect",
]
GUESS_PATHS = [
    "/contatti", "/contact", "/contacts", "/contact-us", "/contattaci", "/kontakt", "/contacto", "/contactez-nous", "/chi-siamo",
    "/about",
]
SOCIAL_NETWORKS = {
    "facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "twitter",
    "x.com": "twitter", "youtube.com": "youtube", "tiktok.com": "tiktok", "wa.me": "whatsapp", "api.whatsapp.com": "whatsapp",
}
SKIP_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "wa.me", "linktr.ee",
    "business.site", "g.page", "goo.gl", "maps.google.com",
]
SOCIAL_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "tiktok.com", "youtube.com", "wa.me", "linktr.ee",
    "beacons.ai", "taplink.cc", "bio.site",
]
PLATFORM_HOSTS = [
    "booksy.com", "treatwell.it", "treatwell.com", "treatwell.co.uk", "treatwell.de", "treatwell.es", "treatwell.fr", "fresha.com",
    "planity.com", "paginegialle.it", "paginebianche.it", "tripadvisor.com", "tripadvisor.it", "tripadvisor.co.uk", "yelp.com",
    "thefork.com", "thefork.it", "booking.com", "calendly.com", "setmore.com", "doctolib.it", "doctolib.fr", "doctolib.de",
    "miodottore.it", "pagesjaunes.fr", "gelbeseiten.de", "yell.com", "goo.gl", "g.page", "maps.app.goo.gl", "wa.me", "linktr.ee",
]
GOOGLE_HOST = r"(^|\.)google\.[a-z]{2,3}(\.[a-z]{2})?$"

EMAIL = r"^[a-z0-9._%+\-]{1,64}@([a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?)*\.[a-z]{2,24})$"
EMAIL_FIND = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
FILE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico", "woff", "woff2", "ttf", "eot", "pdf", "mp4", "avif", "map"]
JUNK_DOMAINS = [
    "example.com", "example.org", "domain.com", "email.com", "yourdomain.com", "yoursite.com", "mysite.com", "sentry.io", "wixpress.com",
    "sentry-next.wixpress.com", "test.com", "company.com", "website.com", "godaddy.com", "latofonts.com",
]
JUNK_LOCAL = (
    r"^(no-?reply|do-?not-?reply|mailer-daemon|postmaster|abuse|webmaster|user|name|your-?email|youremail|email|test|admin@admin)$"
    r"|^(privacy|gdpr|dpo|press|stampa|legal|cookie|unsubscribe|security|copyright|datenschutz|rgpd|abuse)([._-].*)?$"
)
ROLE_LOCAL = [
    "info", "contact", "sales", "support", "hello", "office", "admin", "enquiries", "inquiries", "enquiry", "service", "booking",
    "reservations", "mail", "team",
]
#: Lists, as Spark and DuckDB build different patterns of them
AT_WORDS = ["at", "@", "chiocciola", "arroba", "ät"]
DOT_WORDS = ["dot", "punto", "ponto", "point"]
GLUED_TLD = r"(\.[a-z]{2,3})[A-Z][a-z]+$"
ESCAPED_AT = r"\\u0040|\\x40|&#0*64;|&#x0*40;|&commat;"
CERTIFIED_MAIL = r"(^|\.)(pec|legalmail|postecert|arubapec|cert)\.|(pec\.it|legalmail\.it|postecert\.it|arubapec\.it)\.$"
VAT = (
    r"(?:p\.?\s*iva|partita\s+iva|c\.?\s*f\.?|cod(?:ice)?\.?\s*fisc(?:ale)?\.?|\brea\b|cciaa|vat(?:\s*(?:no|number|id))?"
    r"|ust-?id(?:nr)?|siret|siren|nif|cif)\s*[:.\-]?\s*(?:[A-Z]{2}\s?)?[0-9][0-9 .\-/]{7,18}"
)

STATUS_OK = "Valid (domain accepts mail)"
STATUS_UNKNOWN = "Unverified (DNS check unavailable)"
MATCHES_SITE = ", matches website"
NOTE_UNDELIVERABLE = ("Found ", " but that address cannot receive mail")
NOTE_NO_WEBSITE = "No website - email not available"
NOTE_BY_STATE = {"ok": "Not found on website", "down": "Website not responding", "blocked": "Website blocks automated access"}
NOTE_OTHER = "Not checked"
EXPORT_COLUMNS = ["Name", "Phone", "Email", "Address", "Website Present", "Website"]

COUNTRY_ALIASES = {
    "uk": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "uae": "AE", "u.a.e.": "AE", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US", "turkey": "TR", "turkiye": "TR",
    "russia": "RU", "south korea": "KR", "korea": "KR", "north korea": "KP", "vietnam": "VN", "iran": "IR", "syria": "SY", "laos": "LA",
    "czech republic": "CZ", "czechia": "CZ", "ivory coast": "CI", "cote d'ivoire": "CI", "bolivia": "BO", "venezuela": "VE",
    "tanzania": "TZ", "moldova": "MD", "palestine": "PS", "taiwan": "TW", "hong kong": "HK", "macau": "MO", "kosovo": "XK",
    "brunei": "BN", "burma": "MM", "myanmar": "MM", "ksa": "SA", "saudi": "SA", "holland": "NL", "the netherlands": "NL",
    "swaziland": "SZ",
}

#: Keyword -> (key, value) tags
CATEGORY_TAGS = {
    "restaurant": [("amenity", "restaurant")],
    "cafe": [("amenity", "cafe")],
    "coffee shop": [("amenity", "cafe")],
    "fast food": [("amenity", "fast_food")],
    "bar": [("amenity", "bar")],
    "pub": [("amenity", "pub")],
    "bakery": [("shop", "bakery")],
    "hotel": [("tourism", "hotel")],
    "guest house": [("tourism", "guest_house")],
    "hostel": [("tourism", "hostel")],
    "motel": [("tourism", "motel")],
    "dentist": [("amenity", "dentist"), ("healthcare", "dentist")],
    "doctor": [("amenity", "doctors"), ("healthcare", "doctor")],
    "clinic": [("amenity", "clinic"), ("healthcare", "clinic")],
    "hospital": [("amenity", "hospital")],
    "pharmacy": [("amenity", "pharmacy")],
    "veterinary": [("amenity", "veterinary")],
    "optician": [("shop", "optician")],
    "gym": [("leisure", "fitness_centre")],
    "fitness": [("leisure", "fitness_centre")],
    "spa": [("leisure", "spa"), ("amenity", "spa")],
    "beauty salon": [("shop", "beauty")],
    "hairdresser": [("shop", "hairdresser")],
    "barber": [("shop", "hairdresser")],
    "school": [("amenity", "school")],
    "university": [("amenity", "university")],
    "college": [("amenity", "college")],
    "kindergarten": [("amenity", "kindergarten")],
    "language school": [("amenity", "language_school")],
    "driving school": [("amenity", "driving_school")],
    "bank": [("amenity", "bank")],
    "atm": [("amenity", "atm")],
    "insurance": [("office", "insurance")],
    "real estate": [("office", "estate_agent")],
    "estate agent": [("office", "estate_agent")],
    "lawyer": [("office", "lawyer")],
    "law firm": [("office", "lawyer")],
    "accountant": [("office", "accountant")],
    "architect": [("office", "architect")],
    "travel agency": [("shop", "travel_agency"), ("office", "travel_agent")],
    "it company": [("office", "it")],
    "software company": [("office", "it")],
    "company": [("office", "company")],
    "ngo": [("office", "ngo")],
    "supermarket": [("shop", "supermarket")],
    "grocery": [("shop", "convenience"), ("shop", "supermarket")],
    "clothing store": [("shop", "clothes")],
    "shoe store": [("shop", "shoes")],
    "jewelry": [("shop", "jewelry")],
    "furniture": [("shop", "furniture")],
    "electronics": [("shop", "electronics")],
    "mobile shop": [("shop", "mobile_phone")],
    "computer store": [("shop", "computer")],
    "hardware store": [("shop", "hardware"), ("shop", "doityourself")],
    "bookstore": [("shop", "books")],
    "florist": [("shop", "florist")],
    "car dealer": [("shop", "car")],
    "car repair": [("shop", "car_repair")],
    "car wash": [("amenity", "car_wash")],
    "car rental": [("amenity", "car_rental")],
    "fuel": [("amenity", "fuel")],
    "gas station": [("amenity", "fuel")],
    "bike shop": [("shop", "bicycle")],
    "photographer": [("craft", "photographer"), ("shop", "photo")],
    "printing": [("shop", "copyshop"), ("craft", "printer")],
    "laundry": [("shop", "laundry"), ("shop", "dry_cleaning")],
    "electrician": [("craft", "electrician")],
    "plumber": [("craft", "plumber")],
    "carpenter": [("craft", "carpenter")],
    "builder": [("craft", "builder")],
    "construction": [("office", "construction_company"), ("craft", "builder")],
    "wedding": [("shop", "wedding"), ("amenity", "events_venue")],
    "event venue": [("amenity", "events_venue")],
    "coworking": [("amenity", "coworking_space")],
    "cinema": [("amenity", "cinema")],
    "nightclub": [("amenity", "nightclub")],
    "pet shop": [("shop", "pet")],
    "supplier": [("shop", "wholesale")],
    "wholesale": [("shop", "wholesale")],
    "factory": [("man_made", "works"), ("industrial", "factory")],
    "warehouse": [("building", "warehouse")],
    "marketing agency": [("office", "advertising_agency")],
    "advertising agency": [("office", "advertising_agency")],
    "recruitment": [("office", "employment_agency")],
    "telecom": [("office", "telecommunication"), ("shop", "mobile_phone")],
}
CATEGORY_ALIASES = {
    "restaurants": "restaurant", "dentists": "dentist", "hotels": "hotel", "doctors": "doctor", "clinics": "clinic", "gyms": "gym",
    "schools": "school", "lawyers": "lawyer", "cafes": "cafe", "salon": "beauty salon", "salons": "beauty salon",
    "pharmacies": "pharmacy", "banks": "bank", "companies": "company", "real estate agent": "real estate", "realtor": "real estate",
    "software house": "software company", "it": "it company",
}
