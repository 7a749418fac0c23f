"""Fixed rule tables: vocabularies, patterns and constants.

Every table here is data. Operators take them as default arguments, so a caller can pass
another vocabulary of the same shape.
"""

# ---------------------------------------------------------------------------
# Sheet structure
# ---------------------------------------------------------------------------

# A row is a table header when at least two of these are hit; each counts once.
HEADER_PATTERNS = [
    r"(?i)description|desc",
    r"(?i)qty|quantity",
    r"(?i)unit",
    r"(?i)rate|price",
    r"(?i)amount|total",
    r"(?i)image|photo",
    r"(?i)sn|s\.n|no\.|item",
]
SUMMARY_CELL = r"(?i)^total\s*(amount)?$"

# Column roles: role -> patterns tried in order; the first column hit wins.
OFFER_ROLES = {
    "description": [r"(?i)description|desc"],
    "qty": [r"(?i)^(?!.*(rate|price|amount)).*(qty|quantity)", r"(?i)qty|quantity"],
    "unit": [r"(?i)unit|uom"],
    "rate": [r"(?i)rate|price"],
    "amount": [r"(?i)^(?!.*(qty|quantity)).*(total|amount)", r"(?i)amount|total"],
}
VALUE_ENGINEERING_ROLES = {
    **OFFER_ROLES,
    "description": [r"(?i)description|desc|disc|item|product"],
}
VIEWER_ROLES = {
    "rate": [r"(?i)rate|price|unit.*price|unit.*rate"],
    "amount": [r"(?i)amount|total(?!.*(qty|quantity))"],
    "qty": [r"(?i)qty|quantity|qt"],
    "unit": [r"(?i)unit|uom"],
    "description": [r"(?i)description|desc|disc|item|product"],
    "image": [r"(?i)image|photo|picture|img|pic|ref"],
}
REGISTER_ROLES = {
    "description": [r"(?i)description|desc|disc|item|product"],
    "brand": [r"(?i)brand|maker|origin"],
    "qty": [r"(?i)revised.*qty|revised.*quantity|actual.*qty|actual.*quantity", r"(?i)qty|quantity|qt"],
    "unit": [r"(?i)uom|unit"],
    "sn": [r"(?i)s\.?n|no\.|#|sr|item|sl"],
    "code": [r"(?i)code|item.*code|ref"],
}
APPROVAL_ROLES = {
    "description": [r"(?i)description|desc"],
    "brand": [r"(?i)brand|maker|origin"],
    "qty": [r"(?i)qty|quantity"],
}
DELIVERY_ROLES = {
    "description": [r"(?i)description|desc|disc|item|product"],
    "qty": [r"(?i)qty|quantity|qt"],
    "unit": [r"(?i)unit|uom"],
    "brand": [r"(?i)brand|maker|origin"],
}
MONEY_COLUMN = r"(?i)rate|price|amount|total(?!.*(qty|quantity))"
QTY_COLUMN = r"(?i)qty|quantity"

# Section-header words: a row with no data that equals one of these, or starts with one and
# a space, is a heading.
SECTION_WORDS = [
    "item", "description", "desc", "quantity", "qty", "unit", "uom",
    "rate", "price", "total", "amount", "s.n.", "sn", "sr.no", "sr no", "id",
    "ref", "area", "specification", "specifications", "remarks", "location",
    "description and area", "description & area", "room", "floor", "block", "zone",
    "subtotal", "total amount", "grand total", "net total", "discount",
]
SECTION_WORDS_SHORT = [
    "item", "description", "desc", "quantity", "qty", "unit", "uom",
    "rate", "price", "total", "amount", "s.n.", "sn", "sr.no", "id",
    "ref", "area", "specification", "remarks", "location",
    "subtotal", "total amount", "grand total", "net total",
]
SECTION_EXACT = r"^(location|area|floor|block|zone|room|item\s*no|s\.no|ref)$"
SECTION_LIST_OF = r"^(group|type|section|category|list)\s+of\s"

# Header words inside an extracted description.
EXTRACTED_HEADER_WORDS = ["sl.no", "description", "qty", "unit", "rate", "total", "amount", "price"]

# Page header words.
PAGE_HEADER_WORDS = [
    "sl.no", "s.n", "sr.no", "no.", "item", "description",
    "image", "qty", "unit", "total", "rate", "price",
]
PAGE_LINE_WORDS = ["sl.no", "description", "qty", "item", "unit", "total"]
PAGE_ITEM_WORDS = ["s.n", "sl.no", "item", "description", "qty", "total"]

NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}

TIERS = ["budgetary", "mid", "high"]

# Plan labels and the items estimated from element counts.
ROOM_WORDS = ["OFFICE", "ROOM", "AREA", "LOUNGE", "KITCHEN", "BATHROOM"]
PLAN_FURNITURE_WORDS = ["CHAIR", "TABLE", "DESK", "SOFA", "BED", "CABINET"]
PLAN_DIMENSION = r"(?i)^\d+(\.\d+)?\s*(m|mm|cm|ft|in|'|\")"
# element type, location, scope, code, description, divisor, floor of the quantity
BASELINE_ITEMS = [
    ("room", "Office Areas", "Furniture", "FRN-001", "Executive Desk with Return", 2, 1),
    ("room", "Office Areas", "Furniture", "FRN-002", "Ergonomic Office Chair", 1, 2),
    ("door", "General", "Fitout", "FIT-001", "Interior Door with Frame", 1, 0),
    ("window", "General", "Fitout", "FIT-002", "Aluminum Window with Glazing", 1, 0),
]

# ---------------------------------------------------------------------------
# Catalog vocabulary (main category, sub category, pattern); order is priority
# ---------------------------------------------------------------------------
TAXONOMY = [
    ("Office Seating", "Stools", r"stool|bar stool|counter stool|drafting stool|high stool|bar-stool"),
    ("Office Seating", "Lounge Chairs", r"lounge chair|armchair|soft seating|easy chair|club chair|relax chair"),
    ("Office Seating", "Executive Chairs", r"executive chair|high back|high-back|\bh\/b\b|head of chair|ceo|director|chairman|president|presidential|boss chair"),
    ("Office Seating", "Conference Chairs", r"conference chair|meeting chair|visitor chair|meeting room chair|meeting room seating|meeting table chair|boardroom chair|general meeting chair|reading hall chair|hall chair|auditorium|multipurpose chair"),
    ("Office Seating", "Staff Chairs", r"staff chair|task chair|mesh chair|operator|operative|work chair|low back|low-back|steno|assistant chair"),
    ("Office Seating", "Supervisor Chairs", r"supervisor chair|manager chair|ergonomic chair|medium back|medium-back|mid back|mid-back|technical chair|specialist chair|lobby chair|waiting chair|guest chair|side chair"),
    ("Office Seating", "Training Chairs", r"training chair|stackable chair|folding chair|seminar chair"),
    ("Office Seating", "Plastic Chair", r"plastic chair|polypropylene|shell chair"),
    ("Office Seating", "Specialist Chairs", r"theatre artist chair|artist chair|drafting chair"),
    ("Office Seating", "Sofas", r"sofa|couch|modular sofa|ottoman|pouf|waiting bench|lounge bench"),
    ("Desk & Table", "Coffee Tables", r"coffee table|side table|low table|breakout table|center table|sky lounge table|occasional table"),
    ("Desk & Table", "Lounge Tables", r"lounge table|informal meeting table|soft seating table"),
    ("Desk & Table", "Conference Tables", r"conference table|meeting table|boardroom table|discussion table|collaborative table|project table"),
    ("Desk & Table", "Desk System", r"desk system|modular desk|workstation system|bench system|staff workstation|bench type|workstation"),
    ("Desk & Table", "Reception Desks", r"reception desk|\bcounter\b(?! stool)|front desk"),
    ("Desk & Table", "Manager Tables", r"manager table|executive table|senior desk|head of desk"),
    ("Desk & Table", "Height Adjustable Desks", r"height adjustable|sit.stand|sit-to-stand|electric desk|motorized"),
    ("Desk & Table", "Single Desks", r"single desk|freestanding desk|individual desk|executive desk|manager desk|secretary desk"),
    ("Desk & Table", "Benching", r"benching|cluster"),
    ("Desk & Table", "Training Desk", r"training desk|classroom desk|educational desk|folding table"),
    ("Desk & Table", "Computer Desks", r"computer desk|pc desk"),
    ("Office Cubicle", "Call Center Workstation", r"call center|telemarketing"),
    ("Office Cubicle", "Modular Cubicle", r"modular cubicle|partitioned workstation"),
    ("Office Cubicle", "Private Cubicle", r"private cubicle|enclosed workstation"),
    ("Office Cubicle", "Desk Screen", r"desk screen|privacy screen|table divider"),
    ("Partition Wall", "full height partition wall", r"full height|glass partition|demountable"),
    ("Partition Wall", "movable partition", r"movable partition|operable wall|folding partition"),
    ("Partition Wall", "Space Division", r"space division|room divider"),
    ("Partition Wall", "wall cladding", r"wall cladding|wall paneling"),
    ("Acoustic Solutions", "Office Pods", r"\bpod\b|acoustic pod|phone booth|meeting booth|acoustic phone booth"),
    ("Acoustic Solutions", "Acoustic Panels", r"acoustic panel|wall dampening|sound absorbing"),
    ("Storage", "pedestals", r"pedestal|mobile drawer"),
    ("Storage", "cabinets", r"cabinet|cupboard|swing door|storage unit"),
    ("Storage", "lateral files", r"lateral file|filing cabinet"),
    ("Storage", "credenzas", r"credenza|sideboard|low storage"),
    ("Storage", "bookcase", r"bookcase|bookshelf"),
    ("Storage", "wardrobes", r"wardrobe|locker|personal storage"),
    ("Accessories", "power data socked", r"power socket|data socket|electrical|power data"),
    ("Accessories", "wires managerment", r"wire management|cable tray|cable spine|cable manager"),
    ("Accessories", "workstation trays", r"tray|monitor arm|keyboard tray"),
    ("Accessories", "writing boards", r"writing board|whiteboard|magnetic board"),
    ("Accessories", "Aluminum Profile", r"aluminum profile|extrusion"),
    ("Materials/Fabrics", "Fabrics", r"fabric|textile|upholstery|leather|mesh|wool|polyester|narbutas era|berta|synergy|step melange"),
    ("Ceiling", "Suspended Ceiling", r"suspended|grid|mineral fiber|acoustic tile"),
    ("Ceiling", "Gypsum Ceiling", r"gypsum ceiling|plasterboard|plain ceiling"),
    ("Ceiling", "Open Cell", r"open cell|baffle"),
    ("Flooring", "Carpet Tiles", r"carpet tile|floor carpet|carpeting|\bcarpet\b"),
    ("Flooring", "Broadloom", r"broadloom|roll carpet|wall-to-wall carpet"),
    ("Flooring", "Luxury Vinyl Tiles", r"lvt|vinyl tile|vinyl floor|spc flooring"),
    ("Flooring", "Raised Floor", r"raised floor|access floor|computer floor"),
    ("Flooring", "Ceramic/Porcelain", r"tile|ceramic|porcelain|wet work"),
    ("Flooring", "Parquet", r"parquet|wood flooring|timber floor|laminate flooring"),
    ("Wall Finishes", "Paint", r"paint|emulsion"),
    ("Wall Finishes", "Wall Cladding", r"wall cladding|wall paneling"),
    ("Wall Finishes", "Wallpaper", r"wallpaper|wall covering"),
    ("Joinery", "Custom Cabinet", r"cabinet|wardrobe|storage"),
    ("Joinery", "Wall Panelling", r"wall panel|cladding"),
    ("Joinery", "Counter", r"reception counter|pantry counter"),
    ("Lighting", "General Lighting", r"led panel|recessed light"),
    ("Lighting", "Decorative Lighting", r"pendant|chandelier|wall lamp"),
    ("Lighting", "Emergency Lighting", r"emergency|exit sign"),
    ("MEP", "HVAC", r"ac|air conditioning|duct|diffuser"),
    ("MEP", "Fire Fighting", r"sprinkler|fire alarm"),
    ("MEP", "Electrical", r"db|distribution board|wiring"),
    ("MEP", "Plumbing", r"plumbing|drainage|water"),
    ("General Requirements", "Site Setup", r"site setup|office setup|storage"),
    ("General Requirements", "Utilities", r"utility|utilities|water|electricity"),
    ("General Requirements", "Health & Safety", r"hse|safety|ppe"),
    ("General Requirements", "Logistics", r"logistics|housekeeping|disposal"),
    ("General Requirements", "Final Works", r"cleaning|handover"),
    ("General Requirements", "Insurance", r"insurance|all-risk"),
    ("Flooring & Wet Works", "Stone Flooring", r"stone|marble|granite|screed"),
    ("Flooring & Wet Works", "Carpet Tiles", r"carpet tile|floor carpet|carpeting|\bcarpet\b"),
    ("Flooring & Wet Works", "Preparation", r"self leveling|screed|leveling"),
    ("Flooring & Wet Works", "Finishing", r"trim|skirting|transition"),
    ("Flooring & Wet Works", "Wet Works", r"tiling|ceramic|porcelain|cement"),
    ("Partitions & Wall Cladding", "Glass Partitions", r"glass partition|toughened glass"),
    ("Partitions & Wall Cladding", "Wood Cladding", r"wood cladding|veneer|fluted"),
    ("Partitions & Wall Cladding", "Metal Cladding", r"metal cladding|stainless steel"),
    ("Partitions & Wall Cladding", "Acoustic Partitions", r"acoustic partition"),
    ("Partitions & Wall Cladding", "Specialized Glass", r"frosted glass|decorative glass"),
    ("Partitions & Wall Cladding", "Masonry & Gypsum", r"drywall|masonry|gypsum"),
    ("Partitions & Wall Cladding", "Temporary Works", r"temporary partition"),
    ("Ceiling Works", "Acoustic Ceiling", r"acoustic panel|fabric ceiling"),
    ("Ceiling Works", "Wood Ceilings", r"wood slat|suspended wood"),
    ("Ceiling Works", "Painting", r"paint|emulsion"),
    ("Doors & Windows", "Window Treatments", r"curtain|blind"),
    ("Doors & Windows", "Specialized Doors", r"sliding door|glass door"),
    ("Doors & Windows", "Standard Doors", r"swing door|wooden door"),
    ("Finishes (Painting & Decoration)", "Painting", r"paint|matte finish"),
    ("Finishes (Painting & Decoration)", "Wallpaper", r"wallpaper"),
    ("Finishes (Painting & Decoration)", "Skirting", r"skirting"),
    ("Finishes (Painting & Decoration)", "Mirrors", r"mirror"),
    ("Finishes (Painting & Decoration)", "Artwork", r"art work|artwork"),
    ("Pantry & Cabinetry", "Custom Cabinets", r"cabinet|pantry"),
    ("Pantry & Cabinetry", "Furniture", r"coffee table|fixed table"),
    ("Pantry & Cabinetry", "Specialized Units", r"whiteboard|artificial plant"),
    ("Electrical & Mechanical (MEP)", "Lighting", r"led|strip light|light"),
    ("Electrical & Mechanical (MEP)", "Plumbing", r"ablution|faucet|sink"),
    ("Electrical & Mechanical (MEP)", "Sanitary", r"stone ledge|counter top"),
    ("Furniture", "Conference Tables", r"conference table"),
    ("Furniture", "Conference Chairs", r"meeting chair|conference chair"),
    ("Furniture", "Office Desks", r"desk|workstation"),
    ("Furniture", "Office Chairs", r"task chair|executive chair"),
    ("Furniture", "Sofa", r"sofa|lounge"),
    ("Furniture", "Coffee Table", r"coffee table"),
]

# Seniority, highest first.
RANKS = [
    (4, r"ceo|chairman|president|luxury|high-end executive|presidential|boardroom|boss"),
    (3, r"manager|director|executive|headrest|high-back|\bh\/b\b|senior|head of department|head of chair|head of desk"),
    (2, r"supervisor|head of|ergonomic|mid-back|medium-back|mid back|lobby|guest"),
    (1, r"staff|employee|operator|task chair|mesh|benching|workstation|staff desk|operative|assistant|staff chair"),
]

# Feature tags (group, tag, pattern).
FEATURES = [
    ("Materials", "leather", r"leather|genuine leather|nappa|top grain|hide"),
    ("Materials", "mesh", r"mesh|breathable"),
    ("Materials", "fabric", r"fabric|upholstered|textile|wool"),
    ("Materials", "veneer", r"veneer|wood finish|natural wood"),
    ("Materials", "melamine", r"melamine|mfc|laminate"),
    ("Materials", "glass", r"glass|tempered"),
    ("Materials", "aluminum", r"aluminum|aluminium"),
    ("Materials", "chrome", r"chrome|polished metal"),
    ("Adjustability", "height_adj", r"height adjustable|seat height|gas lift|adjustable height|gas height"),
    ("Adjustability", "tilt", r"tilt|recline|synchro|tension|mechanism"),
    ("Adjustability", "swivel", r"swivel|360 degree"),
    ("Adjustability", "lumbar", r"lumbar support"),
    ("Adjustability", "headrest", r"headrest"),
    ("Adjustability", "armrests", r"armrest|adjustable arm|4d arm"),
    ("Base", "5_star", r"5-star base|star-base|casters|wheels|star base"),
    ("Base", "sled", r"sled base|cantilever|meeting base"),
    ("Base", "4_leg", r"4-leg|four leg|wooden leg|4 star base|4 legs"),
    ("Base", "pedestal", r"pedestal base|trumpet base"),
    ("Mechanism", "flip_top", r"flip-top|folding top"),
    ("Mechanism", "stackable", r"stackable|nesting"),
    ("Mechanism", "wire_managed", r"wire management|cable port|cable management"),
]

# Size text.
SIZE_PATTERN = r"(?i)(\d{2,4})\s*[x*]\s*(\d{2,4})"
ROUND_PATTERN = r"(?i)(?:r|dia|round|circle)[:\s]*(\d{2,4})"

# Products that are not products.
ERROR_PAGE = r"502 bad gateway|404 not found|service unavailable|internal server error|cloudflare"
MATERIAL_SAMPLE = (
    r"material|fabric|upholstery|textile|leather|veneer sample|finish sample|color sample|swatch"
    r"|narbutas era|berta|synergy|step melange"
)

# Keyword-count classification: category -> (keywords, sub category -> keywords).
KEYWORD_CATEGORIES = {
    "Office Seating": (
        ["chair", "seating", "stool", "saddle", "seat", "operative", "task chair", "executive chair", "office chair", "mesh chair", "ergonomic"],
        {
            "Task Chair": ["task", "operative", "mesh", "ergonomic", "work chair", "office chair"],
            "Executive Chair": ["executive", "manager", "director", "high back", "leather chair"],
            "Visitor Chair": ["visitor", "guest", "side chair", "meeting chair", "conference chair"],
            "Stool": ["stool", "bar stool", "counter stool", "saddle"],
        },
    ),
    "Lounge & Reception": (
        ["sofa", "lounge", "armchair", "pouf", "ottoman", "bench", "couch", "reception chair", "waiting"],
        {
            "Sofa": ["sofa", "couch", "2-seater", "3-seater", "two seat", "three seat"],
            "Lounge Chair": ["lounge chair", "armchair", "easy chair", "relax"],
            "Pouf & Ottoman": ["pouf", "ottoman", "footrest"],
            "Bench": ["bench", "waiting bench"],
        },
    ),
    "Desk & Table": (
        ["desk", "table", "workstation", "worktop", "work surface", "benching"],
        {
            "Height-Adjustable Desk": ["height adjustable", "sit-stand", "standing desk", "electric desk"],
            "Fixed Desk": ["fixed desk", "executive desk", "manager desk", "single desk", "l-shape"],
            "Meeting Table": ["meeting table", "conference table", "boardroom", "round table", "seminar"],
            "Workstation System": ["workstation", "bench system", "benching", "cluster", "nova", "open plan"],
        },
    ),
    "Storage": (
        ["cabinet", "storage", "drawer", "pedestal", "locker", "filing", "cupboard", "sideboard", "shelving", "bookcase"],
        {
            "Pedestal": ["pedestal", "mobile pedestal", "under-desk"],
            "Filing Cabinet": ["filing", "file cabinet", "lateral cabinet"],
            "Locker": ["locker", "personal locker"],
            "Shelving": ["shelving", "bookcase", "shelf", "open storage"],
        },
    ),
    "Acoustic Solutions": (
        ["pod", "booth", "acoustic", "privacy", "phone booth", "meeting pod", "focus pod"],
        {
            "Phone Booth": ["phone booth", "solo pod", "1 person"],
            "Meeting Pod": ["meeting pod", "group pod", "collaboration pod"],
        },
    ),
    "Partitions & Screens": (
        ["partition", "screen", "panel", "divider", "privacy screen"],
        {
            "Desk Screen": ["desk screen", "desktop screen", "desk divider"],
            "Floor Screen": ["floor screen", "floor partition", "room divider"],
        },
    ),
}
TIER_RANK = {
    "budgetary": 1, "economy": 1, "entry": 1,
    "mid": 2, "standard": 2, "mid-range": 2,
    "premium": 3, "high": 3, "high-end": 3, "luxury": 3,
}

# Value-engineering buckets in order: bucket, label, default brand, keywords.
BUCKETS = [
    ("desking", "DESKING", "NARBUTAS", ["desk", "workstation", "meeting table", "conference table", "table", "bench", "height adjustable", "sit stand"]),
    ("seating", "SEATING", "SEDUS", ["chair", "task chair", "executive chair", "operational chair", "directional chair", "office seating", "stool"]),
    ("softSeating", "SOFT SEATING", "B&T DESIGN", ["sofa", "lounge", "soft seating", "armchair", "public seating", "couch", "bench seating", "ottoman"]),
    ("accessories", "ACCESSORIES", "NARBUTAS", ["lighting", "acoustic", "pod", "electrification", "screen", "partition", "accessory", "cable", "monitor arm", "pedestal"]),
]

# Synonyms used by the model matcher, directional.
SYNONYMS = {
    "stool": ["chair", "seat", "barstool", "bench"],
    "chair": ["stool", "seat", "armchair", "sidechair"],
    "desk": ["table", "workstation", "bench"],
    "table": ["desk", "workstation", "bench"],
    "sofa": ["couch", "bench", "ottoman", "pouf"],
    "cabinet": ["cupboard", "storage", "wardrobe"],
}

# Words that tell fit-out materials apart, used by the rate-card matcher.
FITOUT_MATERIALS = [
    "carpet", "marble", "stone", "granite", "ceramic", "porcelain", "vinyl", "wood", "timber",
    "parquet", "laminate", "glass", "gypsum", "paint", "metal", "steel", "aluminum", "fabric",
    "veneer", "wallpaper", "mirror", "acoustic", "mineral", "screed", "cement", "skirting",
]

# Currency units per US dollar.
USD_RATES = {
    "USD": "1", "EUR": "0.92", "GBP": "0.79", "AED": "3.67", "SAR": "3.75", "QAR": "3.64",
    "OMR": "0.385", "KWD": "0.31", "BHD": "0.376", "INR": "83.5", "CNY": "7.24",
}

# ---------------------------------------------------------------------------
# Stored web pages
# ---------------------------------------------------------------------------
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|webp|svg)(\?|$)"
IMAGE_FILE = r"(?i)\.(jpg|jpeg|png|webp|gif|svg)$"
TRUSTED_IMAGE_DOMAINS = [
    "narbutas.com", "steelcase.com", "hermanmiller.com", "knoll.com", "vitra.com", "muuto.com", "haworth.com",
]
NOT_PRODUCT_IMAGE = [
    "logo", "icon", "placeholder", "avatar", "blank", "default", "loading", "spinner", "banner", "hero",
    "header", "footer", "social", "facebook", "twitter", "instagram", "linkedin", "youtube", "email",
    "phone", "contact", "arrow", "chevron", "close", "menu", "search", "cart", "checkout",
]
UI_IMAGE_WORDS = ["logo", "icon", "arrow", "chevron", "placeholder", "blank", "loading", "spinner", "social", "banner"]
CARD_UI_IMAGE_WORDS = ["logo", "icon", "placeholder", "blank", "banner", "hero", "social"]
BLOCK_UI_IMAGE_WORDS = ["logo", "icon", "arrow", "chevron", "dot", "placeholder"]
PRODUCT_URL_PARTS = [
    "/product/", "/products/", "/p/", "/item/", "/items/", "/furniture/",
    "/collection/", "/collections/", "/catalog/", "/shop/", "/categories/", "/category/",
]
PRODUCT_URL_PATTERNS = [r"(?i)/(p|product|item|furniture)[/-]\d+", r"(?i)/[a-z0-9-]+\.(html|php|aspx)$"]
NAV_CATEGORY_WORDS = [
    "product", "products", "collection", "collections", "catalog", "furniture", "seating", "chairs",
    "desks", "tables", "storage", "office", "meeting", "conference", "executive", "workstation",
    "sofa", "lounge", "partition", "cabinet", "accessori",
]
NAV_EXCLUDE = [
    "contact", "about", "blog", "news", "career", "login", "cart", "checkout", "account",
    "privacy", "terms", "cookie", "faq", "support", "help",
]
SITE_PRODUCT_WORDS = [
    "product", "item", "furniture", "chair", "desk", "table", "office", "collection", "catalog",
    "series", "seating", "workstation", "storage", "meeting",
]
SITE_CATEGORY_WORDS = ["category", "collection", "products", "furniture", "office", "catalogue", "series"]
SITE_EXCLUDE = [
    "contact", "about", "login", "cart", "privacy", "social", "news", "blog", "terms", "careers",
    "account", "faq", "help", "project", "history", "download", "press", "event", "exhibition",
    "case-study", "award", "designer", "sustainability", "video", "career", "partner", "showroom",
    "location", "search", "media", "document",
]
MENU_EXCLUDE = [
    "contact", "about", "login", "cart", "privacy", "social", "news", "blog", "terms", "careers",
    "account", "faq", "instagram", "facebook", "twitter", "youtube", "linkedin",
]
COLLECTION_URL_PARTS = ["/collection/", "/collections/", "/category/", "/product-group/"]
DETAIL_URL_PARTS = ["/p/", "/product/"]
GENERIC_CATEGORIES = ["homepage", "products", "general", "select category"]

# Product containers: (selector, tag, class token, class fragment, attribute).
CONTAINERS = [
    (".product", None, "product", None, None),
    ("li.product", "li", "product", None, None),
    (".product-item", None, "product-item", None, None),
    (".product-card", None, "product-card", None, None),
    (".product-box", None, "product-box", None, None),
    (".product-tile", None, "product-tile", None, None),
    ('[class*="product-item"]', None, None, "product-item", None),
    ('[class*="product-card"]', None, None, "product-card", None),
    ('[class*="ProductCard"]', None, None, "ProductCard", None),
    (".grid-item", None, "grid-item", None, None),
    (".catalog-item", None, "catalog-item", None, None),
    (".collection-item", None, "collection-item", None, None),
    (".shop-item", None, "shop-item", None, None),
    ('[class*="grid-item"]', None, None, "grid-item", None),
    ('[class*="catalog-item"]', None, None, "catalog-item", None),
    (".card", None, "card", None, None),
    (".item-card", None, "item-card", None, None),
    (".furniture-item", None, "furniture-item", None, None),
    (".article-item", None, "article-item", None, None),
    (".portfolio-item", None, "portfolio-item", None, None),
    (".gallery-item", None, "gallery-item", None, None),
    ("[data-product]", None, None, None, "data-product"),
    ("[data-item]", None, None, None, "data-item"),
    ("[data-product-id]", None, None, None, "data-product-id"),
    (".col-item", None, "col-item", None, None),
    (".masonry-item", None, "masonry-item", None, None),
    (".isotope-item", None, "isotope-item", None, None),
]
# Card titles in order of preference, same shape.
CARD_TITLES = [
    ("h2", "h2", None, None, None),
    ("h3", "h3", None, None, None),
    ("h4", "h4", None, None, None),
    (".product-title", None, "product-title", None, None),
    (".product-name", None, "product-name", None, None),
    (".item-title", None, "item-title", None, None),
    (".item-name", None, "item-name", None, None),
    ('[class*="product-title"]', None, None, "product-title", None),
    ('[class*="product-name"]', None, None, "product-name", None),
    ('[class*="ProductName"]', None, None, "ProductName", None),
    (".title", None, "title", None, None),
    (".name", None, "name", None, None),
    (".heading", None, "heading", None, None),
    ("a[title]", "a", None, None, "title"),
]
# Description elements in order of preference, same shape.
DESCRIPTIONS = [
    (".woocommerce-product-details__short-description", None, "woocommerce-product-details__short-description", None, None),
    (".product-short-description", None, "product-short-description", None, None),
    (".product-description", None, "product-description", None, None),
    (".product_description", None, "product_description", None, None),
    (".description", None, "description", None, None),
    ('[class*="description"]', None, None, "description", None),
    ('[itemprop="description"]', None, None, None, "itemprop=description"),
]
# Paragraph fallbacks: first paragraph inside a container (tag, class token, first child only).
DESCRIPTION_PARAGRAPHS = [
    (".content p:first-child", None, "content", True),
    (".entry-content p:first-child", None, "entry-content", True),
    (".product-info p", None, "product-info", False),
    (".product-detail p", None, "product-detail", False),
    (".text-content p", None, "text-content", False),
    ("article p:first-child", "article", None, True),
]

# Logo scores.
LOGO_SRC_SCORES = [
    ("logo", 10), ("brand", 5), ("footer", -50), ("social", -50),
    ("icon", -20), ("placeholder", -50), ("blank", -50),
]
LOGO_BRAND_IN_ALT = 20

# Lengths (least, most) of card titles, link labels, descriptions and meta descriptions; least length of block titles;
# pages with fewer cards than this are read block by block; extracted headers are shorter than this.
CARD_TITLE_LENGTH = (3, 199)
LABEL_LENGTH = (3, 49)
TEXT_LENGTH = (16, 799)
META_LENGTH = (16, 499)
BLOCK_TITLE_LEAST = 3
FEW_CARDS = 5
HEADER_TEXT_LENGTH = 80

# Models of a brand that an identification step is told.
CONTEXT_MODELS = 500

# Link caps per page.
LINK_CAPS = {"product": 50, "category": 20, "pagination": 5}

SESSION_GAP = "2 hours"
