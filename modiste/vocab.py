"""Word lists, lookup tables and thresholds that must equal the published behaviour for right results."""

# ── categories ────────────────────────────────────────────────────────────────
CATEGORIES = ["dress", "top", "bottom", "jacket", "shoes", "bag"]

CATEGORY_SLUGS = {
    "dresses": "dress", "tops": "top", "bottoms": "bottom", "outerwear": "jacket", "shoes": "shoes",
    "bags and accessories": "bag",
}

FEED_CATEGORY_WORDS = {
    "dress": ["dress", "jumpsuit", "romper", "playsuit", "gown", "bodycon", "shift", "sundress", "minidress", "maxi dress", "midi dress"],
    "top": ["top", "blouse", "shirt", "tee", "tank", "cami", "camisole", "bodysuit", "sweater", "knit", "cardigan", "pullover",
            "sweatshirt", "hoodie", "corset", "crop"],
    "bottom": ["trouser", "pant", "skirt", "short", "jean", "denim", "legging", "culotte", "jogger", "wide-leg", "palazzo", "cargo"],
    "jacket": ["jacket", "blazer", "coat", "trench", "vest", "gilet", "puffer", "anorak", "cape", "overcoat", "bomber", "leather jacket"],
    "shoes": ["shoe", "boot", "sandal", "heel", "flat", "loafer", "sneaker", "mule", "pump", "stiletto", "wedge", "ankle boot",
              "ballet flat", "slingback"],
    "bag": ["bag", "tote", "clutch", "handbag", "purse", "backpack", "crossbody", "satchel", "pouch", "wristlet", "shoulder bag", "mini bag"],
}

# jackets are tried before tops so that "cropped jacket" stays a jacket
JACKET_FIRST_CATEGORY_WORDS = {
    "jacket": ["jacket", "blazer", "coat", "trench", "vest", "gilet", "puffer", "anorak", "cape", "overcoat", "bomber"],
    "dress": ["dress", "jumpsuit", "romper", "playsuit", "gown", "bodycon", "shift", "sundress"],
    "bottom": ["trouser", "pant", "skirt", "short", "jean", "denim", "legging", "culotte", "jogger", "palazzo", "cargo"],
    "top": ["top", "blouse", "shirt", "tee", "tank", "cami", "camisole", "bodysuit", "sweater", "knit", "cardigan", "pullover",
            "sweatshirt", "hoodie", "corset", "crop"],
    "shoes": ["shoe", "boot", "sandal", "heel", "flat", "loafer", "sneaker", "mule", "pump", "stiletto", "wedge"],
    "bag": ["bag", "tote", "clutch", "handbag", "purse", "backpack", "crossbody", "satchel", "pouch", "wristlet"],
}

MARKETPLACE_CATEGORY_WORDS = {
    "dress": ["dress", "gown", "romper", "jumpsuit", "playsuit"],
    "top": ["top", "blouse", "shirt", "tee", "tank", "cami", "sweater", "cardigan", "hoodie", "sweatshirt", "bodysuit", "corset",
            "pullover", "turtleneck"],
    "bottom": ["skirt", "pant", "trouser", "jean", "denim", "short", "legging", "jogger", "cargo", "culotte"],
    "jacket": ["jacket", "blazer", "coat", "trench", "vest", "puffer", "anorak", "bomber", "cape", "overcoat"],
    "shoes": ["shoe", "boot", "sandal", "heel", "flat", "loafer", "sneaker", "mule", "pump", "stiletto", "wedge", "slingback", "slide"],
    "bag": ["bag", "tote", "clutch", "handbag", "purse", "backpack", "crossbody", "satchel", "pouch", "wristlet"],
    "accessories": ["necklace", "earring", "bracelet", "ring", "jewelry", "jewellery", "sunglasses", "belt", "scarf", "hat", "hair",
                    "watch", "accessory"],
}

# vendor breadcrumb words, tried in this order; a category may be tried twice
BREADCRUMB_WORDS = [
    ("dress", ["dress", "gown"]),
    ("bottom", ["skirt"]),
    ("bottom", ["pant", "jean", "trouser", "short"]),
    ("top", ["top", "blouse", "shirt", "sweater", "cardigan"]),
    ("jacket", ["jacket", "coat", "blazer", "outerwear"]),
    ("shoes", ["shoe", "boot", "sandal", "heel", "sneaker", "loafer"]),
    ("bag", ["bag", "handbag", "wallet", "clutch", "tote"]),
    ("accessories", ["jewelry", "necklace", "earring", "bracelet", "ring", "sunglasses", "accessory", "belt", "scarf", "hat"]),
]

# ── aesthetics ────────────────────────────────────────────────────────────────
FEED_AESTHETICS = {
    "minimalist": ["minimal", "simple", "clean", "basic", "classic", "timeless", "structured", "tailored"],
    "bohemian": ["boho", "floral", "wrap", "maxi", "flowy", "linen", "crochet", "embroidered", "tiered", "peasant"],
    "romantic": ["lace", "ruffle", "frill", "satin", "silk", "floral", "tiered", "feminine", "bow", "ribbon", "corset"],
    "edgy": ["leather", "asymmetric", "cutout", "mesh", "chain", "bold", "moto", "grunge", "fishnet"],
    "preppy": ["plaid", "striped", "button", "collar", "polo", "tailored", "blazer", "nautical", "gingham"],
    "casual": ["jersey", "cotton", "relaxed", "oversized", "everyday", "comfort", "knit", "t-shirt"],
    "elegant": ["satin", "silk", "velvet", "drape", "formal", "evening", "gown", "ballgown", "sequin"],
    "sporty": ["active", "sport", "tennis", "athletic", "stretch", "performance", "biker"],
    "cottagecore": ["floral", "ditsy", "prairie", "puff sleeve", "milkmaid", "embroidered", "gingham", "smocked"],
    "party": ["sequin", "glitter", "metallic", "mini", "bodycon", "cutout", "backless", "going out"],
    "y2k": ["low rise", "baby", "denim", "butterfly", "velour", "rhinestone", "micro", "crop"],
    "coastal": ["linen", "stripe", "nautical", "white", "blue", "breezy", "resort", "vacation", "sundress"],
}

MARKETPLACE_AESTHETICS = {
    "minimalist": ["minimal", "simple", "clean", "basic", "classic", "timeless", "structured"],
    "bohemian": ["boho", "floral", "wrap", "maxi", "flowy", "linen", "crochet", "embroidered", "tiered"],
    "romantic": ["lace", "ruffle", "satin", "silk", "feminine", "bow", "ribbon", "corset", "floral"],
    "edgy": ["leather", "asymmetric", "cutout", "mesh", "chain", "moto", "fishnet"],
    "preppy": ["plaid", "striped", "button", "collar", "polo", "blazer", "nautical", "gingham"],
    "casual": ["jersey", "cotton", "relaxed", "oversized", "everyday", "knit"],
    "elegant": ["satin", "silk", "velvet", "drape", "formal", "evening", "gown", "sequin"],
    "party": ["sequin", "glitter", "metallic", "mini", "bodycon", "backless", "going out"],
    "y2k": ["low rise", "velour", "rhinestone", "micro", "crop", "butterfly"],
    "vintage": ["vintage", "retro", "secondhand", "preloved", "thrifted", "90s", "80s", "70s"],
    "cottagecore": ["floral", "puff sleeve", "milkmaid", "smocked", "prairie"],
    "coastal": ["linen", "stripe", "nautical", "resort", "vacation", "sundress"],
}

TAG_COLORS = [
    "black", "white", "red", "blue", "green", "pink", "yellow", "orange", "purple", "brown", "beige", "cream", "navy", "burgundy",
    "olive", "sage", "terracotta", "coral", "mauve", "lilac", "rust", "camel", "chocolate", "ivory", "gold", "silver", "leopard",
    "floral", "print",
]

LENGTH_WORDS = ["mini", "midi", "maxi"]

# ── query classification ──────────────────────────────────────────────────────
GARMENTS = [
    "dress", "gown", "kaftan", "caftan", "jumpsuit", "romper", "bodysuit",
    "top", "shirt", "blouse", "tee", "tank", "cami", "camisole", "polo",
    "hoodie", "sweatshirt", "sweater", "cardigan", "jumper", "henley",
    "bralette", "bustier", "corset", "crop",
    "skirt", "pants", "trousers", "trouser", "jeans", "jean", "shorts",
    "leggings", "tights", "culottes", "chinos", "joggers", "sweatpants",
    "jacket", "coat", "blazer", "trench", "parka", "anorak", "windbreaker", "vest", "puffer", "bomber",
    "sneaker", "sneakers", "trainer", "trainers", "loafer", "loafers",
    "mule", "mules", "sandal", "sandals", "heel", "heels", "stiletto",
    "boot", "boots", "bootie", "booties", "clog", "moccasin", "oxford", "espadrille", "slingback",
    "bag", "tote", "clutch", "satchel", "backpack", "handbag", "purse", "crossbody", "shoulder", "messenger", "duffle",
    "bikini", "swimsuit", "tankini", "monokini",
]

QUERY_COLORS = [
    "black", "white", "cream", "ivory", "beige", "tan", "khaki", "olive",
    "navy", "blue", "denim", "indigo", "teal", "turquoise", "aqua",
    "red", "burgundy", "wine", "maroon", "crimson",
    "pink", "rose", "blush", "fuchsia", "magenta",
    "purple", "lavender", "lilac", "violet",
    "yellow", "mustard", "ochre", "amber",
    "orange", "coral", "peach", "rust",
    "green", "sage", "forest", "emerald", "mint",
    "brown", "chocolate", "caramel", "camel", "cognac",
    "grey", "gray", "silver", "charcoal",
    "gold", "metallic", "rose-gold",
]

# ── steer phrases ─────────────────────────────────────────────────────────────
STEER_COLORS = [
    "black", "white", "red", "blue", "green", "pink", "yellow", "orange", "purple", "brown",
    "beige", "cream", "navy", "burgundy", "olive", "sage", "terracotta", "coral", "mauve", "lilac",
    "rust", "camel", "chocolate", "ivory", "gold", "silver", "leopard", "fuchsia", "magenta",
    "grey", "gray", "tan", "nude", "khaki", "plum", "teal", "aqua", "turquoise", "salmon",
    "mustard", "taupe", "lavender", "charcoal", "indigo", "cobalt", "emerald", "wine", "maroon",
    "peach", "apricot", "mint", "forest", "lime", "cherry", "blush", "champagne", "bronze",
]

STEER_CATEGORY_WORDS = {
    "dress": ["dress", "dresses", "gown", "gowns"],
    "top": ["top", "tops", "shirt", "shirts", "blouse", "blouses", "tee", "tees", "tank", "tanks", "sweater", "sweaters", "knit",
            "knits", "cardigan", "hoodie", "hoodies", "sweatshirt"],
    "bottom": ["pants", "trousers", "pant", "trouser", "skirt", "skirts", "jeans", "jean", "denim", "short", "shorts"],
    "jacket": ["jacket", "jackets", "blazer", "blazers", "coat", "coats", "outerwear", "trench"],
    "shoes": ["shoe", "shoes", "boot", "boots", "heel", "heels", "sneaker", "sneakers", "loafer", "loafers", "sandal", "sandals"],
    "bag": ["bag", "bags", "tote", "totes", "purse", "purses", "clutch", "handbag", "backpack", "crossbody"],
}

STEER_STOPWORDS = [
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "from",
    "i", "you", "we", "they", "it", "this", "that", "these", "those",
    "more", "less", "very", "some", "any", "all", "kind", "sort", "thing", "things",
    "want", "like", "show", "me", "please", "really", "super",
]

STEER_ABSTRACT = [
    "edgy", "edgier", "soft", "softer", "hard", "harder",
    "romantic", "minimal", "minimalist", "minimalism", "clean", "structured",
    "relaxed", "oversized", "tight", "fitted", "loose",
    "flowy", "drapey", "crisp", "sharp", "polished", "casual", "formal",
    "dressy", "dressier", "fancier", "classier",
    "boho", "bohemian", "preppy", "grunge", "classic", "timeless",
    "feminine", "masculine", "androgynous", "tomboy",
    "quiet", "loud", "bold", "understated", "subtle", "striking",
    "sexy", "cute", "chic", "elegant", "refined", "cool", "trendy",
]

BUDGET_PHRASE = r"\b(cheap(?:er)?|cheapest|budget|affordable|inexpensive)\b"
LUXURY_PHRASE = r"\b(luxury|luxe|expensive|high[- ]?end|premium|designer(?:\s+only)?|splurge)\b"
MID_PHRASE = r"\b(mid[- ]?range|mid[- ]?tier|middle)\b"
UNDER_DOLLAR = r"\bunder\s*\$?(\d{2,5})\b"
OVER_DOLLAR = r"\bover\s*\$?(\d{2,5})\b"
NEGATION_PHRASE = (r"\b(?:no|not|without|skip|avoid|less|hate|don'?t\s+want|not\s+a\s+fan\s+of|ditch|nothing)"
                   r"\s+([a-z][a-z0-9\s\-]{1,30})")
NEGATION_STOP = r"[,.;!?]|\s(?:and|but|or|with|more|also)\s"
MORE_PHRASE = r"\b(?:more|lots?\s+of|show\s+me)\s+([a-z][a-z\-]{2,20})"
SHIFT_PHRASE = r"\b(more|less|way)\s+[a-z]+"

# ── gender, language, boards ──────────────────────────────────────────────────
MENS_WORDS = ["men", "mens", "man", "boys", "male", "unisex"]
MENS_PHRASE = r"\b(mens?|men's|boys?|boy's|for\s+him)\b"
MARKETPLACE_MENS_PHRASE = r"\b(mens?|men's|boys?|boy's)\b"

ENGLISH_WORDS = [
    "the", "and", "with", "for", "this", "from", "in", "of", "to", "on", "by", "that", "our", "your", "all", "is", "are", "was", "were",
    "cotton", "leather", "silk", "wool", "linen", "cashmere", "denim", "knit", "jersey", "fabric", "tweed", "satin", "velvet",
    "chiffon", "lace",
    "black", "white", "cream", "navy", "beige", "red", "blue", "green", "brown", "pink", "gold", "silver", "tan", "grey", "gray",
    "olive", "sage", "ivory",
    "dress", "shirt", "skirt", "pant", "pants", "trouser", "jean", "jacket", "coat", "blazer", "top", "blouse", "cardigan", "sweater",
    "hoodie", "tee", "tank", "cami", "bralette", "bra", "polo", "henley", "jumper", "gown", "romper", "jumpsuit", "bodysuit",
    "bikini", "swimsuit", "swim", "set", "suit", r"two[-\s]?piece", r"one[-\s]?piece", "cover",
    "bag", "tote", "clutch", "crossbody", "shoulder", "backpack", "wallet",
    "shoe", "boot", "sandal", "heel", "flat", "loafer", "sneaker", "mule", "pump",
    "mini", "midi", "maxi", "short", "long", "cropped", "oversized", "fitted",
    "bottom", "brief", "thong", "sleeve", "collar", "hem", "button", "fit", "cut", "wear", "made",
    "size", "color", "colour", "length", "style", "design", "new", "sale", "final",
]

BOARD_WORDS = [
    "fashion", "style", "stylist", "styling", "inspo", "inspiration",
    "wardrobe", "closet", "outfit", "ootd", "look", "looks", "lookbook",
    "clothes", "clothing", "wear", "streetwear",
    "dress", "dresses", "skirt", "jean", "denim",
    "shoe", "shoes", "bag", "bags", "purse",
    "accessor", "jewel",
    "vintage", "thrift", "preloved", "archive",
    "fit", "fits", "capsule", "aesthetic",
]

NON_CLOTHING_WORDS = [
    "recipe", "recipes", "cooking", "food", "meal", "breakfast", "lunch", "dinner",
    "cocktail", "drink", "coffee", "cake", "pastry", "dessert", "snack",
    "interior", "interiors", "decor", "home", "bedroom", "kitchen", "living room",
    "bathroom", "apartment", "house", "workspace", "office",
    "plants", "plant", "garden", "flower arrangement", "bouquet",
    "makeup", "make-up", "beauty", "skincare", "perfume",
    "hair", "haircut", "hairstyle", "braid",
    "nails", "manicure", "nail art",
    "wallpaper", "phone", "screensaver", "background",
    "car", "motorcycle", "travel", "landscape", "scenery", "sunset",
    "tattoo", "tattoos",
    "wedding venue", "wedding decor", "wedding cake",
]

SKIP_HANDLE_WORDS = ["balm", "corrector", "protector", "brush", "mist", "spray", "cream", "gift-card", "giftcard", "care-kit", "swatch", "sample"]

# ── title blockers ────────────────────────────────────────────────────────────
LANE_TITLE_BLOCKERS = {
    "tops": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "pant", "skirt", "dress", "jean", "trouser", "bag", "tote",
             "handbag", "clutch", "bikini", "swim", "swimsuit", "swimwear", "maillot", "bralette", "corset", "lingerie", "thong",
             "panty", "panties", "underwear"],
    "dresses": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "pant", "jean", "trouser", "bag", "tote", "handbag",
                "clutch", "jacket", "coat", "blazer", "bikini", "swim", "swimsuit", "swimwear", "lingerie", "bralette"],
    "bottoms": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "dress", "shirt", "blouse", "top", "tee", "tank",
                "jacket", "coat", "blazer", "bag", "tote", "handbag", "clutch", "bikini", "swim", "swimsuit", "swimwear", "thong",
                "panty", "panties", "underwear", "bralette"],
    "shoes": ["hoody", "hoodie", "sweater", "sweatshirt", "cardigan", "jumper", "shirt", "blouse", "tee", "tank", "dress", "gown",
              "pant", "skirt", "short", "jean", "trouser", "jacket", "coat", "blazer", "bag", "tote", "handbag", "clutch", "necklace",
              "bracelet", "ring", "earring", "belt"],
    "outerwear": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "dress", "gown", "skirt", "short", "jean", "trouser",
                  "bag", "tote", "handbag", "clutch", "bikini", "swim"],
    "bags and accessories": ["shoe", "boot", "sandal", "heel", "sneaker", "pant", "skirt", "dress", "shirt", "blouse", "jacket", "coat"],
}

FOCUS_TITLE_BLOCKERS = {
    "dress": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "pant", "jean", "trouser", "bag", "tote", "handbag",
              "clutch", "jacket", "coat", "blazer", "necklace", "bracelet", "ring", "earring"],
    "top": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "pant", "skirt", "dress", "jean", "trouser", "bag", "tote",
            "handbag", "clutch", "necklace", "bracelet", "ring", "earring"],
    "bottom": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "dress", "shirt", "blouse", "top", "tee", "tank",
               "jacket", "coat", "blazer", "bag", "tote", "handbag", "clutch", "necklace", "bracelet", "ring", "earring"],
    "jacket": ["shoe", "boot", "sandal", "heel", "sneaker", "loafer", "pump", "dress", "gown", "skirt", "short", "jean", "trouser",
               "bag", "tote", "handbag", "clutch", "necklace", "bracelet", "ring", "earring"],
    "shoes": ["hoody", "hoodie", "sweater", "sweatshirt", "cardigan", "jumper", "shirt", "blouse", "tee", "tank", "dress", "gown",
              "pant", "skirt", "short", "jean", "trouser", "jacket", "coat", "blazer", "bag", "tote", "handbag", "clutch", "necklace",
              "bracelet", "ring", "earring", "belt", "hat", "cap", "scarf"],
    "bag": ["shoe", "boot", "sandal", "heel", "sneaker", "pant", "skirt", "dress", "shirt", "blouse", "jacket", "coat", "necklace",
            "bracelet", "ring", "earring"],
}

KNIT_TITLE_WORDS = ["knit", "sweater", "cardigan", "cashmere", "wool", "cable", "jumper", "pullover", "turtleneck"]

INDEX_TITLE_ALLOW = {
    "shoes": ["heel", "boot", "sandal", "sneaker", "loafer", "pump", "mule", "shoe", "slipper", "espadrille", "oxford", "moccasin",
              "derby", "clog", "slide"],
    "dress": ["dress", "gown", "slip", "midi", "maxi", "sundress"],
    "top": ["top", "shirt", "blouse", "tee", "tank", "cami", "bodice", "halter", "bustier"],
    "bottom": ["pant", "skirt", "jean", "trouser", "legging", "short", "culotte"],
    "jacket": ["jacket", "coat", "blazer", "trench", "parka", "puffer", "peacoat", "bomber", "cape"],
    "bag": ["bag", "tote", "clutch", "purse", "handbag", "backpack", "satchel", "crossbody"],
    "knits": ["knit", "sweater", "cardigan", "cashmere", "wool", "jumper", "pullover", "turtleneck"],
}
INDEX_TITLE_BLOCK = {"dress": ["haute", "couture", "archive"]}

# ── retailers, domains, entities ──────────────────────────────────────────────
RETAILER_NAMES = {
    "nordstrom.com": "Nordstrom", "revolve.com": "Revolve", "asos.com": "ASOS", "anthropologie.com": "Anthropologie",
    "urbanoutfitters.com": "Urban Outfitters", "freepeople.com": "Free People", "hm.com": "H&M", "zara.com": "Zara",
    "shein.com": "SHEIN", "poshmark.com": "Poshmark", "depop.com": "Depop", "thredup.com": "ThredUp", "shopbop.com": "Shopbop",
    "farfetch.com": "Farfetch", "net-a-porter.com": "Net-a-Porter", "ssense.com": "SSENSE", "bloomingdales.com": "Bloomingdale's",
    "saksfifthavenue.com": "Saks Fifth Avenue", "intermixonline.com": "INTERMIX", "nastygal.com": "Nasty Gal",
    "prettylittlething.com": "PLT", "boohoo.com": "Boohoo", "reformation.com": "Reformation", "mango.com": "Mango",
    "uniqlo.com": "Uniqlo", "cos.com": "COS", "arket.com": "ARKET", "& otherstories.com": "& Other Stories",
    "abercrombie.com": "Abercrombie", "gap.com": "Gap", "jcrew.com": "J.Crew", "birdsnest.com.au": "Birdsnest",
    "amazon.com": "Amazon Fashion",
}

PROBE_TLDS = [".com", ".co", ".shop", ".co.uk", ".com.au", ".store", ".net", ".nyc"]

NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014",
    "hellip": "\u2026", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "copy": "\u00a9",
    "reg": "\u00ae", "trade": "\u2122",
}

BRAND_RATES = {  # brand -> US dollars per unit of the listed currency
    "Dhruv Kapoor": 0.012, "Momotaro Jeans": 0.0066, "Marmar Halim": 0.272, "Lisa Yang": 0.093, "Dima Ayad": 0.272,
    "Clio Peppiatt": 1.27, "Hissa Line": 0.275,
}

AXES = ["formality", "minimalism", "edge", "romance", "drape"]

URL_SKIP = r"(?i)/(collections|category|categories|pages|blogs?|about|contact|search|account|cart|policies)/"
URL_KEEP = r"(?i)/(product|products|shop|style|item)/"

# ── image quality thresholds ──────────────────────────────────────────────────
BLUR_THRESHOLD, ENTROPY_THRESHOLD, MIN_DIM, MAX_RATIO = 18, 2.8, 200, 3.5

# ── audit rules: (name, pattern, pattern that excuses, wrong categories, target or None for deletion), first hit wins ──
AUDIT_RULES = [
    ("beauty_in_apparel",
     r"\b(eyeshadow|eye shadow|mascara|concealer|highlighter palette|bronzer palette|setting spray|setting powder|nail polish|nail lacquer|eau de parfum|eau de toilette|sheet mask)\b",
     None, ["top", "dress", "bottom", "jacket", "shoes", "bag"], None),
    ("lifestyle_in_apparel",
     r"\b(candle|diffuser|throw pillow|coaster|tumbler|water bottle|bath salts|body scrub|body wash|hand cream|lip balm|sheet mask|incense holder|incense burner|incense stick)\b",
     None, ["top", "dress", "bottom", "jacket"], None),
    ("swimwear_in_dress",
     r"\b(bikini|swimsuit|swim suit|bathing suit|one[- ]piece swim|tankini|monokini|rashguard|rash guard)\b",
     r"\b(dress|gown)\b", ["dress"], "other"),
    ("swimwear_in_top_or_bottom",
     r"\b(one[- ]piece swimsuit|one[- ]piece bathing suit|monokini|tankini\b(?! top| bottom))",
     None, ["top", "bottom"], "other"),
    ("shoes_mistagged",
     r"\b(sneaker|trainer|loafer(?:s)?|mule(?:s)?|sandal(?:s)?|stiletto(?:s)?|pump heel(?:s)?|kitten heel(?:s)?|wedge heel(?:s)?|ankle boot(?:s)?|knee[- ]high boot(?:s)?|chelsea boot(?:s)?|combat boot(?:s)?|cowboy boot(?:s)?|riding boot(?:s)?|moccasin(?:s)?|oxford shoe(?:s)?|derby shoe(?:s)?|brogue(?:s)?|espadrille(?:s)?|slingback(?:s)?|platform sandal(?:s)?|flat sandal(?:s)?)\b",
     r"\b(bag|handbag|tote|clutch|backpack|hat|earring|necklace|ring|skirt|mini skirt|midi skirt|dress|top|shirt|blouse|tee|tank|hoodie|sweater|cardigan|sweatshirt|trouser|jeans|pants|shorts)\b",
     ["top", "dress", "bottom", "jacket"], "shoes"),
    ("bags_mistagged",
     r"\b(handbag|tote bag|crossbody bag|crossbody|clutch bag|satchel|backpack|messenger bag|duffle bag|fanny pack|bumbag|hobo bag|saddle bag|bucket bag|shoulder bag|baguette bag|top handle bag|mini bag|shopper bag)\b",
     r"\b(top|dress|skirt|pants|jacket|shoes)\b", ["top", "dress", "bottom", "jacket"], "bag"),
    ("dress_in_top",
     r"\b(maxi dress|midi dress|mini dress|sundress|sun dress|wrap dress|slip dress|shirtdress|shirt dress|t[- ]shirt dress|sweater dress|knit dress|kaftan dress|caftan dress|cocktail dress|bodycon dress|prom dress|evening gown|ball gown)\b",
     None, ["top"], "dress"),
    ("top_in_dress",
     r"\b(crop top|tank top|cami top|camisole top|polo shirt|bralette top|bustier top|corset top)\b",
     r"\bdress\b", ["dress"], "top"),
    ("bottom_in_top",
     r"\b(jeans|trousers|skirt|shorts|leggings|culottes|chinos|joggers|sweatpants|cargo pants|wide[- ]leg pants|wide leg trouser|pleated trouser|straight leg pant|baggy pant)\b",
     r"\b(top|shirt|blouse|tee|tank|hoodie|sweater|cardigan|sweatshirt|jumper|polo|crop|corset|bustier|bralette|bodysuit|bodice|set|suit|matching|two[- ]piece|2[- ]piece|& |and skirt|and pants|and trouser|and jeans)\b",
     ["top"], "bottom"),
]

# ── curated edits: slug, categories (empty = all), tests (must match?, fields, pattern). Fields: t title, c colour, m material,
#    d description; "c?" tests apply only to rows with a colour, "!c" tests only to rows without one. ──
_KIDS = r"\b(baby|infant|toddler|kids|maternity)\b"
_KIDS_PET = r"\b(baby|infant|toddler|kids|maternity|pet)\b"
_KIDS_CATDOG = r"\b(baby|infant|toddler|kids|maternity|pet|dog\b|cat\b)\b"
_MOTIFS = r"\b(floral|flower|print|stripe|check(?:ed|er)?|polka|gingham|leopard|tiger|rainbow|ombre|tie[\s-]?dye|camo|animal|paisley|combo|two[-\s]?tone|multi|mix|colou?rblock|ikat|jacquard|pineapple|abstract|graphic|embroidered)\b"
_NOT_BLACK = r"\b(white|red|pink|blue|green|yellow|purple|brown|gold|silver|navy|cream|ecru|beige|tan|ivory|orange|grey|gray|rose|nude|olive|burgundy|taupe|charcoal|plum|lilac|lavender|mauve|khaki|rust|mint)\b"
_NOT_WHITE = r"\b(red|pink|blue|green|yellow|purple|brown|gold|silver|navy|black|orange|grey|gray|plum|rust|olive|burgundy)\b"
_WHITE = r"(white|cream|ecru|ivory|off[-\s]?white|chalk)"
EDIT_RULES = [
    ("swimwear", [], [
        (False, "t", r"\b(gown|tulle|bridal|wedding|gift\s*card|tarjeta\s*regalo|e-gift)\b"),
        (False, "t", r"\b(sandal|shoe\b|heel|boot|clog|sunglass|earring|bracelet|necklace|ring\b|hair\s*clip|jaw\s*clip)\b"),
        (False, "t", r"\b(cover[\s-]?up|sarong|sundress|kaftan|caftan|pareo|wrap\s*dress)\b"),
        (False, "t", r"\b(baby|infant|toddler|kids|children|girl\s|boy\s|maternity)\b"),
        (True, "t", r"\b(bikini|swimsuit|swim\s*(?:top|bottom|brief|short|set|wear|suit)|tankini|one[\s-]?piece\s*swim|bathing\s*suit|swimwear)\b"),
    ]),
    ("streetwear", ["top", "bottom", "jacket", "shoes"], [(False, "t", r"\b(baby|infant|toddler|kids|children|maternity)\b")]),
    ("lbd", ["dress"], [
        (True, "t", r"\bmini\b"), (True, "t", r"\bdress\b"),
        (False, "t", r"\b(midi|maxi|long|floor|gown|full[-\s]?length)\b"),
        (False, "t", r"\b(clip|jaw|earring|necklace|bracelet|ring|shoe|bag|belt|hair\b)\b"),
        (False, "t", r"\b(baby|infant|toddler|kids|children|maternity|nightgown|sleep|lingerie|pajama|pyjama)\b"),
        (False, "t", _MOTIFS), (False, "c", _MOTIFS), (False, "t", _NOT_BLACK),
        (True, "c?", r"black"), (False, "c?", r"[\/&]|\band\b|\swith\b|,"), (False, "c?", _NOT_BLACK),
        (False, "c?", r"\b(polka|print|floral|stripe|dot|pattern|check|plaid)\b"), (True, "!c", r"\bblack\b"),
    ]),
    ("white-shirt", ["top"], [
        (True, "t", r"\b(shirt|blouse|poplin|oxford|button[-\s]?(?:up|down))\b"),
        (False, "t", r"\b(t[-\s]?shirt|\btee\b|tank|crewneck|sweat|hoodie|cardigan|pajama|pyjama|nightshirt|night\s*shirt|sleep|robe|bathrobe)\b"),
        (False, "t", _KIDS), (False, "t", _NOT_WHITE), (True, "c?", _WHITE), (False, "c?", _NOT_WHITE), (False, "c?", r"[\/&]|\band\b|,"),
        (True, "!c", _WHITE), (False, "t", r"\b(stripe|check|polka|floral|print|gingham|plaid)\b"),
    ]),
    ("trench", ["jacket"], [
        (True, "t", r"\b(trench|mac\b|mackintosh|duster|rain[\s-]?coat)\b"),
        (False, "t", r"\b(puffer|parka|sherpa|fleece|shearling|down|quilted|puffy)\b"), (False, "t", _KIDS_CATDOG),
    ]),
    ("slip-dress", ["dress"], [
        (True, "t", r"\bdress\b"), (True, "t", r"\b(slip|bias|cami(?:sole)?)\b"),
        (False, "t", r"\b(blazer|jacket|coat|sweater|cardigan|boxer|brief|thong|bralette)\b"),
        (False, "t", r"\b(nightgown|night\s*dress|sleep|lingerie|robe|bathrobe|pajama|pyjama|chemise)\b"), (False, "t", _KIDS),
    ]),
    ("cashmere", [], [
        (True, "t|m", r"\bcashmere\b"),
        (False, "t", r"\b(blanket|throw|pillow|cushion|bedding|duvet|sheet|tablecloth|napkin|placemat|doormat|washcloth)\b"),
        (False, "t", _KIDS_CATDOG),
    ]),
    ("wide-leg-jeans", ["bottom"], [
        (True, "t", r"\b(jean|denim)\b"), (False, "t", r"\b(jacket|skirt|short\b|vest|dress)\b"),
        (True, "t", r"\b(wide|baggy|relaxed|straight|flare|flared|boot[-\s]?cut|loose|oversized|trouser)\b"),
        (False, "t", r"\b(skinny|slim|tapered|tight|cigarette)\b"), (False, "t", _KIDS),
    ]),
    ("wedding-guest", ["dress"], [
        (True, "t", r"\b(dress|gown)\b"),
        (True, "t", r"\b(midi|maxi|full[-\s]?length|floor[-\s]?length|column|wrap|a[-\s]?line|gown)\b"),
        (False, "t", r"\b(bridal|wedding\s*dress|bride\b)\b"),
        (False, "t", r"\b(baby|infant|toddler|kids|children|maternity|nightgown|sleep|lingerie|pajama|pyjama)\b"),
        (False, "tc", r"\b(white|ivory|cream|ecru|off[-\s]?white|chalk|black|nero|noir|blanc|bianco|jet|onyx|raven|charcoal)\b"),
        (False, "tcmd", r"\b(smock(?:ed)?|prairie|peasant|shirtdress|t[-\s]?shirt\s*dress|polo\s*dress|polo\s*(?:mini|midi|maxi)|knit\s*polo|milkmaid|sundress|sun[-\s]?dress|beach\s*dress|cover[-\s]?up|caftan|kaftan|muumuu|gauze|linen|poplin|cotton\s*(?:gauze|poplin|jersey)|denim|gingham|chambray|plaid|flannel|corduroy|oversized|relax(?:ed)?[-\s]?fit|boho|bohemian|prairie|mini\s*dress)\b"),
        (False, "tc", r"\b(sand|beige|oatmeal|stone|mushroom|mocha|taupe|camel|khaki|sage|olive|army|forest|moss|chocolate|espresso|coffee|bronze|natural|nude|ecru|tan\b)\b"),
        (False, "tcmd", r"\b(stripe|striped|pinstripe|polka)\b"),
        (False, "t", r"\b(collar|collared|peter\s*pan|button[-\s]?down)\b"),
        (True, "tcmd", r"\b(silk|satin|velvet|chiffon|tulle|sequin(?:ed|s)?|bead(?:ed|s|ing)?|lam[ée]|metallic|lurex|organza|taffeta|brocade|jacquard|lace|crepe|duchess|mikado|gown|column|sheath|mermaid|halter|cowl|backless|one[-\s]?shoulder|strapless|bias|slip|drap(?:e|ed|ing)|cors(?:et|eted)|bodice|fit[-\s]?and[-\s]?flare|plunge|plunging|formal|evening|occasion|cocktail|black[-\s]?tie|gala|ballroom|red[-\s]?carpet|party)\b"),
        (True, "tcmd", r"\b(red|pink|rose|blush|fuchsia|magenta|coral|peach|salmon|orange|rust|copper|terracotta|amber|yellow|butter|mustard|gold|mint|emerald|teal|turquoise|aqua|navy|blue|sky|cobalt|cerulean|periwinkle|indigo|purple|plum|lavender|lilac|mauve|grape|violet|aubergine|melanzana|burgundy|wine|maroon|oxblood|roseira|magnolia|marigold|chili|bloom|posie|floral|print|polka|paisley|multi|champagne|silver|rose[-\s]?gold)\b"),
    ]),
    ("office", [], [
        (True, "t", r"\b(blazer|trouser|loafer|oxford\s*shoe|pleated|button[-\s]?(?:up|down)|pencil\s*skirt|tailored|wool\s*pant|suit\s*pant)\b"),
        (False, "t", r"\b(hoodie|sweatpant|jogger|cargo|graphic\s*tee|tracksuit|sweatshirt|athleisure|yoga|gym|pajama|pyjama|sleep|robe|kaftan|sarong|bikini|swim)\b"),
        (False, "t", _KIDS_PET),
    ]),
    ("coastal", [], [
        (True, "tm", r"\b(stripe|breton|mariniere|linen|rope|raffia|canvas|chambray|nautical|sailor|fisherman)\b"),
        (False, "t", r"\b(bikini|swimsuit|tankini|one[-\s]?piece\s*swim|swim\s*(?:top|bottom|brief|short|set|wear|suit))\b"),
        (False, "tm", r"\b(hoodie|sweatshirt|sweater|cardigan|crewneck|jean|denim|blazer|trench|parka|puffer|fleece|shearling|tweed|corduroy|velvet)\b"),
        (False, "tm", r"\b(wool|cashmere|merino|mohair|alpaca|flannel)\b"), (False, "t", _KIDS_PET),
    ]),
    ("linen", [], [
        (True, "t|m", r"\blinen\b"), (False, "t", r"\b(bridal|wedding\s*dress|tulle)\b"),
        (False, "t", r"\b(napkin|placemat|tablecloth|sheet\b|bedding|duvet|pillowcase|pillow\s*case|tea\s*towel|dish\s*towel|curtain|washcloth|doormat|blanket|throw)\b"),
        (False, "t", r"\b(pajama|pyjama|nightgown|night\s*dress|night\s*shirt|robe|bathrobe)\b"), (False, "t", _KIDS_PET),
    ]),
]

# ── brand policies of the curated edits: `accept` passes the edit's required tests, `only` is an allow-list, `exclude` drops ids; `caps` are brands with a
#    cap of their own in the final pick (others: 8), `first` brands and `first_title` titles come first in their category ──
EDIT_BRAND_CAP = 8
EDIT_POLICIES = {
    "swimwear": {
        "accept": ["dippin daisys"], "exclude": ["shpfy-arthurapparelcom-9148247900375"], "caps": {"Dippin Daisys": 10}, "first": ["dippin daisys"],
        "first_title": r"\b(bikini|swimsuit|swim\s*(?:top|bottom|brief|short)|tankini|one[\s-]?piece\s*swim)\b",
    },
    "streetwear": {
        "only": ["4028", "Coramisa", "Othernormal", "Berlinc", "Bubon"], "caps": {"4028": 10, "Coramisa": 8, "Othernormal": 8, "Berlinc": 6, "Bubon": 6},
    },
    "cashmere": {"caps": {"Johnstons Of Elgin": 6, "Ghiaia Cashmere": 6}},
}
