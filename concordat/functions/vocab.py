"""Vocabularies, patterns and tables as data, used by the column functions and by the SQL they are held against.

All patterns keep to what Java's regular expressions and RE2 read alike; ``(?i)`` is added where used.
"""

from __future__ import annotations

# -- fixed values: page and line signals ---------------------------------------------------------

CURRENCY = r"(?:₹|INR|Rs\.?|USD|US\$|EUR|GBP|\$|\b(?:crores?|millions?|billions?|trillions?|lakhs?)\b)"
PAGE_UNIT = (
    r"(?:%|\b(?:tonnes?|tons?|kg|km|sq\.?\s*ft\.?|square\s+feet|customers?|employees?|shipments?|units?|pin\s*codes?"
    r"|centres?|centers?|vehicles?|shares?|bps|basis\s+points)\b)"
)
LINE_UNIT = (
    r"(?:%|\b(?:tonnes?|tons?|kg|km|sq\.?\s*ft\.?|square\s+feet|customers?|employees?|shipments?|parcels?|packages?|units?"
    r"|pin\s*codes?|centres?|centers?|vehicles?|shares?|bps|basis\s+points|destinations?|gateways?|hubs?)\b)"
)
PAGE_METRIC = (
    r"\b(?:financial|performance|revenue|profit|loss|ebitda|income|expenditure|expenses?|margin|growth|rate|sales|assets"
    r"|liabilities|capital|turnover|volume|tonnage|gdp|inflation|cpi|wpi|deficit|reserves|exports?|imports?"
    r"|advance\s+estimates?|projections?|forecasts?|operating\s+leverage|pat|cash\s+flow)\b"
)
LINE_METRIC = (
    r"\b(?:revenue|ebitda|profit|loss|margin|growth|sales|income|expenditure|expenses?|assets?|liabilities?|capital|turnover"
    r"|volume|tonnage|gdp|inflation|cpi|wpi|deficit|reserves?|exports?|imports?|pat|cash\s+flow|borrowings?|earnings"
    r"|operating\s+leverage|market\s+share|capacity|utilization|yield|headcount|orders?)\b"
)
NUMBER = r"(?:[><≥≤~]\s*)?[\d,]+(?:\.\d+)?(?:\+)?(?:\s*%)?"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
PAGE_TIME = r"\b(?:FY\s*\d{2,4}|Q[1-4]\s*(?:FY\s*\d{2,4})?|20\d{2}-\d{2,4}|20\d{2}|(?:" + _MONTHS + r")\s+\d{1,2},\s*\d{4})\b"
LINE_TIME = (
    r"\b(?:FY\s*\d{2,4}|Q[1-4]\s*(?:FY\s*\d{2,4})?|20\d{2}-\d{2,4}|20\d{2}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{4})\b"
)
BOILERPLATE = (
    r"\b(?:table\s+of\s+contents|contents|all\s+rights\s+reserved|confidential|disclaimer|forward-looking\s+statements"
    r"|safe\s+harbor|blank\s+page|this\s+page\s+intentionally\s+left\s+blank|corporate\s+information|directory)\b"
)
YEAR_COLUMN = r"\b(?:FY\s*\d{2,4}|20\d{2}(?:-\d{2,4})?|Q[1-4])\b"
PLAIN_NUMBER = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"
PLAIN_PERCENT = r"\b\d+(?:\.\d+)?\s*(?:%|percent(?:age)?)\b"
PLAIN_CURRENCY = r"(?:₹|\$|USD|INR|EUR|GBP|Rs\.?|dollars?|rupees?|crores?|lakhs?|billions?|millions?)"

#: What most texts hold of CURRENCY, as parts of other words, and all else of it.
CURRENCY_COMMON = r"[IiRr](?:(?<=[Ii])[Nn][Rr]|(?<=[Rr])[Ss]\.?)"
CURRENCY_OTHER = r"₹|USD|EUR|GBP|\$|crore|illion|lakh"

#: Where a text is broken into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAK_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: White space of any script.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Any other character.
NO_SPACE = r"(?U)[^\s\x1c-\x1f]"
SPACE_RE2 = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"

# -- fixed values: normalisation -----------------------------------------------------------------

#: Scale -> (power of ten, tokens that say it).
SCALES: dict[str, tuple[int, tuple[str, ...]]] = {
    "crore": (7, ("crore", "crores", "cr", "crs")),
    "lakh": (5, ("lakh", "lakhs", "lac", "lacs")),
    "thousand": (3, ("thousand", "thousands", "k")),
    "million": (6, ("million", "millions", "mn", "mns")),
    "billion": (9, ("billion", "billions", "bn", "bns")),
    "trillion": (12, ("trillion", "trillions", "tn", "tns")),
}
SCALE_OF_TOKEN = {token: label for label, (_, tokens) in SCALES.items() for token in tokens}

#: Currency -> pattern over lower-cased text, tried in this order.
CURRENCIES = {
    "INR": r"(?:₹|\binr\b|\brs\.?\b|\brupees?\b)",
    "USD": r"(?:us\$|\busd\b|\bus\s+dollars?\b|\bu\.s\.\s*dollars?\b)",
    "EUR": r"(?:€|\beur\b|\beuros?\b)",
    "GBP": r"(?:£|\bgbp\b|\bpounds?\b)",
}
PERCENT = r"(?:%|percent(?:age)?)"
DASHES = r"[\u2010-\u2015\u2212]"
DASHES_RE2 = r"[\x{2010}-\x{2015}\x{2212}]"
DECLINE = (
    r"(?:decline|declined|declines|declining|decrease|decreased|decreases|decreasing|drop|dropped|drops|dropping|reduction"
    r"|reductions|reduced|reducing|fall|fell|falls|falling|contraction|contracted|contractions|contracting|loss|losses)"
)
CURRENCY_WORDS = ("inr", "usd", "eur", "gbp", "rs", "rupee", "rupees", "dollar", "dollars", "percent", "percentage")
#: How a raw value starts (or, for the last of the symbols, ends) -> its qualifier, tried in this order.
QUALIFIER_SYMBOLS = ((">=", ">="), ("<=", "<="), (">", ">"), ("<", "<"), ("=", "="))
QUALIFIER_WORDS = (
    ("more than", ">"),
    ("less than", "<"),
    ("at least", ">="),
    ("at most", "<="),
    ("approximately", "approximately"),
    ("approx", "approx"),
    ("around", "around"),
    ("about", "about"),
    ("nearly", "nearly"),
)
NOTE_PERCENT = "Percentage value retained as percentage points."
NOTE_NO_PERCENT = "Failed to parse numeric value for percentage."
NOTE_NO_NUMBER = "Unable to extract numeric component from raw value."
NOTE_DOLLAR = "Ambiguous currency symbol '$' without explicit country code."

MONTH_NUMBER = {
    "january": "01", "jan": "01", "february": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04", "may": "05",
    "june": "06", "jun": "06", "july": "07", "jul": "07", "august": "08", "aug": "08", "september": "09", "sep": "09", "sept": "09",
    "october": "10", "oct": "10", "november": "11", "nov": "11", "december": "12", "dec": "12",
}
#: Patterns of period labels.
DAY_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DAY_MONTH_FIRST = r"(?:as\s+of\s+)?([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DAY_DAY_FIRST = r"(?:as\s+of\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]+),?\s+(\d{4})"
YEAR_CALENDAR = r"^(?:cy|calendar\s+year)\s*(\d{4})$"
YEAR_SPAN = r"^(?:fy|fiscal\s+year)?\s*(\d{4})\s*[-/]\s*(\d{2,4})"
QUARTER_SPAN = r"^q([1-4])\s*(?:fy|fiscal\s+year)?\s*(\d{4})\s*[-/]\s*(\d{2,4})"
QUARTER_BARE = r"^q([1-4])\s*(?:fy\s*)?(\d{2,4})"
YEAR_FISCAL = r"^fy\s*(\d{2,4})$"

LEGAL_SUFFIX = (
    r"[\s,]+(?:private\s+limited|pvt\.?\s*ltd\.?|limited|ltd\.?|incorporated|inc\.?|corporation|corp\.?|llc|plc|gmbh"
    r"|s\.a\.?|n\.v\.?)\.?$"
)

# -- fixed values: matching and relations --------------------------------------------------------

METRIC_STOPWORDS = (
    "from", "of", "in", "to", "for", "the", "and", "a", "an", "at", "by", "on", "as", "since", "during", "over", "per",
    "all", "total", "net", "gross", "delivered", "reported", "based", "approx", "approximately", "inception", "overall",
    "full", "annual",
)
QUANTITY_WORDS = ("count", "number", "num", "no", "qty", "quantity")
CURRENCY_UNITS = ("inr", "usd", "eur", "gbp")

TEMPORAL_PHRASES = (
    "up from", "down from", "increased from", "decreased from", "rose from", "fell from", "compared with", "compared to",
    "versus", "vs.", "vs", "previously", "earlier",
)
TEMPORAL_PATTERNS = (
    r"\b(?:up|down|increased|decreased|rose|fell|grown|declined)\s+from\b",
    r"\bcompared\s+(?:with|to)\b",
    r"\b(?:versus|vs\.?)\b",
    r"\b(?:previously|earlier)\b",
    r"\bfrom\s+(?:[\$€£¥₹]?\d+(?:\.\d+)?%?|\d{4})\s+to\s+(?:[\$€£¥₹]?\d+(?:\.\d+)?%?|\d{4})\b",
    r"\bwas\s+.+?\s+in\s+\d{4}\s+and\s+.+?\s+in\s+\d{4}\b",
    r"\b(?:year[- ]on[- ]year|yoy|annualized|quarter[- ]on[- ]quarter|qoq)\b",
)
#: For each of these patterns the words of which a text that it matches holds at least one.
TEMPORAL_NEEDS = (
    ("from",), ("compared",), ("versus", "vs"), ("previously", "earlier"), ("from",), ("and",),
    ("year", "yoy", "annualized", "quarter", "qoq"),
)
SUPERSESSION = (
    "superseded", "supersedes", "restated", "restatement", "revised actuals", "subsequently restated", "superseding",
)
#: The phrases above by a word that they need; where it is itself one of them, the others hold it and need not be asked for.
TEMPORAL_PHRASES_BY_WORD = {
    "from": tuple(p for p in TEMPORAL_PHRASES if p.endswith(" from")),
    "compared": tuple(p for p in TEMPORAL_PHRASES if p.startswith("compared ")),
    "versus": ("versus",), "vs": ("vs.", "vs"), "previously": ("previously",), "earlier": ("earlier",),
}
SUPERSESSION_BY_WORD = {
    "supersed": tuple(p for p in SUPERSESSION if p.startswith("supersed")),
    "restate": ("restated", "restatement", "subsequently restated"),
    "revised actuals": ("revised actuals",),
}
#: Data vintages of which one is known to follow the other.
VINTAGE_STEPS = (
    ("first advance estimate", "second advance estimate"),
    ("first advance estimate", "provisional actuals"),
    ("first advance estimate", "revised estimate"),
    ("second advance estimate", "provisional actuals"),
    ("second advance estimate", "revised estimate"),
    ("provisional", "revised"),
    ("advance estimate", "revised estimate"),
    ("interim", "final"),
)
# -- fixed values: claims read off lines by rule ---------------------------------------------------

_SIZE = r"(?:Cr(?:ore)?|Mn|Million|Bn|Billion|Lakh)"
RULE_MONEY = r"(?:₹|Rs\.?|INR|\$|USD)\s*[\d,]+(?:\.\d+)?(?:\s*" + _SIZE + r")?"
RULE_PERCENT = r"[-+]?[\d,]+(?:\.\d+)?\s*%"
RULE_BOUND = (
    r"([><≥≤~]|at least|over|more than|approximately)\s*([\d,]+(?:\.\d+)?(?:\s*" + _SIZE
    + r")?(?:\s*(?:tonnes?|shipments?|customers?|pin\s*codes?|\%))?)"
)
RULE_COUNT = r"\b([\d,]{4,}(?:\.\d+)?(?:\+)?)(?:\s*(?:customers?|pin\s*codes?|employees?))?\b"
RULE_FISCAL = r"\b(FY\s*\d{2,4}|Q[1-4]\s*FY\s*\d{2,4}|FY\s*\d{2,4}-\d{2,4})\b"
RULE_CALENDAR = r"\b(20\d{2}-20\d{2}|20\d{2}-\d{2}|20\d{2})\b"
#: What a lower-cased line holds -> entity or metric, tried in this order. A corpus brings its own.
RULE_ENTITIES = (
    (("delhivery",), "Delhivery Limited"),
    (("rbi", "reserve bank"), "Reserve Bank of India"),
    (("imf", "international monetary fund"), "International Monetary Fund"),
    (("india", "economic survey", "gdp"), "Government of India"),
)
RULE_METRICS = (
    (("revenue",), "Revenue from Operations"),
    (("customer base", "customers"), "Active Customers"),
    (("freight", "tonnes", "ptl"), "Part-Truckload Freight Volume"),
    (("shipment", "express"), "Express Parcel Shipment Volume"),
    (("gdp",), "Real GDP Growth"),
    (("pin code", "pincode"), "Pin Code Reach"),
)
RULE_STATUS = (
    (("projected", "baseline projection", "forecast", "expected to grow", "outlook"), "Baseline Projection"),
    (("advance estimate", "provisional"), "Official Estimate"),
    (("target", "ambition", "aim", "goal"), "Target / Ambition"),
)
STATUS_WORDS = ((("project", "forecast"), "projected"), (("estimate",), "estimated"), (("target", "ambition"), "target"), (("audit",), "audited"))
NO_ENTITY, NO_METRIC, NO_PERIOD = "Unspecified Entity", "Unspecified Metric", "Unspecified Period"

EPISTEMIC = ("reported", "estimated", "projected", "target", "audited")
DIMENSIONS = ("entity", "metric", "unit", "time_period", "scope", "geography", "epistemic_status", "data_vintage")
