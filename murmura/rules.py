"""Weights, thresholds, word lists and patterns, as data."""

from __future__ import annotations

# Risk formula.
TOPIC_WEIGHTS = {
    "Regulatory Risk": 100, "Legal Risk": 90, "Cybersecurity": 60, "Safety Recall": 60, "Labor Relations": 35,
    "Customer Satisfaction": 0, "Environmental": 0, "Full Self-Driving / Autopilot": 0, "Executive Leadership": 0,
    "Mergers & Acquisitions": 0, "Innovation": 0, "Financial Results": 0, "Competition": 0, "Market Share": 0, "Product Launch": 0,
    "Electric Vehicles": 0, "Energy Storage": 0,
}
SENTIMENT_WEIGHTS = {"Positive": 0, "Neutral": 10, "Negative": 40}
RISK_DIVISOR = 140.0
TOPIC_MIN_CONFIDENCE = 0.65
RISK_BANDS = [(25.0, "LOW"), (50.0, "MEDIUM"), (75.0, "HIGH")]
STATUS_CAP, LOW_CAP, HIGH_FLOOR, ROLE_MIN = 50.0, 25.0, 51.0, 25.0
GRADES = [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (40, "D")]
RELIABILITY_BY_WORD = [
    ("government", 1.20), ("regulatory", 1.20), ("court", 1.20), ("company", 1.10), ("news", 1.00), ("blog", 0.85), ("social", 0.70),
    ("forum", 0.70),
]

# Reach and trust.
REACH_ANCHORS = [(0.00, 0.50), (1.89, 0.65), (2.65, 0.85), (3.86, 1.00), (4.66, 1.10), (6.08, 1.20)]
COMMENT_WEIGHT = 10
TRUST_TIERS = {"high": 1.15, "medium": 0.95, "low": 0.85, "unknown": 0.65}
OUTLET_TIERS = {
    "the economic times": "high", "economictimes.com": "high", "moneycontrol.com": "high", "moneycontrol": "high",
    "business standard": "high", "the business standard": "high", "business-standard.com": "high",
    "realty.economictimes.indiatimes.com": "high", "economictimes.indiatimes.com": "high", "livemint": "high", "mint": "high",
    "reuters": "high", "reuters.com": "high", "bloomberg": "high", "bloomberg.com": "high",
    "the hindu": "medium", "thehindu.com": "medium", "hindustan times": "medium", "the times of india": "medium",
    "times of india": "medium", "ndtv": "medium", "ndtv profit": "medium", "the indian express": "medium", "indian express": "medium",
    "bw businessworld": "low", "construction week india": "low", "devdiscourse": "low", "realty plus magazine": "low",
}
#: document type -> least views, least comments
REACH_FLOORS = {"youtube": (10000, 50), "instagram": (2900, 20), "reddit": (50, 10)}

# Composite scores.
REPUTATION_WEIGHTS = {"sentiment": 0.30, "risk": 0.30, "source": 0.10, "visibility": 0.05}
EXECUTIVE_WEIGHTS = {"sentiment": 0.35, "risk": 0.30, "visibility": 0.10}
MIN_WEIGHT = 0.20
REPUTATION_DAYS, EXECUTIVE_DAYS, BENCHMARK_DAYS, PRODUCT_DAYS = 30, 365, 90, 30
VISIBILITY_HALF, EXECUTIVE_FULL_DOCS = 5000.0, 500.0

# Alerts.
ALERT_LEVELS = [(50, 55.0), (15, 40.0)]
ALERT_DEFAULT = 15.0
ALERT_TRANSITIONS = {
    "ACTIVE": ["ACKNOWLEDGED", "RESOLVED", "CLOSED"], "ACKNOWLEDGED": ["RESOLVED", "CLOSED"], "RESOLVED": ["ACTIVE", "CLOSED"],
    "CLOSED": ["ACTIVE"],
}

# Title rules.
SERIOUS = (
    r"\b(?:rera|maharera|ncdrc|consumer (?:commission|court|forum)|tribunal|nclt|nclat|enforcement|arrest\w*|raids?|penalt\w+|scam|"
    r"fraud|forgery|cheating|money laundering|tax (?:demand|evasion)|gst demand|protest\w*|lawsuit)\b"
    r"|\bfined\b|\bfines?\s+(?:of\s+)?(?:rs\.?|₹|inr|\d)"
    r"|\b(?:high|supreme|district|civil|sessions|magistrate|consumer)\s+court\b"
    r"|\bcourt\s+(?:orders?|directs?|denies|rejects?|dismisses|slams|summons|restrains|stays|notice|pulls up|upholds|issues notice)\b"
    r"|\b(?:moves?|moved|approach\w*|taken to|goes? to|drag\w*(?:\s+\w+)?\s+to)\s+(?:the\s+)?court\b"
    r"|\b(?:ed|cbi|sebi|police|sit|eow|income[- ]tax|it dept|govt|government|cag)\s+probe\b"
    r"|\bprobe\s+(?:into|against|ordered|launched)\b"
    r"|\b(?:orders?|ordered|directs?|directed|asks?|asked|told)\b[^.;]{0,40}\brefund\w*"
    r"|\b(?:legal|land|property|tax|title|payment|contractual|boundary)\s+disputes?\b|\bin dispute\b"
)
SERIOUS_ABBR = r"\b(?:ED|FIR|HC|CBI|SC)\b"
KEEP_SCORING = (
    r"\b(?:probe|investigat\w+|allegations?|alleged|raids?|arrest\w*|scandal|bribe\w*|resign\w*|default\w*|insolvency|bankruptcy|"
    r"downgrade\w*|sebi|sfio|nclt|nclat|ncdrc|rera|penalt\w+|fined|fraud|scam|lawsuit|ransomware|breach|hack\w*|forgery|cheating)\b"
)
FLOOR_EXCLUDE = (
    r"\b(approved|approval|nod|launch|pre-?launch|eoi|offers?|registered|merger|amalgamation|sanction\w*|settle\w*|settlement|"
    r"resolve[sd]?|defamat\w*)\b|rera (?:received|ii)|\balleges\b|filed by|\bheld in\b|\bdismiss\w*[^.;]{0,60}\bcomplaints?\s+against\b"
)
CHARGES_DROPPED = (
    r"\b(?:drops?|dropped|withdraws?|withdrawn|quash(?:es|ed)|clears?|cleared|acquit(?:s|ted)?|exonerat\w+|dismiss(?:es|ed))\b"
    r"[^.;]{0,50}\b(?:charges?|cases?|probe|allegations?|complaints?|fir)\b"
)
MOVES = (
    r"(?:rise|rises|rose|gain|gains|gained|surge|surges|surged|jump|jumps|jumped|rally|rallies|rallied|fall|falls|fell|slip|slips|"
    r"slipped|drop|drops|dropped|slide|slides|tumble|tumbles|crash|crashes|crashed|plunge|plunges|plunged|slump|slumps|slumped|"
    r"decline|declines|declined|climb|climbs|up|down|gap down|gap up)"
)
MARKET = (
    r"\b(?:stocks?|shares?|scrip)\b[^.;]{0,30}\b" + MOVES + r"\b"
    r"|\bshare price\b|\bstock picks?\b|\bstocks? to (?:buy|watch|sell)\b|\banalysts? (?:recommend|suggest|advise|like)\w*"
    r"|\b(?:buy|sell|hold|accumulate)\s+(?:rating|call|recommendation)\b|\btarget price\b|\b52[- ]week (?:high|low)\b"
    r"|\bDMAs?\b|\b(?:nifty|sensex)\b|\btop (?:gainers|losers)\b|\bcrash\w*\s+(?:nearly |over |about |around )?\d+(?:\.\d+)?\s?%"
    r"|\b(?:falls?|rises?|gains?|jumps?|surges?|slips?|drops?|slides?|tumbles?|slumps?|declines?)\s+(?:over |nearly |about )?\d+(?:\.\d+)?\s?%"
)
RESULTS = (
    r"\bQ[1-4]\b[^.;]{0,25}\b(?:results?|earnings|profit|pat|revenue|loss|sales)\b"
    r"|\b(?:net |consolidated )?(?:profit|pat|income|revenue|sales|bookings?|earnings)\b[^.;]{0,25}\b" + MOVES + r"\b"
    r"|\bposting (?:a )?loss\b|\bposts? (?:a )?(?:net )?loss\b|\bnet loss\b|\bloss (?:narrows|widens)\b|\bearnings calls?\b|\bdividend\b"
    r"|\bboard meeting\b|\bresults? (?:today|preview|date)\b"
)
PROMO = (
    r"\b\d\s?bhk\b|\bpayment plan\b|\bpay \d+\s?%|\bsite visit\b|\bfly ?through\b|\bwalk ?through\b|\bpre-?launch\b|\bnew launch\b"
    r"|\bbook(?:ing)? now\b|\bprice list\b|\bluxury (?:apartments?|villas?|homes?|living)\b|\bso expensive\b"
    r"|\bwhy (?:is|are)\b[^?]{0,40}\b(?:expensive|costly|worth it)\b|\btruth about\b|\bworth (?:it|the (?:money|price))\b"
    r"|\bconcept film\b|\binvest in\b|\bhandover\b|\b\d{10}\b"
)
PROMO_TYPES = ["youtube", "instagram"]
FLOOR_TYPES = ["rss", "gdelt", "hn_algolia"]
FLOOR_EXCLUDED_OUTLETS = ["sprouts news", "inventiva"]
CASE_STATUSES = ["allegation", "probe", "charged", "penalty_or_order", "settled", "dismissed_or_closed", "unrelated"]
CAPPED_STATUSES = ["unrelated", "dismissed_or_closed", "settled"]

# User-generated allegations.
UGC_TYPES = ["youtube", "instagram", "reddit", "hn_algolia", "post", "video", "forum", "review", "tiktok", "facebook", "twitter", "x"]
UGC_VIEWS = 100_000
NEWS_OUTLETS = [
    "ndtv", "aaj tak", "abp news", "abp ananda", "zee news", "zee business", "zee 24 taas", "india today", "cnbc tv18", "cnbc-tv18",
    "cnbc awaaz", "times now", "news18", "republic world", "republic bharat", "the hindu", "hindustan times", "indian express",
    "economic times", "et now", "et realty", "business standard", "livemint", "moneycontrol", "financial express", "the print",
    "theprint", "wion", "dd news", "doordarshan", "tv9", "news9", "india tv", "firstpost", "business today", "bloomberg quint",
    "bq prime", "ndtv profit", "news nation", "etv bharat", "times of india", "dainik bhaskar", "dainik jagran", "amar ujala",
    "navbharat times", "lokmat", "asianet news", "mathrubhumi news", "manorama news", "suvarna news", "public tv", "tv9 kannada",
    "news first kannada", "sakshi tv", "ntv telugu", "tv5 news", "sun news", "puthiya thalaimurai", "pti news", "ani news", "ians",
    "bloomberg", "reuters", "bbc news", "cnn", "al jazeera", "cnbc", "financial times", "wall street journal", "associated press",
    "the guardian", "sky news", "dw news", "france 24",
]

# Penalties, in lakh rupees.
SMALL_LAKH, OLD_DAYS = 25.0, 730
UNIT_LAKH = {
    "crore": 100.0, "crores": 100.0, "cr": 100.0, "lakh": 1.0, "lakhs": 1.0, "lac": 1.0, "lacs": 1.0, "l": 1.0, "million": 10.0,
    "mn": 10.0, "thousand": 0.01, "k": 0.01,
}
AMOUNT = r"(?:₹|\brs\.?|\binr)\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|cr\b|lakhs?|lacs?|l\b|million|mn\b|thousand|k\b)?"
AMOUNT_BARE = r"\b([0-9][0-9,]*(?:\.[0-9]+)?)\s*(crores?|lakhs?|lacs?)\b"
SENIOR = r"\b(high court|supreme court|sebi|enforcement directorate|nclt|nclat|competition commission|cci)\b"
SENIOR_ABBR = r"\b(ED|CBI|HC|SC)\b"
SMALL = (
    r"\b(consumer (?:commission|forum|court|disputes)|ncdrc|\w*rera|real estate regulatory authority|municipal\w*|civic body|mcd|bmc|pmc)\b"
)
CRIMINAL = r"\b(criminal|fir|arrest\w*|charge-?sheet\w*|cheating|fraud\w*|launder\w*|ipc|bns|conspiracy|prosecution|bribe\w*|forgery)\b"
RESTRICT = (
    r"\b(?:(?:revok\w*|cancel\w*|suspend\w*|withdr[ae]w\w*|debar\w*)\b[^.;:|]{0,40}\b(?:registration|registrations|licen[cs]es?|rera registration)\b"
    r"|(?:registration|registrations|licen[cs]es?)\b[^.;:|]{0,50}\b(?:revoked|cancell?ed|suspended|withdrawn)\b"
    r"|(?:ban|bans|banned|banning|bars|barred|barring|prohibit\w*|restrain\w*)\b[^.;:|]{0,40}\b(?:sale|sales|selling|booking|bookings|advertis\w*|launch\w*|marketing)\b"
    r"|(?:stop|stops|stopped|stopping|halt\w*|freez\w*|stay\w*)[ -]?(?:work\b|order\b)"
    r"|(?:stop|stops|stopped|stopping|halt\w*|freez\w*|stalls?|stalled)\b[^.;:|]{0,40}\b(?:project|projects|construction|sales|work on)\b)"
)

# Incidents.
INCIDENT_DAYS = 45
EVENT_JACCARD, EVENT_SHARED, EVENT_OVERLAP = 0.5, 3, 0.6
TITLE_SHARED, TITLE_OVERLAP = 4, 0.5
ENTITY_WORD_RATIO = 0.8
INCIDENT_STOP_WORDS = (
    "a an the of in on at to for and or as by with from over after amid into about against its his her their is are was were be has have "
    "had says said say new news report reports reportedly case cases india indian company companies group ltd limited pvt private "
    "properties what why how who which that this these those here there more than also not no"
).split()
SAME_MOVE = {
    "chargesheets": "chargesheet", "chargesheeted": "chargesheet", "charges": "chargesheet", "charged": "chargesheet",
    "charge": "chargesheet", "chargesheet": "chargesheet", "raids": "raid", "raided": "raid", "searches": "raid", "searched": "raid",
    "search": "raid", "raid": "raid", "probes": "probe", "probed": "probe", "probing": "probe", "investigation": "probe",
    "investigates": "probe", "investigating": "probe", "probe": "probe", "fined": "fine", "fines": "fine", "penalty": "fine",
    "penalised": "fine", "penalized": "fine", "slaps": "fine", "settles": "settle", "settled": "settle", "settlement": "settle",
    "ed": "ed", "enforcement": "ed", "cgrera": "rera", "maharera": "rera", "rera": "rera", "accuses": "allege", "alleges": "allege",
    "alleged": "allege", "allegation": "allege", "allegations": "allege", "claim": "allege", "claims": "allege", "accused": "allege",
    "chinese": "china", "link": "link", "links": "link", "ties": "link", "tie": "link", "linked": "link", "ads": "advertisement",
    "advert": "advertisement", "advertising": "advertisement", "advertisements": "advertisement", "arrested": "arrest", "arrests": "arrest",
}
