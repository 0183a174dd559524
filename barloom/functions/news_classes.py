"""Fixed values of the news taxonomy: class, pattern, direction, prior severity. The first match in this order counts."""

# Fixed values: (class, pattern, direction, prior).
CLASSES: list[tuple[str, str, int, float]] = [
    ("NOISE", r"here'?s how much|if you invested|would have made|would be worth|how much you would|\blive on\b|halftime report|final trades?|how to earn|benzinga (?:pro|edge)|^(?:bitcoin|ethereum|dogecoin)\b", 0, 0.0),
    ("EARNINGS_PREVIEW", r"earnings (?:scheduled|preview|expectations)|to report .*earnings|ahead of earnings", 0, 0.4),
    ("EARNINGS_BEAT", r"\bbeats?\b(?!.*\bmiss)|tops? (?:estimates|views|consensus)", 1, 1.6),
    ("EARNINGS_MISS", r"\bmiss(?:es|ed)?\b|falls? short of (?:estimates|views)", -1, 1.8),
    ("GUIDANCE_RAISE", r"(?:raises?|lifts?|boosts?|hikes?|ups)\s+(?:\S+\s+){0,3}?(?:guidance|outlook|forecast)", 1, 2.0),
    ("GUIDANCE_CUT", r"(?:cuts?|lowers?|slashes|trims?|reduces?)\s+(?:\S+\s+){0,3}?(?:guidance|outlook|forecast)|withdraws? (?:guidance|outlook)", -1, 2.4),
    ("GUIDANCE", r"\bsees\b\s+(?:fy|q[1-4]|full.year|\d{4})|conference call:|reaffirms? (?:fy|guidance)", 0, 1.6),
    ("EARNINGS", r"\bq[1-4]\b.*\b(?:eps|sales|revenue)\b|adj\.? eps|reports? (?:q[1-4]|first|second|third|fourth).*(?:results|earnings)", 0, 1.5),
    ("OFFERING", r"\boffering\b|prices? \$?[\d.]+ ?(?:m|b|million|billion)? (?:common )?stock|public offering|registered direct|\batm\b program|shelf registration|convertible notes? offering", -1, 3.0),
    ("DILUTION", r"dilut|warrant exercise|share issuance|increases? authorized shares", -1, 2.5),
    ("BANKRUPTCY", r"bankrupt|chapter 11|chapter 7|going concern|insolven|receivership", -1, 5.0),
    ("DELISTING", r"delist|deficiency (?:letter|notice)|non.?compliance with.*listing|reverse split", -1, 3.5),
    ("SHORT_REPORT", r"short (?:report|seller)|hindenburg|muddy waters|citron|fuzzy panda|scorpion capital|grizzly research", -1, 4.0),
    ("MA", r"\bacquir|\bmerger\b|\bmerges?\b|to be acquired|takeover|buyout|definitive agreement to (?:acquire|merge)|\bLBO\b", 1, 3.5),
    ("FDA", r"\bfda\b|phase [123]|clinical (?:trial|data)|topline|\bpdufa\b|breakthrough therapy|orphan drug|\bnda\b|\bbla\b|ind clearance", 0, 3.5),
    ("HALT", r"trading halt|halted|resumes? trading|circuit breaker", 0, 3.0),
    ("LAWSUIT", r"lawsuit|class action|\bsues?\b|litigation|settlement|investigation|subpoena|\bsec charges?\b|doj", -1, 2.0),
    ("INDEX_ADD", r"(?:join|add(?:ed)?|inclusion).{0,20}(?:s&p|russell|nasdaq.100|index)", 1, 2.5),
    ("CONTRACT", r"\bcontract\b|\bawarded\b|\bwins?\b .{0,24}(?:deal|order|award)|purchase order|task order|selected by", 1, 2.0),
    ("PARTNERSHIP", r"partnership|collaborat|joint venture|strategic (?:alliance|investment)|teams? up with", 1, 1.5),
    ("BUYBACK", r"buyback|repurchase program|tender offer", 1, 1.5),
    ("DIVIDEND", r"dividend|distribution declared", 0, 0.8),
    ("INSIDER", r"insider (?:buy|sell|purchase)|\bform 4\b|(?:ceo|cfo|director) (?:buys?|sells?)", 0, 1.2),
    ("EXEC_CHANGE", r"(?:appoints?|names?|steps? down|resigns?|departs?|to retire).{0,30}(?:ceo|cfo|coo|president|chairman)|leadership transition", 0, 1.8),
    ("ANALYST_MAINTAIN", r"maintains?|reiterat|reaffirm|initiates? coverage|assumes? coverage", 0, 0.5),
    ("ANALYST_UP", r"upgrade|raises? price target|\bpt raised\b", 1, 1.4),
    ("ANALYST_DOWN", r"downgrade|(?:cuts?|lowers?) price target|\bpt (?:cut|lowered)\b", -1, 1.6),
    ("MOVER", r"shares? (?:jump|surge|soar|spike|plunge|tumble|slide|sink|fall|rise)|trading (?:higher|lower)|moving (?:higher|lower)|stocks? moving|why .* shares are|what'?s going on with|why is .* stock|stock (?:of the day|is (?:up|down)|rises|falls)", 0, 1.0),
    ("ANALYST_ROUNDUP", r"these analysts|top wall street forecasters|analysts? (?:revise|increase|slash|adjust)", 0, 0.6),
    ("RECALL", r"\brecalls?\b .{0,40}(?:vehicle|unit|product|lot)|issues? (?:a )?recall|safety recall|product recall", -1, 2.2),
    ("MACRO", r"\bfed\b|fomc|federal reserve|inflation|\bcpi\b|\bppi\b|jobs report|tariff|interest rates?|treasury yield|s&p 500|dow (?:jones|futures)|nasdaq composite|oil price|opec|leading and lagging sectors|market.moving news|\b(?:pmi|ism|redbook|nonfarm|payrolls?|jobless claims)\b|(?:sector|business|consumer|manufacturing) (?:outlook|sentiment|index)|\bgdp\b|retail sales index", 0, 0.8),
    ("OPTIONS", r"options? (?:activity|trade)|whale|unusual options", 0, 0.6),
]

# Weights of words and phrases; below zero for bad news.
WEIGHTS: dict[str, float] = {
    "beat": 2.0, "beats": 2.0, "tops": 1.8, "surges": 2.2, "surge": 2.0, "soars": 2.4, "soar": 2.2, "jumps": 2.0, "jump": 1.8, "spikes": 2.0, "rallies": 1.8, "rally": 1.5, "climbs": 1.4, "gains": 1.3, "rises": 1.2,
    "record": 1.6, "strong": 1.5, "robust": 1.5, "upgrade": 2.0, "upgrades": 2.0, "raises": 1.8, "boosts": 1.8, "lifts": 1.6, "outperform": 1.5, "buy": 1.0, "approval": 2.5, "approved": 2.5, "wins": 2.0, "awarded": 2.0, "secures": 1.8,
    "expands": 1.2, "launch": 1.2, "breakthrough": 2.5, "milestone": 1.5, "profitable": 1.8, "profit": 1.2, "growth": 1.2, "accelerates": 1.5, "exceeds": 2.0, "outpaces": 1.6, "bullish": 1.8, "optimistic": 1.4, "positive": 1.2,
    "acquisition": 1.5, "acquires": 1.5, "partnership": 1.3, "buyback": 1.6, "repurchase": 1.5, "dividend increase": 1.8, "guidance raise": 2.5, "better than expected": 2.5, "ahead of estimates": 2.2, "price target raised": 1.8,
    "miss": -2.0, "misses": -2.0, "missed": -2.0, "plunges": -2.4, "plunge": -2.2, "tumbles": -2.2, "sinks": -2.0, "slides": -1.6, "falls": -1.4, "drops": -1.5, "declines": -1.4, "slumps": -1.8, "weak": -1.6, "weakness": -1.6, "soft": -1.2,
    "downgrade": -2.0, "downgrades": -2.0, "cuts": -1.8, "lowers": -1.6, "slashes": -2.2, "underperform": -1.5, "sell": -1.0, "warns": -2.2, "warning": -2.0, "halts": -2.0, "halted": -2.0, "recall": -2.2, "rejects": -2.4, "rejected": -2.4,
    "denied": -2.2, "lawsuit": -1.8, "investigation": -2.0, "probe": -1.8, "fraud": -3.0, "bankruptcy": -3.5, "bankrupt": -3.5, "delisting": -2.8, "dilution": -2.2, "dilutive": -2.2, "offering": -1.8, "loss": -1.5, "losses": -1.5,
    "deficit": -1.5, "layoffs": -1.8, "restructuring": -1.4, "impairment": -1.8, "writedown": -1.8, "resigns": -1.5, "steps down": -1.5, "delays": -1.8, "delayed": -1.8, "bearish": -1.8, "concerns": -1.4, "disappointing": -2.2,
    "shortfall": -2.0, "below estimates": -2.2, "worse than expected": -2.5, "guidance cut": -2.8, "going concern": -3.5, "price target cut": -1.8, "short report": -3.0,
}
NEGATORS = {"not", "no", "never", "fails", "fail", "failed", "without", "despite", "lacks", "unable", "wont", "cannot", "cant"}
INTENSIFIERS = {"sharply": 1.4, "significantly": 1.3, "substantially": 1.3, "massively": 1.5, "slightly": 0.6, "marginally": 0.5, "modestly": 0.7, "slight": 0.6}
QUIET = {"NOISE", "MACRO"}
