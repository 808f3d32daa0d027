"""Vocabularies shared by every job.

FIXED VALUES.  Everything in this module is a constant that has to equal the
published vocabulary for results to agree: enum members, taxonomy entries, phrase
lists, thresholds and weights.  They are written out plainly, in natural order.
No logic lives here; jobs turn these into literal columns or small dimension
tables (all of them have fewer than two hundred entries, so broadcasting one is
safe by construction).
"""

# --- enums ---------------------------------------------------------------------
REPORT_TYPES = ["10-K", "10-Q", "TRANSCRIPT", "OTHER"]
COMPARISON_TYPES = ["YOY", "QOQ"]
METRIC_CATEGORIES = [
    "REVENUE", "PROFITABILITY", "MARGINS", "CASH_FLOW", "DEBT", "CAPEX", "GUIDANCE", "OTHER",
]
EMBEDDING_STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
EXTRACTION_METHODS = ["RULE_BASED", "LLM_BASED", "HYBRID_VALIDATED"]
RISK_CATEGORIES = [
    "SUPPLY_CHAIN", "REGULATORY", "MARKET", "COMPETITION", "TECHNOLOGY", "CYBERSECURITY",
    "OPERATIONAL", "LIQUIDITY", "GEOPOLITICAL", "LEGAL", "ENVIRONMENTAL", "REPUTATION",
    "MACROECONOMIC", "OTHER",
]
RISK_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
RISK_EVOLUTION_TYPES = [
    "NEW_RISK", "REMOVED_RISK", "UNCHANGED_RISK", "ESCALATED_RISK", "REDUCED_RISK",
]
SENTIMENTS = ["POSITIVE", "NEUTRAL", "NEGATIVE"]
CONFIDENCE_LEVELS = ["VERY_CAUTIOUS", "CAUTIOUS", "CONFIDENT", "VERY_CONFIDENT"]  # ascending
TONE_EVOLUTION_TYPES = [
    "MORE_POSITIVE", "MORE_NEGATIVE", "MORE_CONFIDENT", "LESS_CONFIDENT", "MORE_CAUTIOUS",
    "LESS_CAUTIOUS", "UNCHANGED",
]
SIGNAL_SEVERITIES = ["VERY_POSITIVE", "POSITIVE", "NEUTRAL", "NEGATIVE", "VERY_NEGATIVE"]
DIMENSIONS = ["FINANCIAL", "RISK", "TONE", "CAPITAL_ALLOCATION"]

# --- lifecycle -------------------------------------------------------------------
STAGES = [
    "PROCESSED", "SECTIONED", "CHUNKED", "EMBEDDED", "METRICS_READY", "COMPARISON_READY",
    "ANALYTICS_READY", "RISKS_READY", "READY",
]
PROGRESS = {
    "UPLOADED": 10, "PROCESSING": 20, "PROCESSED": 20, "SECTIONING": 30, "SECTIONED": 30,
    "CHUNKING": 40, "CHUNKED": 40, "EMBEDDING": 55, "EMBEDDED": 55,
    "METRICS_EXTRACTING": 65, "METRICS_READY": 65, "COMPARING": 70, "COMPARISON_READY": 70,
    "ANALYTICS": 75, "ANALYTICS_READY": 75, "RISKS": 85, "RISKS_READY": 85, "TONE": 92,
    "READY": 100,
}
DONE_STATUSES = [
    "EMBEDDED", "EXTRACTED", "COMPARED", "ANALYZED", "RISK_EXTRACTED", "TONE_EXTRACTED",
    "COMPLETED", "READY", "METRICS_READY", "COMPARISON_READY", "ANALYTICS_READY", "RISKS_READY",
]

# --- acceptance limits -------------------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
FILE_EXTENSIONS = [".pdf"]
CONTENT_TYPES = ["application/pdf", "application/x-pdf"]
PDF_MAGIC = "%PDF-"
ERROR_MESSAGE_CHARS = 2000

# --- section taxonomy ----------------------------------------------------------------
SECTIONS = [
    "Business Overview", "Risk Factors", "MD&A", "Market Risk Disclosures",
    "Financial Statements", "Balance Sheet", "Income Statement", "Cash Flow Statement",
    "Notes to Financial Statements", "Forward Guidance", "Management Commentary",
    "Legal Proceedings", "Controls and Procedures", "Operator Remarks", "Prepared Remarks",
    "CEO Commentary", "CFO Commentary", "Question & Answer", "Closing Remarks", "Uncategorized",
]
SECTION_ALIASES = {
    "Business Overview": [
        "business", "business overview", "our business", "company overview",
        "overview of the business",
    ],
    "Risk Factors": [
        "risk factors", "principal risks", "key risks", "risk considerations",
        "risk disclosures", "principal risks and uncertainties", "certain risk factors",
    ],
    "MD&A": [
        "md&a", "mda", "management discussion", "management discussion and analysis",
        "management's discussion and analysis",
        "management's discussion and analysis of financial condition and results of operations",
        "discussion and analysis",
    ],
    "Market Risk Disclosures": [
        "quantitative and qualitative disclosures about market risk", "market risk",
        "market risk disclosures",
    ],
    "Financial Statements": [
        "financial statements", "consolidated financial statements",
        "financial statements and supplementary data",
        "condensed consolidated financial statements",
    ],
    "Balance Sheet": [
        "balance sheet", "balance sheets", "consolidated balance sheet",
        "consolidated balance sheets", "statement of financial position",
    ],
    "Income Statement": [
        "income statement", "statements of operations", "statement of operations",
        "consolidated statements of operations", "statements of income", "statement of income",
        "profit and loss",
    ],
    "Cash Flow Statement": [
        "cash flow statement", "statement of cash flows", "statements of cash flows",
        "consolidated statements of cash flows",
    ],
    "Notes to Financial Statements": [
        "notes to financial statements", "notes to the financial statements",
        "notes to consolidated financial statements",
        "notes to the consolidated financial statements",
    ],
    "Forward Guidance": [
        "forward guidance", "guidance", "outlook", "financial outlook", "fiscal year outlook",
        "forward-looking guidance",
    ],
    "Management Commentary": ["management commentary", "management's commentary"],
    "Legal Proceedings": ["legal proceedings"],
    "Controls and Procedures": ["controls and procedures"],
    "Operator Remarks": ["operator"],
    "Prepared Remarks": ["prepared remarks"],
    "CEO Commentary": ["ceo commentary", "chief executive officer"],
    "CFO Commentary": ["cfo commentary", "chief financial officer"],
    "Question & Answer": [
        "question-and-answer session", "questions and answers", "q&a", "q & a",
    ],
    "Closing Remarks": ["closing remarks", "conclusion"],
}
ITEM_SECTIONS = {
    "10-K": {
        "1": "Business Overview", "1A": "Risk Factors", "3": "Legal Proceedings", "7": "MD&A",
        "7A": "Market Risk Disclosures", "8": "Financial Statements",
        "9A": "Controls and Procedures",
    },
    "10-Q-I": {
        "1": "Financial Statements", "2": "MD&A", "3": "Market Risk Disclosures",
        "4": "Controls and Procedures",
    },
    "10-Q-II": {"1": "Legal Proceedings", "1A": "Risk Factors"},
}
TRANSCRIPT_SECTIONS = [
    "Operator Remarks", "Prepared Remarks", "Question & Answer", "Closing Remarks",
]
SECTION_CONFIDENCE = {
    "sec_item": 0.95, "transcript_marker": 0.90, "exact_alias": 0.85, "pattern": 0.75,
    "weak": 0.50,
}
FALLBACK_SECTION = "Uncategorized"
FALLBACK_CONFIDENCE = 0.3
HEADING_MAX_CHARS = 90
HEADING_MAX_WORDS = 14

METRIC_SECTIONS = [
    "Income Statement", "Financial Statements", "Balance Sheet", "Cash Flow Statement",
    "Notes to Financial Statements", "MD&A", "Forward Guidance", "Management Commentary",
]
RISK_SECTIONS = ["Risk Factors", "MD&A", "Forward Guidance", "Forward-Looking Statements"]
TONE_SECTIONS = [
    "Management Commentary", "CEO Commentary", "CFO Commentary", "Prepared Remarks",
    "Question & Answer", "Forward Guidance", "MD&A", "Shareholder Letters",
]

# --- chunking strategies ------------------------------------------------------------------
PROSE_SEPARATORS = ["\n\n", "\n", ". ", " "]
TABLE_SEPARATORS = ["\n\n", "\n", " "]
CHUNK_DEFAULT = {"target": 700, "max": 800, "min": 50, "overlap": 75}
CHUNK_OVERRIDES = {
    "Risk Factors": {"target": 500},
    "Legal Proceedings": {"target": 500},
    "Financial Statements": {"target": 800, "overlap": 40, "table": True},
    "Balance Sheet": {"target": 800, "overlap": 40, "table": True},
    "Income Statement": {"target": 800, "overlap": 40, "table": True},
    "Cash Flow Statement": {"target": 800, "overlap": 40, "table": True},
    "Notes to Financial Statements": {"target": 800},
}
CHUNK_METADATA_KEYS = [
    "company", "report_type", "year", "quarter", "section_name", "normalized_section_name",
    "start_page", "end_page", "report_id", "section_id",
]

# --- metric taxonomy: canonical -> (category, value kind, aliases, expected sections) --------
_STATEMENTS = ["Income Statement", "Financial Statements", "MD&A"]
_CASH = ["Cash Flow Statement", "Financial Statements", "MD&A"]
_FORWARD = ["Forward Guidance", "MD&A", "Management Commentary"]
METRICS = {
    "REVENUE": ("REVENUE", "currency", [
        "revenue", "net sales", "total revenue", "total net sales", "net revenue",
        "total revenues", "sales"], _STATEMENTS),
    "NET_INCOME": ("PROFITABILITY", "currency", [
        "net income", "net earnings", "profit after tax", "net profit",
        "net income attributable", "net loss"], _STATEMENTS),
    "OPERATING_INCOME": ("PROFITABILITY", "currency", [
        "operating income", "income from operations", "operating profit", "operating loss"],
        _STATEMENTS),
    "GROSS_PROFIT": ("PROFITABILITY", "currency", ["gross profit", "gross income"], _STATEMENTS),
    "EBITDA": ("PROFITABILITY", "currency", ["ebitda", "adjusted ebitda"], _STATEMENTS),
    "GROSS_MARGIN": ("MARGINS", "percent", ["gross margin", "gross profit margin"], _STATEMENTS),
    "OPERATING_MARGIN": ("MARGINS", "percent", [
        "operating margin", "operating profit margin"], _STATEMENTS),
    "NET_MARGIN": ("MARGINS", "percent", [
        "net margin", "net profit margin", "net income margin"], _STATEMENTS),
    "OPERATING_CASH_FLOW": ("CASH_FLOW", "currency", [
        "operating cash flow", "cash flow from operations",
        "net cash provided by operating activities", "cash from operations",
        "cash provided by operating activities"], _CASH),
    "FREE_CASH_FLOW": ("CASH_FLOW", "currency", ["free cash flow", "fcf"], _CASH),
    "TOTAL_DEBT": ("DEBT", "currency", [
        "total debt", "total borrowings", "total long-term debt", "long-term debt",
        "total indebtedness"],
        ["Balance Sheet", "Financial Statements", "MD&A", "Notes to Financial Statements"]),
    "CAPEX": ("CAPEX", "currency", [
        "capital expenditure", "capital expenditures", "capex",
        "purchases of property and equipment", "additions to property and equipment",
        "purchases of property plant and equipment"], _CASH),
    "REVENUE_GUIDANCE": ("GUIDANCE", "currency", [
        "revenue guidance", "revenue outlook", "expected revenue", "projected revenue",
        "revenue is expected to be", "full-year revenue"], _FORWARD),
    "MARGIN_GUIDANCE": ("GUIDANCE", "percent", [
        "margin guidance", "operating margin guidance", "expected margin", "projected margin",
        "margin is expected to be"], _FORWARD),
}
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
CURRENCY_CODES = {
    "usd": "USD", "us$": "USD", "eur": "EUR", "gbp": "GBP", "jpy": "JPY", "cad": "CAD",
    "aud": "AUD", "cny": "CNY", "rmb": "CNY",
}
KNOWN_CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CNY"]
KNOWN_UNITS = ["ABSOLUTE", "THOUSAND", "MILLION", "BILLION", "TRILLION", "PERCENT"]
SCALE_POWERS = {"THOUSAND": 3, "MILLION": 6, "BILLION": 9, "TRILLION": 12}
TEXT_SCALES = {
    "thousand": "THOUSAND", "k": "THOUSAND",
    "million": "MILLION", "mm": "MILLION", "mn": "MILLION", "m": "MILLION",
    "billion": "BILLION", "bn": "BILLION", "b": "BILLION",
    "trillion": "TRILLION", "tn": "TRILLION", "t": "TRILLION",
}
CANDIDATE_SCALES = {
    "thousand": "THOUSAND", "thousands": "THOUSAND", "k": "THOUSAND",
    "million": "MILLION", "millions": "MILLION", "mm": "MILLION", "m": "MILLION",
    "billion": "BILLION", "billions": "BILLION", "bn": "BILLION", "b": "BILLION",
    "trillion": "TRILLION", "tn": "TRILLION",
}
PERCENT_WORDS = ["%", "percent", "pct"]
NON_NEGATIVE_METRICS = ["REVENUE", "TOTAL_DEBT", "CAPEX", "REVENUE_GUIDANCE"]
AGREEMENT_TOLERANCE = "0.01"

# --- risk taxonomy -----------------------------------------------------------------------
RISK_KEYWORDS = {
    "SUPPLY_CHAIN": [
        "supply chain", "supplier", "vendor", "procurement", "logistics", "distribution",
        "supplier concentration", "supply disruption", "single source", "component shortage",
        "raw material"],
    "REGULATORY": [
        "regulatory", "regulation", "compliance", "regulatory compliance",
        "government regulation", "regulatory approval", "regulatory change",
        "regulatory action", "regulatory requirement", "permit", "license"],
    "MARKET": [
        "market", "market condition", "market demand", "pricing pressure", "market share",
        "market volatility", "demand decline", "market downturn", "consumer preference",
        "seasonal"],
    "COMPETITION": [
        "competition", "competitive", "competitor", "competitive pressure", "new entrant",
        "market entry", "competitive advantage", "competitive position",
        "pricing competition", "alternative product"],
    "TECHNOLOGY": [
        "technology", "technological change", "innovation", "obsolescence",
        "technological disruption", "research and development", "technical",
        "technology failure", "system failure", "software"],
    "CYBERSECURITY": [
        "cybersecurity", "cyber attack", "data breach", "information security",
        "cyber threat", "ransomware", "malware", "phishing", "unauthorized access",
        "data privacy", "data protection", "security breach", "hacking"],
    "OPERATIONAL": [
        "operational", "operations", "key personnel", "employee", "talent", "workforce",
        "production", "manufacturing", "capacity", "execution risk",
        "operational disruption", "business continuity", "internal control"],
    "LIQUIDITY": [
        "liquidity", "cash flow", "capital", "credit", "debt", "financing",
        "credit facility", "indebtedness", "leverage", "interest rate", "refinancing",
        "debt covenant", "working capital"],
    "GEOPOLITICAL": [
        "geopolitical", "political", "international", "trade", "tariff", "sanction",
        "embargo", "war", "conflict", "political instability", "foreign", "export control",
        "trade restriction"],
    "LEGAL": [
        "legal", "litigation", "lawsuit", "legal proceeding", "intellectual property",
        "patent", "trademark", "copyright", "infringement", "class action", "settlement",
        "legal liability", "regulatory investigation"],
    "ENVIRONMENTAL": [
        "environmental", "climate", "climate change", "natural disaster", "weather",
        "carbon", "emission", "pollution", "environmental regulation", "sustainability",
        "renewable", "flood", "earthquake", "wildfire", "pandemic", "epidemic",
        "health crisis"],
    "REPUTATION": [
        "reputation", "reputational", "brand", "public perception", "media",
        "social media", "negative publicity", "consumer trust", "stakeholder",
        "controversy", "scandal"],
    "MACROECONOMIC": [
        "macroeconomic", "economic", "recession", "inflation", "economic downturn",
        "economic condition", "GDP", "unemployment", "consumer spending",
        "economic slowdown", "currency", "foreign exchange", "exchange rate"],
    "OTHER": [],
}
RISK_TRIGGERS = [
    r"\brisk[s]?\b", r"\buncertaint(y|ies)\b", r"\badverse(ly)?\b", r"\bthreat[s]?\b",
    r"\bnegatively impact[s]?\b",
    r"\bcould (impact|affect|harm|disrupt|damage|limit|prevent|reduce|impair)\b",
    r"\bmay (impact|affect|harm|disrupt|damage|limit|prevent|reduce|impair)\b",
    r"\bfail(ure|s)? to\b",
]
# every trigger contains one of these
RISK_TRIGGER_STEMS = [
    "risk", "uncertaint", "adverse", "threat", "negatively impact", "could ", "may ", "fail",
]
RISK_SECTION_MATCH = ["RISK FACTORS", "MD&A", "FORWARD GUIDANCE", "FORWARD-LOOKING STATEMENTS"]
SEVERITY_KEYWORDS = {
    "CRITICAL": [
        "existential threat", "substantial impairment", "severe regulatory action",
        "going concern", "bankruptcy", "insolvency", "cessation of operations",
        "catastrophic", "irreparable", "criminal", "severe adverse", "total loss",
        "complete failure", "systemic risk"],
    "HIGH": [
        "material adverse effect", "material adverse impact", "materially affect",
        "materially impact", "significant disruption", "significant adverse",
        "could materially", "may materially", "material risk", "substantial risk",
        "serious risk", "major impact", "significant harm", "significant loss",
        "critical vulnerability", "adversely affect our business", "adversely impact"],
    "MEDIUM": [
        "may impact", "could impact", "may affect", "could affect", "moderate",
        "could negatively impact", "may adversely", "could adversely", "potential impact",
        "may result in", "could result in", "uncertainty", "exposure to", "dependence on",
        "subject to", "vulnerable", "vulnerability", "disruption", "adverse effect"],
    "LOW": [
        "minor", "limited impact", "limited exposure", "unlikely",
        "not expected to be material", "immaterial", "de minimis", "low probability",
        "remote", "insignificant"],
}
RISK_NAME_ALIASES = {
    "supplier dependence": "SUPPLY_CHAIN_DEPENDENCY",
    "supply chain dependency": "SUPPLY_CHAIN_DEPENDENCY",
    "vendor concentration": "SUPPLY_CHAIN_DEPENDENCY",
    "single source supplier": "SUPPLY_CHAIN_DEPENDENCY",
    "supply disruption": "SUPPLY_CHAIN_DISRUPTION",
    "supply chain disruption": "SUPPLY_CHAIN_DISRUPTION",
    "component shortage": "SUPPLY_CHAIN_DISRUPTION",
    "regulatory compliance": "REGULATORY_COMPLIANCE",
    "government regulation": "REGULATORY_COMPLIANCE",
    "regulatory change": "REGULATORY_CHANGE",
    "regulatory approval": "REGULATORY_APPROVAL",
    "cyber attack": "CYBERSECURITY_THREAT",
    "cyber threat": "CYBERSECURITY_THREAT",
    "data breach": "DATA_BREACH",
    "information security": "CYBERSECURITY_THREAT",
    "security breach": "DATA_BREACH",
    "ransomware": "CYBERSECURITY_THREAT",
    "competitive pressure": "COMPETITIVE_PRESSURE",
    "pricing competition": "COMPETITIVE_PRESSURE",
    "new market entrant": "COMPETITIVE_PRESSURE",
    "technological change": "TECHNOLOGY_DISRUPTION",
    "technology disruption": "TECHNOLOGY_DISRUPTION",
    "technology obsolescence": "TECHNOLOGY_DISRUPTION",
    "liquidity risk": "LIQUIDITY_RISK",
    "cash flow risk": "LIQUIDITY_RISK",
    "debt covenant": "DEBT_COVENANT_RISK",
    "refinancing risk": "REFINANCING_RISK",
    "trade restriction": "GEOPOLITICAL_RISK",
    "political instability": "GEOPOLITICAL_RISK",
    "international conflict": "GEOPOLITICAL_RISK",
    "tariff risk": "GEOPOLITICAL_RISK",
    "litigation risk": "LITIGATION_RISK",
    "patent infringement": "IP_RISK",
    "intellectual property": "IP_RISK",
    "class action": "LITIGATION_RISK",
    "climate change": "CLIMATE_RISK",
    "natural disaster": "NATURAL_DISASTER_RISK",
    "environmental regulation": "ENVIRONMENTAL_COMPLIANCE",
    "pandemic": "PANDEMIC_RISK",
    "economic downturn": "MACROECONOMIC_RISK",
    "recession risk": "MACROECONOMIC_RISK",
    "inflation risk": "INFLATION_RISK",
    "currency fluctuation": "CURRENCY_RISK",
    "foreign exchange": "CURRENCY_RISK",
    "key personnel": "KEY_PERSONNEL_RISK",
    "talent retention": "KEY_PERSONNEL_RISK",
    "operational disruption": "OPERATIONAL_DISRUPTION",
    "business continuity": "OPERATIONAL_DISRUPTION",
}
RISK_STOP_WORDS = [
    "risk", "factors", "and", "or", "the", "a", "of", "to", "in", "for", "on", "with", "at",
    "by", "from", "up", "about", "into", "over", "after",
]
RISK_FUZZY_THRESHOLD = 0.4

# --- tone phrases -------------------------------------------------------------------------
POSITIVE_PHRASES = [
    "strong growth", "record performance", "exceeded expectations", "robust demand",
    "accelerating adoption", "increased profitability", "revenue expansion",
    "market leadership", "favorable trends", "improved efficiency", "optimistic outlook",
    "successful integration", "positive momentum", "outstanding results",
    "double-digit growth", "solid execution", "strong cash flow", "margin expansion",
    "operational excellence", "strategic success", "historic high", "healthy demand",
    "exceptional performance", "clear upside", "highly productive",
]
NEGATIVE_PHRASES = [
    "declining demand", "headwinds", "pressure", "weakness", "contraction",
    "operational challenges", "margin pressure", "supply chain disruption",
    "revenue decline", "underperformance", "increased competition", "reduced guidance",
    "macroeconomic uncertainty", "softer market", "cost inflation", "regulatory hurdles",
    "negative impact", "impairment charge", "capacity constraints", "lower volume",
    "sluggish growth", "decrease in net", "higher expenses", "unfavorable impact",
    "credit deterioration",
]
CONFIDENCE_PHRASES = [
    "we are confident", "we expect", "we believe", "strong visibility", "positioned well",
    "on track", "well-positioned", "highly confident", "fully expect",
    "reiterate guidance", "clear pathway", "strong execution", "continued growth",
    "track record", "proven model", "sustainable advantage", "confident in our ability",
    "clear direction", "remain optimistic", "solid pipeline",
]
HEDGING_PHRASES = [
    "may", "might", "could", "potentially", "uncertain", "subject to", "depends on",
    "possible", "possibly", "estimate", "estimated", "approximate", "approximately",
    "unpredictable", "variability", "volatile", "volatility", "forecast", "speculative",
    "assumes", "assuming", "potential risks", "some degree", "not guarantee",
    "contingent upon",
]
DEFAULT_TONE_SOURCE = "Management Commentary"
SENTIMENT_MARGIN = 0.01
HEDGING_STEP = 0.05

# --- analytics -----------------------------------------------------------------------------
RATIO_CODES = [
    "GROSS_MARGIN", "OPERATING_MARGIN", "NET_MARGIN", "DEBT_TO_REVENUE", "CASH_FLOW_MARGIN",
]
GROWTH_SIGNAL_TYPES = {
    "REVENUE": "GROWTH", "NET_INCOME": "PROFITABILITY", "EBITDA": "PROFITABILITY",
    "OPERATING_CASH_FLOW": "CASH_FLOW", "FREE_CASH_FLOW": "CASH_FLOW",
}
TREND_THRESHOLDS = {"strong": "0.15", "moderate": "0.05", "low": "0.00"}
MARGIN_METRICS = ["GROSS_MARGIN", "OPERATING_MARGIN", "NET_MARGIN"]

# --- benchmark -----------------------------------------------------------------------------
METRIC_DIRECTIONS = {
    "FINANCIAL": {
        "REVENUE_GROWTH": True, "EBITDA_GROWTH": True, "NET_INCOME_GROWTH": True,
        "FCF_GROWTH": True, "OPERATING_MARGIN": True, "NET_MARGIN": True,
        "DEBT_TO_REVENUE": False, "CASH_FLOW_MARGIN": True,
    },
    "RISK": {
        "TOTAL_RISKS": False, "HIGH_SEVERITY_RISKS": False, "CRITICAL_RISKS": False,
        "NEW_RISKS": False, "ESCALATED_RISKS": False, "RISK_DENSITY": False,
    },
    "TONE": {
        "SENTIMENT_SCORE": True, "CONFIDENCE_SCORE": True, "HEDGING_SCORE": False,
        "TONE_STABILITY": True, "CONFIDENCE_EVOLUTION": True,
    },
    "CAPITAL_ALLOCATION": {
        "CAPEX": True, "CAPEX_GROWTH": True, "DEBT_REDUCTION": True,
        "CASH_DEPLOYMENT": True, "DIVIDEND_METRICS": True, "BUYBACK_METRICS": True,
    },
}
DEFAULT_WEIGHTS = {"financial": 0.40, "risk": 0.25, "tone": 0.15, "capital_allocation": 0.20}
PROFILE_ALIASES = {
    "revenue": ["REVENUE", "TOTAL_REVENUE", "SALES", "NET_SALES"],
    "ebitda": ["EBITDA", "OPERATING_EBITDA"],
    "net_income": ["NET_INCOME", "NET_PROFIT", "NET_EARNINGS"],
    "fcf": ["FREE_CASH_FLOW", "FCF"],
    "debt": ["TOTAL_DEBT", "DEBT"],
    "ocf": ["OPERATING_CASH_FLOW", "CASH_FROM_OPERATIONS", "CASH_FLOW_OPERATIONS"],
    "operating_income": ["OPERATING_INCOME", "OPERATING_PROFIT", "EBIT"],
    "operating_margin": ["OPERATING_MARGIN"],
    "net_margin": ["NET_MARGIN"],
    "debt_to_revenue": ["DEBT_TO_REVENUE"],
    "cash_flow_margin": ["CASH_FLOW_MARGIN"],
    "capex": ["CAPEX", "CAPITAL_EXPENDITURES", "CAPITAL_EXPENDITURE", "CAPITAL_SPENDING"],
    "dividends": ["DIVIDENDS", "DIVIDEND_PAYMENTS", "DIVIDEND_YIELD"],
    "buybacks": ["BUYBACKS", "SHARE_REPURCHASES", "STOCK_REPURCHASES"],
}

# --- retrieval ------------------------------------------------------------------------------
TOP_K_DEFAULT, TOP_K_MIN, TOP_K_MAX = 10, 5, 50
MAX_QUERY_CHARS = 8192
EMBED_BATCH = 100
EMBED_PRICE_PER_MILLION = 0.15
BUDGETS = {"SMALL": 4000, "MEDIUM": 16000, "LARGE": 64000}
PROFILES = {
    "GENERAL": [],
    "RISK_ANALYSIS": ["Risk Factors", "Market Risk Disclosures", "Legal Proceedings"],
    "MANAGEMENT_TONE": [
        "Management Commentary", "CEO Commentary", "CFO Commentary", "Prepared Remarks",
        "Question & Answer"],
    "FINANCIAL_STATEMENTS": [
        "Financial Statements", "Balance Sheet", "Income Statement", "Cash Flow Statement",
        "Notes to Financial Statements"],
    "GUIDANCE": ["Forward Guidance", "MD&A"],
}
# strategy -> (rewrite, hypothetical passage, depth, rerank, budget, profile)
STRATEGIES = {
    "FINANCIAL_METRICS": (True, False, 20, True, "MEDIUM", "FINANCIAL_STATEMENTS"),
    "RISK_ANALYSIS": (True, True, 25, True, "LARGE", "RISK_ANALYSIS"),
    "TONE_ANALYSIS": (True, True, 20, True, "MEDIUM", "MANAGEMENT_TONE"),
    "GUIDANCE_ANALYSIS": (True, True, 20, True, "MEDIUM", "GUIDANCE"),
    "GENERAL_ANALYSIS": (False, False, 10, False, "SMALL", "GENERAL"),
}
QUERY_KEYWORDS = {
    "FINANCIAL_METRIC": [
        "revenue", "margin", "cash flow", "capex", "capital expenditure", "ebitda", "profit",
        "sales", "income", "balance sheet", "net income", "debt"],
    "RISK": [
        "risk", "threat", "concern", "supply chain", "cybersecurity", "breach", "lawsuit",
        "regulation", "legal", "uncertainty", "litigation", "competitor"],
    "TONE": [
        "sentiment", "tone", "management discussion", "md&a", "transcript",
        "prepared remarks", "q&a", "call", "optimistic", "pessimistic", "hedging",
        "confidence"],
    "GUIDANCE": [
        "guidance", "outlook", "future", "forecast", "projection", "expect", "predict",
        "next year", "upcoming"],
    "GENERAL": [
        "overview", "business description", "company description", "who is", "what does",
        "ceo", "board of directors", "headquarters"],
}
QUERY_STOP_WORDS = [
    "what", "are", "is", "how", "did", "the", "company", "in", "of", "for", "with", "a", "an",
    "on", "to", "by",
]
QUERY_EXPANSIONS = {
    "FINANCIAL_METRIC": [
        "revenue", "operating margin", "cash flow", "capital expenditure", "EBITDA"],
    "RISK": [
        "supply chain risk", "regulatory disruption", "cybersecurity",
        "operational vulnerability"],
    "TONE": [
        "management tone", "prepared remarks sentiment", "optimism level", "hedging score"],
    "GUIDANCE": [
        "forward guidance", "outlook projection", "future target", "forecast expectations"],
    "GENERAL": ["operational performance", "overview profile", "business description"],
}
PASSAGES = {
    "risk": (
        "The company faces risks related to its global supply chain, including potential "
        "logistics delays, supplier concentration, and vulnerabilities in component "
        "procurement. Disruption in manufacturing facilities or transportation corridors "
        "could adversely impact our financial performance, operating results, and capacity "
        "utilization."),
    "financial": (
        "During the reporting period, total revenues increased, driven by higher product "
        "sales and expansion of services segments. Operating margins improved due to cost "
        "control measures and operational efficiencies, offset by inflationary pressures "
        "and capital investments."),
    "tone": (
        "Management remains optimistic regarding our long-term strategic direction and "
        "commercial tailwinds. While near-term macroeconomic headwinds and cost increases "
        "require careful capital allocation, we continue to see strong demand and "
        "competitive advantages across our key operating segments."),
    "other": (
        "the company operates in a competitive environment characterized by technological "
        "changes and evolving customer needs. We execute our business strategy to sustain "
        "growth, improve capital efficiency, and manage potential regulatory and financial "
        "risks."),
}

# --- memo / guards ----------------------------------------------------------------------------
PROHIBITED_PHRASES = [
    r"\bstrong buy\b", r"\bstrong sell\b", r"\bbuy recommendation\b",
    r"\bsell recommendation\b", r"\bprice target\b", r"\btarget price\b",
    r"\bportfolio allocation\b", r"\bportfolio optimization\b", r"\bstock rating\b",
    r"\binvestment advice\b", r"\brating\b\s*:\s*\b(buy|sell|hold)\b",
]
INJECTION_PATTERNS = [
    r"ignore\s+(?:all\s+)?previous\s+instructions", r"system\s+override",
    r"you\s+are\s+now\s+a", r"act\s+as\s+a", r"developer\s+mode", r"bypass\s+safety",
    r"forget\s+(?:all\s+)?instructions", r"new\s+rule\s+supersedes",
]
MEMO_SECTIONS = [
    "Company Overview", "Financial Summary", "Risk Summary", "Management Assessment",
    "Competitive Position", "Bull Case", "Bear Case", "Questions to Investigate",
]
MEMO_EVIDENCE_CHUNKS = 20
GROUNDING_FAIL_AT = 5
