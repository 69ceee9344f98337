"""Fixed values.

The texts, word lists, thresholds and patterns below decide the results, so they are stated
here as they must be, in their natural order. Everything else in the package is built on them.
"""

# --- categories, sources, confidences ---------------------------------------------------------
DEFAULT_CATEGORY = "Ask My Accountant"
UNCATEGORIZED = "Uncategorized"
INTEREST_CATEGORY = "Interest"
SOURCE_REGISTER = "Check Register"
SOURCE_VENDOR = "Vendor Code"
SOURCE_RULE = "Rule"
SOURCE_MODEL = "AI"
SOURCE_OVERRIDE = "Override"

CONFIDENCE_REGISTER_CATEGORY = 1.0
CONFIDENCE_VENDOR = 0.98
CONFIDENCE_RULE = 0.95
CONFIDENCE_REGISTER_RULE = 0.90
CONFIDENCE_MODEL_DEFAULT = 0.74
CONFIDENCE_OVERRIDE = 1.0

MODEL_MIN_CONFIDENCE = 0.70
MODEL_REVIEW_CONFIDENCE = 0.80
SHORT_TRIGGER_LENGTH = 3
HIGH_SCORE = 0.800
DEFAULT_RATE_WARNING = 40
LOW_RULE_COUNT = 30

# --- review texts ------------------------------------------------------------------------------
REASON_NO_RULE = "No matching client rule was found."
REASON_MODEL_LOW = "Matched by artificial intelligence with lower confidence."
REASON_SHORT_TRIGGER = "Matched with a very short trigger keyword."
REASON_NO_REGISTER = "Check transaction has no check register mapping."
REASON_NO_CODE = "ACH vendor payment detected, but no valid 4 digit vendor code found."
OVERRIDE_TRIGGER = "One-time override from review screen"
MODEL_TRIGGER_FALLBACK = "Gemini semantic match"

# --- trigger wording that is too generic -------------------------------------------------------
GENERIC_PAYMENT_PHRASES = [
    "DIRECT PAY",
    "DIRECTPAY",
    "ACH PAYMENT",
    "ACH TRANSFER",
    "WIRE TRANSFER",
    "WIRE",
    "CASH CHECK",
    "PAYMENT",
    "ACH DEBIT",
    "ACH CREDIT",
]

# --- bank noise in descriptions ----------------------------------------------------------------
NOISE_PREFIXES = [
    "Recurring Payment authorized on",
    "Recurring Payment authorized",
    "Purchase authorized on",
    "Purchase authorized",
    "Payment authorized on",
    "Payment authorized",
]
NOISE_DATE = r"^\s*\d{1,2}/\d{1,2}(/\d{2,4})?\s*"
NOISE_STARS = r"\*+"
NOISE_PROCESSOR = r"^\s*[A-Za-z]{2,4}\s+"
NOISE_PHONE = r"\d{3}[-.]?\d{3}[-.]?\d{4}"
NOISE_CARD_STATE = r"(?i)\s+CA\s+S?\d+\s+Card\s+\d+.*$"
NOISE_CARD = r"(?i)\s+Card\s+\d+.*$"

# --- check numbers -----------------------------------------------------------------------------
CHECK_NUMBER_PATTERNS = [
    r"(\d+)\s*[Cc]heck\b",
    r"(\d+)\s*[Cc][Hh][Kk]\b",
    r"[Cc]heck\s*#?\s*(\d+)",
    r"[Cc][Hh][Kk]\s*#?\s*(\d+)",
    r"[Cc]hk\s+(\d+)",
]
LEGACY_CHECK_PATTERN = r"(?i)(?:check|chk|ck)\s*#?\s*(\d+)"

# --- ACH vendor codes --------------------------------------------------------------------------
ACH_WORDS = ["ACH", "DIRECT PAY", "DIRECTPAY"]
ACH_PAYMENT_HINTS = ["VENDOR", "PAYMENT", "PAY ", "TRNSFR", "TRANSFER", "CCD", "PPD", "WEB"]
VENDOR_CODE_PATTERNS = [
    r"\bDIRECT\s*PAY\s+(\d{4})\b",
    r"\bACH\b.*?\b(?:CODE|VENDOR|PAYEE|ID)\s*[:#-]?\s*(\d{4})\b",
    r"\b(?:VENDOR|PAYEE)\s*[:#-]?\s*(\d{4})\b",
]
FOUR_DIGITS = r"\b(\d{4})\b"

# --- account id prefixes -----------------------------------------------------------------------
ACCOUNT_ID_PREFIXES = [
    "REVENUE-", "REV-", "INC-",
    "COGS-", "COG-",
    "EXP-", "EXPENSE-",
    "LIAB-", "LIABILITY-",
    "ASSET-", "AST-",
    "EQUITY-", "EQ-",
    "TAX-",
    "AMA-",
]

# --- payee wording -----------------------------------------------------------------------------
PAYEE_GENERIC_TERMS = [
    "BUSINESS", "AMERICAN", "EXPRESS", "COMPANY", "CORP", "CORPORATION",
    "INC", "LLC", "LTD", "BANK", "BANKING", "FINANCIAL", "SERVICES",
    "ACH", "DEBIT", "CREDIT", "PAYMENT", "TRANSFER", "PMT", "WIRE",
    "ONLINE", "BILLPAY", "CHECK", "CHK", "WF", "TO", "FROM", "AND", "THE",
    "STO", "PAYMENTS", "SALE", "SALES", "REGISTRATION",
]
PAYEE_STOP_TERMS = [
    "PAYMENT", "PAYMENTS", "ACH", "DEBIT", "CREDIT", "TRANSFER", "PMT",
    "SALE", "SALES", "REGISTRATION",
]
PAYEE_CLIENT_MARKS = ["INC", "LLC", "LTD", "CORP", "CORPORATION", "CARRIER", "INC."]
PAYEE_PHRASES = [
    r"(?i)(?:payment|pay)\s+(?:to|from)\s+([A-Z][A-Za-z\s&,\.]+?)(?:\s|$|,|\.)",
    r"(?i)transfer\s+(?:to|from)\s+([A-Z][A-Za-z\s&,\.]+?)(?:\s|$|,|\.)",
    r"(?i)ACH\s+(?:DEBIT|CREDIT|PAYMENT)\s+([A-Z][A-Za-z\s&,\.]+?)(?:\s|$|,|\.)",
    r"(?i)check\s+\d+\s+([A-Z][A-Za-z\s&,\.]+?)(?:\s|$|,|\.)",
]

# --- header names of input files ---------------------------------------------------------------
GL_HEADERS = {
    "date": ["date", "transaction date", "posting date", "entry date", "trans date", "doc date"],
    "name": ["name", "account name", "vendor", "payee", "customer", "supplier", "company name"],
    "memo": [
        "memo", "description", "transaction description", "details", "notes", "narrative",
        "transaction details", "particulars", "remarks", "comment", "reference", "trans desc",
    ],
    "split": [
        "split", "category", "account", "account name", "account code", "account number",
        "account description", "gl account", "chart of account", "coa", "account title",
    ],
    "debit": ["debit", "debit amount", "dr", "dr amount", "withdrawal", "expense", "payment"],
    "credit": ["credit", "credit amount", "cr", "cr amount", "deposit", "income", "receipt"],
    "amount": ["amount", "transaction amount", "value", "total", "net amount", "balance"],
}
GL_KEYWORDS = {
    "date": ["date", "dt"],
    "name": ["name"],
    "memo": ["desc", "memo", "note", "detail"],
    "split": ["split", "category", "account"],
    "debit": ["debit", "dr"],
    "credit": ["credit", "cr"],
    "amount": ["amount", "amt"],
}
TABULAR_HEADERS = {
    "date": ["date", "transaction date", "posted date", "post date"],
    "description": ["description", "memo", "details", "payee", "name"],
    "amount": ["amount", "amt"],
    "credit": ["credit", "deposit"],
    "debit": ["debit", "withdrawal", "payment"],
    "account_number": ["account number", "acct", "account"],
    "bank": ["bank", "bank name"],
}
REGISTER_HEADERS = {
    "check_number": [
        "check number", "check_number", "check #", "check#", "chk", "chk number", "check no", "num",
    ],
    "payee_name": ["payee", "payee name", "payee_name", "pay to", "vendor", "vendor name", "name"],
    "category": ["category", "account", "account name", "account_name", "classification", "split"],
    "type": ["type", "transaction type", "txn type", "entry type"],
    "split_amount": ["split_amount", "split amount", "split amt", "amount split"],
    "memo": ["memo", "description", "notes", "details", "memo/description"],
}
REGISTER_INSPECTION_HEADERS = {
    "check_number": ["check number", "check #", "check", "chk", "check no", "number"],
    "payee": ["payee name", "payee", "pay to", "vendor", "name"],
    "memo": ["memo", "description", "details", "notes", "memo description"],
}
GL_RANGE_HEADERS = ["date", "transaction date", "posting date", "post date", "trans date", "doc date"]
COA_CATEGORY_COLUMNS = ["account", "account name", "name", "category", "type", "description"]
MISSING_WORDS = ["", "nan", "none", "null"]

# --- dates -------------------------------------------------------------------------------------
DATE_FORMATS = ["M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M/d/yy", "d/M/yy"]
STATEMENT_PERIOD_PATTERNS = [
    r"(?i)([A-Za-z]+\s+\d{1,2},\s*\d{4})\s*-\s*([A-Za-z]+\s+\d{1,2},\s*\d{4})",
    r"(?i)([A-Za-z]{3}\s+\d{1,2},\s*\d{4})\s*-\s*([A-Za-z]{3}\s+\d{1,2},\s*\d{4})",
    r"(?i)(\d{1,2}/\d{1,2}/\d{4})\s*-\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?i)for\s+([A-Za-z]+\s+\d{1,2},\s*\d{4})\s+to\s+([A-Za-z]+\s+\d{1,2},\s*\d{4})",
]

# --- banks -------------------------------------------------------------------------------------
WELLS_KEYS = ["wells fargo", "wellsfargo.com", "wells fargo bank, n.a."]
WELLS_CARD_KEYS = [
    "transaction details", "annual percentage rate", "finance charges", "cash advances",
    "minimum payment", "transaction finance charges",
]
WELLS_SECOND_KEYS = [
    "primary account number", "ending daily balance summary", "service charge summary",
    "interest summary", "deposits and withdrawals summary",
]
BOA_KEYS = [
    "bank of america", "bankofamerica.com", "bank of america, n.a.", "p.o. box 15284", "wilmington, de",
]
BOA_CARD_KEYS = [
    "fees charged", "interest charged", "totals year-to-date", "transaction finder",
    "rewards summary", "payment information", "minimum payment",
]
CHASE_KEYS = ["jpmorgan chase", "chase.com", "chase bank"]
CHASE_CARD_KEYS = ["transactions this cycle", "late fee warning", "total interest charged", "reference:"]
STATEMENT_KEYWORDS = [
    "bank statement", "account statement", "statement period", "account number", "account summary",
    "transactions", "deposits", "withdrawals", "debit", "credit", "balance", "opening balance",
    "closing balance", "statement date", "transaction history",
]
STATEMENT_MIN_KEYWORDS = 2
BANK_LABEL_NAMES = ["wells fargo", "bank of america", "chase", "bmo", "us bank", "u.s. bank"]
BANK_LABEL_TYPES = ["chk", "checking", "savings", "business", "credit"]

# --- card polarity -----------------------------------------------------------------------------
CARD_CREDIT_WORDS = ["payment", "credit", "return", "refund"]
CARD_DEBIT_WORDS = ["purchase", "charge", "fee", "interest"]

# --- loans -------------------------------------------------------------------------------------
LOAN_ID_PATTERN = r"(?i)(?:CO\s+)?ID:([A-Z0-9]+)"
LOAN_DIGITS_PATTERN = r"(\d{4,})"
LOAN_DEFAULT_MONTHS = 60
LOAN_SCORE_EXACT = 20
LOAN_SCORE_CONTAINS = 15
LOAN_SCORE_AMOUNT = 10
LOAN_SCORE_CLIENT = 10
LOAN_START_DAYS = 45
MONTH_NAMES = (
    r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
)
LOAN_TEXT_PATTERNS = {
    "legal_name": [
        r"legal\s+name[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|borrower|account|loan|funding)",
        r"borrower[:\s]+name[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|account|loan|funding)",
        r"borrower[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|account|loan|funding)",
        r"name[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|account\s+number|loan|funding)",
        r"entity\s+name[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|account|loan|funding)",
        r"company\s+name[:\s]+([A-Za-z0-9\s,\.&\-']+?)(?:\n|$|account|loan|funding)",
    ],
    "funding_provided": [
        r"funding\s+provided[:\s]*\$?([\d,]+\.?\d*)",
        r"loan\s+amount[:\s]*\$?([\d,]+\.?\d*)",
        r"principal[:\s]*\$?([\d,]+\.?\d*)",
        r"amount\s+financed[:\s]*\$?([\d,]+\.?\d*)",
    ],
    "annual_percentage_rate": [
        r"annual\s+percentage\s+rate[:\s]*([\d.]+)\s*%?",
        r"apr[:\s]*([\d.]+)\s*%?",
        r"interest\s+rate[:\s]*([\d.]+)\s*%?",
    ],
    "finance_charge": [
        r"finance\s+charge[:\s]*\$?([\d,]+\.?\d*)",
        r"total\s+finance\s+charge[:\s]*\$?([\d,]+\.?\d*)",
    ],
    "total_payment_amount": [
        r"total\s+payment[:\s]*\$?([\d,]+\.?\d*)",
        r"total\s+of\s+payments[:\s]*\$?([\d,]+\.?\d*)",
        r"total\s+amount\s+payable[:\s]*\$?([\d,]+\.?\d*)",
    ],
    "payment": [
        r"monthly\s+payment[:\s]*\$?([\d,]+\.?\d*)",
        r"payment\s+amount[:\s]*\$?([\d,]+\.?\d*)",
        r"regular\s+payment[:\s]*\$?([\d,]+\.?\d*)",
        r"payment[:\s]*\$?([\d,]+\.?\d*)",
    ],
    "account_no": [
        r"account\s+(?:number|no\.?)[:\s]*([\d\-X]+)",
        r"account\s+#[:\s]*([\d\-X]+)",
        r"acct\s+(?:number|no\.?)[:\s]*([\d\-X]+)",
    ],
    "due_date": [
        r"finance\s+agreement\s+dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"master\s+equipment\s+finance\s+agreement\s+dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"equipment\s+finance\s+schedule[^.]*dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"equipment\s+finance\s+schedule\s+no[^.]*dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"(?:finance|equipment|schedule|agreement|master).*?dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"dated\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"due\s+date[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"payment\s+due[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
        r"first\s+payment\s+due[:\s]+([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    ],
    "start_date": [
        r"start\s+date[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"loan\s+start[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"date\s+of\s+loan[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"origination\s+date[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"beginning\s+date[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"effective\s+date[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"start[:\s]+(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})",
        r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\s*(?:start|beginning|origination)",
    ],
}

# --- events ------------------------------------------------------------------------------------
VALID_EVENT_TYPES = [
    "tool_usage", "feature_access", "document_action", "chat_action", "login",
    "download", "upload", "api_call", "error", "custom",
]
VALID_STATUSES = ["success", "error", "pending"]

# --- output files ------------------------------------------------------------------------------
CATEGORIZED_CSV_COLUMNS = [
    "Date", "Description", "Credit", "Debit", "Category", "Source", "Payee", "Bank", "AccountNumber",
    "Confidence", "NeedsReview", "ReviewReason", "RuleId", "Trigger", "VendorCode", "MatchedViaMemo",
]
LEGACY_CSV_COLUMNS = [
    "Date", "Description", "Credit", "Debit", "Category", "Bank", "Payee", "AccountNumber",
]
EXTRACTION_COLUMNS = ["date", "post_date", "description", "credit", "debit", "bank"]
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# --- statement text ----------------------------------------------------------------------------
MONEY_PATTERN = r"-?\$?\d[\d,]*\.\d{2}"
FURNITURE_PATTERN = (
    r"(?i)(Electronic deposits/bank credits|Electronic debits/bank debits|Transaction detail|"
    r"Page\s+\d+\s+of\s+\d+|All rights reserved|Member FDIC|Sheet Seq)"
)
TOTAL_PATTERN = r"(?i)^Total\s+(credits|debits|checks)"
LEDGER_END_PATTERN = r"(?i)^Daily\s+Ledger\s+Balance\s+Summary"
SECTION_PATTERNS = {
    "credit": r"(?i)^\s*Credits\s*$",
    "debit": r"(?i)^\s*Debits\s*$",
    "checks": r"(?i)^\s*Checks\s+paid\s*$",
}
INLINE_ROW_PATTERN = r"^\s*(\d{2}/\d{2})(?:\s+(\d{2}/\d{2}))?\s+([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})\s*(.*)$"
GENERIC_ROW_PATTERN = r"^(\d{2}/\d{2}|[A-Za-z]{3}\s+\d{1,2})\s+(.+?)\s+(-?\$?[\d,]+\.\d{2})$"
DATE_LINE_PATTERN = r"^\s*(\d{2}/\d{2})\s*$"
AMOUNT_LINE_PATTERN = r"^\$?([0-9]{1,3}(?:,[0-9]{3})*\.\d{2})\s*$"
CHECK_LINE_PATTERN = r"^\d{3,6}(?:\s*\*)?$"
CHECK_MARKER_PATTERN = r"^[\*\^]$"
ACCOUNT_HEADER_PATTERN = r"(?i)Account\s*number[:\s]*([0-9*]{4,})"
BALANCE_PAIR_PATTERN = r"(\d{2}/\d{2})\s+([\d,]+\.\d{2})"
POLARITY_CREDIT_WORDS = [
    "credit", "refund", "reversal", "returned ach", "nsf", "incoming wire", "interest paid", "interest",
]
POLARITY_DEBIT_WORDS = [
    "debit", "fee", "charge", "withdrawal", "payment", "ach debit", "check", "cheque", "chk",
]
TABLE_CREDIT_HINTS = [
    "deposit", "edeposit", "e deposit", "wells fargo rewards", "rewards", "interest payment", "interest",
    "hrtland", "heartland", "pmt sys", "txns/fees", "slam dunk sports bar",
    "online transfer from", "zelle payment from", "wt fed", "wire in", "incoming wire",
]
TABLE_DEBIT_HINTS = [
    "ach debit", "business to business ach debit", "purchase authorized", "recurring payment",
    "online transfer to", "check", "deposited or cashed check", "currency ordered fee",
    "coin ordered fee", "fee", "lottery lotto invoices", "ins prem", "payroll", "transfer to",
    "bill pay", "dtv*directv", "amazon",
]
TABLE_TWO_AMOUNT_DEBIT_WORDS = [
    "ach debit", "purchase authorized", "recurring payment", "online transfer to", "check", "fee", "lottery",
]
TABLE_TWO_AMOUNT_CREDIT_WORDS = ["hrtland", "heartland", "deposit", "interest", "rewards"]
TABLE_ONE_AMOUNT_CREDIT_WORDS = ["deposit", "interest", "rewards", "hrtland", "heartland", "txns/fees"]
SHORT_DESCRIPTION_WORDS = [
    "interest", "nsf", "fee", "refund", "return", "wire", "debit", "credit", "check", "cheque", "chk",
]
LONG_DESCRIPTION_WORDS = [
    "ach", "wire", "credit", "debit", "fee", "transfer", "serv", "analysis", "interest",
    "refund", "return", "nsf", "charge", "check", "cheque", "chk",
]
PAGE_HEADER_PATTERNS = [
    r"(?i)transaction\s+history",
    r"(?i)deposits\s+and\s+other\s+credits",
    r"(?i)withdrawals\s+and\s+other\s+debits",
    r"(?i)service\s+fees",
    r"(?i)monthly\s+activity\s+details",
    r"(?i)deposits\s+and\s+additions",
    r"(?i)checks\s+paid",
    r"(?i)atm\s*[&]\s*debit\s+card\s+withdrawals",
    r"(?i)electronic\s+withdrawals?",
    r"(?i)other\s+withdrawals?",
    r"(?i)\bfees\b",
    r"(?i)\bcredits\b",
    r"(?i)\bdebits\b",
]
CARD_PAGE_HEADER_PATTERNS = [
    r"(?i)account\s+activity",
    r"(?i)payments\s+and\s+other\s+credits",
    r"(?i)purchases\s+and\s+other\s+charges",
    r"(?i)fees\s+and\s+adjustments",
    r"(?i)cash\s+advances",
    r"(?i)credits\s+and\s+returns",
    r"(?i)transaction\s+details",
]
PAGE_AMOUNT_PATTERN = r"[\$]?\s*\d+[,\d]*\.\d{2}"
PAGE_DATE_PATTERN = r"\d{1,2}/\d{1,2}"
PAGE_CONTENT_LENGTH = 200
PAGE_SUMMARY_PATTERN = r"(?i)(summary|total|ending\s+balance|account\s+summary)"
