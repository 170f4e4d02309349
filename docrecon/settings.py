"""Settings and the fixed values of the rules."""

from __future__ import annotations

from dataclasses import dataclass

# Folder shapes.
FY_FOLDER = r"(?i)^FY\s*\d{2}\s*-\s*\d{2}$"
MONTH_FOLDER = r"^[A-Za-z]{3,9}-\d{4}$"
DATE_FOLDER = r"^\d{1,2}-[A-Za-z]{3,9}-\d{4}$"

# Content signals of an invoice (pattern, weight, reason), then those against it.
INVOICE_SIGNALS = (
    (r"\btax\s+invoice\b", 3.0, "has 'TAX INVOICE'"),
    (r"\binvoice\s*no\.?\b", 1.5, "has 'Invoice No'"),
    (r"\bgstin\b", 1.0, "has GSTIN"),
    (r"total\s+invoice\s+value", 1.5, "has 'Total Invoice Value'"),
    (r"place\s+of\s+supply", 0.5, "has 'Place of Supply'"),
    (r"hsn/?sac", 0.5, "has HSN/SAC"),
)
OTHER_SIGNALS = (
    (r"purchase\s*/?\s*expense\s+approval", 4.0, "is an Approval form"),
    (r"\bapproval\s+form\b", 2.0, "is an Approval form"),
    (r"approval\s+decision", 1.0, "has 'Approval Decision'"),
    (r"gstr-?2a", 3.0, "is a GSTR-2A return"),
)
APPROVAL_MARKER, RETURN_MARKER = OTHER_SIGNALS[0][0], OTHER_SIGNALS[3][0]
FILENAME_INVOICE, FILENAME_APPROVAL = r"^invoice[_\-\s]", r"^approval[_\-\s]"

# Field patterns.
ID_FROM_FILENAME = r"^(?:invoice[_\-\s])?(.+?)\.pdf$"
INVOICE_NO = r"invoice\s*no\.?\s*:?\s*([A-Za-z0-9][A-Za-z0-9/\-]+)"
GSTIN = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b"
INVOICE_DATE = r"invoice\s*date\s*:?\s*([0-9]{1,2}[-/][A-Za-z]{3,9}[-/][0-9]{2,4})"
TAXABLE = r"taxable\s+value\s*:?\s*rs\.?\s*([\d,]+\.\d{2})"
TOTAL = r"total\s+invoice\s+value\s*:?\s*rs\.?\s*([\d,]+\.?\d*)"
BILL_TO = r"bill\s*to"

# Words that name a legal form, taken out of company names.
LEGAL_SUFFIXES = ("private limited", "pvt ltd", "pvt. ltd.", "pvt limited", "llp", "limited", "ltd", "inc", "incorporated", "co", "company", "& associates", "and associates")

# Columns of the master sheet.
MASTER_COLUMNS = (
    "invoice_id", "company", "vendor_name_pdf", "vendor_gstin", "invoice_date", "taxable_value", "total_value", "bill_to_name", "bill_to_gstin", "link_status", "gstr_row",
    "gstr_ref", "fy", "month", "date_folder", "bank", "source", "confidence", "reviewed", "flags", "rel_path", "file_path",
)

# What a reference cell may hold that is no reference.
NO_REFERENCE = ("", "not found", "copy failed", "skipped")

# Cut-offs of the finder.
SEARCH_CUTOFF, TOKEN_CUTOFF, SHORT_TOKEN, PARTIAL_SHADE, LITERAL_BONUS, FOLDER_CUTOFF = 62.0, 75.0, 2, 0.95, 12.0, 70.0


@dataclass(frozen=True)
class Settings:
    """Values that a run may override."""

    bank_scope: str = "Kotak"
    fy_scope: str | None = None
    root: str = ""
    min_text_chars: int = 20
    invoice_score: float = 3.0
    filename_hint: float = 1.0
    accept: float = 90.0
    soft: float = 70.0
    tolerance: float = 1.0
    review_below: float = 0.80
    explode_pages: bool = True


DEFAULTS = Settings()
