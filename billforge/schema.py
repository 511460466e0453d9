"""Schemas of the ledger, the invoice rows and the reports; names of states; the three notions of blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = (
    "message_id string, status string, supplier string, subject string, mail_date string, reason string, attempts int, saved_count int, "
    "files array<string>, first_seen string, updated_at string"
)
LOOKUPS = (
    "message_id string, mail_date string, header_date string, sender string, subject string, invoice_no string, lookup_code string, updated_at string, "
    "pdf_status string, pdf_file string, pdf_error string, pdf_attempts int, pdf_updated_at string, dup_of string, master_synced int, force_pdf int, pdf_not_found int"
)
INVOICE = (
    "file_stem string, issuer string, doc_kind string, buyer_name string, buyer_tax_id string, series string, invoice_no string, invoice_date string, "
    "pre_tax_amount bigint, plate string, goods string, provenance string, seller_tax_id string"
)
ATTACHMENT = "filename string, mime string, size bigint, attachment_id string, content binary"

DONE, FAILED, SKIPPED, PENDING, DUPLICATE, NO_CODE = "DONE", "FAILED", "SKIPPED", "PENDING", "DUPLICATE", "NO_CODE"
#: Sentinels that a worksheet shows for a missing value.
REVIEW, NO_PLATE = "Cần kiểm tra", "Không biển số"


def nz(c) -> Column:
    """Blank and null as null, else trimmed."""
    return F.nullif(F.trim(c), F.lit(""))


def blank_value(c) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def blank_cell(c) -> Column:
    """Worksheet cells: the sentinels count as blank too."""
    return blank_value(c) | F.coalesce(F.trim(c).isin(REVIEW, NO_PLATE), F.lit(False))


def blank_name(c) -> Column:
    """Buyer keys: also names that say there is none."""
    return blank_cell(c) | F.coalesce(F.lower(F.trim(c)).isin("nan", "none", "-"), F.lit(False))
