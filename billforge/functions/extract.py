"""Invoice fields from text: the functions of ``rules``, ``page_fields`` and ``money`` under one name."""

from __future__ import annotations

from .money import pre_tax_amount, region_amount, words_amount, words_to_number
from .page_fields import buyer_name, buyer_tax_id, clean_plate, date, file_number, goods_name, header_identity, invoice_number, lookup_fields, normal_series, plate, plate_in, series
from .rules import amount, amount_status, goods_class, needs_better, pick_pre_tax, suspicious_number, vat_matches, word_override

__all__ = [
    "amount", "amount_status", "buyer_name", "buyer_tax_id", "clean_plate", "date", "file_number", "goods_class", "goods_name", "header_identity", "invoice_number", "lookup_fields", "needs_better",
    "normal_series", "pick_pre_tax", "plate", "plate_in", "pre_tax_amount", "region_amount", "series", "suspicious_number", "vat_matches", "word_override", "words_amount", "words_to_number",
]
