"""Spark-native analytics over electronic invoices, their mailbox ledger and their pages."""
