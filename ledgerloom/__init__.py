"""Ledger analytics on Spark: filters, dashboards, FX, matching, detection and curation
of bank-transaction ledgers as DataFrame operators."""
