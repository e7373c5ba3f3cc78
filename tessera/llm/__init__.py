"""Operators for preparing large text corpora: packing, deduplication, filters, scans and counts."""
