"""Operators for preparing training text: deduplication, scoring, decontamination, packing, token files."""
