"""Operators for preparing training data: deduplication, decontamination, language, packing, formats."""
