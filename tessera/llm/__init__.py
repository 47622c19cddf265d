"""Operators for preparing training data: deduplication, packing, archives,
decontamination, similarity joins, extraction and scoring."""
