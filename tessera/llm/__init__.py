"""Operators of a training-data pipeline: quality, packing, deduplication, language, privacy, extraction, decontamination, chat."""
