"""Operators of a training-data pipeline: language ID, secrets, fingerprints, dedup, decontamination, packing, licenses."""
