"""Operators for training-data pipelines: packing, sharding, decontamination, duplicates, quality, derivatives."""
