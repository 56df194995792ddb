"""Operators of a training-data pipeline (packing, deduplication, licence
scans, token files, decontamination, toxicity, search, quality).

Nothing else in the library imports this subpackage; ``queries`` holds its
registered queries and their SQL.
"""
