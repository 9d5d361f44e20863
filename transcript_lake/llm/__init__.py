"""Operators for preparing training data: scoring, rules, duplicates, packing, sharding.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
