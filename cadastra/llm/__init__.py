"""Operators of a training-data pipeline: personal data, tokens, quality, near copies, scores, packing.

Nothing else in the library imports this subpackage.
"""
