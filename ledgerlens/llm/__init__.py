"""Training-data operators: scoring, scanning, search, extraction, near
duplicates, mixing, token counts, packing and quality ranking.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames and returns DataFrames; ``queries`` wraps each in its digest query.
"""
