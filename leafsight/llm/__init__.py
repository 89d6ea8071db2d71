"""Operators for large training corpora: filtering, de-duplication, search, scoring, packing."""
