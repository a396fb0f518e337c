"""Operators for preparing training data from text, pages and vectors."""
