"""Operators over sample, trace, station and alert tables."""
