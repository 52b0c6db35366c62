"""Whole procedures: preparation, detectors, search and the query catalogue."""
