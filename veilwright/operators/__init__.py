"""Detectors, ranges, overlap resolution, grouping and replacement."""
