"""Whole plans: scanning, anonymizing, and the query catalog."""
