"""Streaming scans."""
