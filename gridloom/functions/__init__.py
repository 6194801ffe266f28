"""Scans and lineage helpers."""
