"""Scans of corpora into files and lines."""
