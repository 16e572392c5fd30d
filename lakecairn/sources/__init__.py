"""Scans that make tables of files, and the places that files come from."""
