"""Readers of files and tables."""
