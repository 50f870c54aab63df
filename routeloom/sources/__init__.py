"""Readers of evidence."""
