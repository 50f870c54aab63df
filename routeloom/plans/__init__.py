"""Whole plans: the adapter from event tables, the commands, and the registered queries."""
