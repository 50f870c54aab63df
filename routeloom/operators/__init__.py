"""Operators over route evidence: pure functions from frames and a configuration to frames."""
