"""Operators over sequences, intervals and statistics."""
