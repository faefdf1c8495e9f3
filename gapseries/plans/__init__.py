"""Composite user-level plans (Q1-Q5)."""
