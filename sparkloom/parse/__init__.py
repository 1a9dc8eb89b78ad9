"""Tolerant readers of source text; one file in, rows out."""
