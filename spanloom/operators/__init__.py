"""Relational operators over traces and reports."""
