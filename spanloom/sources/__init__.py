"""Readers of traces and rules, writers of reports."""
