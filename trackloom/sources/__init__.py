"""Readers of library exports into track rows, and writers of reports."""
