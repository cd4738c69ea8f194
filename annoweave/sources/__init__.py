"""Readers of text formats and writers of exports."""
