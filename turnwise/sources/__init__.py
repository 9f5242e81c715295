"""Readers that turn documents, text and tables into words, turns and segments."""
