"""Operators for training-data pipelines over documents and web pages.

Every operator reads the columns it names, takes them by exact name and ignores all others, so extra
columns with any name do no harm. Nothing outside this package imports it.
"""
