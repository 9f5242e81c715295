"""Structured Streaming variants. Each takes a streaming DataFrame with a timestamp column `ts` and
gives one; the batch operators they follow are named in the docstrings."""
