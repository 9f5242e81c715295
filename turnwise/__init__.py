"""Conversation and timeline analytics as PySpark DataFrame operators."""
