"""Structured Streaming: exact groups kept up to date as fragments arrive."""
