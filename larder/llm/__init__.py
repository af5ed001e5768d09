"""Operators for preparing training data; nothing outside this folder depends on it."""
