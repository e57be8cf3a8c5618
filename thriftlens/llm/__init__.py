"""Operators that prepare text for training; nothing outside this package imports it."""
