"""Queries put together from operators, with their SQL."""
