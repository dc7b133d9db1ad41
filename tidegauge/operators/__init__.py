"""Operators over bars and events."""
