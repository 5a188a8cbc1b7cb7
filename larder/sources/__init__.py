"""Readers of raw tables."""
