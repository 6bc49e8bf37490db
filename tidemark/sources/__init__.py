"""Readers, synthetic series and writers."""
