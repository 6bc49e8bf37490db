"""Structured Streaming for the causal detectors."""
