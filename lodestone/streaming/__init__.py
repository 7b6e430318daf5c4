"""Streams of benchmark output."""
