"""Incoming findings as streams."""
