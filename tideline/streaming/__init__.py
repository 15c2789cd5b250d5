"""Rates over streams."""
